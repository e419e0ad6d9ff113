"""Spelling variants against brute force over all pairs of words."""

import collections
import re
import zlib

import numpy as np
import pytest

from huntlake.llm import variants


def plain_counts(texts, drop=97):
    counts = collections.Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % drop == 0:
                k = h % len(word)
                word = word[:k] + word[k + 1:]
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def plain_groups(counts):
    near = {w: [v for v in counts if abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), form[w] and counts[form[w]]))
    return out


def made_texts(seed, n_words=1500):
    rng = np.random.default_rng(seed)
    base = ["separate", "necessary", "aaaaaa", "abcabcabc", "Éclair", "façade", "straße", "tokenise", "abcde", "hello", "mississippi"]
    words = list(base)
    for w in base:
        for _ in range(12):
            k, c = int(rng.integers(0, len(w) + 1)), "aesbéÿ×"[rng.integers(0, 7)]
            words.append([w[:k] + c + w[k:], w[:k] + w[k + 1:], w[:k] + c + w[k + 1:], w + "X"][rng.integers(0, 4)])
    weights = rng.zipf(1.3, len(words)).clip(1, 50).astype(float)
    drawn = rng.choice(words, n_words, p=weights / weights.sum())
    texts = [(i, " ".join(drawn[k:k + 50])) for i, k in enumerate(range(0, n_words, 50))]
    return texts + [(90, "hello-Hello'HELLO\nhelloĀhello ÀÿÀÿÀÿ"), (91, None), (92, ""), (None, "abcde abcde hello"), (None, "abcde abcde hello"), (93, "x" * 200 + " " + "x" * 200 + " " + "X" * 200)]


@pytest.mark.parametrize("seed,big,tile", [(0, 2048, 256), (1, 5, 4), (2, 3, 2)])
def test_groups_equal_brute_force(spark, monkeypatch, seed, big, tile):
    monkeypatch.setattr(variants, "BIG", big)
    monkeypatch.setattr(variants, "TILE", tile)
    texts = made_texts(seed)
    docs = spark.createDataFrame([(i, t, "w", 1, 2) for i, t in texts], "doc_id long, text string, word string, n long, block int").repartition(4)
    words = variants.count_words(docs, drop_one_in=97)
    assert {r.word: r.n for r in words.collect()} == plain_counts(texts)
    got = variants.spelling_groups(docs, drop_one_in=97)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = plain_groups(plain_counts(texts))
    assert sorted(map(tuple, got.collect())) == sorted(want) and any(r[1] for r in want)
    near = {r.word: r.n_near for r in variants.near_words(words, big).collect()}
    assert near == {r[0]: r[4] for r in want if r[4]}


def test_no_words(spark):
    docs = spark.createDataFrame([(1, None), (2, "abc 12")], "doc_id long, text string")
    assert variants.spelling_groups(docs, drop_one_in=97).count() == 0 and variants.spelling_groups(docs.limit(0)).count() == 0


def test_windows_of_a_long_text_lose_no_word(monkeypatch, spark):
    monkeypatch.setattr(variants, "WINDOW_BYTES", 64)
    texts = [(i, "".join("wörter gleich " for _ in range(i))) for i in range(30)] + [(40, "z" * 500), (41, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    assert {r.word: r.n for r in variants.count_words(docs, min_count=1).collect()} == {"wörter": 435, "gleich": 435, "z" * 500: 1}


def test_checksums_of_joined_strings():
    rng = np.random.default_rng(3)
    heads = [rng.bytes(int(n)) for n in rng.integers(0, 30, 200)]
    words = [rng.bytes(int(n)) for n in rng.integers(0, variants._SHIFT_LENGTHS + 1, 200)]
    got = variants.joined_crc(np.array([zlib.crc32(h) for h in heads], np.uint32), np.array([zlib.crc32(w) for w in words], np.uint32), np.array(list(map(len, words))))
    assert got.tolist() == [zlib.crc32(h + w) for h, w in zip(heads, words)]


def test_form_chains_end_at_the_last(spark):
    chain = [(f"w{k:03d}", f"w{k + 1:03d}") for k in range(40)] + [("a", "w039")]
    got = {r.word: r.root for r in variants.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {w: "w040" for w, _ in chain}


@pytest.mark.parametrize("a,b", [("abcde", "abcdef"), ("abcde", "xabcde"), ("aaaaa", "aaaaaa"), ("abcde", "abxde"), ("abcde", "abde"), ("abcab", "abcabcab"), ("abcde", "bacde"), ("abcde", "edcba")])
def test_each_near_pair_is_found_under_one_key(spark, a, b):
    words = spark.createDataFrame([(a, 3), (b, 4)], "word string, n long")
    got = {r.word: (r.n_near, r.best) for r in variants.near_words(words).collect()}
    assert got == ({a: (1, b), b: (1, a)} if one_edit(a, b) else {})
