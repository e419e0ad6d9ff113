"""Alignment of two vocabularies against a plain double loop."""

import collections
import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from huntlake.llm import align

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(8)
    words = ["alignment", "of", "the", "tokens", "Überraschung", "naïve", "été", "12345", "x=y+z;", "日本語", "🙂", "don't", "\n", "THE"]
    odd = ["", None, " ", "  two  spaces ", "\t tab", "<|endoftext|> plain", "<s> </s> <0x41>", "▁ has the mark", "mark at the end ▁", "nul \x00 byte", "ﬁ ligature", "trailing ", "aaaaaaaaaaaaaaaa", "same text", "same text"]
    rows = list(enumerate(odd)) + [(100 + i, " ".join(rng.choice(words, 1 + 7 * i))) for i in range(40)]
    return rows + [(None, "no id"), (None, None), (13, "same text"), (300, " ".join(rng.choice(words, 6000))), (301, " ".join(rng.choice(words, 3000)) + " ▁")]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, 1, "x", 2, 3) for i, t in texts], "doc_id long, text string, block int, pairs string, a int, n_a long").repartition(4)


@pytest.fixture(scope="module")
def brute(texts):
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    byte, rest = {chr(b): b for b in shown}, 256
    for b in range(256):
        if b not in shown:
            byte[chr(rest)], rest = b, rest + 1
    library = Tokenizer.from_file(BYTES)
    library.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)

    def spans(pieces):
        at, out = 0, []
        for i, raw in pieces:
            out.append((i, at, at + len(raw)))
            at += len(raw)
        return out, b"".join(raw for _, raw in pieces)

    found = []
    for doc, t in texts:
        a, b, links, groups = [], [], [], []
        if t:
            raw = (" " + t).encode()
            a, joined_a = spans([(i, bytes(byte[c] for c in library.id_to_token(i))) for i in library.encode(" " + t, add_special_tokens=False).ids])
            b, joined_b = spans([(i, bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()) for i, p in ((i, model.id_to_piece(i)) for i in model.encode(t))])
            if joined_a != raw or joined_b != raw:
                a, b = [], []
            lo = 0
            for i, s, e in a:
                while lo < len(b) and b[lo][2] <= s:
                    lo += 1
                k = lo
                while k < len(b) and b[k][1] < e:
                    links.append((i, b[k][0]))
                    k += 1
            last = 0
            for end in sorted({e for *_, e in a} & {e for *_, e in b}):
                groups.append(",".join(str(i) for i, s, e in a if last < e <= end) + "|" + ",".join(str(i) for i, s, e in b if last < e <= end) if len(a) < 3000 else (last, end))
                last = end
            if len(a) >= 3000:
                parts_a, parts_b = collections.defaultdict(list), collections.defaultdict(list)
                ends = np.array([e for _, e in groups])
                for side, parts in ((a, parts_a), (b, parts_b)):
                    for i, s, e in side:
                        parts[int(np.searchsorted(ends, e))].append(str(i))
                groups = [",".join(parts_a[k]) + "|" + ",".join(parts_b[k]) for k in range(len(ends))]
        found.append((doc, len(a), len(b), groups, links))
    return found


def want(brute):
    counts = collections.Counter(x for *_, links in brute for x in links)
    high = collections.Counter()
    for (a, b), n in counts.items():
        high[b] = max(high[b], n)
    rows = [(doc, na, nb, len(groups), len(links), sum(counts[x] == high[x[1]] for x in links), sum(counts[x] for x in links),
             hashlib.sha256(";".join(groups).encode()).hexdigest() if na else "") for doc, na, nb, groups, links in brute]
    return rows, counts, high


@pytest.mark.parametrize("small", [False, True])
def test_alignment_equals_a_plain_loop(docs, brute, monkeypatch, small):
    if small:  # long texts in parts, several batches a block and blocks a task
        monkeypatch.setattr(align, "BATCH_BYTES", 200)
        monkeypatch.setattr(align, "BLOCK_BYTES", 1500)
    got = align.align_documents(docs)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(want(brute)[0])


def test_token_map_and_links(docs, brute, monkeypatch):
    monkeypatch.setattr(align, "BATCH_BYTES", 300)
    _, counts, high = want(brute)
    assert {tuple(r) for r in align.token_map(docs).collect()} == {(b, a, n) for (a, b), n in counts.items() if n == high[b]}
    rows = align.token_links(docs).collect()
    assert collections.Counter((r.a, r.b) for r in rows) == counts
    doc = next(x for x in brute if x[0] == 300)
    own = sorted((r.start, r.a, r.b) for r in rows if r.doc_id == 300)
    assert [(a, b) for _, a, b in own] == doc[4]
    for r in rows:
        assert r.a_group == r.b_group
    assert max(r.a_group for r in rows if r.doc_id == 300) == len(doc[3]) - 1


def test_nothing_to_align(spark, docs):
    assert align.align_documents(docs.limit(0)).count() == 0
    none = align.align_documents(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect()
    assert sorted(map(tuple, none)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
