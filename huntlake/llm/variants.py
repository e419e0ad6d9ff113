"""Operator 12: spelling variants, grouped under their commonest near word.

Words are counted over all whole texts. Two words are near if one inserted, deleted or
replaced code point turns one into the other: with p the length of their common prefix and q
that of their common suffix, p + q >= length of the longer - 1. The test runs densely on
tiles: the code points of two blocks of words stand in padded matrices, once aligned left and
once aligned right, and all pairs of the tile are compared at once.

Which words meet in a tile loses no pair. For a pair whose shorter word has m code points,
p falls in one of three ranges cut at a = m // 3 and b = m - m // 3: p >= b means both share
the first b code points; p < a, the last m - a; else the first a and the last m - b. So each
word is filed under those three keys for m its length and for m one less, and only words of
one key are tiled; a pair counts under the key of its p alone, once. A key with more than
``BIG`` words is cut into blocks and every pair of blocks is a tile of its own, so no task gets
a whole hot key.

Defined results: words are maximal runs of A-Z, a-z and U+00C0 to U+00FF; A-Z are lower-cased.
A null text has no words, a null doc_id is written as nothing before the colon of the hash,
repeated rows count again. Ties between equally common near words go to the smallest in
code-point order. Empty tables give no rows. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huntlake.llm.textkit import LOWER, utf8
from huntlake.session import cut_lineage

BIG, TILE, WINDOW_BYTES = 2048, 256, 1 << 23
_SHIFT_LENGTHS = 96


# words ---------------------------------------------------------------------------------------

def letter_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, rows and code points of the maximal letter runs inside each row."""
    lead = data == 0xC3  # U+00C0 to U+00FF are this byte and one more
    inside = lead | ((data | 0x20) >= 97) & ((data | 0x20) <= 122)
    inside[1:] |= lead[:-1]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    at = edges[edges < len(data)]
    first[at] = inside[at]
    before = edges[edges > 0] - 1
    last[before] = inside[before]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    leads = np.r_[0, np.cumsum(lead)]
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1, ends - starts - (leads[ends] - leads[starts])


def _windows(data: np.ndarray, offsets: np.ndarray, size: int):
    """(data, offsets, first row) of stretches of about ``size`` bytes, cut at row edges or, in a long row, at spaces."""
    row, at, n = 0, 0, len(offsets) - 1
    while row < n and at < len(data):
        end = min(at + size, len(data))
        if end < len(data):
            edge = int(np.searchsorted(offsets, end, side="right")) - 1
            if offsets[edge] > at:
                end = int(offsets[edge])
            else:  # inside one long row
                spaces, to = np.zeros(0, np.int64), end
                while not len(spaces) and to < int(offsets[edge + 1]):
                    spaces = np.flatnonzero(data[to:to + size] == 0x20)
                    end, to = (to + int(spaces[0]), to) if len(spaces) else (int(offsets[edge + 1]), to + size)
                end = min(end, int(offsets[edge + 1]))
        to_row = int(np.searchsorted(offsets, end, side="left"))
        yield data[at:end], np.clip(offsets[row:to_row + 1] - at, 0, end - at), row
        row, at = (to_row if offsets[to_row] == end else to_row - 1), end


@lru_cache(None)
def _shift_tables() -> np.ndarray:
    """[length, byte place, byte]: the checksum state after ``length`` zero bytes, for each byte of the state before."""
    state = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    out = [state]
    table = np.array([_crc_step(b) for b in range(256)], np.uint32)
    for _ in range(_SHIFT_LENGTHS):
        state = (state >> np.uint32(8)) ^ table[state & np.uint32(255)]
        out.append(state)
    return np.array(out)


def _crc_step(byte: int) -> int:
    for _ in range(8):
        byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
    return byte


def joined_crc(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """crc32 of two strings end to end, from their own checksums and the byte length of the second (at most ``_SHIFT_LENGTHS``)."""
    tables, out = _shift_tables(), second.copy()
    for k in range(4):
        out ^= tables[length, k, (first >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def _window_counts(data: np.ndarray, offsets: np.ndarray, heads: list[bytes], min_length: int, drop_one_in: int | None) -> tuple[list[str], list[int]]:
    """Words of a window and how often each occurs, after the deletions."""
    starts, ends, rows, points = letter_runs(data, offsets)
    keep = points >= min_length
    starts, ends, rows, sizes = starts[keep], ends[keep], rows[keep], (ends - starts)[keep]
    if not len(starts):
        return [], []
    at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    buffers = [None, pa.py_buffer(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.py_buffer(LOWER[data[at]])]
    coded = pa.Array.from_buffers(pa.binary(), len(sizes), buffers).dictionary_encode()
    words, which = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    counts = np.bincount(which, minlength=len(words))
    changed: dict[str, int] = {}
    if drop_one_in:
        head = np.array([zlib.crc32(h) for h in heads], np.uint32)[rows]
        own = np.array([zlib.crc32(w) for w in words], np.uint32)[which]
        h = joined_crc(head, own, np.minimum(sizes, _SHIFT_LENGTHS))
        for k in np.flatnonzero(sizes > _SHIFT_LENGTHS):
            h[k] = zlib.crc32(words[which[k]], int(head[k]))
        hits = np.flatnonzero(h % np.uint32(drop_one_in) == 0)
        counts -= np.bincount(which[hits], minlength=len(words))
        for k, value in zip(which[hits].tolist(), h[hits].tolist()):
            word = words[k].decode()
            place = value % len(word)
            word = word[:place] + word[place + 1:]
            changed[word] = changed.get(word, 0) + 1
    found = [(w.decode(), n) for w, n in zip(words, counts.tolist()) if n]
    found += [(w, n) for w, n in changed.items() if len(w) >= min_length]
    return [w for w, _ in found], [n for _, n in found]


def count_words(docs: DataFrame, min_length: int = 5, min_count: int = 3, drop_one_in: int | None = None,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): words of at least ``min_length`` code points that occur ``min_count`` times.

    With ``drop_one_in`` = k, an occurrence whose crc32 of ``<doc_id>:<word>`` is divisible by k loses the code point at
    that checksum modulo its length: misspellings at a known rate, the same in every run.
    """

    def count(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            heads = [b"%s:" % (b"" if i is None else str(i).encode()) for i in batch.column(0).to_pylist()]
            for part, own, row in _windows(data, offsets, WINDOW_BYTES):
                words, counts = _window_counts(part, own, heads[row:row + len(own) - 1], min_length, drop_one_in)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int64())], ["word", "n"])

    found = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# near words ----------------------------------------------------------------------------------

def _filed(words: DataFrame) -> DataFrame:
    """(level and class, key, word, n): every word under its six keys."""
    length = F.length("word")
    rows = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("m")).where("m > 0")
    m, a = F.col("m"), F.floor(F.col("m") / 3).cast("int")
    b, own = m - a, F.length("word")

    def head(n):
        return F.substring("word", F.lit(1), n)

    def tail(n):
        return F.substring("word", own - n + 1, n)

    keys = F.array(*[F.struct(F.lit(k).alias("c"), F.xxhash64(key).alias("g")) for k, key in enumerate((head(b), F.concat(head(a), F.lit("\n"), tail(a)), tail(b)))])
    return rows.select("word", "n", "m", F.explode(keys).alias("k")).select((F.col("m") * 3 + F.col("k.c")).cast("int").alias("lc"), F.col("k.g").alias("g"), "word", "n")


def _tiles(filed: DataFrame, big: int) -> DataFrame:
    """(lc, g, i, j, block, word, n): rows of a key that is too large are dealt to blocks and repeated for each pair of blocks."""
    large = filed.groupBy("lc", "g").agg(F.count("*").alias("size")).where(F.col("size") > big) \
        .select("lc", "g", F.ceil(F.col("size") / big).cast("int").alias("blocks"))
    dealt = filed.join(large, ["lc", "g"], "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("word"), "blocks"), F.lit(0)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks") - 1, F.lit(0))))
    return dealt.select("lc", "g", "word", "n", "block", other.alias("other")).select(
        "lc", "g", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "word", "n")


def _matrices(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the words aligned left and aligned right, padded with zeros, and their lengths."""
    packed = np.array(words)
    left = packed.view(np.uint32).reshape(len(words), -1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    if left.max(initial=0) < 1 << 16:
        left = left.astype(np.uint8 if left.max(initial=0) < 256 else np.uint16)
    at = np.arange(left.shape[1]) - (left.shape[1] - lengths)[:, None]
    return left, np.where(at >= 0, np.take_along_axis(left, np.maximum(at, 0), 1), 0), lengths


def near_in_tile(left: np.ndarray, right: np.ndarray, lengths: np.ndarray, rows: np.ndarray, columns: np.ndarray, m: int, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs (row, column) of the tile whose shorter word has m code points and whose p is in the range of ``kind``."""
    width = m + 1
    a, b = m // 3, m - m // 3
    first = left[rows, None, :width] != left[columns][None, :, :width]
    p = np.where(first.any(2), first.argmax(2), width)
    first = right[rows, None, ::-1][:, :, :width] != right[columns][None, :, ::-1][:, :, :width]
    q = np.where(first.any(2), first.argmax(2), width)
    longer = np.maximum(lengths[rows][:, None], lengths[columns])
    near = (p + q >= longer - 1) & (np.minimum(lengths[rows][:, None], lengths[columns]) == m) & (p < width) & \
        ((p >= b) if kind == 0 else (p < a) if kind == 2 else (p >= a) & (p < b))
    x, y = np.nonzero(near)
    return rows[x], columns[y]


def _near_rows(table: pa.Table) -> pa.RecordBatch:
    """Partial sums for the words of whole runs of equal (lc, g, i, j)."""
    words, n = table.column("word").to_pylist(), table.column("n").to_numpy()
    keys = [table.column(c).to_numpy() for c in ("lc", "g", "i", "j")]
    block = table.column("block").to_numpy()
    left, right, lengths = _matrices(words)
    cuts = np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)])
    ends = np.r_[cuts[1:], len(words)]
    run = np.repeat(np.arange(len(cuts)), ends - cuts)
    alone = keys[2][cuts] != keys[3][cuts]  # two blocks of a large key
    found: list[tuple[np.ndarray, np.ndarray]] = []
    k = 0
    while k < len(cuts):
        lc, i, j = int(keys[0][cuts[k]]), keys[2][cuts[k]], keys[3][cuts[k]]
        last = k
        while not alone[k] and last + 1 < len(cuts) and not alone[last + 1] and int(keys[0][cuts[last + 1]]) == lc and ends[last + 1] - cuts[k] <= TILE:
            last += 1  # several small keys of one level share a tile
        rows = np.arange(cuts[k], ends[last])
        if i != j:
            pairs = [(rows[block[rows] == i], rows[block[rows] == j])]
        else:
            parts = [rows[x:x + TILE] for x in range(0, len(rows), TILE)]
            pairs = [(x, y) for u, x in enumerate(parts) for y in parts[u:]]
        for x, y in pairs:
            for at in range(0, len(x), TILE):
                for to in range(0, len(y), TILE):
                    s, t = near_in_tile(left, right, lengths, x[at:at + TILE], y[to:to + TILE], lc // 3, lc % 3)
                    once = (run[s] == run[t]) & ((s < t) | (i != j))
                    found.append((s[once], t[once]))
        k = last + 1
    source, other = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in zip(*[(np.r_[s, t], np.r_[t, s]) for s, t in found])) if found else (np.zeros(0, np.int64),) * 2
    rank = np.unique(np.array(words), return_inverse=True)[1]
    order = np.lexsort((rank[other], -n[other], rank[source]))
    source, other = source[order], other[order]
    heads = np.flatnonzero(np.r_[True, rank[source][1:] != rank[source][:-1]]) if len(source) else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array([words[k] for k in source[heads]], pa.string()), pa.array(np.diff(np.r_[heads, len(source)]), pa.int64()), pa.array(n[other[heads]], pa.int64()),
         pa.array([words[k] for k in other[heads]], pa.string())], ["word", "n_near", "best_n", "best"])


def _runs(batches):
    """Tables that hold whole runs of equal (lc, g, i, j) of a sorted partition."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(k).to_numpy() for k in range(4)]
        same = np.all([k == k[-1] for k in keys], axis=0)
        cut = batch.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
        if held and any(k[0] != held[-1].column(c)[-1].as_py() for c, k in enumerate(keys)):
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def near_words(words: DataFrame, big: int | None = None) -> DataFrame:
    """(word, n_near, best_n, best) of every word of ``words`` (word, n) that has a near word."""
    tiles = _tiles(_filed(words), big or BIG)
    n = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["lc", "g", "i", "j"]

    def compare(batches):
        for table in _runs(batches):
            yield _near_rows(table)

    partial = tiles.select(*keys, "block", "word", "n").repartition(n, *keys).sortWithinPartitions(*keys) \
        .mapInArrow(compare, "word string, n_near long, best_n long, best string")
    return partial.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), "best")).alias("top")) \
        .select("word", "n_near", (-F.col("top.m")).alias("best_n"), F.col("top.best").alias("best"))


# groups --------------------------------------------------------------------------------------

def roots(forms: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(word, root): the last form reached from every word of ``forms`` (word, form), none null, by doubling the steps."""
    now = cut_lineage(forms.select("word", F.col("form").alias("root")))
    for _ in range(max_rounds):
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = cut_lineage(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = step.select("word", "root")
        if not step.where("moved").limit(1).count():
            return now
    raise RuntimeError(f"forms did not end in {max_rounds} rounds")


def spelling_groups(docs: DataFrame, min_length: int = 5, min_count: int = 3, ratio: int = 2, drop_one_in: int | None = None,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word: its form is its commonest near word if that is ``ratio`` times as common."""
    words = cut_lineage(count_words(docs, min_length, min_count, drop_one_in, id_col, text_col))
    chosen = F.when(F.col("best_n") >= ratio * F.col("n"), F.col("best"))
    rows = cut_lineage(words.join(near_words(words), "word", "left").select(
        "word", chosen.alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(chosen.isNotNull(), F.col("best_n")).alias("form_n")))
    ends = roots(rows.where("form IS NOT NULL"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
