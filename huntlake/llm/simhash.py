"""Operator 7: near duplicates by 64-bit SimHash and a byte-position inverted index.

Fingerprints that differ in at most d bits have at least 8 - d equal bytes at
equal positions. The index posts every distinct fingerprint under groups of three
byte positions chosen so that any pair with the guaranteed number of equal bytes
shares a posting list (for d <= 3 at least five bytes agree, so at least three
agree within one half of the eight). Within a list the shared positional bytes of
each pair are tallied, pairs below the guaranteed minimum go, and the bit distance
of the rest is verified. A list that is too long is posted again under two more
positions. A list that is long even then has five fixed bytes, so its members are
looked up at every flip of up to d bits of the other three: work in proportion to
the list. A list returns a spanning forest of its links, never its pairs.

Equal fingerprints (exact copies, and documents without words, whose fingerprint
is zero) are one node, with a partial aggregate before the shuffle.

Defined results: null or empty text: fingerprint zero. Repeated rows come out as
often as they come in. A null id is a row like any other; its component_id is the
smallest id that is there, null if none is. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huntlake.llm.components import connected_components
from huntlake.llm.textkit import LOWER, forest, run_edges, runs
from huntlake.session import cut_lineage

SEED = 42
LONG_LIST = 2048
BYTES = 8


def fingerprint(text: str | None, width: int = 3) -> int:
    """SimHash of the word shingles (repeats count), as an unsigned integer."""
    words = (text or "").encode().translate(LOWER.tobytes()).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        digests = xxhash.xxh64_digest(joined, SEED)
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.r_[0, ends[:-1] + 1]
        digests = b"".join([xxhash.xxh64_digest(joined[a:b], SEED) for a, b in
                            zip(starts[:len(words) - width + 1].tolist(), ends[width - 1:].tolist())])
    bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(bits), 255):  # sums of up to 255 bits fit a byte
        counts += np.add.reduce(bits[at:at + 255], axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(counts * 2 > len(bits)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def compute(batches):
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")) \
        .mapInArrow(compute, "doc_id long, fp long")


def posting_groups(max_bits: int) -> list[tuple[int, ...]]:
    """Groups of byte positions such that any two fingerprints within ``max_bits`` share one group in full."""
    if not 0 <= max_bits <= 3:
        raise ValueError("the byte-position index is laid out for 0 to 3 differing bits")
    half = BYTES // 2
    return [*itertools.combinations(range(half), 3), *itertools.combinations(range(half, BYTES), 3)]


def _octet(fp, position: int):
    return F.shiftrightunsigned(fp, 8 * position).bitwiseAND(F.lit(255).cast("long"))


def _posting(fp, number: int, positions: tuple[int, ...]):
    key = F.lit(number).cast("long")
    for p in positions:
        key = F.shiftleft(key, 8).bitwiseOR(_octet(fp, p))
    return key


def near_links(fps: DataFrame, max_bits: int = 3, long_list: int = LONG_LIST) -> DataFrame:
    """(a, b) links that connect every two distinct values of ``fp`` that differ in at most ``max_bits`` bits, directly or in steps."""
    groups = posting_groups(max_bits)
    deeper = [(g, pair) for g in groups for pair in itertools.combinations([p for p in range(BYTES) if p not in g], 2)]
    fp = F.col("fp")
    distinct = fps.select("fp").distinct()
    posted = distinct.select("fp", F.explode(F.array(*[_posting(fp, i, g) for i, g in enumerate(groups)])).alias("key"))
    sizes = posted.groupBy("key").agg(F.count("fp").alias("n")).where("n > 1")
    posted = cut_lineage(posted.join(sizes, "key"))
    again = [F.when(F.shiftright("key", 24) == groups.index(g), _posting(fp, len(groups) + i, (*g, *pair)))
             for i, (g, pair) in enumerate(deeper)]
    long = posted.where(F.col("n") > long_list).select("fp", F.explode(F.filter(F.array(*again), lambda k: k.isNotNull())).alias("key"))
    both = posted.where(F.col("n") <= long_list).select("key", "fp").union(long.select("key", "fp"))

    def join(batches):
        for batch in runs(batches, "key"):
            keys = batch.column(0).to_numpy()
            values = batch.column(1).to_numpy().view(np.uint64)
            left, right = [], []
            for a, b in zip(*run_edges(keys)):
                if b - a > 1:
                    number = int(keys[a]) >> 24 if int(keys[a]) >> 24 < len(groups) else None
                    member = list_links(values[a:b], max_bits, None if number is not None else deeper[(int(keys[a]) >> 40) - len(groups)], long_list)
                    away = np.flatnonzero(member != np.arange(b - a))
                    left.append(values[a:b][away])
                    right.append(values[a:b][member[away]])
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (left, right)], ["a", "b"])

    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.repartition(n, "key").sortWithinPartitions("key", "fp").mapInArrow(join, "a long, b long")


def list_links(values: np.ndarray, max_bits: int, fixed: tuple | None, long_list: int = LONG_LIST) -> np.ndarray:
    """Smallest linked member for each fingerprint of one posting list."""
    n = len(values)
    if fixed is not None and n > long_list:
        return _probe(values, max_bits, [p for p in range(BYTES) if p not in (*fixed[0], *fixed[1])])
    left, right = [], []
    octets = values.view(np.uint8).reshape(n, 8)
    for at in range(0, n, 256):
        tally = (octets[at:at + 256, None, :] == octets[None, :, :]).sum(2, dtype=np.uint8)
        i, j = np.nonzero(tally >= BYTES - max_bits)
        near = (i + at < j) & (np.bitwise_count(values[i + at] ^ values[j]) <= max_bits)
        left.append(i[near] + at)
        right.append(j[near])
    return forest(n, np.concatenate(left), np.concatenate(right))


def _probe(values: np.ndarray, max_bits: int, free: list[int]) -> np.ndarray:
    """Links in a long list whose other bytes are fixed: every flip of up to ``max_bits`` bits of the free bytes is looked up."""
    bits = [8 * p + k for p in free for k in range(8)]
    order = np.argsort(values)
    ranked, label = values[order], np.arange(len(values))
    for weight in range(1, max_bits + 1):
        for flip in itertools.combinations(bits, weight):
            other = ranked ^ np.uint64(sum(1 << k for k in flip))
            at = np.minimum(np.searchsorted(ranked, other), len(ranked) - 1)
            hit = np.flatnonzero(ranked[at] == other)
            hit = hit[label[hit] != label[at[hit]]]
            if len(hit):
                i, j = label[hit], label[at[hit]]
                label = forest(len(values), i, j)[label]
    out = np.empty(len(values), np.int64)
    first = np.full(len(values), len(values))
    np.minimum.at(first, label, order)
    out[order] = first[label]
    return out


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_bits: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs``."""
    fps = cut_lineage(fingerprints(docs, id_col, text_col, width))
    parts = connected_components(near_links(fps, max_bits)).select(F.col("node").alias("fp"), "component")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")).join(parts, "fp", "left") \
        .withColumn("component", F.coalesce("component", "fp"))
    nodes = cut_lineage(nodes)
    firsts = nodes.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = nodes.join(firsts, "component").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first_of_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_bits: int = 3) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its group; a row without id stays, and so do all rows that share the smallest id."""
    groups = simhash_groups(docs, id_col, text_col, width, max_bits)
    gone = groups.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col(id_col).cast("long") == F.col("__gone"), "left_anti")
