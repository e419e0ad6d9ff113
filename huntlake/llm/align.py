"""Operator 11: alignment of the tokens of two vocabularies over the same bytes.

A text is encoded by a byte-level vocabulary (A) and by a piece vocabulary (B), both with one
space before it. In a batch of documents every token has its document and its first byte; a
``merge_asof`` by document gives for each start of A the token of B that covers it, a second one
for each start of B the token of A. Together these are all overlapping pairs (pairs that start
together come up in both and are kept once). Where tokens of both sides end on one byte, a group
ends. Texts are cut at spaces where both sides have a boundary, so a long text goes in parts.

Counts of id pairs over the corpus: a block of documents (``BLOCK_BYTES`` of text) keeps its
links as numbers into the table of its distinct id pairs and is checkpointed in that form; the
pair tables are summed by Spark with partial aggregation, the highest count of each B id is
added, and a block gets the counts of its own pairs back by a join on the pair. No text is
encoded twice and no task holds the pairs of the corpus.

Defined results: a text that is null, empty or whose joined token bytes on either side differ
from a space and the text has no tokens: zeros and an empty ``groups_sha256``. A row is a
document, with or without id, repeated or not. Strings of special tokens are plain text. Empty
tables give no rows. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from huntlake.llm.blocks import pack, unpack
from huntlake.llm.tokens import ByteLevelIds, PieceIds, chunks, opened, parts, spread
from huntlake.session import cut_lineage

BATCH_BYTES, BLOCK_BYTES = 1 << 20, 1 << 23


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Side:
    """A vocabulary with the bytes and the decimal form of its ids."""

    def __init__(self, kind: type, path: str):
        self.vocabulary = opened(kind, path)
        table = self.vocabulary.token_bytes()
        self.sizes = np.array(list(map(len, table)), np.int64)
        self.bytes = np.frombuffer(b"".join(table), np.uint8)

    def encode(self, text: str, words: list[str]) -> np.ndarray:
        """Ids of a space and the text, whose chunks are ``words``."""
        packed = self.vocabulary.ids(text, True, words) if isinstance(self.vocabulary, ByteLevelIds) else self.vocabulary.ids(text, words)
        return np.frombuffer(packed, "<u4").astype(np.int64)

    def writes(self, ids: np.ndarray, raw: bytes) -> bool:
        """Whether the tokens' bytes, joined, are ``raw``."""
        return int(self.sizes[ids].sum()) == len(raw) and spread(self.bytes, self.sizes, ids).tobytes() == raw


@dataclass
class Batch:
    """Token ids of some documents (or parts of one), end to end; ``docs`` are their numbers, ascending."""

    docs: list[int] = field(default_factory=list)
    a: list[np.ndarray] = field(default_factory=list)
    b: list[np.ndarray] = field(default_factory=list)
    size: int = 0


@dataclass
class Aligned:
    """Tokens and links of a batch: token rows of A and B, and for each the byte range and the group. The links
    are those of the starts of A, in order, and then those of the other starts of B, in order."""

    a_ids: np.ndarray
    b_ids: np.ndarray
    a_docs: np.ndarray
    b_docs: np.ndarray
    a_starts: np.ndarray
    b_starts: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    a_groups: np.ndarray
    b_groups: np.ndarray
    group_ends: np.ndarray


def align(batch: Batch, a: Side, b: Side) -> Aligned:
    """Overlapping tokens by two as-of merges keyed by document, and groups by equal ends."""
    ids = np.concatenate(batch.a), np.concatenate(batch.b)
    docs = [np.repeat(np.arange(len(x)), list(map(len, x))) for x in (batch.a, batch.b)]
    sizes = a.sizes[ids[0]], b.sizes[ids[1]]
    ends = np.cumsum(sizes[0]), np.cumsum(sizes[1])
    starts = ends[0] - sizes[0], ends[1] - sizes[1]
    left, right = (pd.DataFrame({"doc": d, "start": s, "token": np.arange(len(s))}) for d, s in zip(docs, starts))
    over_a = pd.merge_asof(left, right, on="start", by="doc")["token_y"].to_numpy(np.int64)  # the B token at each start of A
    over_b = pd.merge_asof(right, left, on="start", by="doc")["token_y"].to_numpy(np.int64)
    fresh = np.flatnonzero(starts[0][over_b] != starts[1])
    link_a, link_b = np.r_[np.arange(len(ids[0])), over_b[fresh]], np.r_[over_a, fresh]
    common = ends[0][ends[1][np.searchsorted(ends[1], ends[0])] == ends[0]]  # both end with the batch
    number = np.array(batch.docs, np.int64)
    return Aligned(*ids, number[docs[0]], number[docs[1]], *starts, link_a, link_b,
                   np.searchsorted(common, ends[0]), np.searchsorted(common, ends[1]), common)


def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Digits of 0 to n - 1 as rows with room for one more character, and the number of digits."""
    digits = [str(i).encode() for i in range(n)]
    width = max(map(len, digits)) + 1
    return np.frombuffer(b"".join(d.ljust(width, b"\0") for d in digits), np.uint8).reshape(n, width), np.array(list(map(len, digits)))


def group_texts(found: Aligned, n_docs: int, decimals: tuple[np.ndarray, np.ndarray]) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` for each document (or part) of the batch, in order."""
    n_a, n_b, n_groups = len(found.a_ids), len(found.b_ids), len(found.group_ends)
    a_until, b_until = (np.cumsum(np.bincount(g, minlength=n_groups)) for g in (found.a_groups, found.b_groups))
    at_a = np.arange(n_a) + np.r_[0, b_until][found.a_groups]
    at_b = np.arange(n_b) + a_until[found.b_groups]
    ids, after = np.empty(n_a + n_b, np.int64), np.full(n_a + n_b, ord(","), np.uint8)
    ids[at_a], ids[at_b] = found.a_ids, found.b_ids
    after[at_a[a_until - 1]] = ord("|")
    after[at_b[b_until - 1]] = ord(";")
    table, digits = decimals
    letters, widths = table[ids], digits[ids]
    letters[np.arange(len(ids)), widths] = after
    flat = letters[np.arange(table.shape[1]) <= widths[:, None]].tobytes()
    doc_of = np.empty(n_a + n_b, np.int64)
    doc_of[at_a], doc_of[at_b] = found.a_docs, found.b_docs
    ends = np.cumsum(np.bincount(doc_of - doc_of[0], weights=widths + 1, minlength=n_docs)).astype(np.int64) if len(ids) else np.zeros(0, np.int64)
    return [flat[s:e - 1] for s, e in zip(np.r_[0, ends[:-1]], ends)]


def _batches(texts: list[str | None], a: Side, b: Side) -> Iterator[Batch]:
    """Encoded batches of the documents that have tokens."""
    batch = Batch()
    for doc, text in enumerate(texts):
        if not text:
            continue
        cut = list(parts(text, BATCH_BYTES))
        if len(cut) > 1 and not all(side.writes(side.encode(p, words), raw) for p in cut for words, raw in [(chunks(p), (" " + p).encode())] for side in (a, b)):
            continue
        for part in cut:
            words, raw = chunks(part), (" " + part).encode()
            own = a.encode(part, words), b.encode(part, words)
            if len(cut) == 1 and not (a.writes(own[0], raw) and b.writes(own[1], raw)):
                break
            batch.docs.append(doc)
            batch.a.append(own[0])
            batch.b.append(own[1])
            batch.size += len(raw)
            if batch.size >= BATCH_BYTES:
                yield batch
                batch = Batch()
    if batch.docs:
        yield batch


class _Block:
    """What is known of a block's documents before the corpus-wide counts."""

    def __init__(self):
        self.doc_ids: list[int | None] = []
        self.sums: list[np.ndarray] = []  # n_a, n_b, n_groups, n_links of each document
        self.digests: list[str] = []
        self.links: list[np.ndarray] = []  # of each batch: numbers into its pairs
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, doc_ids: list, texts: list[str | None], a: Side, b: Side, decimals) -> None:
        sums, hashes = np.zeros((4, len(texts)), np.int64), {}
        for batch in _batches(texts, a, b):
            local = Batch(list(range(len(batch.docs))), batch.a, batch.b)
            found = align(local, a, b)
            number = np.array(batch.docs)
            group_docs = found.a_docs[np.searchsorted(found.a_starts, found.group_ends, side="left") - 1]
            for row, docs in zip(sums, (found.a_docs, found.b_docs, group_docs, found.a_docs[found.link_a])):
                np.add.at(row, number, np.bincount(docs, minlength=len(number)))
            for doc, text in zip(batch.docs, group_texts(found, len(number), decimals)):
                if doc in hashes:
                    hashes[doc].update(b";" + text)
                else:
                    hashes[doc] = hashlib.sha256(text)
            which, pairs = pd.factorize(found.a_ids[found.link_a] << 32 | found.b_ids[found.link_b])
            first = np.bincount(found.a_docs, minlength=len(number))  # links of the starts of A; those of other starts of B go beside them
            other = np.bincount(found.a_docs[found.link_a[len(found.a_ids):]], minlength=len(number))
            at_first = np.arange(len(found.a_ids)) + (np.cumsum(other) - other)[found.a_docs]
            at_other = np.arange(len(which) - len(found.a_ids)) + np.repeat(np.cumsum(first), other)
            by_doc = np.empty(len(which), np.uint32)
            by_doc[at_first], by_doc[at_other] = which[:len(found.a_ids)], which[len(found.a_ids):]
            self.links.append(by_doc)
            self.pairs.append((pairs, np.bincount(which, minlength=len(pairs))))
        self.doc_ids += doc_ids
        self.sums.append(sums)
        self.digests += [hashes[k].hexdigest() if k in hashes else "" for k in range(len(texts))]
        self.size += sum(map(len, filter(None, texts)))

    def row(self, number: int) -> pa.RecordBatch:
        """One row; the pairs of all batches become one table and the links point into it."""
        pairs, where = np.unique(np.concatenate([np.zeros(0, np.int64), *[p for p, _ in self.pairs]]), return_inverse=True)
        counts = np.zeros(len(pairs), np.int64)
        at, links = 0, [np.zeros(0, np.uint32)]
        for (own, n), which in zip(self.pairs, self.links):
            slots = where[at:at + len(own)]
            counts[slots] += n
            links.append(slots[which].astype(np.uint32))
            at += len(own)
        sums = np.concatenate(self.sums, axis=1)
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), pa.array([self.doc_ids], pa.list_(pa.int64())), pa.array([self.digests], pa.list_(pa.string())), pa.array([pack(*sums)], pa.binary()),
             pa.array([pack(np.concatenate(links))], pa.binary()), pa.array([pack(pairs, counts)], pa.binary())], ["block", "doc_ids", "digests", "sums", "links", "pairs"])


def aligned_blocks(docs: DataFrame, vocabularies: tuple[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Checkpointed blocks of aligned documents."""

    def build(batches):
        number, block = TaskContext.get().partitionId() << 32, _Block()
        a, b = Side(ByteLevelIds, vocabularies[0]), Side(PieceIds, vocabularies[1])
        decimals = _decimals(max(len(a.sizes), len(b.sizes)))
        for batch in batches:
            sizes = np.asarray(batch.column(1).fill_null("").to_numpy(zero_copy_only=False), object)
            held, size = 0, 0
            for k, text in enumerate(sizes):
                size += len(text)
                if size >= BLOCK_BYTES or k + 1 == len(sizes):
                    rows = batch.slice(held, k + 1 - held)
                    block.add(rows.column(0).to_pylist(), rows.column(1).to_pylist(), a, b, decimals)
                    held, size = k + 1, 0
                    if block.size >= BLOCK_BYTES:
                        yield block.row(number)
                        number, block = number + 1, _Block()
        if block.doc_ids:
            yield block.row(number)

    return cut_lineage(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        build, "block long, doc_ids array<long>, digests array<string>, sums binary, links binary, pairs binary"))


def _block_pairs(blocks: DataFrame) -> DataFrame:
    """(block, slot, a, b, n): the distinct id pairs of each block."""

    def read(batches):
        for batch in batches:
            for block, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pairs, counts = unpack(packed, np.int64, np.int64)
                for at in range(0, len(pairs), 1 << 17):
                    own = pairs[at:at + (1 << 17)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(own), block, np.int64)), pa.array(np.arange(at, at + len(own), dtype=np.int32)), pa.array((own >> 32).astype(np.int32)),
                         pa.array((own & 0xFFFFFFFF).astype(np.int32)), pa.array(counts[at:at + len(own)])], ["block", "slot", "a", "b", "n"])

    return blocks.select("block", "pairs").mapInArrow(read, "block long, slot int, a int, b int, n long")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(a, b, count, best): links of every id pair in the corpus, and whether none of its B id has more."""
    counts = _block_pairs(blocks).groupBy("a", "b").agg(F.sum("n").alias("count"))
    return counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b")))


def _document_rows(blocks: DataFrame) -> DataFrame:
    """The blocks' documents with the sums over the counts of their links."""
    replies = _block_pairs(blocks).drop("n").join(pair_counts(blocks), ["a", "b"]).groupBy("block").agg(
        F.collect_list(F.struct("slot", "count", "best")).alias("replies"))  # at most the distinct pairs of a block

    def finish(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                n_a, n_b, n_groups, n_links = unpack(batch.column(3)[k].as_py(), *[np.int64] * 4)
                (links,) = unpack(batch.column(4)[k].as_py(), np.uint32)
                counts, best = np.zeros(int(links.max(initial=0)) + 1, np.int64), np.zeros(int(links.max(initial=0)) + 1, np.int64)
                reply = batch.column(5)[k].values
                if reply is not None:
                    slots = reply.field("slot").to_numpy()
                    counts[slots] = reply.field("count").to_numpy()
                    best[slots] = reply.field("best").to_numpy(zero_copy_only=False)
                ends = np.cumsum(n_links)
                totals = [np.diff(np.r_[0, np.r_[0, np.cumsum(values[links])][ends]]) if len(links) else np.zeros(len(ends), np.int64) for values in (best, counts)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1)[k].values, *map(pa.array, (n_a, n_b, n_groups, n_links, *totals)), batch.column(2)[k].values],
                    ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return blocks.drop("pairs").join(replies, "block", "left").mapInArrow(
        finish, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def align_documents(docs: DataFrame, vocabularies: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    return _document_rows(aligned_blocks(docs, vocabularies or default_vocabularies(), id_col, text_col))


def token_map(docs: DataFrame, vocabularies: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(b, a, count): for every B id the A ids it is linked with most, a table to carry embeddings from one vocabulary to the other."""
    return pair_counts(aligned_blocks(docs, vocabularies or default_vocabularies(), id_col, text_col)).where("best").select("b", "a", "count")


def token_links(docs: DataFrame, vocabularies: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a link: (doc_id, start, a, b, a_group, b_group): first shared byte of the text (a space before it), ids, and the groups in the document."""
    paths = vocabularies or default_vocabularies()

    def build(batches):
        a, b = Side(ByteLevelIds, paths[0]), Side(PieceIds, paths[1])
        for rows in batches:
            ids, bases = rows.column(0), {}
            for batch in _batches(rows.column(1).to_pylist(), a, b):
                found = align(Batch(list(range(len(batch.docs))), batch.a, batch.b), a, b)
                local = found.a_docs[found.link_a]
                first_byte = found.a_starts[np.searchsorted(found.a_docs, np.arange(len(batch.docs)))]
                first_group = found.a_groups[np.searchsorted(found.a_docs, np.arange(len(batch.docs)))]
                lengths, groups = np.diff(np.r_[first_byte, found.group_ends[-1]]), np.diff(np.r_[first_group, len(found.group_ends)])
                base = np.zeros((2, len(batch.docs)), np.int64)
                for k, doc in enumerate(batch.docs):  # parts of a long text follow each other
                    base[:, k] = bases.get(doc, (0, 0))
                    bases[doc] = (base[0, k] + lengths[k], base[1, k] + groups[k])
                start = np.maximum(found.a_starts[found.link_a], found.b_starts[found.link_b]) - first_byte[local] + base[0][local]
                shift = base[1][local] - first_group[local]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(np.array(batch.docs)[local])), pa.array(start), pa.array(found.a_ids[found.link_a]), pa.array(found.b_ids[found.link_b]),
                     pa.array(found.a_groups[found.link_a] + shift), pa.array(found.b_groups[found.link_b] + shift)], ["doc_id", "start", "a", "b", "a_group", "b_group"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        build, "doc_id long, start long, a long, b long, a_group long, b_group long")
