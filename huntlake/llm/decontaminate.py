"""Operator 5: finds short test items inside long documents by MinHash containment.

An item is inside a document if at least ``threshold`` of the item's distinct
five-word shingles are among the document's. Jaccard similarity, which plain MinHash
estimates, vanishes when the document is long, so items are partitioned by size: an
item with n distinct shingles keeps its n - ceil(threshold * n) + 1 smallest hashes.
A document that holds enough shingles cannot miss all of these, so a lookup of every
document shingle in the table of kept hashes finds every pair: no false negatives,
for documents of any length. Each candidate is verified on the shingle texts.

Documents stay where they are; only the item index travels, in blocks of at most
``items_per_block`` items and ``BLOCK_BYTES`` of text (one longer item is a block of its
own), each a broadcast of bounded size and a pass of its own.

Words are runs without white space, A-Z lower-cased. An item with fewer words than a
shingle is one shingle of its own length, and is sought among the windows of that many
words of every document. A text without words has no shingles and matches nothing (null
and empty texts, items and documents alike). Repeated document rows or item rows give repeated
pairs. Null ids are carried as null. Either table may be empty. Other columns of the
documents are passed on by the filter and not read otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huntlake.llm.textkit import LOWER, pieces, prefix_hashes, shingles, span_hash, utf8, word_bounds

WIDTH, THRESHOLD = 5, 0.8
ITEMS_PER_BLOCK, BLOCK_BYTES = 50_000, 1 << 25
_FILTER_BITS = 22


def shingle_texts(text: str | None, width: int = WIDTH) -> set[bytes]:
    words = (text or "").encode().translate(LOWER.tobytes()).split()
    return {b" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def chunk_shingles(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of all shingles of a column of texts."""
    data, offsets = utf8(column)
    starts, ends, rows = word_bounds(data, offsets)
    h, r, _ = shingles(span_hash(prefix_hashes(LOWER[data]), starts, ends), rows, width)
    return h, r


class _Kept:
    """The kept hashes of the items of one shingle width, in sorted order, behind a one-byte-a-bucket filter."""

    def __init__(self, hashes: list[np.ndarray], owner: list[int], width: int):
        every = np.concatenate(hashes)
        order = np.argsort(every, kind="stable")
        self.width, self.hashes, self.owner = width, every[order], np.array(owner, np.int64)[order]
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(self.hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def candidates(self, column: pa.Array) -> set[tuple[int, int]]:
        h, r = chunk_shingles(column, self.width)
        maybe = self.filter[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)]
        h, r = h[maybe], r[maybe]
        first, last = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
        return {(int(row), int(k)) for row, a, b in zip(r, first, last) for k in self.owner[a:b]}


class ItemIndex:
    """The kept hashes of a block of items, by the width of their shingles."""

    def __init__(self, items: list[tuple[int | None, str | None]], width: int = WIDTH, threshold: float = THRESHOLD):
        self.threshold = threshold
        sized = [(i, t, min(width, len((t or "").encode().translate(LOWER.tobytes()).split()))) for i, t in items]
        self.items = [(i, shingle_texts(t, own), own) for i, t, own in sized if own]
        self.kept: list[_Kept] = []
        for own_width in sorted({w for *_, w in self.items}):
            hashes, owner = [], []
            for k, (_, texts, w) in enumerate(self.items):
                if w == own_width:
                    own, _ = chunk_shingles(pa.array([x.decode() for x in texts]), w)
                    own = np.sort(np.unique(own))
                    keep = len(own) - math.ceil(threshold * len(own) - 1e-9) + 1  # by size: one of these is in any document that holds enough
                    hashes.append(own[:keep])
                    owner += [k] * keep
            self.kept.append(_Kept(hashes, owner, own_width))

    def candidates(self, column: pa.Array) -> Iterator[tuple[int, int]]:
        """(row, item position) pairs that share a kept hash."""
        return iter(sorted(set().union(*[kept.candidates(column) for kept in self.kept])))

    def matches(self, column: pa.Array) -> Iterator[tuple[int, int | None, int, int]]:
        """(row, item id, shingles of the item, how many of them are in the document), verified on the texts."""
        last, texts = None, {}
        for row, k in self.candidates(column):
            if row != last:
                last, texts = row, {}
            item_id, own, width = self.items[k]
            if width not in texts:
                texts[width] = shingle_texts(column[row].as_py(), width)
            shared = len(own & texts[width])
            if shared >= self.threshold * len(own) - 1e-9:
                yield row, item_id, len(own), shared


def _blocks(items: DataFrame, id_col: str, text_col: str, size: int) -> Iterator[list]:
    block, held = [], 0
    for r in items.select(F.col(id_col).cast("long"), F.col(text_col)).toLocalIterator():
        if block and (len(block) == size or held + len(r[1] or "") > BLOCK_BYTES):
            yield block
            block, held = [], 0
        block.append((r[0], r[1]))
        held += len(r[1] or "")
    if block:
        yield block


def find_contained(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
                   width: int = WIDTH, threshold: float = THRESHOLD, items_per_block: int = ITEMS_PER_BLOCK) -> DataFrame:
    """(doc_id, item_id, n_item_shingles, n_shared, containment) for every item inside a document."""
    schema = "doc_id long, item_id long, n_item_shingles long, n_shared long, containment double"
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = []
    for block in _blocks(items, item_id_col, item_text_col, items_per_block):
        index = docs.sparkSession.sparkContext.broadcast(ItemIndex(block, width, threshold))

        def search(batches, index=index):
            for whole in batches:
                for batch in pieces(whole, "text"):
                    hits = list(index.value.matches(batch.column(1)))
                    if hits:
                        rows, ids, sizes, shared = map(list, zip(*hits))
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(pa.array(rows, pa.int64())), *[pa.array(x, pa.int64()) for x in (ids, sizes, shared)],
                             pa.array([a / b for a, b in zip(shared, sizes)], pa.float64())], ["doc_id", "item_id", "n_item_shingles", "n_shared", "containment"])

        found.append(slim.mapInArrow(search, schema))
    return reduce(DataFrame.unionAll, found) if found else docs.sparkSession.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
                      width: int = WIDTH, threshold: float = THRESHOLD, items_per_block: int = ITEMS_PER_BLOCK) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    for block in _blocks(items, item_id_col, item_text_col, items_per_block):
        index = docs.sparkSession.sparkContext.broadcast(ItemIndex(block, width, threshold))

        def keep(batches, index=index, at=docs.columns.index(text_col)):
            for whole in batches:
                for batch in pieces(whole, text_col):
                    clean = np.ones(batch.num_rows, bool)
                    clean[[row for row, *_ in index.value.matches(batch.column(at))]] = False
                    yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
