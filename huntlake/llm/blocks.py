"""Blocks of texts, and questions about their content that are answered by key.

Texts are packed into compressed blocks of about a megabyte (one longer text is a block
of its own), dealt out by block number and checkpointed once in the shared folder. An
exchange then sends from each block, for each bucket of keys, one packed row of keys
without repeats, lets a bucket answer all blocks, and brings the answers back to the
blocks. A key in a third of all documents is one entry a block, not one a document, and
texts are not shuffled again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huntlake.llm.textkit import pieces, utf8
from huntlake.session import cut_lineage

BLOCK_BYTES, BUCKET_BYTES = 1 << 20, 1 << 23


@dataclass
class Block:
    number: int
    ids: list[int | None]
    offsets: np.ndarray  # of the texts in data, one more than texts
    data: np.ndarray  # all texts as UTF-8, end to end
    replies: dict[int, bytes]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed row value; ``unpack`` needs their types."""
    head = np.array([len(arrays), *map(len, arrays)], np.int64).tobytes()
    return zstandard.compress(head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays), 1)


def unpack(value: bytes, *types) -> list[np.ndarray]:
    raw = zstandard.decompress(value)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes, at, out = np.frombuffer(raw, np.int64, n, 8), 8 * (n + 1), []
    for size, kind in zip(sizes, types, strict=True):
        out.append(np.frombuffer(raw, kind, int(size), at))
        at += int(size) * np.dtype(kind).itemsize
    return out


def make_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Checkpointed (block, ids, data, n_bytes), dealt out by block."""

    def build(batches):
        number = TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch in pieces(whole, "text", block_bytes):
                data, offsets = utf8(batch.column(1))
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64())),
                                                  pa.array([pack(offsets, data)], pa.binary()), pa.array([len(data)], pa.int64())], ["block", "ids", "data", "n_bytes"])
                number += 1

    built = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")) \
        .mapInArrow(build, "block long, ids array<long>, data binary, n_bytes long")
    return _checkpoint_dealt(built, "block")


def _checkpoint_dealt(df: DataFrame, key: str) -> DataFrame:
    """Checkpoint that later joins on ``key`` need not shuffle. Spark keeps the partitioning of a
    checkpoint only if the plan before it is fixed, so adaptive execution rests for this one step."""
    conf, name = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    was = conf.get(name)
    try:
        conf.set(name, "false")
        return cut_lineage(df.repartition(int(conf.get("spark.sql.shuffle.partitions")), key))
    finally:
        conf.set(name, was)


def buckets_for(blocks: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> int:
    """So many buckets that one answers for the keys of about ``bucket_bytes`` of text."""
    return max(16, (blocks.agg(F.sum("n_bytes")).first()[0] or 0) // bucket_bytes)


def read_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        names = batch.schema.names
        for i in range(batch.num_rows):
            offsets, data = unpack(batch.column(2)[i].as_py(), np.int64, np.uint8)
            replies = batch.column(names.index("replies"))[i].as_py() if "replies" in names else None
            yield Block(batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), offsets, data, {r["bucket"]: r["reply"] for r in replies or []})


def exchange(blocks: DataFrame, ask: Callable[[Block], Iterable[tuple[int, bytes]]], answer: Callable[[int, list[bytes]], list[bytes]]) -> DataFrame:
    """(bucket, block, reply): ``ask`` gives a block's (bucket, question) rows, ``answer`` the replies to all questions of a bucket, in their order."""

    def asked(batches):
        for block in read_blocks(batches):
            rows = list(ask(block))
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([block.number] * len(rows), pa.int64()), pa.array([q for _, q in rows], pa.binary())],
                                             ["bucket", "block", "question"])

    def answered(table: pa.Table) -> pa.Table:
        replies = answer(table.column("bucket")[0].as_py(), table.column("question").to_pylist())
        return pa.table([table.column("bucket"), table.column("block"), pa.array(replies, pa.binary())], ["bucket", "block", "reply"])

    return blocks.mapInArrow(asked, "bucket int, block long, question binary").groupBy("bucket").applyInArrow(answered, "bucket int, block long, reply binary")


def with_replies(blocks: DataFrame, replies: DataFrame) -> DataFrame:
    """The blocks with all replies to them; only the replies move."""
    mine = replies.groupBy("block").agg(F.collect_list(F.struct("bucket", "reply")).alias("replies"))  # at most one row a bucket
    return blocks.join(mine, "block", "left")
