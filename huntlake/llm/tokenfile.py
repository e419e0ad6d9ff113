"""Operator 13: token ids in files of independent zstandard frames with a seek table.

Documents are tokenised in map tasks, checkpointed as packed rows, sorted by doc_id over
range partitions and written as shard files in the shared folder. A shard holds

* data frames of about ``FRAME_IDS`` little-endian ids (16 bits where the vocabulary allows,
  else 32), each an independent zstandard frame. A document that fits in a frame never
  crosses into the next one; a longer one begins a frame;
* one directory frame: id, number of tokens and lack of an id of each document of the shard;
* the seek table of the public seekable format, a skippable frame at the very end: compressed
  size, size and XXH64 checksum (low 32 bits) of every frame.

A manifest in the folder names the shards in doc_id order with their first id position. It is
written only after the reports of all shards are checkpointed; files of attempts that did not
report are never named in it. Readers take a shard's end, its directory, and then only the
frames of the documents they want; every frame's checksum is verified.

Defined results: a null or empty text is the end id alone. Rows without doc_id come last; rows
that share a doc_id follow each other by checksum and length of their ids and all are written.
An empty table writes a manifest without shards. Columns other than the id and the text are not
read, and a row of very many ids travels in parts of ``PART_IDS``.
"""

from __future__ import annotations

import bisect
import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from huntlake.llm.tokens import ByteLevelIds, opened
from huntlake.llm.warc import _store
from huntlake.session import cut_lineage, scratch_path

END_ID = 0
FRAME_IDS, PART_IDS, SHARD_IDS, LEVEL = 1 << 16, 1 << 20, 1 << 27, 1
#: Fixed values of the seekable format.
SKIPPABLE, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
REPORT = "task long, shard int, file string, first_id long, last_id long, n_docs long, n_ids long, wide boolean"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ShardWriter:
    """Writes one shard; documents come in parts, in order."""

    def __init__(self, stream, wide: bool):
        self.stream, self.kind, self.width = stream, "<u4" if wide else "<u2", 4 if wide else 2
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        self.table: list[tuple[int, int, int]] = []
        self.ids: list[int | None] = []
        self.counts: list[int] = []
        self.held, self.open, self.n_ids = bytearray(), bytearray(), 0

    def add(self, doc_id: int | None, ids: bytes, begins: bool) -> None:
        """A part of a document: its packed ids in this shard's width."""
        if begins:
            self._close_document()
            self.ids.append(doc_id)
            self.counts.append(0)
        self.counts[-1] += len(ids) // self.width
        self.n_ids += len(ids) // self.width
        self.open += ids
        size = FRAME_IDS * self.width
        if len(self.open) > size:  # a long document has frames of its own
            self._flush_held()
            while len(self.open) > size:
                self._frame(bytes(self.open[:size]))
                del self.open[:size]

    def _close_document(self) -> None:
        if len(self.held) + len(self.open) > FRAME_IDS * self.width:
            self._flush_held()
        self.held += self.open
        self.open.clear()

    def _flush_held(self) -> None:
        if self.held:
            self._frame(bytes(self.held))
            self.held.clear()

    def _frame(self, raw: bytes) -> None:
        packed = self.packer.compress(raw)
        self.stream.write(packed)
        self.table.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def close(self) -> None:
        self._close_document()
        self._flush_held()
        self._frame(np.array([[i or 0 for i in self.ids], self.counts, [i is None for i in self.ids]], "<i8").tobytes())
        entries = b"".join(struct.pack("<III", *e) for e in self.table)
        footer = struct.pack("<IBI", len(self.table), CHECKSUMS, SEEKABLE)
        self.stream.write(struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer)
        self.stream.close()


class ShardReader:
    """Random access to the documents of a shard; only the frames asked for are read."""

    def __init__(self, file, wide: bool):
        self.file, self.kind, self.width = file, "<u4" if wide else "<u2", 4 if wide else 2
        self.unpacker = zstandard.ZstdDecompressor()
        size = file.size()
        n, flags, magic = struct.unpack("<IBI", file.read_at(9, size - 9))
        if magic != SEEKABLE or flags != CHECKSUMS:
            raise ValueError("no seek table at the end of the shard")
        entries = np.frombuffer(file.read_at(12 * n, size - 9 - 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.packed, self.raw, self.sums = entries.T
        self.places = np.cumsum(self.packed) - self.packed
        self.doc_ids, self.counts, missing = np.frombuffer(self.frame(n - 1), "<i8").reshape(3, -1)
        self.missing = missing.astype(bool)  # these documents are the last ones
        self.starts = np.cumsum(self.counts) - self.counts
        self.frame_ends = np.cumsum(self.raw[:-1]) // self.width  # in ids
        self.frames_read = 0

    def frame(self, k: int) -> bytes:
        raw = self.unpacker.decompress(self.file.read_at(int(self.packed[k]), int(self.places[k])), max_output_size=int(self.raw[k]))
        if len(raw) != self.raw[k] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"frame {k} does not fit its checksum")
        return raw

    def stretches(self, rows):
        """(row, ids) of the documents at ``rows`` (ascending), a long one in several stretches."""
        held, at, raw = -1, 0, np.zeros(0, self.kind)
        for row in rows:
            start, end = int(self.starts[row]), int(self.starts[row] + self.counts[row])
            while True:
                k = int(np.searchsorted(self.frame_ends, start, side="right"))
                if k != held:
                    raw, held, at = np.frombuffer(self.frame(k), self.kind), k, int(self.frame_ends[k - 1]) if k else 0
                    self.frames_read += 1
                to = min(end, at + len(raw))
                yield row, raw[start - at:to - at]
                if to >= end:
                    break
                start = to


def _tokenised(docs: DataFrame, vocabulary: str, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, crc, n_tokens, row, part, wide, ids): compressed ids, long documents in parts."""

    def encode(batches):
        task, row = TaskContext.get().partitionId() << 40, 0
        encoder = opened(ByteLevelIds, vocabulary)
        kind = "<u2" if len(encoder.lengths) <= 1 << 16 else "<u4"
        end, packer = END_ID.to_bytes(4, "little"), zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                packed = encoder.ids(text.as_py() or "") + end
                crc, ids = zlib.crc32(packed), np.frombuffer(packed, "<u4").astype(kind)
                for part, at in enumerate(range(0, len(ids), PART_IDS)):
                    out.append((doc_id.as_py(), crc, len(ids), task + row, part, kind == "<u4", packer.compress(ids[at:at + PART_IDS].tobytes())))
                    size += len(out[-1][-1])
                    if size > 1 << 24:
                        yield _rows(out)
                        out, size = [], 0
                row += 1
            if out:
                yield _rows(out)

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]
    names = ["doc_id", "crc", "n_tokens", "row", "part", "wide", "ids"]

    def _rows(out):
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        encode, "doc_id long, crc long, n_tokens long, row long, part int, wide boolean, ids binary")


def write_token_files(docs: DataFrame, folder: str, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Tokenises all documents and writes the shards and the manifest in ``folder``."""
    spark = docs.sparkSession
    tokens = cut_lineage(_tokenised(docs, vocabulary or default_vocabulary(), id_col, text_col))
    order = [F.col("doc_id").asc_nulls_last(), *map(F.col, ("crc", "n_tokens", "row"))]  # one document's parts stay together

    def write(batches):
        store, base = _store(folder)
        task, shard, writer, name, unpacker = TaskContext.get().partitionId(), 0, None, "", zstandard.ZstdDecompressor()

        def report():
            writer.close()
            row = task, shard, name, writer.ids[0], writer.ids[-1], len(writer.ids), writer.n_ids, writer.width == 4
            return pa.RecordBatch.from_pylist([dict(zip(names, row))], schema)

        for batch in batches:
            for doc_id, part, wide, ids in zip(*[batch.column(c) for c in ("doc_id", "part", "wide", "ids")]):
                if writer and part.as_py() == 0 and writer.n_ids >= SHARD_IDS:
                    yield report()
                    writer, shard = None, shard + 1
                if writer is None:
                    store.create_dir(base, recursive=True)
                    name = f"{uuid.uuid4().hex}.ids.zst"
                    writer = ShardWriter(store.open_output_stream(f"{base}/{name}", compression=None), wide.as_py())
                writer.add(doc_id.as_py(), unpacker.decompress(ids.as_py()), part.as_py() == 0)
        if writer:
            yield report()

    names = [x.split()[0] for x in REPORT.split(", ")]
    schema = pa.schema(list(zip(names, [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()])))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = cut_lineage(tokens.repartitionByRange(n, *order).sortWithinPartitions(*order, "part").mapInArrow(write, REPORT))
    manifest, start = [], 0
    for r in sorted(shards.collect(), key=lambda r: (r.task, r.shard)):  # one row a shard
        manifest.append({"file": r.file, "first_id": r.first_id, "last_id": r.last_id, "n_docs": r.n_docs, "start": start, "n_ids": r.n_ids, "wide": r.wide})
        start += r.n_ids
    store, base = _store(folder)
    store.create_dir(base, recursive=True)
    with store.open_output_stream(f"{base}/manifest.json") as out:
        out.write(json.dumps({"shards": manifest}).encode())


def read_manifest(folder: str) -> list[dict]:
    """One entry a shard, in doc_id order."""
    store, base = _store(folder)
    with store.open_input_stream(f"{base}/manifest.json") as f:
        return json.loads(f.read())["shards"]


def _open_shard(store, base: str, entry: dict) -> ShardReader:
    return ShardReader(store.open_input_file(f"{base}/{entry['file']}"), entry["wide"])


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the shards, one task a shard."""
    manifest = read_manifest(folder)

    def read(batches):
        store, base = _store(folder)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                shard = _open_shard(store, base, manifest[k])
                with shard.file:
                    crcs = np.zeros(len(shard.counts), np.int64)
                    for row, ids in shard.stretches(range(len(shard.counts))):
                        crcs[row] = zlib.crc32(ids.astype("<u4").tobytes(), int(crcs[row]))
                    for a in range(0, len(crcs), 100_000):
                        rows = slice(a, a + 100_000)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(shard.doc_ids[rows], mask=shard.missing[rows]), pa.array(shard.starts[rows] + manifest[k]["start"]), pa.array(shard.counts[rows]),
                             pa.array(crcs[rows])], ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, len(manifest))
    return spark.range(0, len(manifest), 1, n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def fetch_documents(wanted: DataFrame, folder: str, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, ids) of the wanted documents; a task reads only the frames they stand in. Ids that are not there give no row."""
    manifest = read_manifest(folder)

    def fetch(batches):
        store, base = _store(folder)
        firsts = [e["first_id"] for e in manifest if e["first_id"] is not None]
        held, shard = -1, None
        for batch in batches:
            out = []
            for doc_id in batch.column(0).to_pylist():
                k = max(bisect.bisect_left(firsts, doc_id) - 1, 0)
                while k < len(firsts) and firsts[k] <= doc_id:
                    if k != held:
                        if shard:
                            shard.file.close()
                        shard, held = _open_shard(store, base, manifest[k]), k
                    known = shard.doc_ids[~shard.missing]
                    for row in range(np.searchsorted(known, doc_id), np.searchsorted(known, doc_id, side="right")):
                        out.append((doc_id, np.concatenate([x for _, x in shard.stretches([row])]).astype(np.int32)))
                    k += 1
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.list_(pa.int32()))], ["doc_id", "ids"])
        if shard:
            shard.file.close()

    keys = wanted.select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    n = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keys.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id").mapInArrow(fetch, "doc_id long, ids array<int>")


def token_file_round_trip(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes all documents to token files and returns what the files say of each."""
    folder = scratch_path(docs.sparkSession, "token-files")
    write_token_files(docs, folder, vocabulary, id_col, text_col)
    return read_token_files(docs.sparkSession, folder)
