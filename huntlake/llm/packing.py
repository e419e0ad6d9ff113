"""Operator 9: best-fit packing of token pieces into sequences of fixed length.

Documents are tokenised in map tasks and cut into pieces. Everything that decides
the packing is the number of pieces of each length, a table of at most
``capacity`` rows whatever the input. From those availability counts the planner
indexes single, pair and triple sums by their exact complement: a gap is filled by
the combination that closes it exactly, as often as the counts allow; what is left
goes by best fit, longest first. The plan is a short list of patterns with
multiplicities. Each piece finds its place from its rank among the pieces of its
length: ranks come from counts per map task and length, so no task ever holds all
pieces of one length.

Defined results: a null or empty text is the end token alone; a repeated row is
packed as often as it comes; a null id stays null; an empty table packs nothing.
Columns other than the id and the text are not read.
"""

from __future__ import annotations

import base64
import re
import zlib

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from huntlake.session import cut_lineage

CAPACITY = 2048
END_ID = 0
_CACHED_WORDS = 400_000
_NEAR_SPACE = re.compile(r"\s |\x20\s")
_encoders: dict[str, _WordIds] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class _WordIds(dict):
    """Packed ids of the words met so far; a miss is tokenised. Emptied when it grows large."""

    def __init__(self, path: str):
        import public_tokenizers

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= _CACHED_WORDS:
            self.clear()
        ids = self[word] = self.encode(" " + word)
        return ids

    def document(self, text: str) -> bytes:
        """Little-endian 32-bit ids. Between two characters that are not white space a single
        space always begins a token, so words can be tokenised apart; other texts go whole."""
        if _NEAR_SPACE.search(text):
            return self.encode(text)
        first, *rest = text.split(" ")
        if first and first[-1].isspace() or text.startswith(" ") or text.endswith(" "):
            return self.encode(text)
        return self.encode(first) + b"".join(map(self.__getitem__, rest))


def token_ids(text: str | None, vocabulary: str) -> bytes:
    """The document's ids, packed, with the end id after them."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = _WordIds(vocabulary)
    return (_encoders[vocabulary].document(text) if text else b"") + END_ID.to_bytes(4, "little")


def cut_pieces(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones at the end, the rest first."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def tokenised_pieces(docs: DataFrame, vocabulary: str, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, rank): rank counts the pieces of a length within a map task."""

    def pieces(batches):
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows, at, part, starts, lengths, crcs, ranks = [], 0, [], [], [], [], []
            for at, text in enumerate(batch.column(1)):
                ids = token_ids(text.as_py(), vocabulary)
                for k, (start, length) in enumerate(cut_pieces(len(ids) // 4, capacity)):
                    rows.append(at)
                    part.append(k)
                    starts.append(start)
                    lengths.append(length)
                    crcs.append(zlib.crc32(ids[4 * start:4 * (start + length)]))
                    ranks.append(int(seen[length]))
                    seen[length] += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(part, pa.int32()), *[pa.array(x, pa.int64()) for x in (starts, lengths, crcs)],
                 pa.array([task] * len(rows), pa.int64()), pa.array(ranks, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        pieces, "doc_id long, piece int, start long, length long, ids_crc32 long, task long, rank long")


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of a sequence, how many such sequences)] that use up the counts exactly.

    Works on the counts alone: at most a few patterns a length, whatever their size.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] += n
    plan: list[tuple[tuple[int, ...], int]] = []

    def take(pattern: tuple[int, ...]) -> int:
        """Consumes the pattern as often as the counts allow."""
        use = {x: pattern.count(x) for x in pattern}
        n = min(int(left[x]) // k for x, k in use.items())
        if n:
            for x, k in use.items():
                left[x] -= n * k
            plan.append((pattern, n))
        return n

    take((capacity,))
    for a in range(capacity - 1, (capacity - 1) // 2, -1):  # a pair sum that is the whole
        if capacity - a <= a:
            take((a, capacity - a))
    for a in range(capacity - 2, (capacity - 1) // 3, -1):  # a gap closed by the sum of two
        while left[a]:
            gap = capacity - a
            b = np.arange(min(a, gap - 1), (gap - 1) // 2, -1)
            need = (left[b] > 0) & (left[gap - b] > 0)
            if not sum(take((a, int(x), gap - int(x))) for x in b[need]):
                break
            if not left[a] or gap < 2:
                break
    for a in range(capacity - 3, (capacity - 1) // 4, -1):  # a gap closed by the sum of three
        if not left[a]:
            continue
        gap = capacity - a
        for b in range(min(a, gap - 2), (gap - 1) // 3, -1):
            if not left[a]:
                break
            if not left[b]:
                continue
            c = np.arange(min(b, gap - b - 1), (gap - b - 1) // 2, -1)
            for x in c[(left[c] > 0) & (left[gap - b - c] > 0)]:
                take((a, b, int(x), gap - b - int(x)))
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for a in range(capacity, 0, -1):  # best fit of what is left, longest first
        while left[a]:
            gap = min((g for g in bins if g >= a), default=None)
            if gap is None:
                n, pattern = int(left[a]), ()
                gap = capacity
                fits = capacity // a
                if n >= fits:
                    n, pattern = n // fits, (a,) * (fits - 1)
                    gap = capacity - a * (fits - 1)
                    left[a] -= n * (fits - 1)
                else:
                    n, pattern = 1, (a,) * (n - 1)
                    gap = capacity - a * len(pattern)
                    left[a] = 1
            else:
                pattern, n = bins[gap].pop()
                if n > left[a]:
                    bins[gap].append((pattern, n - int(left[a])))
                    n = int(left[a])
                if not bins[gap]:
                    del bins[gap]
            left[a] -= n
            if gap > a:
                bins.setdefault(gap - a, []).append(((*pattern, a), n))
            else:
                plan.append(((*pattern, a), n))
    return plan + [x for closed in bins.values() for x in closed]


def _slots(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length the rows (first rank, first sequence, offset) of its places, by rank."""
    found: dict[int, list] = {}
    ranks: dict[int, int] = {}
    base = 0
    for pattern, n in plan:
        offset = 0
        for length in pattern:
            found.setdefault(length, []).append((ranks.get(length, 0), base, offset))
            ranks[length] = ranks.get(length, 0) + n
            offset += length
        base += n
    return {k: np.array(v, np.int64) for k, v in found.items()}


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every row."""
    pieces = cut_lineage(tokenised_pieces(docs, vocabulary or default_vocabulary(), capacity, id_col, text_col))
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    slots = docs.sparkSession.sparkContext.broadcast(_slots(plan_packing(counts, capacity)))

    def place(batches):
        for batch in batches:
            lengths = batch.column(3).to_numpy()
            ranks = batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            order = np.argsort(lengths, kind="stable")
            cuts = np.flatnonzero(np.r_[True, lengths[order][1:] != lengths[order][:-1]]) if len(order) else []
            for a, b in zip(cuts, np.r_[cuts[1:], len(order)]):
                rows = order[a:b]
                table = slots.value[int(lengths[rows[0]])]
                hit = np.searchsorted(table[:, 0], ranks[rows], side="right") - 1
                sequence[rows] = table[hit, 1] + ranks[rows] - table[hit, 0]
                offset[rows] = table[hit, 2]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                                             ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = pieces.join(firsts, ["length", "task"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("first")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
