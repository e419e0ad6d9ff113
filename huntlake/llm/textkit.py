"""Small numpy helpers over Arrow text columns: byte buffers, words, hashes, runs.

Word hashes are 64-bit positional hashes (a table value per byte times a power of
an odd base, summed), computed for all words of a chunk at once from one running
sum. They serve candidate search; operators verify on the bytes themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so every power has an inverse modulo 2**64
_BASE_INV = pow(_BASE, -1, 1 << 64)

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _byte_table() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)


BYTE_VALUE = _byte_table()
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("p")
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        for name, base in (("p", _BASE), ("q", _BASE_INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["p"], _powers["q"]


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser: spreads every bit over the whole word."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column end to end and the n + 1 row offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.string()), "") if column.null_count else column.cast(pa.string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def pieces(batch: pa.RecordBatch, text: str, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in row slices of about ``max_bytes`` of text; one long text is a slice of its own."""
    n = batch.num_rows
    if not n:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), np.int64)
    group = np.cumsum(sizes) // max_bytes
    cuts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    for a, b in zip(cuts, np.r_[cuts[1:], n]):
        yield batch.slice(int(a), int(b - a))


def word_bounds(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the maximal runs without separator bytes inside each row."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~separator[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(data)]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    before = edges[edges > 0] - 1
    last[before] = inside[before]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Running positional hash of a chunk, for ``span_hash``."""
    power, _ = _power_table(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * power[:len(data)], out=out[1:])
    return out


def span_hash(running: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span [start, end): equal bytes give equal hashes, wherever they stand."""
    _, inverse = _power_table(len(running))
    return mix((running[ends] - running[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def shingles(hashes: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, first word) of each run of ``width`` words in a row; a row with fewer words gives its whole sequence."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    whole = np.zeros(n, bool)
    if n >= width:
        part = np.zeros(n - width + 1, np.uint64)
        for j in range(width):
            part = part * U64(0xC2B2AE3D27D4EB4F) + hashes[j:n - width + 1 + j]
        total[:n - width + 1] = mix(part)
        whole[:n - width + 1] = rows[:n - width + 1] == rows[width - 1:]
    firsts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    lengths = np.diff(np.r_[firsts, n])
    for f, k in zip(firsts[lengths < width], lengths[lengths < width]):
        h = np.full(1, k, np.uint64)
        for x in hashes[f:f + k]:
            h = h * U64(0xC2B2AE3D27D4EB4F) + x
        total[f], whole[f] = mix(h)[0], True
    at = np.flatnonzero(whole)
    return total[at], rows[at], at


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Cuts a partition that is sorted by ``key`` into batches that hold whole runs of equal keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(keys, keys[-1], side="left")) if keys[0] != keys[-1] else 0
        if held and keys[0] != held[-1].column(key)[-1].as_py():
            yield _join(held)
            held = []
        if cut:
            yield _join([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield _join(held)


def _join(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if len(parts) > 1 else parts[0]


def run_edges(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return starts, np.r_[starts[1:], len(keys)]


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest member of each node's component, for links among n local nodes."""
    label = np.arange(n)
    while len(left):
        a, b = label[left], label[right]
        low = np.minimum(a, b)
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            break
        label = new
        differ = label[left] != label[right]
        left, right = left[differ], right[differ]
    return label
