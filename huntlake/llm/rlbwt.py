"""Operator 2: exact removal of repeated 50-byte passages with run-compressed BWT indexes.

A byte goes if a ``width``-byte string that covers it also starts in a document with a
smaller id. Every such string is filed under an anchor: the k-mer with the smallest hash
inside it, so equal strings have equal anchors at equal places. Neighbouring strings with
one anchor form a span of at most 2 * width - k bytes.

1. Blocks report their anchors; buckets answer which occur in more than one document.
2. Blocks send the distinct spans of these, with the smallest document id of each. Where
   all documents show one and the same span for an anchor, its smallest document holds all
   its strings. Of the other spans, the repetitive neighbourhoods of edits, a bucket builds
   a run-length compressed Burrows-Wheeler transform (terminators in span order), keeps samples at run ends (run starts with the count of
   the symbol before them, which is all LF-mapping needs) and, at the ends of the runs of
   rows that agree on ``width`` symbols, the smallest document id. Each span is streamed
   backwards through the index: the matching statistic grows by one a step, and from
   ``width`` on the row tells the smallest document that holds the string.
3. Blocks mark the strings that a smaller document holds, and cut the covered bytes.

In the index equality is that of bytes. Anchors with one span, the inside of exact copies and
shared passages, are settled by equal 64-bit hashes of whole spans instead. A passage in
a third of all documents is one span a block. Texts are read from the checkpointed blocks.

Defined results: null or empty text: no bytes, the digest of nothing. A row without id is
neither compared nor cut. Rows that share an id are one document: they do not cut each
other, but each loses what a smaller id holds. Empty tables are fine. Other columns are
not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huntlake.llm.blocks import Block, buckets_for, exchange, make_blocks, pack, read_blocks, unpack, with_replies
from huntlake.llm.textkit import U64, prefix_hashes, run_edges, span_hash
from huntlake.session import cut_lineage

WIDTH, KMER = 50, 20
_PLACE = 28  # bits for a position among the starts taken at once
_STARTS = 1 << 16  # starts taken at once: their hashes stay in a core's cache


def anchor_groups(block: Block, width: int = WIDTH, kmer: int = KMER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, key, row): the runs of string starts with one anchor, its hash, and the text they are in."""
    n = len(block.data) - width + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none.astype(np.uint64), none
    at = np.arange(len(block.data) - kmer + 1)
    running = prefix_hashes(block.data)
    value = span_hash(running, at, at + kmer)
    anchor, step = np.empty(n, np.int64), min(_STARTS, (1 << _PLACE) - (width - kmer))
    for a in range(0, n, step):  # so many starts that a position counted from the first has _PLACE bits
        b = min(a + step, n)
        best = (value[a:b + width - kmer] >> U64(_PLACE) << U64(_PLACE)) | at[:b - a + width - kmer].astype(np.uint64)
        size, want = 1, width - kmer + 1
        while size * 2 <= want:
            best = np.minimum(best[:-size], best[size:])
            size *= 2
        if size < want:
            best = np.minimum(best[:len(best) - (want - size)], best[want - size:])
        anchor[a:b] = a + (best & U64((1 << _PLACE) - 1)).astype(np.int64)
    del best
    row = np.repeat(np.arange(len(block.ids)), np.diff(block.offsets))[:n]
    known = np.array([i is not None for i in block.ids])
    ok = (block.offsets[row + 1] - np.arange(n) >= width) & known[row]
    starts = np.flatnonzero(ok)
    if not len(starts):
        return none, none, none.astype(np.uint64), none
    new = np.r_[True, (anchor[starts[1:]] != anchor[starts[:-1]]) | (np.diff(starts) != 1) | (row[starts[1:]] != row[starts[:-1]])]
    first = starts[new]
    last = np.r_[starts[np.flatnonzero(new)[1:] - 1], starts[-1]]
    return first, last, value[anchor[first]], row[first]


def _by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """Distinct keys, each key's place among them, and the (bucket, from, to) cuts; keys of a bucket stand together."""
    distinct, place = np.unique(keys, return_inverse=True)
    bucket = distinct % U64(buckets)
    order = np.argsort(bucket, kind="stable")
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    cuts = [(int(bucket[order[a]]), a, b) for a, b in zip(*run_edges(bucket[order]))] if len(order) else []
    return distinct[order], back[place], cuts


def ask_anchors(buckets: int):
    def ask(block: Block):
        _, _, keys, rows = anchor_groups(block)
        distinct, place, cuts = _by_bucket(keys, buckets)
        ids = np.array([0 if i is None else i for i in block.ids], np.int64)[rows]
        least, most = np.full(len(distinct), np.iinfo(np.int64).max), np.full(len(distinct), np.iinfo(np.int64).min)
        np.minimum.at(least, place, ids)
        np.maximum.at(most, place, ids)
        several = least < most
        for bucket, a, b in cuts:
            yield bucket, pack((distinct[a:b] // U64(buckets)).astype(np.uint32), np.packbits(several[a:b]))
    return ask


def answer_anchors(bucket: int, questions: list[bytes]) -> list[bytes]:
    """For each asked key, whether it occurs in more than one block or in several documents of one.
    (32 bits of the key: a chance agreement only brings a span to the index in vain.)"""
    asked = [unpack(q, np.uint32, np.uint8) for q in questions]
    sizes = [len(k) for k, _ in asked]
    keys = np.concatenate([k for k, _ in asked])
    several = np.concatenate([np.unpackbits(s, count=len(k)) for k, s in asked]).astype(bool)
    order = np.argsort(keys, kind="stable")
    starts, ends = run_edges(keys[order])
    shared = np.repeat((ends - starts > 1) | (np.add.reduceat(several[order].astype(np.int64), starts) > 0), ends - starts)
    out = np.empty(len(keys), bool)
    out[order] = shared
    return [pack(np.packbits(x)) for x in np.split(out, np.cumsum(sizes)[:-1])]


def _spans(block: Block, buckets: int, shared: dict[int, bytes]):
    """The groups whose anchor is shared, the distinct spans they show, and the cuts of these by bucket."""
    first, last, keys, rows = anchor_groups(block)
    distinct, place, cuts = _by_bucket(keys, buckets)
    flag = np.zeros(len(distinct), bool)
    for bucket, a, b in cuts:
        (bits,) = unpack(shared[bucket], np.uint8)
        flag[a:b] = np.unpackbits(bits, count=b - a).astype(bool)
    use = flag[place]
    first, last, keys, rows = first[use], last[use], keys[use], rows[use]
    # same bytes, same bucket: the span's hash with the bucket of its anchor in the low part
    content = span_hash(prefix_hashes(block.data), first, last + WIDTH)
    spans, span, span_cuts = _by_bucket(content // U64(buckets) * U64(buckets) + keys % U64(buckets), buckets)
    example = np.zeros(len(spans), np.int64)
    example[span] = np.arange(len(span))
    anchors = (keys[example] // U64(buckets)).astype(np.uint32)
    ids = np.array([0 if i is None else i for i in block.ids], np.int64)[rows]
    least = np.full(len(spans), np.iinfo(np.int64).max)
    np.minimum.at(least, span, ids)
    return first, last, ids, span, example, least, anchors, span_cuts


def ask_spans(buckets: int):
    def ask(block: Block):
        first, last, _, _, example, least, anchors, cuts = _spans(block, buckets, _decode(block, 0))
        for bucket, a, b in cuts:
            f, e = first[example[a:b]], last[example[a:b]] + WIDTH
            yield bucket, pack((e - f).astype(np.uint8), anchors[a:b], least[a:b], block.data[_ranges(f, e)])
    return ask


def _decode(block: Block, phase: int) -> dict[int, bytes]:
    """Replies of the two exchanges share a map: phase 0 has bucket numbers, phase 1 their complements."""
    return {b if phase == 0 else ~b: r for b, r in block.replies.items() if (b >= 0) == (phase == 0)}


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sizes = ends - starts
    return np.arange(sizes.sum()) + np.repeat(starts - np.r_[0, np.cumsum(sizes)[:-1]], sizes)


class RunIndex:
    """Run-compressed BWT of distinct strings (at most 112 bytes), terminators ordered as the strings."""

    def __init__(self, data: np.ndarray, lengths: np.ndarray, owner: np.ndarray, width: int = WIDTH):
        m = len(lengths)
        ends = np.cumsum(lengths + 1)  # each string and its terminator, symbol 0
        self.starts, self.lengths = ends - lengths - 1, lengths
        text = np.zeros(int(ends[-1]), np.uint16)
        text[_ranges(self.starts, ends - 1)] = data.astype(np.uint16) + 1
        last = np.repeat(ends - 1, lengths + 1)  # the terminator of each position's string
        rank, size = self._first_rank(text, last)
        string_of = np.repeat(np.arange(m), lengths + 1)
        while size < max(width, int(lengths.max(initial=0))):  # no two strings agree on all their symbols
            if size <= width <= 2 * size:  # rows that agree on ``width`` symbols: two overlapping parts agree
                agree = self._pair(rank, width - size, last)
            rank = self._pair(rank, size, last)
            size *= 2
        order = np.argsort(rank, kind="stable")  # equal to the terminator: in the order of the strings
        bwt = text[order - 1]  # a string's first symbol is preceded by the terminator before it
        head = np.flatnonzero(np.r_[True, bwt[1:] != bwt[:-1]])
        self.run_start, self.run_symbol = head, bwt[head]
        run_length = np.diff(np.r_[head, len(bwt)])
        counts = np.bincount(bwt, minlength=258)
        below = np.r_[0, np.cumsum(counts)[:-1]]
        by_symbol = np.argsort(self.run_symbol, kind="stable")
        seen = np.cumsum(run_length[by_symbol]) - run_length[by_symbol]
        first_of = np.r_[True, np.diff(self.run_symbol[by_symbol].astype(np.int64)) != 0]
        seen -= np.repeat(seen[first_of], np.diff(np.r_[np.flatnonzero(first_of), len(by_symbol)]))
        self.run_target = np.empty(len(head), np.int64)  # LF of the run's first row
        self.run_target[by_symbol] = below[self.run_symbol[by_symbol]] + seen
        whole = (last - np.arange(len(text)) >= width)[order]
        same = agree[order]
        self.group_start = np.flatnonzero(np.r_[True, (same[1:] != same[:-1]) | ~whole[1:] | ~whole[:-1]])
        self.group_least = np.minimum.reduceat(np.where(whole, owner[string_of[order]], np.iinfo(np.int64).max), self.group_start)

    @staticmethod
    def _dense(keys: np.ndarray) -> np.ndarray:
        order = np.argsort(keys)
        new = np.r_[False, keys[order][1:] != keys[order][:-1]]
        rank = np.empty(len(keys), np.uint32)
        rank[order] = np.cumsum(new) + 1
        return rank

    def _first_rank(self, text: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, int]:
        """Ranks by as many symbols as fit in a word, and their number: few kinds of symbols need few bits each."""
        used = np.zeros(257, np.uint64)
        used[text] = 1
        small = (np.cumsum(used) - U64(1)).astype(np.uint64)[text]  # order is kept
        bits = max(1, int(used.sum() - 1).bit_length())
        n = min(64 // bits, 40)
        key, live = np.zeros(len(text), np.uint64), np.arange(len(text))
        for j in range(n):
            key = (key << U64(bits)) | small[np.minimum(live + j, last)]
        return self._dense(key), n

    def _pair(self, rank: np.ndarray, shift: int, last: np.ndarray) -> np.ndarray:
        at = np.arange(len(rank)) + shift
        second = np.where(at <= last, rank[np.minimum(at, len(rank) - 1)], 0)
        return self._dense((rank.astype(np.uint64) << U64(32)) | second.astype(np.uint64))

    def stream(self, width: int = WIDTH) -> np.ndarray:
        """Walks every string backwards. Returns, string by string, the smallest owner of each
        ``width``-symbol string by its start."""
        windows = np.maximum(self.lengths - width + 1, 0)
        offsets = np.r_[0, np.cumsum(windows)]
        out = np.empty(int(offsets[-1]), np.int64)
        lane = np.argsort(-self.lengths, kind="stable")
        row, left = lane.copy(), self.lengths[lane]  # the terminator of string i is row i
        for step in range(1, int(self.lengths.max(initial=0)) + 1):
            live = int(np.searchsorted(-left, -step, side="right"))
            row = row[:live]
            run = np.searchsorted(self.run_start, row, side="right") - 1
            row = self.run_target[run] + row - self.run_start[run]  # LF: the match is one symbol longer
            if step >= width:
                group = np.searchsorted(self.group_start, row, side="right") - 1
                out[offsets[lane[:live]] + left[:live] - step] = self.group_least[group]
        return out


def answer_spans(bucket: int, questions: list[bytes]) -> list[bytes]:
    """For each string of each asked span, whether a document smaller than the span's own holds it."""
    asked = [unpack(q, np.uint8, np.uint32, np.int64, np.uint8) for q in questions]
    lengths = np.concatenate([a[0] for a in asked]).astype(np.int64)
    anchors = np.concatenate([a[1] for a in asked])
    least = np.concatenate([a[2] for a in asked])
    data = np.concatenate([a[3] for a in asked])
    counts = [len(a[0]) for a in asked]
    del asked
    ends = np.cumsum(lengths)
    starts = ends - lengths
    _, example, which = np.unique(span_hash(prefix_hashes(data), starts, ends), return_index=True, return_inverse=True)
    owner = np.full(len(example), np.iinfo(np.int64).max)
    np.minimum.at(owner, which, least)
    windows = lengths[example] - WIDTH + 1
    offsets = np.r_[0, np.cumsum(windows)]
    smallest = np.repeat(owner, windows)
    _, anchor, spans_of = np.unique(anchors[example], return_inverse=True, return_counts=True)
    varied = np.flatnonzero(spans_of[anchor] > 1)
    if len(varied):
        pick = example[varied]
        index = RunIndex(data[_ranges(starts[pick], ends[pick])], lengths[pick], owner[varied])
        smallest[_ranges(offsets[varied], offsets[varied + 1])] = index.stream()
    windows = lengths - WIDTH + 1
    bits = smallest[_ranges(offsets[which], offsets[which] + windows)] < np.repeat(least, windows)
    per_question = np.add.reduceat(windows, np.cumsum([0, *counts])[:-1])
    return [pack(np.packbits(x)) for x in np.split(bits, np.cumsum(per_question)[:-1])]


def remaining(block: Block, buckets: int) -> tuple[np.ndarray, list[tuple[int, int, int, str]]]:
    """(mask of removed bytes, (bytes, removed, runs, digest of the rest) of each text)."""
    first, last, ids, span, example, least, _, cuts = _spans(block, buckets, _decode(block, 0))
    replies = _decode(block, 1)
    edge = np.zeros(len(block.data) + 1, np.int64)
    older = ids > least[span] if len(span) else np.zeros(0, bool)
    np.add.at(edge, first[older], 1)
    np.add.at(edge, last[older] + WIDTH, -1)
    span_windows = (last - first + 1)[example] if len(example) else np.zeros(0, np.int64)
    flags, at = [], np.zeros(len(example) + 1, np.int64)
    for bucket, a, b in cuts:
        (bits,) = unpack(replies[bucket], np.uint8)
        flags.append(np.unpackbits(bits, count=int(span_windows[a:b].sum())).astype(bool))
    at[1:] = np.cumsum(span_windows)
    flags = np.concatenate(flags) if flags else np.zeros(0, bool)
    own = np.flatnonzero(~older)
    hit = _ranges(at[span[own]], at[span[own] + 1])
    starts = _ranges(first[own], last[own] + 1)[flags[hit]]
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WIDTH, -1)
    gone = np.cumsum(edge[:-1]) > 0
    out = []
    for a, b in zip(block.offsets[:-1], block.offsets[1:]):
        cut, part = gone[a:b], block.data[a:b]
        runs = int(cut[0]) + int((cut[1:] & ~cut[:-1]).sum()) if b > a else 0
        out.append((int(b - a), int(cut.sum()), runs, hashlib.sha256(part[~cut].tobytes()).hexdigest()))
    return gone, out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row, and the remaining bytes if asked."""
    blocks = make_blocks(docs, id_col, text_col)
    buckets = buckets_for(blocks)
    shared = cut_lineage(exchange(blocks, ask_anchors(buckets), answer_anchors))
    marked = exchange(with_replies(blocks, shared), ask_spans(buckets), answer_spans)
    both = shared.union(marked.select((-F.col("bucket") - 1).alias("bucket"), "block", "reply"))

    def finish(batches):
        for block in read_blocks(batches):
            gone, rows = remaining(block, buckets)
            columns = [pa.array(block.ids, pa.int64()), *[pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], pa.array([r[3] for r in rows])]
            if with_text:
                columns.append(pa.array([block.data[a:b][~gone[a:b]].tobytes() for a, b in zip(block.offsets[:-1], block.offsets[1:])], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][:len(columns)])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    return with_replies(blocks, both).mapInArrow(finish, schema)
