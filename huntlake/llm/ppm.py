"""Operator 10: language-model score by prediction by partial matching over bytes.

The model is a byte-context trie of order ``ORDER``: for each context of four bytes down
to none, how often which byte followed it in the training documents. A byte's probability
starts at the longest context; if the byte was not seen there, the escape probability
(method C: distinct followers over followers and distinct ones) is paid and the next
shorter context asked, without the symbols that the longer one knows (exclusion); below
the empty context the bytes never seen share evenly. So the probabilities of all 256 bytes
add up to one in every context. A document is its bytes and a closing zero byte, after
four zero bytes of context; its score is the sum of log10 probabilities.

The trie is never in one place. Blocks of text send their distinct five-byte strings with
training counts to buckets by the two bytes before the last; such a bucket holds all
longer contexts that end in these bytes, adds up the counts of all blocks, derives the
shorter contexts from the longest and replies with the log-probability of each string
asked. Only the counts of byte pairs (at most 65,536) are known everywhere. Word counts
for the base score go the same way. All training documents count, in full.

Defined results: null or empty text: the end token, and the closing byte. A null id has
the empty text as its digest, so it trains. Repeated rows count and are scored each time.
Without training rows every byte costs log10(1/256) and the base score's counts are zero.
Empty tables are fine. Other columns are not read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huntlake.llm.blocks import Block, buckets_for, exchange, make_blocks, pack, read_blocks, unpack, with_replies
from huntlake.llm.rlbwt import _by_bucket
from huntlake.llm.textkit import LOWER, U64, prefix_hashes, run_edges, span_hash, word_bounds
from huntlake.session import cut_lineage

ORDER = 4
FOLDS, HELD_OUT = 5, 1
END_WORD = U64(0)


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % FOLDS == HELD_OUT


def byte_events(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(five-byte strings as numbers, offsets of the texts in them): one for each byte of a text and its closing zero."""
    n = len(block.ids)
    sizes = np.diff(block.offsets)
    padded = np.zeros(int(sizes.sum()) + n * (ORDER + 1), np.uint8)
    starts = block.offsets[:-1] + np.arange(n) * (ORDER + 1) + ORDER
    place = np.arange(len(block.data)) + np.repeat(starts - block.offsets[:-1], sizes)
    padded[place] = block.data
    windows = np.zeros(max(len(padded) - ORDER, 0), np.uint64)
    for j in range(ORDER + 1):
        windows = (windows << U64(8)) | padded[j:len(windows) + j]
    real = np.ones(len(windows), bool)
    for j in range(ORDER):  # strings that end in the zeros before a text
        at = starts[1:] - ORDER + j - ORDER
        real[at[at >= 0]] = False
    return windows[real], np.r_[0, np.cumsum(sizes + 1)]


def block_words(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each word, and of the end token of each text."""
    starts, ends, rows = word_bounds(block.data, block.offsets)
    words = span_hash(prefix_hashes(LOWER[block.data]), starts, ends)
    words = np.where(words == END_WORD, U64(1), words)
    n = len(block.ids)
    return np.r_[words, np.full(n, END_WORD)], np.r_[rows, np.arange(n)]


def _trains(block: Block) -> np.ndarray:
    return np.array([not is_held_out(i) for i in block.ids], bool)


def _gram_bucket(grams: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of the two bytes before the last."""
    return ((grams >> U64(8)) & U64(0xFFFF)) * U64(0x9E3779B1) % U64(1 << 32) % U64(buckets)


def _cuts(distinct: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    order = np.argsort(bucket, kind="stable")
    return order, [(int(bucket[order[a]]), a, b) for a, b in zip(*run_edges(bucket[order]))] if len(order) else []


def ask_counts(buckets: int):
    """Words go to buckets 0.., byte strings to the same number of buckets after them."""

    def ask(block: Block):
        trains = _trains(block)
        words, rows = block_words(block)
        distinct, place, cuts = _by_bucket(words, buckets)
        count = np.bincount(place, weights=trains[rows], minlength=len(distinct)).astype(np.uint32)
        for bucket, a, b in cuts:
            yield bucket, pack(distinct[a:b], count[a:b])
        events, offsets = byte_events(block)
        distinct = np.unique(events)
        seen, many = np.unique(events[np.repeat(trains, np.diff(offsets))], return_counts=True)
        count = np.zeros(len(distinct), np.uint32)
        count[np.searchsorted(distinct, seen)] = many
        order, cuts = _cuts(distinct, _gram_bucket(distinct, buckets))
        for bucket, a, b in cuts:
            yield buckets + bucket, pack(distinct[order[a:b]], count[order[a:b]])
    return ask


def answer_counts(buckets: int, pairs: np.ndarray):
    """``pairs``: 256 x 256 training counts of a byte after a byte."""

    def answer(bucket: int, questions: list[bytes]) -> list[bytes]:
        asked = [unpack(q, np.uint64, np.uint32) for q in questions]
        keys = np.concatenate([a[0] for a in asked])
        distinct, which = np.unique(keys, return_inverse=True)
        count = np.bincount(which, weights=np.concatenate([a[1] for a in asked]), minlength=len(distinct))
        sizes = np.cumsum([len(a[0]) for a in asked])[:-1]
        if bucket < buckets:
            known = int((count > 0).sum())  # told once a bucket
            return [pack(x.astype(np.int64), np.array([known if i == 0 else 0])) for i, x in enumerate(np.split(count[which], sizes))]
        score = log10_probability(distinct, distinct[count > 0], count[count > 0], pairs)
        return [pack(x.astype(np.float32)) for x in np.split(score[which], sizes)]
    return answer


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, which = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(which, weights=values, minlength=len(distinct))


def _look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0.0)


def log10_probability(asked: np.ndarray, grams: np.ndarray, counts: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """log10 probability of the last byte of each asked string after the bytes before it.

    ``grams``: all training strings (sorted) whose context ends in the two bytes before the
    last of any string asked, with their counts.
    """
    byte = U64(8)
    levels = []  # from the longest context: strings, counts
    for order in range(ORDER, 1, -1):
        levels.append(_sums(grams & U64((1 << 8 * (order + 1)) - 1), counts))
    pair_keys = np.flatnonzero(pairs.ravel()).astype(np.uint64)
    levels.append((pair_keys, pairs.ravel()[pair_keys.astype(np.int64)].astype(float)))
    single = pairs.sum(0)
    levels.append((np.flatnonzero(single).astype(np.uint64), single[single > 0].astype(float)))
    out, open_ = np.zeros(len(asked)), np.ones(len(asked), bool)
    hidden = hidden_kinds = np.zeros(len(asked))  # what the longer context excludes, as counts and symbols of this level
    for k, (keys, value) in enumerate(levels):
        order = ORDER - k
        wanted = asked & U64((1 << 8 * (order + 1)) - 1)
        contexts, totals = _sums(keys >> byte, value)
        _, kinds = _sums(keys >> byte, np.ones(len(keys)))
        total = _look(contexts, totals, wanted >> byte) - hidden
        kind = _look(contexts, kinds, wanted >> byte) - hidden_kinds
        mine = _look(keys, value, wanted)
        whole = total + kind
        found = open_ & (mine > 0)
        out[found] += np.log10(mine[found] / whole[found])
        escape = open_ & ~found & (whole > 0)
        out[escape] += np.log10(kind[escape] / whole[escape])
        open_ = open_ & ~found
        if k + 1 < len(levels):  # the followers known here, as the next shorter context counts them
            below_keys, below = levels[k + 1]
            at_next = _look(below_keys, below, keys & U64((1 << 8 * order) - 1))
            _, masked = _sums(keys >> byte, at_next)
            hidden = _look(contexts, masked, wanted >> byte)
            hidden_kinds = _look(contexts, kinds, wanted >> byte)
    out[open_] -= math.log10(max(1, 256 - len(levels[-1][0])))
    return out


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    blocks = make_blocks(docs, id_col, text_col)
    buckets = buckets_for(blocks)

    def count_pairs(batches):
        table, tokens = np.zeros(1 << 16, np.int64), 0
        for block in read_blocks(batches):
            trains = _trains(block)
            events, offsets = byte_events(block)
            table += np.bincount((events[np.repeat(trains, np.diff(offsets))] & U64(0xFFFF)).astype(np.int64), minlength=1 << 16)
            tokens += int(trains[block_words(block)[1]].sum())
        pair = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[pair, -1]), pa.array(np.r_[table[pair], tokens])], ["pair", "n"])

    counted = blocks.mapInArrow(count_pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()  # at most 65,537 rows
    pairs, train_tokens = np.zeros(1 << 16, np.int64), 0
    for r in counted:
        if r["pair"] < 0:
            train_tokens = r["n"]
        else:
            pairs[r["pair"]] = r["n"]
    replies = cut_lineage(exchange(blocks, ask_counts(buckets), answer_counts(buckets, pairs.reshape(256, 256))))

    def kinds(batches):
        for batch in batches:
            own = [int(unpack(r.as_py(), np.int64, np.int64)[1][0]) for b, r in zip(batch.column(0).to_pylist(), batch.column(1)) if b < buckets]
            yield pa.RecordBatch.from_arrays([pa.array([sum(own)], pa.int64())], ["n"])

    words = replies.where(F.col("bucket") < buckets).select("bucket", "reply").mapInArrow(kinds, "n long").agg(F.sum("n")).first()[0] or 0
    price = math.log10(train_tokens + 0.5 * (words + 1))

    def score(batches):
        for block in read_blocks(batches):
            n = len(block.ids)
            token, rows = block_words(block)
            distinct, place, cuts = _by_bucket(token, buckets)
            count = np.zeros(len(distinct))
            for bucket, a, b in cuts:
                count[a:b] = unpack(block.replies[bucket], np.int64, np.int64)[0]
            count = count[place]
            tokens = np.bincount(rows, minlength=n)
            base = np.bincount(rows, weights=np.log10(count + 0.5), minlength=n) - tokens * price
            events, offsets = byte_events(block)
            distinct, which = np.unique(events, return_inverse=True)
            order, cuts = _cuts(distinct, _gram_bucket(distinct, buckets))
            logs = np.zeros(len(distinct))
            for bucket, a, b in cuts:
                logs[order[a:b]] = unpack(block.replies[buckets + bucket], np.float32)[0]
            total = np.add.reduceat(logs[which], offsets[:-1]) if n else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(block.ids, pa.int64()), pa.array([is_held_out(i) for i in block.ids], pa.bool_()), pa.array(tokens.astype(np.int64)),
                 pa.array(np.bincount(rows[count > 0], minlength=n).astype(np.int64)), pa.array(np.full(n, train_tokens, np.int64)), pa.array(base), pa.array(total)],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return with_replies(blocks, replies).mapInArrow(
        score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
