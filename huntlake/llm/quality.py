"""Operator 6: quality classifier from weak labels.

Four questions are asked of a document: is it symbol noise, shouting, repetition, or
toxic. For each, several overlapping heuristic labellers vote bad, good or nothing.
(One question for all kinds of junk would break the model's assumption that labellers
err independently: a repetitive text is not noisy.) Expectation-maximisation
over the counts of vote patterns of ALL documents estimates how often each labeller
votes what in the good and in the bad class; the posterior of a document's pattern
is its training label. A sparse linear scorer over hashed features (words, word
beginnings, shape thresholds) is trained on these posteriors and judges every
document; a document is accepted if no probability exceeds one half.

Bounds, all parameters: the scorer is fitted on at most about ``sample_docs``
documents, labelled ones first and others if those are fewer, both taken by a hash of
the id; lexicon labellers are mined from the labelled ones among them. Vote patterns number at most 3 ** labellers, whatever the input.

Defined results: a null or empty text has no features, so it gets the probability of
the intercept alone; repeated rows are judged each; a null id is judged like any
other but is never in the sample; without label rows the mined lexicons abstain; an
empty table gives an empty result. Other columns are not read or, for the filter,
passed on.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huntlake.llm.textkit import LOWER, U64, WHITE, pieces, prefix_hashes, span_hash, utf8, word_bounds

SAMPLE_DOCS = 12_000
BITS = 18
LEAST_ROWS = 4  # bad rows that a feature needs to count as telling
BAD, GOOD, NONE = 2, 1, 0

# FIXED VALUES: common English insults, for one of the labellers of toxic text
INSULTS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "imbecile", "dumbass", "bastard", "bitch", "retard")
SYMBOLS = b"!#$%&*|<>{}[]=~^\\@+_"
#: Shape: name -> (good below, bad above), and the thresholds that become features.
SHAPES = {"symbols": (0.02, 0.08), "endings": (0.1, 0.3), "marked_words": (0.1, 0.3),
          "capitals": (0.2, 0.5), "capital_words": (0.2, 0.5), "capital_pairs": (0.2, 0.5),
          "same_as_last": (0.05, 0.2), "same_as_last_but_one": (0.05, 0.2), "same_pairs": (0.3, 0.6)}
SHAPE_STEPS = (0.02, 0.05, 0.1, 0.2, 0.3, 0.5)
TASKS = {"noise": tuple(SHAPES)[:3], "shouting": tuple(SHAPES)[3:6], "repetition": tuple(SHAPES)[6:],
         "toxic": ("insults", "mined_a", "mined_b", "mined_stems")}
SCORES = tuple(f"p_{task}" for task in TASKS)

_SEPARATOR = WHITE.copy()
_SEPARATOR[[b for b in range(128) if not chr(b).isalnum()]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True


def _bucket(h: np.ndarray, salt: int) -> np.ndarray:
    """Feature number of a hash; stems and words of equal spelling differ by the salt."""
    return ((h + U64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> U64(64 - BITS)).astype(np.int64)


def _insult_features() -> np.ndarray:
    data = np.frombuffer(" ".join(INSULTS).encode(), np.uint8)
    starts, ends, _ = word_bounds(data, np.array([0, len(data)]))
    return np.unique(_bucket(span_hash(prefix_hashes(data), starts, ends), 0))


def text_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature) arrays of the hashed words and stems, and the shape ratios (rows x shapes)."""
    data, offsets = utf8(column)
    n = len(offsets) - 1
    lower = LOWER[data]
    running = prefix_hashes(lower)
    starts, ends, rows = word_bounds(data, offsets, _SEPARATOR)
    all_rows, feats = [rows], [_bucket(span_hash(running, starts, ends), 0)]
    for k in (4, 5, 6):
        long = np.flatnonzero(ends - starts > k)
        all_rows.append(rows[long])
        feats.append(_bucket(span_hash(running, starts[long], starts[long] + k), k))
    shape = np.zeros((n, len(SHAPES)))

    def per_row(mask):
        total = np.r_[0, np.cumsum(mask)]
        return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)

    w_start, w_end, w_row = word_bounds(data, offsets)
    words = np.maximum(np.bincount(w_row, minlength=n), 1).astype(float)

    def word_share(mask):
        return np.bincount(w_row[mask], minlength=n) / words

    def inside(mask):
        total = np.r_[0, np.cumsum(mask)]
        return total[w_end] - total[w_start]

    letters = per_row(_LETTER[data])
    upper = inside(_UPPER[data])
    whole = span_hash(running, w_start, w_end)
    shape[:, 0] = per_row(_SYMBOL[data]) / np.maximum(per_row(~WHITE[data]), 1)
    if len(w_end):
        shape[:, 1] = word_share(_SYMBOL[data[w_end - 1]])
        shape[:, 2] = word_share(inside(_SYMBOL[data]) > 0)
    loud = letters >= 20
    shape[:, 3] = np.where(loud, per_row(_UPPER[data]) / np.maximum(letters, 1), 0)
    shape[:, 4] = np.where(loud, word_share((upper > 0) & (upper == inside(_LETTER[data]))), 0)
    shape[:, 5] = np.where(loud, word_share(upper > 1), 0)
    for k in (1, 2):
        same = np.r_[np.zeros(min(k, len(whole)), bool), (whole[k:] == whole[:-k]) & (w_row[k:] == w_row[:-k])]
        shape[:, 5 + k] = word_share(same)
    if len(whole) > 1:
        pair = np.flatnonzero(w_row[1:] == w_row[:-1])
        _, firsts = np.unique(whole[pair] * U64(3) + whole[pair + 1] + w_row[pair].astype(np.uint64) * U64(0xC2B2AE3D27D4EB4F), return_index=True)
        shape[:, 8] = np.where(words >= 20, 1 - np.bincount(w_row[pair[firsts]], minlength=n) / np.maximum(words - 1, 1), 0)
    return np.concatenate(all_rows), np.concatenate(feats), shape


def shape_features(shape: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    row, col, step = np.nonzero(shape[:, :, None] > np.array(SHAPE_STEPS))
    return row, (1 << BITS) + col * len(SHAPE_STEPS) + step


N_FEATURES = (1 << BITS) + len(SHAPES) * len(SHAPE_STEPS)


@dataclass
class QualityModel:
    lexicons: dict[str, np.ndarray] = field(default_factory=dict)
    accuracies: dict[str, np.ndarray] = field(default_factory=dict)
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    bias: dict[str, float] = field(default_factory=dict)


def _votes(rows: np.ndarray, feats: np.ndarray, shape: np.ndarray, lexicons: dict[str, np.ndarray], has_words: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Votes of all labellers of each task (rows x labellers)."""
    low, high = np.array([SHAPES[s][0] for s in SHAPES]), np.array([SHAPES[s][1] for s in SHAPES])
    if has_words is None:
        has_words = np.bincount(rows, minlength=len(shape)) > 0
    form = np.where(shape > high, BAD, np.where((shape < low) & has_words[:, None], GOOD, NONE))
    toxic = np.zeros((len(shape), len(TASKS["toxic"])), np.int64)
    for k, name in enumerate(TASKS["toxic"]):
        lexicon = lexicons.get(name)
        if lexicon is not None and len(lexicon):
            flag = np.zeros(1 << BITS, bool)
            flag[lexicon] = True
            hits = np.bincount(rows[flag[feats]], minlength=len(shape))
            toxic[:, k] = np.where(hits > 0, BAD, np.where(has_words, GOOD, NONE))
    return {task: toxic if task == "toxic" else form[:, [list(SHAPES).index(x) for x in names]] for task, names in TASKS.items()}


def _pattern(votes: np.ndarray) -> np.ndarray:
    return (votes * 3 ** np.arange(votes.shape[1])).sum(1)


def estimate_accuracies(patterns: np.ndarray, counts: np.ndarray, labellers: int, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """EM over vote patterns: (P(vote | class) as class x labeller x vote, posterior of bad for each pattern)."""
    votes = patterns[:, None] // 3 ** np.arange(labellers) % 3
    bad = np.where((votes == BAD).any(1), 0.9, 0.05)
    table = np.zeros((2, labellers, 3))
    for _ in range(rounds):
        prior = np.clip(np.average(bad, weights=counts), 1e-6, 1 - 1e-6)
        for c, share in enumerate((1 - bad, bad)):
            for j in range(labellers):
                seen = np.bincount(votes[:, j], weights=share * counts, minlength=3) + np.array([0.01, 0.01, 0.01])
                table[c, j] = seen / seen.sum()
        score = [np.log(p) + sum(np.log(table[c, j, votes[:, j]]) for j in range(labellers)) for c, p in enumerate((1 - prior, prior))]
        new = 1 / (1 + np.exp(np.clip(score[0] - score[1], -50, 50)))
        if np.abs(new - bad).max() < 1e-9:
            break
        bad = new
    return table, bad


def telling_features(rows: np.ndarray, feats: np.ndarray, bad: np.ndarray, size: int, least: float = LEAST_ROWS, evidence: float = 6) -> np.ndarray:
    """Features whose rows are bad so much more often than rows at large that chance over all
    features would hardly do it: the binomial tail, bounded by its relative entropy, is under
    10 ** -evidence, and that are bad more often than not. One (row, feature) pair each; ``bad`` is each row's share of being bad."""
    prior = float(np.clip(bad.mean(), 1e-6, 1 - 1e-6))
    n = np.bincount(feats, minlength=size).astype(float)
    hits = np.bincount(feats, weights=bad[rows], minlength=size)
    rate = np.clip(hits / np.maximum(n, 1), 1e-9, 1 - 1e-9)
    tail = n * (rate * np.log10(rate / prior) + (1 - rate) * np.log10((1 - rate) / (1 - prior)))
    return np.flatnonzero((hits >= least) & (rate > max(0.6, (1 + prior) / 2)) & (tail > evidence))


def mine_lexicon(rows: np.ndarray, feats: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Features that tell bad rows and stand almost only in bad rows."""
    found = telling_features(rows, feats, label.astype(float), 1 << BITS)
    good = np.bincount(feats[~label[rows]], minlength=1 << BITS)[found]
    bad = np.bincount(feats[label[rows]], minlength=1 << BITS)[found]
    return found[bad >= 10 * good]


def train_linear(rows: np.ndarray, feats: np.ndarray, n: int, target: np.ndarray, l2: float = 1e-3, rounds: int = 600) -> tuple[np.ndarray, float]:
    """Logistic loss against soft labels over the telling features, by accelerated gradient steps.
    All other weights are zero, so a long document gathers no chance evidence; none is negative."""
    kept = telling_features(rows, feats, target, N_FEATURES)
    place = np.full(N_FEATURES, -1, np.int32)
    place[kept] = np.arange(len(kept))
    use = place[feats] >= 0
    rows, feats = rows[use], place[feats[use]]
    w = look = np.zeros(len(kept))
    b = b_look = float(np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3)))
    t, step = 1.0, 4 / (np.bincount(rows, minlength=n).max(initial=0) + 1)
    for _ in range(rounds):
        margin = np.bincount(rows, weights=look[feats], minlength=n) + b_look
        wrong = 1 / (1 + np.exp(-np.clip(margin, -50, 50))) - target
        gradient = np.bincount(feats, weights=wrong[rows], minlength=len(kept)) / n + l2 * look / n
        new, b_new = np.maximum(look - step * gradient, 0), b_look - step * wrong.mean()
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, b_look = new + (t - 1) / t_new * (new - w), b_new + (t - 1) / t_new * (b_new - b)
        w, b, t = new, b_new, t_new
    out = np.zeros(N_FEATURES)
    out[kept] = w
    return out, b


def _unique_pairs(rows: np.ndarray, feats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(rows * N_FEATURES + feats)
    return both // N_FEATURES, both % N_FEATURES


def fit_quality(docs: DataFrame, labels: DataFrame | None, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> QualityModel:
    """Mines the lexicons, estimates the labellers on all rows of ``docs`` and trains the scorers on the sample."""
    ids, text = F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31))

    def share(wanted, there):
        return F.lit(int(min(1.0, wanted / max(1, there)) * (1 << 31)))

    known, n_known, n_docs = None, 0, docs.count()
    if labels is not None:
        known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        n_known = known.agg(F.count_distinct("doc_id")).first()[0]
        known = known.where(place < share(sample_docs, n_known)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    others = place < share(max(0, sample_docs - n_known), max(1, n_docs - n_known))

    def features(batches):
        for whole in batches:
            for batch in pieces(whole, "text"):
                rows, feats, shape = text_features(batch.column(1))
                rows, feats = _unique_pairs(rows, feats)
                at = np.searchsorted(rows, np.arange(batch.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(feats.astype(np.int32))),
                                                  pa.array(list(shape), pa.list_(pa.float64())), batch.column(2)], ["doc_id", "feats", "shape", "toxic"])

    rows = docs.select(ids, text).where("doc_id IS NOT NULL")
    if known is None:
        chosen = rows.where(others).select("*", F.lit(None).cast("int").alias("toxic"))
    else:
        chosen = rows.join(F.broadcast(known), "doc_id", "left").where(F.col("toxic").isNotNull() | others)  # about sample_docs ids at most
    sample = chosen.mapInArrow(features, "doc_id long, feats array<int>, shape array<double>, toxic int")
    got = sample.orderBy("doc_id").toArrow().combine_chunks()  # at most about sample_docs rows
    n = got.num_rows
    model = QualityModel(lexicons={"insults": _insult_features()})
    if n == 0:
        return model
    lists = got.column("feats").combine_chunks()
    at = np.asarray(lists.offsets, np.int64)
    feats = np.asarray(lists.flatten(), np.int32)
    rows = np.repeat(np.arange(n, dtype=np.int32), np.diff(at))
    has_words = np.diff(at) > 0
    often = np.bincount(feats, minlength=1 << BITS) >= LEAST_ROWS  # no other feature can tell anything below
    often[model.lexicons["insults"]] = True
    use = often[feats]
    rows, feats = rows[use], feats[use]
    del lists, use
    shape = np.array(got.column("shape").to_pylist()).reshape(n, len(SHAPES))
    toxic = got.column("toxic").to_pylist()
    labelled = np.array([t is not None for t in toxic])
    label = np.array([t == 1 for t in toxic])
    del got
    order = np.cumsum(labelled)
    for name, part in (("mined_a", labelled & (order % 2 == 0)), ("mined_b", labelled & (order % 2 == 1)), ("mined_stems", labelled)):
        if (label & part).sum() >= 10 and (part & ~label).sum() >= 10:
            number = np.cumsum(part) - 1
            inside = part[rows]
            model.lexicons[name] = mine_lexicon(number[rows[inside]], feats[inside], label[part])

    lexicons = docs.sparkSession.sparkContext.broadcast(model.lexicons)  # at most 2 ** BITS feature numbers each

    def count_patterns(batches):
        for whole in batches:
            for batch in pieces(whole, "text"):
                votes = _votes(*text_features(batch.column(0)), lexicons.value)
                for task in TASKS:
                    found, many = np.unique(_pattern(votes[task]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([task] * len(found)), pa.array(found.astype(np.int64)), pa.array(many.astype(np.int64))], ["task", "pattern", "n"])

    counted = docs.select(text).mapInArrow(count_patterns, "task string, pattern long, n long") \
        .groupBy("task", "pattern").agg(F.sum("n").alias("n")).collect()  # at most 3 ** labellers rows a task
    votes = _votes(rows, feats, shape, model.lexicons, has_words)
    extra_rows, extra = shape_features(shape)
    rows, feats = np.concatenate([rows, extra_rows.astype(np.int32)]), np.concatenate([feats, extra.astype(np.int32)])
    for task, names in TASKS.items():
        mine = sorted((r["pattern"], r["n"]) for r in counted if r["task"] == task)
        patterns, counts = np.array([p for p, _ in mine]), np.array([c for _, c in mine], float)
        model.accuracies[task], bad = estimate_accuracies(patterns, counts, len(names))
        target = bad[np.minimum(np.searchsorted(patterns, _pattern(votes[task])), len(patterns) - 1)]
        w, b = train_linear(rows, feats, n, target)
        model.weights[task], model.bias[task] = w.astype(np.float32), b
    return model


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, a probability for each task, accepted) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        m = shared.value
        for whole in batches:
            for batch in pieces(whole, "text"):
                p = probabilities(batch.column(1), m)
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, p.values()), pa.array(accepted(p))], ["doc_id", *SCORES, "accepted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")) \
        .mapInArrow(judge, f"doc_id long, {' double, '.join(SCORES)} double, accepted boolean")


def accepted(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.logical_and.reduce([x <= 0.5 for x in p.values()])


def probabilities(column: pa.Array, model: QualityModel) -> dict[str, np.ndarray]:
    rows, feats, shape = text_features(column)
    n = len(shape)
    extra_rows, extra = shape_features(shape)
    rows, feats = np.r_[rows, extra_rows], np.r_[feats, extra]
    out = {}
    if not model.weights:
        return {task: np.zeros(n) for task in TASKS}
    used = np.zeros(N_FEATURES, bool)
    for w in model.weights.values():
        used |= w != 0
    hit = used[feats]
    pair_rows, pair_feats = _unique_pairs(rows[hit], feats[hit])
    for task in TASKS:
        total = np.bincount(pair_rows, weights=model.weights[task][pair_feats], minlength=n) + model.bias[task]
        out[task] = 1 / (1 + np.exp(-np.clip(total, -50, 50)))
    return out


def accepted_only(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the scorer accepts, with all their columns, in one map pass."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def keep(batches):
        for whole in batches:
            for batch in pieces(whole, text_col):
                p = probabilities(batch.column(at), shared.value)
                yield batch.filter(pa.array(accepted(p)))

    return docs.mapInArrow(keep, docs.schema)
