"""M1: isolation forest, fitted and scored on Spark.

* Sampling: every row joins tree t when a hash of (row draw, t) falls below
  sample_size / n, so each tree gets about ``sample_size`` rows (no driver sample),
  also when many rows share a key.
* Fitting: ``groupBy(tree_id).applyInPandas`` grows the trees in parallel; a tree
  group is bounded by the sample size. Only the trees (a few hundred nodes each)
  come back to the driver.
* Scoring: an Arrow pandas UDF walks all trees for a batch of rows at once. With
  ``score_distinct`` the distinct feature vectors are scored once and joined back
  (log features have a handful of distinct values).
* Threshold: the contamination quantile of the training scores (exact, weighted
  by multiplicity when scoring distinct vectors).
"""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from huntlake.functions.cols import c
from huntlake.operators.fitted import JsonEstimator, JsonModel
from huntlake.operators.stats import quantiles

EULER = 0.5772156649


def _c(n: np.ndarray | float) -> np.ndarray:
    """Average path length of an unsuccessful search in a BST of n points."""
    n = np.asarray(n, dtype="float64")
    out = np.zeros_like(n)
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER) - 2.0 * (n[big] - 1.0) / n[big]
    out[n == 2] = 1.0
    return out


def _grow(x: np.ndarray, rng: np.random.Generator, max_depth: int) -> dict:
    feat, thr, left, right, size = [], [], [], [], []

    def node(idx: np.ndarray, depth: int) -> int:
        me = len(feat)
        feat.append(-1), thr.append(0.0), left.append(-1), right.append(-1), size.append(len(idx))
        if depth >= max_depth or len(idx) <= 1:
            return me
        sub = x[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if usable.size == 0:
            return me
        q = int(rng.choice(usable))
        t = float(rng.uniform(lo[q], hi[q]))
        go_left = sub[:, q] <= t
        feat[me], thr[me] = q, t
        left[me] = node(idx[go_left], depth + 1)
        right[me] = node(idx[~go_left], depth + 1)
        return me

    node(np.arange(x.shape[0]), 0)
    return {"feat": feat, "thr": thr, "left": left, "right": right, "size": size}


def _path_lengths(trees: list[dict], x: np.ndarray) -> np.ndarray:
    n = x.shape[0]
    total = np.zeros(n)
    rows = np.arange(n)
    for t in trees:
        feat, thr = np.asarray(t["feat"]), np.asarray(t["thr"])
        left, right, size = np.asarray(t["left"]), np.asarray(t["right"]), np.asarray(t["size"])
        node = np.zeros(n, dtype=np.int64)
        depth = np.zeros(n)
        while True:
            f = feat[node]
            internal = f >= 0
            if not internal.any():
                break
            fi = np.where(internal, f, 0)
            nxt = np.where(x[rows, fi] <= thr[node], left[node], right[node])
            node = np.where(internal, nxt, node)
            depth = depth + internal
        total += depth + _c(size[node])
    return total / max(len(trees), 1)


class IsolationForestModel(JsonModel):
    """Adds ``anomaly_score`` (the usual s in (0, 1]), ``score_samples`` (= -s)
    and ``is_anomaly`` (score_samples below the fitted offset)."""

    def score_column(self, cols: list[str], nested: bool = False):
        st = self.get_state()
        trees, psi = st["trees"], st["psi"]
        norm = float(_c(np.array([psi]))[0]) or 1.0

        @F.pandas_udf(T.DoubleType())
        def s(*series: pd.Series) -> pd.Series:
            x = np.column_stack([ser.to_numpy(dtype="float64", na_value=0.0) for ser in series])
            return pd.Series(np.power(2.0, -_path_lengths(trees, x) / norm))

        return s(*[F.coalesce((F.col(n) if nested else c(n)).cast("double"), F.lit(0.0)) for n in cols])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        st, o = self.get_state(), self.get_options()
        cols = self.get_cols()
        if o.get("score_distinct", True):
            vector = F.struct(*[F.coalesce(c(n).cast("double"), F.lit(0.0)).alias(f"f{i}") for i, n in enumerate(cols)])  # never null
            scored = dataset.select(vector.alias("__x")).distinct().select("__x", self.score_column([f"__x.f{i}" for i in range(len(cols))], nested=True).alias("anomaly_score"))
            out = dataset.withColumn("__x", vector).join(scored, on="__x", how="left").drop("__x")
        else:
            out = dataset.withColumn("anomaly_score", self.score_column(cols))
        out = out.withColumn("score_samples", -F.col("anomaly_score"))
        return out.withColumn("is_anomaly", F.coalesce(F.col("score_samples") < F.lit(st["offset"]), F.lit(False)))


class IsolationForest(JsonEstimator):
    model_class = IsolationForestModel

    def default_options(self):
        return {"n_trees": 100, "sample_size": 256, "contamination": 0.1, "seed": 42, "key": None,
                "score_distinct": True}

    def fit_state(self, dataset: DataFrame) -> dict:
        o = self.get_options()
        cols = self.get_cols()
        key = o["key"]
        n = dataset.count()
        psi = int(min(o["sample_size"], n))
        p = min(1.0, psi / max(n, 1))
        max_depth = int(math.ceil(math.log2(max(psi, 2))))
        trees_ids = F.sequence(F.lit(0), F.lit(o["n_trees"] - 1))
        if not key:
            raise ValueError("the forest needs a key column that tells rows apart: its hash draws each tree's rows")
        # 63 bits of a hash of (row, tree) against p: exact at any number of rows, and the
        # same trees however the rows are partitioned
        ident = F.xxhash64(c(key))
        below = F.lit(min((1 << 63) - 1, int(p * (1 << 63)))).cast("long")
        member = F.filter(trees_ids, lambda t: F.shiftrightunsigned(F.xxhash64(F.col("__id"), t, F.lit(o["seed"])), 1) <= below)
        sampled = dataset.withColumn("__id", ident).select(F.explode(member).alias("tree_id"),
                                 *[F.coalesce(c(x).cast("double"), F.lit(0.0)).alias(f"f{i}") for i, x in enumerate(cols)])
        seed = o["seed"]
        nf = len(cols)

        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            tid = int(pdf["tree_id"].iloc[0])
            x = pdf[[f"f{i}" for i in range(nf)]].to_numpy(dtype="float64")
            tree = _grow(x, np.random.default_rng([seed, tid]), max_depth)
            return pd.DataFrame({"tree_id": [tid], "feat": [tree["feat"]], "thr": [tree["thr"]],
                                 "left": [tree["left"]], "right": [tree["right"]], "size": [tree["size"]],
                                 "m": [x.shape[0]]})

        schema = ("tree_id int, feat array<int>, thr array<double>, left array<int>, right array<int>, "
                  "size array<int>, m long")
        rows = sampled.groupBy("tree_id").applyInPandas(build, schema).collect()
        if n and len(rows) < o["n_trees"]:
            raise RuntimeError(f"{o['n_trees'] - len(rows)} trees have no rows: is the key column unique?")
        trees = [{"feat": list(r["feat"]), "thr": list(r["thr"]), "left": list(r["left"]),
                  "right": list(r["right"]), "size": list(r["size"])} for r in sorted(rows, key=lambda r: r["tree_id"])]
        state = {"trees": trees, "psi": psi, "offset": 0.0}
        model = IsolationForestModel()
        model._set(inputCols=cols, options=self.getOrDefault(self.options))
        model._set(state=json.dumps(state))
        # offset: contamination quantile of the training score_samples (weighted by multiplicity)
        if o.get("score_distinct", True):
            g = dataset.groupBy(*[c(x) for x in cols]).agg(F.count(F.lit(1)).alias("__w"))
            g = g.withColumn("__s", -model.score_column(cols))
            off = quantiles(g, ["__s"], [o["contamination"]], weight="__w")["__s"][0]
        else:
            s = dataset.select((-model.score_column(cols)).alias("__s"))
            off = quantiles(s, ["__s"], [o["contamination"]])["__s"][0]
        state["offset"] = float(off or 0.0)
        return state
