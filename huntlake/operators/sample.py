"""Sampling and resampling.

Splits are deterministic hash splits (stable under re-partitioning and executor
loss). SMOTE synthesises minority rows between a row and one of its nearest
minority neighbours along a seeded random projection: the minority rows are
range-partitioned on (projection, hash), so no pair set is ever built and a
block of identical points still spreads over partitions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from huntlake.functions.cols import c
from huntlake.operators.prefix import row_numbers, running_sums

BUCKETS = 1_000_000
BLOCK_ROWS = 4_096  # rows of one neighbour search of SMOTE
COPY_ROWS = 10_000  # synthetic rows made from one row in one go


def hash_bucket(key: str, seed: int = 42):
    return F.pmod(F.xxhash64(c(key), F.lit(seed)), F.lit(BUCKETS))


def hash_split(df: DataFrame, key: str, train_fraction: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Deterministic split on a hash of the key (near-stratified at scale, X1)."""
    cut = int(train_fraction * BUCKETS)
    h = hash_bucket(key, seed)
    return df.where(h < cut), df.where(h >= cut)


def stratified_split(df: DataFrame, key: str, label: str, train_fraction: float = 0.8,
                     seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """X1 (exact): per label, the first round(fraction * count) rows in hash order go
    to train. Distributed row numbers; class counts are the only fitted values."""
    counts = {r[0]: r[1] for r in df.groupBy(c(label)).count().collect()}
    h = df.withColumn("__h", hash_bucket(key, seed)).withColumn("__one", F.lit(1.0))
    numbered = running_sums(h, [label, "__h", key], ["__one"], descending=False, prefix="__rn")
    # offset of each label = rows of the labels before it in the sort order
    labels = sorted(counts, key=lambda v: (v is None, v))
    offset, off = {}, 0
    for v in labels:
        offset[v] = off
        off += counts[v]
    case_off, case_n = F.lit(0.0), F.lit(0.0)
    for v in labels:
        cond = c(label).isNull() if v is None else (c(label) == F.lit(v))
        case_off = F.when(cond, F.lit(float(offset[v]))).otherwise(case_off)
        case_n = F.when(cond, F.lit(float(round(train_fraction * counts[v])))).otherwise(case_n)
    rn_in_label = F.col("__rn__one") - case_off
    tagged = numbered.withColumn("__train", rn_in_label <= case_n).drop("__h", "__one", "__rn__one")
    return (tagged.where("__train").drop("__train"), tagged.where(~F.col("__train")).drop("__train"))


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """Rows per class."""
    return df.groupBy(c(label).alias("label")).agg(F.count(F.lit(1)).alias("count"))


def class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """X3 (cheap alternative): balanced class weights N / (classes * count)."""
    counts = {r[0]: r[1] for r in df.groupBy(c(label)).count().collect()}
    total, k = sum(counts.values()), max(len(counts), 1)
    expr = F.lit(1.0)
    for v, n in counts.items():
        if v is not None:
            expr = F.when(c(label) == F.lit(v), F.lit(total / (k * n))).otherwise(expr)
    return df.withColumn(out, expr)


def smote(df: DataFrame, key: str, label: str, features: list[str], minority=1, ratio: float = 1.0,
          k: int = 5, seed: int = 42) -> DataFrame:
    """Add synthetic minority rows until minority / majority reaches ``ratio``.

    Each synthetic row is x + u * (nn - x), nn one of the k nearest minority rows
    among the 2k neighbours in projection order, u uniform in [0, 1) from a hash.
    Exactly the missing number of rows comes out, the same ones for any number of
    partitions. With fewer than two minority rows there is nothing to draw between:
    the result is empty. Returns only the synthetic rows (``synthetic`` = true);
    union them with the input to train.
    """
    counts = {r[0]: r[1] for r in df.groupBy(c(label)).count().collect()}
    n_min = counts.get(minority, 0)
    n_maj = sum(v for kk, v in counts.items() if kk != minority)
    need = int(max(0, round(ratio * n_maj) - n_min))
    out_schema = T.StructType([T.StructField(f, T.DoubleType()) for f in features]
                              + [T.StructField(label, df.schema[label].dataType),
                                 T.StructField("synthetic", T.BooleanType())])
    if n_min < 2 or need == 0:
        return df.sparkSession.createDataFrame([], out_schema)
    direction = np.random.default_rng(seed).normal(size=len(features))
    x = [F.coalesce(c(f).cast("double"), F.lit(0.0)) for f in features]
    proj = F.lit(0.0)
    for w, v in zip(direction, x):
        proj = proj + F.lit(float(w)) * v
    mins = df.where(c(label) == F.lit(minority)).select(
        F.array(*x).alias("x"), proj.alias("proj"), F.xxhash64(c(key), F.lit(seed)).alias("h"), c(key).cast("string").alias("tie"))
    placed = row_numbers(mins, ["proj", "h", "tie"], out="rn").drop("proj", "tie")
    # the missing rows are dealt out evenly along the order: need = per_row * n_min + extra
    per_row, extra = divmod(need, n_min)
    upto = lambda rn: F.expr(f"cast({rn} as decimal(19, 0)) * {extra} div {n_min}")
    placed = placed.withColumn("m", F.lit(per_row) + upto("rn") - upto("(rn - 1)"))
    # blocks of the order, each with the k rows on either side of it
    size = max(BLOCK_ROWS, k)
    block, at = F.floor((F.col("rn") - 1) / size), (F.col("rn") - 1) % size
    homes = F.array_compact(F.array(block, F.when((at < k) & (block > 0), block - 1), F.when(at >= size - k, block + 1)))
    blocks = placed.select("*", F.explode(homes).alias("block")).withColumn("own", F.col("block") == block)
    d = len(features)

    def neighbours(pdf):
        pdf = pdf.sort_values("rn")
        points = np.vstack(pdf["x"].to_numpy())
        n = len(points)
        steps = np.array([o for o in range(-k, k + 1) if o])
        place = np.arange(n)[:, None] + steps
        inside = (place >= 0) & (place < n)
        place = np.clip(place, 0, n - 1)
        dist = np.where(inside, np.linalg.norm(points[place] - points[:, None, :], axis=2), np.inf)
        best = np.argsort(dist, axis=1, kind="stable")[:, :k]
        known = np.minimum(inside.sum(1), k)
        chosen = np.take_along_axis(place, best, axis=1)
        own = pdf["own"].to_numpy() & (pdf["m"].to_numpy() > 0)
        return pd.DataFrame({"h": pdf["h"].to_numpy()[own], "m": pdf["m"].to_numpy()[own], "x": pd.Series(list(points[own]), dtype=object),
                             "near": pd.Series([points[chosen[i, :known[i]]].ravel() for i in np.flatnonzero(own)], dtype=object)})

    drawn = blocks.groupBy("block").applyInPandas(neighbours, "h long, m long, x array<double>, near array<double>")
    # a row that makes very many copies is dealt out in runs of COPY_ROWS
    runs = drawn.select("h", "m", "x", "near", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(m - 1) div {COPY_ROWS}"))).alias("run"))
    if per_row >= COPY_ROWS:
        runs = runs.repartition("h", "run")
    copies = runs.select("h", "x", "near", F.explode(F.sequence(
        F.col("run") * COPY_ROWS + 1, F.least((F.col("run") + 1) * COPY_ROWS, F.col("m")))).alias("copy"))
    pick = F.pmod(F.xxhash64("h", "copy", F.lit(seed)), (F.size("near") / d).cast("long"))
    u = F.pmod(F.xxhash64("h", "copy", F.lit(seed + 1)), F.lit(1 << 52)) / float(1 << 52)
    made = copies.select("x", F.slice("near", (pick * d + 1).cast("int"), d).alias("nn"), u.alias("u"))
    return made.select(*[(F.col("x")[i] + F.col("u") * (F.col("nn")[i] - F.col("x")[i])).alias(f) for i, f in enumerate(features)],
                       F.lit(minority).cast(df.schema[label].dataType).alias(label), F.lit(True).alias("synthetic"))
