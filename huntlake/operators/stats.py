"""Shared fit helpers: every fit is ONE aggregation job over all columns together."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huntlake.functions.cols import c, nan_to_null
from huntlake.session import cut_lineage

# percentile_approx accuracy used when exact=False (relative error 1e-4).
APPROX_ACCURACY = 10000


def quantiles(df: DataFrame, cols: list[str], qs: list[float], exact: bool = True, weight: str | None = None) -> dict[str, list]:
    """Quantiles (linear interpolation, like pandas/numpy) of several columns together."""
    if not cols:
        return {}
    if exact:
        return exact_quantiles(df, cols, qs, weight)
    row = df.agg(*[F.percentile_approx(_xcol(n), [float(q) for q in qs], APPROX_ACCURACY).alias(f"q{i}")
                   for i, n in enumerate(cols)]).first()
    return {n: list(row[f"q{i}"]) if row[f"q{i}"] is not None else [None] * len(qs) for i, n in enumerate(cols)}


def moments(df: DataFrame, cols: list[str], ddof: int = 0) -> dict[str, tuple]:
    """(mean, std) per column in one job; ddof 0 = population, 1 = sample."""
    if not cols:
        return {}
    std = F.stddev_pop if ddof == 0 else F.stddev_samp
    aggs = []
    for i, n in enumerate(cols):
        x = nan_to_null(c(n)).cast("double")
        aggs += [F.avg(x).alias(f"m{i}"), std(x).alias(f"s{i}")]
    row = df.agg(*aggs).first()
    return {n: (row[f"m{i}"], row[f"s{i}"]) for i, n in enumerate(cols)}


# Exact quantiles -------------------------------------------------------------------
#
# One path for every size. All columns become one table of (column, value, count),
# summed on the map side first, so ties are one row. It is range-partitioned by
# (column, value) and checkpointed; the counts per partition and column (at most one
# row a partition and one a column) tell which partition holds each wanted rank, and a
# second pass over these partitions reads the values off. No value map of a column sits
# in one task, and at most two values per quantile and column come to the driver.


def _xcol(name: str):
    return nan_to_null(c(name)).cast("double")


def exact_quantiles(df: DataFrame, cols: list[str], qs: list[float], weight: str | None = None) -> dict[str, list]:
    """Exact quantiles with linear interpolation (numpy default, Spark ``percentile``,
    DuckDB ``quantile_cont``) for several columns; ``weight`` names a column of row counts."""
    if not cols:
        return {}
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = F.array(*[F.struct(F.lit(i).alias("i"), _xcol(name).alias("v")) for i, name in enumerate(cols)])
    times = c(weight).cast("long") if weight else F.lit(1).cast("long")
    counts = (df.select(F.explode(cells).alias("s"), times.alias("w")).select("s.i", "s.v", "w")
              .where(F.col("v").isNotNull()).groupBy("i", "v").agg(F.sum("w").alias("n")))
    ranged = cut_lineage(counts.repartitionByRange(n, "i", "v").sortWithinPartitions("i", "v")
                         .withColumn("pid", F.spark_partition_id()))
    parts = sorted((r["i"], r["pid"], r["n"]) for r in ranged.groupBy("i", "pid").agg(F.sum("n").alias("n")).collect())
    totals = [sum(x for j, _, x in parts if j == i) for i in range(len(cols))]
    wanted: dict[int, dict[int, list]] = {}
    for i, total in enumerate(totals):
        ranks = sorted({int(f((total - 1) * q)) for q in qs for f in (np.floor, np.ceil)}) if total else []
        before = 0
        for j, pid, size in parts:
            if j == i:
                for r in ranks:
                    if before <= r < before + size:
                        wanted.setdefault(pid, {}).setdefault(i, []).append((r, r - before))
                before += size

    def read(batches):
        seen: dict = {}
        for pdf in batches:
            out = []
            for (pid, i), g in pdf.groupby(["pid", "i"], sort=False):
                start = seen.get((pid, i), 0)
                ends = start + g["n"].cumsum().to_numpy()
                seen[(pid, i)] = int(ends[-1])
                for rank, local in wanted.get(int(pid), {}).get(int(i), []):
                    if start <= local < ends[-1]:
                        out.append((int(i), rank, float(g["v"].iloc[int(np.searchsorted(ends, local, side="right"))])))
            yield pd.DataFrame(out, columns=["i", "rank", "v"])

    found = {(r["i"], r["rank"]): r["v"] for r in ranged.where(F.col("pid").isin(list(wanted)))
             .mapInPandas(read, "i int, rank long, v double").collect()} if wanted else {}
    out = {}
    for i, name in enumerate(cols):
        vals = []
        for q in qs if totals[i] else []:
            h = (totals[i] - 1) * q
            a, b = int(np.floor(h)), int(np.ceil(h))
            vals.append(found[(i, a)] if a == b else (b - h) * found[(i, a)] + (h - a) * found[(i, b)])
        out[name] = vals or [None] * len(qs)
    return out
