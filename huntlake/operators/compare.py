"""Detector vs SIEM comparison.

Both detectors are scored against the same truth in ONE aggregation; the long
(detector, metric, value) table comes from exploding that one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huntlake.functions.cols import c
from huntlake.operators.stats import quantiles
from huntlake.operators.metrics import METRICS, metric_columns, roc_auc

COUNTS = ["tp", "fp", "tn", "fn"]


def compare_metrics(df: DataFrame, truth: str = "is_apt", siem: str = "siem_detection",
                    ml: str = "apt_prediction", ml_score: str | Column | None = None) -> DataFrame:
    """Counts and V2 metrics for both detectors (+ ROC AUC of the ML score)."""
    y = c(truth).cast("int")
    aggs = []
    for tag, col in (("siem", siem), ("ml", ml)):
        p = c(col).cast("int")
        aggs += [F.count_if((y == 1) & (p == 1)).alias(f"{tag}_tp"), F.count_if((y == 0) & (p == 1)).alias(f"{tag}_fp"),
                 F.count_if((y == 0) & (p == 0)).alias(f"{tag}_tn"), F.count_if((y == 1) & (p == 0)).alias(f"{tag}_fn")]
    wide = df.agg(*aggs)
    structs = []
    for tag in ("siem", "ml"):
        cnt = [F.col(f"{tag}_{k}") for k in COUNTS]
        m = metric_columns(*cnt)
        structs += [F.struct(F.lit(tag).alias("detector"), F.lit(k).alias("metric"), m[k].alias("value"))
                    for k in METRICS]
        structs += [F.struct(F.lit(tag).alias("detector"), F.lit(k).alias("metric"), col.cast("double").alias("value"))
                    for k, col in zip(COUNTS, cnt)]
    out = wide.select(F.explode(F.array(*structs)).alias("s")).select("s.*")
    if ml_score is not None:
        auc = roc_auc(df, truth, ml_score).select(F.lit("ml").alias("detector"), F.lit("roc_auc").alias("metric"),
                                                  F.col("roc_auc").alias("value"))
        out = out.unionByName(auc)
    return out


def metric_difference(long: DataFrame) -> DataFrame:
    """(metric, siem, ml, difference = ml - siem) from the C1 table."""
    wide = long.groupBy("metric").agg(
        F.max(F.when(F.col("detector") == "siem", F.col("value"))).alias("siem"),
        F.max(F.when(F.col("detector") == "ml", F.col("value"))).alias("ml"))
    return wide.withColumn("difference", F.col("ml") - F.col("siem"))


def detection_time_diff(df: DataFrame, truth: str, siem: str, ml: str, siem_time: str | Column,
                        ml_time: str | Column, exact: bool = True) -> DataFrame:
    """C3 + C4: seconds ml - siem over rows where truth, SIEM and ML are all 1:
    mean, median, min, max (NULL when none) and how often each side was faster."""
    st = c(siem_time) if isinstance(siem_time, str) else siem_time
    mt = c(ml_time) if isinstance(ml_time, str) else ml_time
    diff = (F.unix_micros(mt.cast("timestamp")) - F.unix_micros(st.cast("timestamp"))).cast("double") / 1e6
    tp = df.where((c(truth) == 1) & (c(siem) == 1) & (c(ml) == 1)).select(diff.alias("d"))
    median = F.lit(quantiles(tp, ["d"], [0.5], exact=exact)["d"][0])
    return tp.agg(F.count(F.lit(1)).alias("pairs"), F.avg("d").alias("mean"), median.cast("double").alias("median"),
                  F.min("d").alias("min"), F.max("d").alias("max"),
                  F.count_if(F.col("d") < 0).alias("ml_faster"), F.count_if(F.col("d") > 0).alias("siem_faster"))


def align_frames(siem_df: DataFrame, ml_df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Explicit key join of the SIEM and ML frames (AQE picks broadcast or
    sort-merge and splits skewed keys) and the SIEM rows without an ML match."""
    aligned = siem_df.join(ml_df, on=key, how="inner")
    unmatched = siem_df.join(ml_df.select(key), on=key, how="left_anti")
    return aligned, unmatched
