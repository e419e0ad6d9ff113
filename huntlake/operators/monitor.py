"""Monitoring in batch form (W1-W6). The streaming form lives in ``streaming.monitor``.

A batch table has one row per batch, so everything after ``batch_metrics`` works
on a table that is data/batch_size rows, never collected.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from huntlake.functions.cols import c
from huntlake.operators.metrics import metric_columns
from huntlake.operators.prefix import row_numbers


def split_batches(df: DataFrame, key: str, batch_size: int = 200, min_batches: int = 5,
                  out: str = "batch") -> DataFrame:
    """Consecutive batches of ``batch_size`` rows in key order (distributed row number).

    Every row keeps its batch: the tail past the last full one is a batch too. A table too
    small for ``min_batches`` full batches is cut into smaller ones, so that there are that
    many (or one row each). Only the key is numbered; the other columns come back by a join.
    """
    numbered = row_numbers(df.select(c(key)), [key])
    n = df.count()
    size = max(1, min(batch_size, n // max(1, min_batches)))
    batched = numbered.withColumn(out, F.floor((F.col("rn") - 1) / size).cast("long"))
    return batched if df.columns == [key] else df.join(batched, key)


def batch_metrics(df: DataFrame, batch: str, truth: str, pred: str) -> DataFrame:
    """Per batch samples, accuracy, precision, recall, F1 (one grouped aggregation)."""
    y, p = c(truth).cast("int"), c(pred).cast("int")
    g = df.groupBy(c(batch).alias("batch")).agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 1) & (p == 0)).alias("fn"))
    m = metric_columns(F.col("tp"), F.col("fp"), F.col("tn"), F.col("fn"))
    return g.select("batch", "samples", *[m[k].alias(k) for k in ("accuracy", "precision", "recall", "f1")])


def drift_flags(history: DataFrame, threshold: float = 0.1) -> DataFrame:
    """baseline = F1 of the first batch; degraded when F1 < baseline - threshold."""
    base = history.agg(F.min_by("f1", "batch").alias("baseline")).first()["baseline"]
    baseline = F.lit(base if base is not None else 0.0)
    return history.withColumn("baseline_f1", baseline) \
                  .withColumn("degraded", F.coalesce(F.col("f1") < baseline - threshold, F.lit(False)))


def adaptation_triggers(history: DataFrame, buffer_rows: int = 1000, threshold: float = 0.1, model: str | None = None) -> DataFrame:
    """Adds baseline_f1, degraded, buffered_rows and retrain to the batch history.

    The first batch sets the baseline. A degraded batch adds its rows to the buffer; once
    the buffer holds ``buffer_rows`` a retrain fires, the buffer is cleared and the next
    batch sets a new baseline. buffered_rows counts the batch itself, before clearing.
    Each batch depends on the one before, so the (narrow) history of one monitored model
    is folded in order, streamed and never held; ``model`` names the column that tells
    models apart.
    """
    names = history.columns
    schema = T.StructType([*history.schema.fields, T.StructField("baseline_f1", T.DoubleType()), T.StructField("degraded", T.BooleanType()),
                           T.StructField("buffered_rows", T.LongType()), T.StructField("retrain", T.BooleanType())])

    def fold(batches):
        current, baseline, buffered = object(), None, 0
        for pdf in batches:
            added = []
            for who, f1, samples in zip(pdf[model] if model else [None] * len(pdf), pdf["f1"], pdf["samples"]):
                if who != current:
                    current, baseline, buffered = who, None, 0
                f1 = None if pd.isna(f1) else float(f1)
                if baseline is None:
                    baseline = f1
                degraded = f1 is not None and baseline is not None and f1 < baseline - threshold
                buffered += int(samples) if degraded else 0
                retrain = degraded and buffered >= buffer_rows
                added.append((baseline, degraded, buffered, retrain))
                if retrain:
                    baseline, buffered = None, 0
            extra = pd.DataFrame(added, columns=["baseline_f1", "degraded", "buffered_rows", "retrain"], index=pdf.index)
            yield pd.concat([pdf[names], extra], axis=1)

    keys = [F.col(model)] if model else [F.lit(0)]
    n = int(history.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return history.repartition(n, *keys).sortWithinPartitions(*([model] if model else []), "batch").mapInPandas(fold, schema)


def monitor_summary(history: DataFrame) -> DataFrame:
    """Total batches and samples, adaptations, first/last/mean F1 and improvement."""
    retrain = F.col("retrain") if "retrain" in history.columns else F.lit(False)
    return history.agg(
        F.count(F.lit(1)).alias("total_batches"), F.sum("samples").alias("total_samples"),
        F.count_if(retrain).alias("adaptations"), F.avg("f1").alias("mean_f1"),
        F.min_by("f1", "batch").alias("first_f1"), F.max_by("f1", "batch").alias("last_f1"),
    ).withColumn("f1_improvement", F.col("last_f1") - F.col("first_f1"))
