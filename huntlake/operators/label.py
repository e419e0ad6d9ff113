"""Labelling (L1-L5) when a frame has no target column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huntlake import schemas as S
from huntlake.functions.cols import c, nan_to_null
from huntlake.functions.heuristics import is_exfiltration
from huntlake.operators import roles
from huntlake.operators.stats import moments, quantiles


def label_from_stage(df: DataFrame, target: str = "is_apt", stage: str = "Stage") -> DataFrame:
    """L1: the exfiltration flag of the stage text as target."""
    return df.withColumn(target, is_exfiltration(c(stage)))


def zscore_outlier_count(df: DataFrame, cols: list[str] | None = None,
                         limit: float = S.ZSCORE_LIMIT, out: str = "outlier_count") -> DataFrame:
    """L2: per row, how many flow columns lie more than ``limit`` sample stds from the mean.

    Missing values are not counted; a zero std never counts. One job fits all columns.
    """
    cols = cols if cols is not None else roles.detect_flow_cols(df)
    m = moments(df, cols, ddof=1)
    total = F.lit(0)
    for n in cols:
        mean, std = m[n]
        if mean is None or std is None or std == 0 or std != std:
            continue
        z = (nan_to_null(c(n)).cast("double") - F.lit(mean)) / F.lit(std)
        total = total + F.when(F.abs(z) > limit, F.lit(1)).otherwise(F.lit(0))
    return df.withColumn(out, total.cast("int"))


def label_from_outliers(df: DataFrame, count_col: str = "outlier_count", target: str = "is_apt",
                        min_columns: int = S.MIN_OUTLIER_COLUMNS) -> DataFrame:
    """L3: at least ``min_columns`` outlying columns -> 1."""
    return df.withColumn(target, F.when(c(count_col) >= min_columns, F.lit(1)).otherwise(F.lit(0)))


def label_balance(df: DataFrame, count_col: str = "outlier_count", target: str = "is_apt",
                  rate_limit: float = S.LABEL_RATE_LIMIT, exact: bool = True) -> DataFrame:
    """L4: too many positives (rate > 0.1) or none at all -> re-threshold at the
    95th percentile of the counts with ``>=``. A 0 percentile marks every row
    (kept as in the detector)."""
    row = df.agg(F.avg(c(target).cast("double")).alias("rate"), F.sum(c(target)).alias("pos")).first()
    rate, pos = row["rate"] or 0.0, row["pos"] or 0
    if rate > rate_limit or pos == 0:
        thr = quantiles(df, [count_col], [0.95], exact=exact)[count_col][0]
        return df.withColumn(target, F.when(c(count_col) >= F.lit(thr), F.lit(1)).otherwise(F.lit(0)))
    return df


def label_statistical(df: DataFrame, target: str = "is_apt", exact: bool = True) -> DataFrame:
    """L2-L4 chained, the no-Stage branch of automatic labelling."""
    return label_balance(label_from_outliers(zscore_outlier_count(df), target=target),
                         target=target, exact=exact)


def label_auto(df: DataFrame, target: str = "is_apt") -> DataFrame:
    """L1 when a Stage column exists, else L2-L4."""
    if target in df.columns:
        return df
    if "Stage" in df.columns:
        return label_from_stage(df, target)
    return label_statistical(df, target)


def label_variance_p95(df: DataFrame, col: str = "Packet Length Variance", target: str = "is_apt",
                       exact: bool = True) -> DataFrame:
    """Variance above its 95th percentile -> 1."""
    thr = quantiles(df, [col], [0.95], exact=exact)[col][0]
    return df.withColumn(target, F.when(F.coalesce(c(col) > F.lit(thr), F.lit(False)), F.lit(1))
                         .otherwise(F.lit(0)))
