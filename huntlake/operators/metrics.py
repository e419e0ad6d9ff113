"""Evaluation aggregations.

Counts come from one aggregation (``count_if`` per cell, map-side partial
aggregation). Curves group rows by distinct score first (one shuffle, partial
aggregation), then use the distributed running sums of ``operators.prefix`` in
score order: no single-partition window over the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huntlake.functions.cols import c, zero_if_null_div
from huntlake.operators.prefix import running_sums_with_totals
from huntlake.operators.stats import quantiles

METRICS = ["accuracy", "precision", "recall", "f1"]


def confusion_counts(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """One row: tp, fp, tn, fn (truth and prediction as 0/1)."""
    y, p = c(truth).cast("int"), c(pred).cast("int")
    return df.agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 1) & (p == 0)).alias("fn"))


def confusion_matrix(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """V1: (truth, predicted, count) - all four cells, zeros included."""
    cc = confusion_counts(df, truth, pred)
    return explode_rows(cc, ["truth", "predicted", "count"], [
        (F.lit(0), F.lit(0), F.col("tn")), (F.lit(0), F.lit(1), F.col("fp")),
        (F.lit(1), F.lit(0), F.col("fn")), (F.lit(1), F.lit(1), F.col("tp"))])


def explode_rows(one_row: DataFrame, names: list[str], rows: list[tuple]) -> DataFrame:
    """Turn one aggregated row into a small long table (one struct per output row)."""
    structs = [F.struct(*[v.alias(n) for n, v in zip(names, row)]) for row in rows]
    return one_row.select(F.explode(F.array(*structs)).alias("s")).select(*[f"s.{n}" for n in names])


def metric_columns(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    """V2 formulas; 0 on a zero denominator. F1 = 2tp / (2tp + fp + fn)."""
    total = tp + fp + tn + fn
    return {
        "accuracy": zero_if_null_div(tp + tn, total),
        "precision": zero_if_null_div(tp, tp + fp),
        "recall": zero_if_null_div(tp, tp + fn),
        "f1": zero_if_null_div(2 * tp, 2 * tp + fp + fn),
    }


def binary_metrics_wide(df: DataFrame, truth: str, pred: str) -> DataFrame:
    cc = confusion_counts(df, truth, pred)
    m = metric_columns(F.col("tp"), F.col("fp"), F.col("tn"), F.col("fn"))
    return cc.select("tp", "fp", "tn", "fn", *[m[k].alias(k) for k in METRICS])


def binary_metrics(df: DataFrame, truth: str, pred: str, detector: str | None = None) -> DataFrame:
    """V2 as a long table (detector, metric, value)."""
    wide = binary_metrics_wide(df, truth, pred)
    return _long(wide, detector or pred, METRICS)


def _long(wide: DataFrame, detector: str, metrics: list[str]) -> DataFrame:
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(detector).alias("detector"), F.lit(k).alias("metric"), F.col(k).cast("double").alias("value"))
        for k in metrics])).alias("s")).select("s.detector", "s.metric", "s.value")


def classification_report(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """V3: per class precision / recall / F1 / support, plus macro and weighted averages."""
    cc = confusion_counts(df, truth, pred)
    tp, fp, tn, fn = F.col("tp"), F.col("fp"), F.col("tn"), F.col("fn")
    pos = metric_columns(tp, fp, tn, fn)
    neg = metric_columns(tn, fn, tp, fp)  # class 0 as the positive class
    wide = cc.select(
        neg["precision"].alias("p0"), neg["recall"].alias("r0"), neg["f1"].alias("f0"), (tn + fp).alias("s0"),
        pos["precision"].alias("p1"), pos["recall"].alias("r1"), pos["f1"].alias("f1"), (tp + fn).alias("s1"))
    s0, s1 = F.col("s0"), F.col("s1")
    total = s0 + s1

    def wavg(a, b):
        return zero_if_null_div(F.col(a) * s0 + F.col(b) * s1, total)

    return explode_rows(wide, ["class", "precision", "recall", "f1", "support"], [
        (F.lit("0"), F.col("p0"), F.col("r0"), F.col("f0"), s0.cast("long")),
        (F.lit("1"), F.col("p1"), F.col("r1"), F.col("f1"), s1.cast("long")),
        (F.lit("macro avg"), (F.col("p0") + F.col("p1")) / 2, (F.col("r0") + F.col("r1")) / 2,
         (F.col("f0") + F.col("f1")) / 2, total.cast("long")),
        (F.lit("weighted avg"), wavg("p0", "p1"), wavg("r0", "r1"), wavg("f0", "f1"), total.cast("long")),
    ])


def score_groups(df: DataFrame, truth: str, score: str | Column) -> DataFrame:
    """(score, p, n): positives and negatives per distinct score (partial aggregation)."""
    s = c(score) if isinstance(score, str) else score
    y = c(truth).cast("int")
    return df.groupBy(s.cast("double").alias("score")).agg(
        F.count_if(y == 1).cast("double").alias("p"), F.count_if(y != 1).cast("double").alias("n"))


def _cumulated(df: DataFrame, truth: str, score) -> tuple[DataFrame, Column, Column]:
    g = score_groups(df, truth, score)
    # the class totals fall out of the per-partition totals of the running sums
    cum, tot = running_sums_with_totals(g, ["score"], ["p", "n"], descending=True)
    return cum, F.lit(float(tot["p"])), F.lit(float(tot["n"]))


def roc_curve(df: DataFrame, truth: str, score) -> DataFrame:
    """V4: (threshold, fpr, tpr) for every distinct score plus the (0, 0) start (threshold NULL)."""
    cum, P, N = _cumulated(df, truth, score)
    pts = cum.select(F.col("score").alias("threshold"),
                     zero_if_null_div(F.col("cum_n"), N).alias("fpr"),
                     zero_if_null_div(F.col("cum_p"), P).alias("tpr"))
    start = df.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"),
                                            F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return start.unionByName(pts)


def roc_auc(df: DataFrame, truth: str, score) -> DataFrame:
    """V5: one row, area under ROC with ties counted half (= Mann-Whitney)."""
    cum, P, N = _cumulated(df, truth, score)
    above = F.col("cum_p") - F.col("p")
    return cum.agg((F.sum(F.col("n") * (above + F.col("p") / 2.0))
                    / F.nullif(P * N, F.lit(0.0))).alias("roc_auc"))


def pr_curve(df: DataFrame, truth: str, score) -> DataFrame:
    """V6: (threshold, recall, precision) per distinct score, and the end point (recall 0, precision 1) without a threshold."""
    cum, P, N = _cumulated(df, truth, score)
    tp, fp = F.col("cum_p"), F.col("cum_n")
    end = df.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("recall"),
                                          F.lit(1.0).alias("precision"))
    return end.unionByName(cum.select(F.col("score").alias("threshold"), zero_if_null_div(tp, P).alias("recall"),
                                      zero_if_null_div(tp, tp + fp).alias("precision")))


def pr_auc(df: DataFrame, truth: str, score) -> DataFrame:
    """V6: trapezoid over recall from the (recall 0, precision 1) start point."""
    cum, P, N = _cumulated(df, truth, score)
    tp, fp = F.col("cum_p"), F.col("cum_n")
    tp0, fp0 = tp - F.col("p"), fp - F.col("n")
    rec, rec0 = tp / P, tp0 / P
    prec = tp / (tp + fp)
    prec0 = F.when(tp0 + fp0 > 0, tp0 / (tp0 + fp0)).otherwise(F.lit(1.0))
    return cum.agg(F.sum((rec - rec0) * (prec + prec0) / 2.0).alias("pr_auc"))


def error_summary(df: DataFrame, scores: dict[str, str | Column], threshold_q: float | None = 0.95,
                  exact: bool = True) -> DataFrame:
    """V7: mean, population std, min, max per score column (+ its q-threshold), one job."""
    aggs = []
    for i, (name, col) in enumerate(scores.items()):
        x = (c(col) if isinstance(col, str) else col).cast("double")
        aggs += [F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}"), F.min(x).alias(f"lo{i}"),
                 F.max(x).alias(f"hi{i}")]
    wide = df.agg(*aggs)
    cuts = {}
    if threshold_q is not None:
        columns = df.select(*[(c(col) if isinstance(col, str) else col).cast("double").alias(f"t{i}") for i, col in enumerate(scores.values())])
        cuts = {k: v[0] for k, v in quantiles(columns, columns.columns, [threshold_q], exact=exact).items()}
    rows = F.array(*[F.struct(
        F.lit(name).alias("score_name"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std"),
        F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"),
        F.lit(cuts.get(f"t{i}")).cast("double").alias("threshold"))
        for i, name in enumerate(scores)])
    return wide.select(F.explode(rows).alias("s")).select("s.*")


def score_histogram(df: DataFrame, score: str | Column, bins: int = 50, name: str = "score") -> DataFrame:
    """V8: equal-width bins between min and max; the maximum falls in the last bin."""
    x = (c(score) if isinstance(score, str) else score).cast("double")
    bounds = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    if bounds["lo"] is None:
        return df.sparkSession.createDataFrame(
            [], "score_name string, bin int, lower double, upper double, count bigint")
    lo, hi = F.lit(float(bounds["lo"])), F.lit(float(bounds["hi"]))
    width = hi - lo
    b = F.when(width > 0, F.least(F.floor((F.col("__x") - lo) * bins / width) + 1, F.lit(bins))) \
        .otherwise(F.lit(1)).cast("int")
    data = df.select(x.alias("__x")).where(F.col("__x").isNotNull())
    counts = data.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return counts.select(F.lit(name).alias("score_name"), "bin",
                         (lo + (F.col("bin") - 1) * width / bins).alias("lower"),
                         (lo + F.col("bin") * width / bins).alias("upper"), "count")


def alert_rate(df: DataFrame, pred: str) -> DataFrame:
    """Number and share of predicted positives."""
    p = c(pred).cast("int")
    return df.agg(F.count_if(p == 1).alias("alerts"), F.count(F.lit(1)).alias("rows"),
                  zero_if_null_div(F.count_if(p == 1), F.count(F.lit(1))).alias("alert_rate"))


def error_vs_prob(df: DataFrame, key: str, error: str | Column, prob: str | Column, truth: str,
                  fraction: float | None = None, seed: int = 42) -> DataFrame:
    """(error, probability, label) points of all rows, or of a hash sample if a fraction is asked for."""
    bucket = F.pmod(F.xxhash64(c(key), F.lit(seed)), F.lit(1_000_000))
    if fraction is not None:
        df = df.where(bucket < int(fraction * 1_000_000))
    e = c(error) if isinstance(error, str) else error
    p = c(prob) if isinstance(prob, str) else prob
    return df.select(
        c(key), e.cast("double").alias("error"), p.cast("double").alias("probability"),
        c(truth).alias("label"))


def combined_vs_encoder(df: DataFrame, truth: str, classifier_pred: str, anomaly_pred: str,
                        classifier_score: str | None = None, anomaly_score: str | None = None) -> DataFrame:
    """V9: V2 for the classifier and for the anomaly flag side by side (one job), and
    the ROC AUC of each score that is given."""
    y = c(truth).cast("int")
    aggs = []
    for tag, col in (("c", classifier_pred), ("a", anomaly_pred)):
        p = c(col).cast("int")
        aggs += [F.count_if((y == 1) & (p == 1)).alias(f"{tag}tp"), F.count_if((y == 0) & (p == 1)).alias(f"{tag}fp"),
                 F.count_if((y == 0) & (p == 0)).alias(f"{tag}tn"), F.count_if((y == 1) & (p == 0)).alias(f"{tag}fn")]
    wide = df.agg(*aggs)
    structs = []
    for tag, name in (("c", "classifier"), ("a", "anomaly")):
        m = metric_columns(*[F.col(f"{tag}{k}") for k in ("tp", "fp", "tn", "fn")])
        structs += [F.struct(F.lit(name).alias("detector"), F.lit(k).alias("metric"), m[k].alias("value"))
                    for k in METRICS]
    out = wide.select(F.explode(F.array(*structs)).alias("s")).select("s.*")
    for name, score in (("classifier", classifier_score), ("anomaly", anomaly_score)):
        if score is not None:
            out = out.unionByName(roc_auc(df, truth, score).select(
                F.lit(name).alias("detector"), F.lit("roc_auc").alias("metric"), F.col("roc_auc").alias("value")))
    return out


def anomaly_threshold(df: DataFrame, error: str, q: float = 0.95, exact: bool = True) -> float:
    """M5: the q-quantile of the reconstruction errors."""
    return quantiles(df, [error], [q], exact=exact)[error][0]
