"""Queries: evaluation (V1-V11), SIEM comparison (C1-C5), projections (P5-P10),
monitoring in batch form (W1-W3, W5, W6).

Fixture: truth ``is_apt``; SIEM prediction ``siem_detection``; score
``coalesce(Flow Bytes/s, 0)``; ML probability ``Packet Length Std / 210`` with the
strict 0.5 threshold as ML prediction; batch = flow_id % 20.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from huntlake import schemas as S
from huntlake.functions.cols import c
from huntlake.operators import compare as C, features as feat, metrics as V, monitor as W
from huntlake.plans.catalog import query, r6
from huntlake.plans.oracle import register, with_flows
from huntlake.sources.tables import flows_view


def scored(spark, sf_dir):
    f = flows_view(spark, sf_dir)
    prob = c("Packet Length Std") / F.lit(210.0)
    return f.select(
        "flow_id", "flow_start", "is_apt", "siem_detection",
        F.coalesce(c("Flow Bytes/s"), F.lit(0.0)).alias("score"),
        prob.alias("ml_prob"),
        F.when(prob > 0.5, F.lit(1)).otherwise(F.lit(0)).alias("apt_prediction"),
        (F.col("flow_id") % 20).alias("batch"),
        F.timestamp_add("SECOND", F.col("siem_delay_s"), F.col("flow_start")).alias("siem_detection_time"),
        F.timestamp_add("SECOND", F.col("ml_delay_s"), F.col("flow_start")).alias("ml_detection_time"),
    )


M_CTE = """m AS (SELECT flow_id, flow_start, is_apt, siem_detection, coalesce("Flow Bytes/s", 0) AS score,
  "Packet Length Std" / 210.0 AS ml_prob, CASE WHEN "Packet Length Std" / 210.0 > 0.5 THEN 1 ELSE 0 END AS apt_prediction,
  flow_id % 20 AS batch,
  flow_start + to_seconds(siem_delay_s) AS siem_detection_time, flow_start + to_seconds(ml_delay_s) AS ml_detection_time
  FROM flows)"""

CC_CTE = """cc AS (SELECT count_if(is_apt = 1 AND siem_detection = 1) AS tp, count_if(is_apt = 0 AND siem_detection = 1) AS fp,
  count_if(is_apt = 0 AND siem_detection = 0) AS tn, count_if(is_apt = 1 AND siem_detection = 0) AS fn FROM m)"""


def _div(a, b):
    return f"coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 0)"


def _metrics_sql(tp="tp", fp="fp", tn="tn", fn="fn"):
    return {
        "accuracy": _div(f"{tp} + {tn}", f"{tp} + {fp} + {tn} + {fn}"),
        "precision": _div(tp, f"{tp} + {fp}"),
        "recall": _div(tp, f"{tp} + {fn}"),
        "f1": _div(f"2 * {tp}", f"2 * {tp} + {fp} + {fn}"),
    }


@query("v1_confusion_matrix")
def v1(spark, sf_dir):
    return V.confusion_matrix(scored(spark, sf_dir), "is_apt", "siem_detection")


register("v1_confusion_matrix", with_flows("""
SELECT * FROM (SELECT 0 AS truth, 0 AS predicted, tn AS count FROM cc UNION ALL SELECT 0, 1, fp FROM cc
  UNION ALL SELECT 1, 0, fn FROM cc UNION ALL SELECT 1, 1, tp FROM cc)""", M_CTE, CC_CTE))


@query("v2_binary_metrics")
def v2(spark, sf_dir):
    return V.binary_metrics(scored(spark, sf_dir), "is_apt", "siem_detection", detector="siem")


register("v2_binary_metrics", with_flows(" UNION ALL ".join(
    f"SELECT 'siem' AS detector, '{k}' AS metric, {e} AS value FROM cc" for k, e in _metrics_sql().items()),
    M_CTE, CC_CTE))


@query("v3_classification_report")
def v3(spark, sf_dir):
    return V.classification_report(scored(spark, sf_dir), "is_apt", "siem_detection")


def _v3_sql():
    pos = _metrics_sql()
    neg = _metrics_sql(tp="tn", fp="fn", tn="tp", fn="fp")
    w = "SELECT {p} AS p0, {r} AS r0, {f} AS f0, tn + fp AS s0, {p1} AS p1, {r1} AS r1, {f1} AS f1, tp + fn AS s1 FROM cc"
    wide = w.format(p=neg["precision"], r=neg["recall"], f=neg["f1"], p1=pos["precision"], r1=pos["recall"], f1=pos["f1"])

    def wavg(a, b):
        return _div(f"{a} * s0 + {b} * s1", "s0 + s1")
    return with_flows(f"""
SELECT '0' AS class, p0 AS precision, r0 AS recall, f0 AS f1, s0 AS support FROM w
UNION ALL SELECT '1', p1, r1, f1, s1 FROM w
UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, s0 + s1 FROM w
UNION ALL SELECT 'weighted avg', {wavg('p0', 'p1')}, {wavg('r0', 'r1')}, {wavg('f0', 'f1')}, s0 + s1 FROM w""",
                      M_CTE, CC_CTE, f"w AS ({wide})")


register("v3_classification_report", _v3_sql())

G_CTE = """g AS (SELECT score AS s, CAST(count_if(is_apt = 1) AS DOUBLE) AS p, CAST(count_if(is_apt <> 1) AS DOUBLE) AS n
  FROM m GROUP BY score)"""
CUM_CTE = """cu AS (SELECT s, p, n, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS fp,
  sum(p) OVER () AS pos, sum(n) OVER () AS neg FROM g)"""


@query("v4_roc_curve")
def v4(spark, sf_dir):
    return V.roc_curve(scored(spark, sf_dir), "is_apt", "score")


register("v4_roc_curve", with_flows(f"""
SELECT CAST(NULL AS DOUBLE) AS threshold, 0.0e0 AS fpr, 0.0e0 AS tpr
UNION ALL SELECT s, {_div('fp', 'neg')}, {_div('tp', 'pos')} FROM cu""", M_CTE, G_CTE, CUM_CTE))


@query("v5_roc_auc")
def v5(spark, sf_dir):
    return V.roc_auc(scored(spark, sf_dir), "is_apt", "score").select(r6(F.col("roc_auc")).alias("roc_auc"))


register("v5_roc_auc", with_flows(
    "SELECT round_even(sum(n * ((tp - p) + p / 2.0)) / nullif(max(pos) * max(neg), 0), 6) AS roc_auc FROM cu",
    M_CTE, G_CTE, CUM_CTE))


@query("v6_pr_curve")
def v6c(spark, sf_dir):
    return V.pr_curve(scored(spark, sf_dir), "is_apt", "score")


register("v6_pr_curve", with_flows(f"""
SELECT s AS threshold, {_div('tp', 'pos')} AS recall, {_div('tp', 'tp + fp')} AS precision FROM cu
UNION ALL SELECT NULL, 0e0, 1e0""",
                                   M_CTE, G_CTE, CUM_CTE))


@query("v6_pr_auc")
def v6a(spark, sf_dir):
    return V.pr_auc(scored(spark, sf_dir), "is_apt", "score").select(r6(F.col("pr_auc")).alias("pr_auc"))


register("v6_pr_auc", with_flows("""
SELECT round_even(sum((rec - r0) * (prec + p0) / 2), 6) AS pr_auc FROM (
  SELECT tp / pos AS rec, tp / (tp + fp) AS prec,
    coalesce(lag(tp / pos) OVER (ORDER BY s DESC), 0e0) AS r0,
    coalesce(lag(tp / (tp + fp)) OVER (ORDER BY s DESC), 1e0) AS p0 FROM cu) d""", M_CTE, G_CTE, CUM_CTE))


@query("v7_error_summary")
def v7(spark, sf_dir):
    out = V.error_summary(scored(spark, sf_dir), {"error": "score", "probability": "ml_prob"})
    return out.select("score_name", r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"),
                      "min", "max", r6(F.col("threshold")).alias("threshold"))


register("v7_error_summary", with_flows(" UNION ALL ".join(
    f"SELECT '{n}' AS score_name, round_even(avg({x}), 6) AS mean, round_even(stddev_pop({x}), 6) AS std, min({x}) AS min, "
    f"max({x}) AS max, round_even(quantile_cont({x}, 0.95), 6) AS threshold FROM m"
    for n, x in (("error", "score"), ("probability", "ml_prob"))), M_CTE))


@query("v8_score_histogram")
def v8(spark, sf_dir):
    return V.score_histogram(scored(spark, sf_dir), "score", bins=50, name="error")


register("v8_score_histogram", with_flows("""
SELECT 'error' AS score_name, bin, lo + (bin - 1) * (hi - lo) / 50 AS lower, lo + bin * (hi - lo) / 50 AS upper,
  count(*) AS count
FROM (SELECT CAST(CASE WHEN hi - lo > 0 THEN least(floor((score - lo) * 50 / (hi - lo)) + 1, 50) ELSE 1 END AS INTEGER) AS bin,
        lo, hi FROM m, (SELECT min(score) AS lo, max(score) AS hi FROM m) b WHERE score IS NOT NULL) x
GROUP BY bin, lo, hi""", M_CTE))


@query("v9_combined_vs_encoder")
def v9(spark, sf_dir):
    df = scored(spark, sf_dir)
    thr = V.anomaly_threshold(df, "score", 0.95)
    df = df.withColumn("anomaly", F.when(F.col("score") > thr, F.lit(1)).otherwise(F.lit(0)))
    out = V.combined_vs_encoder(df, "is_apt", "siem_detection", "anomaly", classifier_score="ml_prob", anomaly_score="score")
    return out.select("detector", "metric", r6(F.col("value")).alias("value"))


def _v9_sql():
    parts = []
    for name, col, score in (("classifier", "siem_detection", "ml_prob"), ("anomaly", "anomaly", "score")):
        cc = (f"SELECT count_if(is_apt = 1 AND {col} = 1) AS tp, count_if(is_apt = 0 AND {col} = 1) AS fp, "
              f"count_if(is_apt = 0 AND {col} = 0) AS tn, count_if(is_apt = 1 AND {col} = 0) AS fn FROM ma")
        for k, e in _metrics_sql().items():
            parts.append(f"SELECT '{name}' AS detector, '{k}' AS metric, round_even({e}, 6) AS value FROM ({cc}) q")
        parts.append(f"""SELECT '{name}', 'roc_auc', round_even(sum(n * (tp - p + p / 2)) / (max(pos) * max(neg)), 6) FROM (
  SELECT p, n, sum(p) OVER (ORDER BY s DESC) AS tp, sum(p) OVER () AS pos, sum(n) OVER () AS neg FROM (
    SELECT {score} AS s, CAST(count_if(is_apt = 1) AS DOUBLE) AS p, CAST(count_if(is_apt <> 1) AS DOUBLE) AS n
    FROM ma GROUP BY s) g) q""")
    return with_flows(" UNION ALL ".join(parts), M_CTE,
                      """ma AS (SELECT *, CASE WHEN score > (SELECT quantile_cont(score, 0.95) FROM m) THEN 1 ELSE 0 END
  AS anomaly FROM m)""")


register("v9_combined_vs_encoder", _v9_sql())


@query("v10_alert_rate")
def v10(spark, sf_dir):
    return V.alert_rate(scored(spark, sf_dir), "apt_prediction")


register("v10_alert_rate", with_flows(f"""
SELECT count_if(apt_prediction = 1) AS alerts, count(*) AS "rows", {_div('count_if(apt_prediction = 1)', 'count(*)')} AS alert_rate
FROM m""", M_CTE))


@query("v11_error_vs_prob")
def v11(spark, sf_dir):
    return V.error_vs_prob(scored(spark, sf_dir), "flow_id", "score", "ml_prob", "is_apt")


register("v11_error_vs_prob", with_flows("""
SELECT flow_id, score AS error, ml_prob AS probability, is_apt AS label FROM m""", M_CTE))


# --- comparison ----------------------------------------------------------------------

def _c1_sql():
    parts = []
    for tag, col in (("siem", "siem_detection"), ("ml", "apt_prediction")):
        cc = (f"SELECT count_if(is_apt = 1 AND {col} = 1) AS tp, count_if(is_apt = 0 AND {col} = 1) AS fp, "
              f"count_if(is_apt = 0 AND {col} = 0) AS tn, count_if(is_apt = 1 AND {col} = 0) AS fn FROM m")
        for k, e in _metrics_sql().items():
            parts.append(f"SELECT '{tag}' AS detector, '{k}' AS metric, {e} AS value FROM ({cc}) q")
        for k in ("tp", "fp", "tn", "fn"):
            parts.append(f"SELECT '{tag}', '{k}', CAST({k} AS DOUBLE) FROM ({cc}) q")
    return " UNION ALL ".join(parts)


GM_CTE = """gm AS (SELECT ml_prob AS s, CAST(count_if(is_apt = 1) AS DOUBLE) AS p, CAST(count_if(is_apt <> 1) AS DOUBLE) AS n
  FROM m GROUP BY ml_prob),
cm AS (SELECT s, p, n, sum(p) OVER (ORDER BY s DESC) AS tp, sum(p) OVER () AS pos, sum(n) OVER () AS neg FROM gm)"""


@query("c1_compare_metrics")
def c1(spark, sf_dir):
    out = C.compare_metrics(scored(spark, sf_dir), "is_apt", "siem_detection", "apt_prediction", ml_score="ml_prob")
    return out.select("detector", "metric", r6(F.col("value")).alias("value"))


register("c1_compare_metrics", with_flows(f"""
SELECT detector, metric, round_even(value, 6) AS value FROM ({_c1_sql()}) x
UNION ALL SELECT 'ml', 'roc_auc', round_even(sum(n * ((tp - p) + p / 2.0)) / nullif(max(pos) * max(neg), 0), 6) FROM cm""",
                                          M_CTE, GM_CTE))


@query("c2_metric_difference")
def c2(spark, sf_dir):
    long = C.compare_metrics(scored(spark, sf_dir), "is_apt", "siem_detection", "apt_prediction")
    out = C.metric_difference(long.where(F.col("metric").isin(V.METRICS)))
    return out.select("metric", "siem", "ml", r6(F.col("difference")).alias("difference"))


register("c2_metric_difference", with_flows(f"""
SELECT metric, max(CASE WHEN detector = 'siem' THEN value END) AS siem, max(CASE WHEN detector = 'ml' THEN value END) AS ml,
  round_even(max(CASE WHEN detector = 'ml' THEN value END) - max(CASE WHEN detector = 'siem' THEN value END), 6) AS difference
FROM ({_c1_sql()}) x WHERE metric IN ('accuracy', 'precision', 'recall', 'f1') GROUP BY metric""", M_CTE))


@query("c3_c4_detection_time_diff")
def c3(spark, sf_dir):
    out = C.detection_time_diff(scored(spark, sf_dir), "is_apt", "siem_detection", "apt_prediction",
                                "siem_detection_time", "ml_detection_time")
    return out.select("pairs", r6(F.col("mean")).alias("mean"), r6(F.col("median")).alias("median"), "min", "max",
                      "ml_faster", "siem_faster")


register("c3_c4_detection_time_diff", with_flows("""
SELECT count(*) AS pairs, round_even(avg(d), 6) AS mean, round_even(quantile_cont(d, 0.5), 6) AS median, min(d) AS min, max(d) AS max,
  count_if(d < 0) AS ml_faster, count_if(d > 0) AS siem_faster
FROM (SELECT CAST(epoch_us(ml_detection_time) - epoch_us(siem_detection_time) AS DOUBLE) / 1e6 AS d FROM m
      WHERE is_apt = 1 AND siem_detection = 1 AND apt_prediction = 1) t""", M_CTE))


def _frames(spark, sf_dir):
    df = scored(spark, sf_dir)
    siem = df.select("flow_id", "is_apt", "siem_detection", "siem_detection_time")
    # the ML side only scores flows with a byte rate (its feature matrix has no gaps)
    ml = flows_view(spark, sf_dir).where(c("Flow Bytes/s").isNotNull()).select("flow_id") \
        .join(df.select("flow_id", "apt_prediction", "ml_detection_time"), "flow_id")
    return C.align_frames(siem, ml, "flow_id")


@query("c5_align_frames")
def c5(spark, sf_dir):
    aligned, _ = _frames(spark, sf_dir)
    return aligned.select("flow_id", "is_apt", "siem_detection", "apt_prediction",
                          (F.unix_micros("ml_detection_time") - F.unix_micros("siem_detection_time")).alias("diff_us"))


register("c5_align_frames", with_flows("""
SELECT flow_id, is_apt, siem_detection, apt_prediction, epoch_us(ml_detection_time) - epoch_us(siem_detection_time) AS diff_us
FROM m JOIN (SELECT flow_id FROM flows WHERE "Flow Bytes/s" IS NOT NULL) f USING (flow_id)""", M_CTE))


@query("c5_unmatched")
def c5u(spark, sf_dir):
    _, unmatched = _frames(spark, sf_dir)
    return unmatched.select("flow_id", "is_apt", "siem_detection")


register("c5_unmatched", with_flows("""
SELECT flow_id, is_apt, siem_detection FROM m WHERE flow_id NOT IN (SELECT flow_id FROM flows WHERE "Flow Bytes/s" IS NOT NULL)""",
                                    M_CTE))


C5_FILE_ROWS = 1_000_000


@query("c5_align_by_position")
def c5p(spark, sf_dir):
    """Two file tables without a common key, one of them shorter, aligned row by row."""
    from huntlake.operators.position import align_by_position
    from huntlake.session import scratch_path
    paths = scratch_path(spark, "c5-siem"), scratch_path(spark, "c5-ml")
    df = scored(spark, sf_dir).select("flow_id", "siem_detection", "apt_prediction")
    last, n = df.agg(F.max("flow_id"), F.count(F.lit(1))).first()
    files = n // C5_FILE_ROWS  # a file is sorted and written by one task
    df.repartitionByRange(5 + files, "flow_id").sortWithinPartitions("flow_id").drop("apt_prediction").write.parquet(paths[0])
    df.where(F.col("flow_id") < last).repartitionByRange(3 + files, "flow_id").sortWithinPartitions("flow_id").select("apt_prediction").write.parquet(paths[1])
    aligned, rest = align_by_position(spark.read.parquet(paths[0]), spark.read.parquet(paths[1]))
    return aligned.unionByName(rest, allowMissingColumns=True)


register("c5_align_by_position", with_flows("""
SELECT row_number() OVER (ORDER BY flow_id) - 1 AS position, flow_id, siem_detection,
  CASE WHEN flow_id < (SELECT max(flow_id) FROM m) THEN apt_prediction END AS apt_prediction FROM m""", M_CTE))


# --- projections / filters -----------------------------------------------------------

@query("p5_suspects_only")
def p5(spark, sf_dir):
    f = flows_view(spark, sf_dir).select("flow_id", F.col("Stage").alias("predicted_stage"))
    return feat.suspects_only(f, "predicted_stage", benign="normal")


register("p5_suspects_only", with_flows("""SELECT flow_id, "Stage" AS predicted_stage FROM flows WHERE "Stage" <> 'normal'"""))


@query("p5_suspect_count")
def p5c(spark, sf_dir):
    f = flows_view(spark, sf_dir).select("flow_id", F.col("Stage").alias("predicted_stage"))
    return feat.suspects_only(f, "predicted_stage", benign="normal").agg(F.count(F.lit(1)).alias("suspects"))


register("p5_suspect_count", with_flows("""SELECT count(*) AS suspects FROM flows WHERE "Stage" <> 'normal'"""))


@query("p6_numeric_only")
def p6(spark, sf_dir):
    return feat.numeric_only(flows_view(spark, sf_dir))


register("p6_numeric_only", with_flows("SELECT * EXCLUDE (flow_start, \"Stage\") FROM flows"))


@query("p7_available_features")
def p7(spark, sf_dir):
    f = flows_view(spark, sf_dir).drop("URG Flag Count", "Bwd Segment Size Avg")
    return feat.available_features(f, S.EXPECTED_FEATURES, on_missing="fill", keep=("flow_id",))


register("p7_available_features", with_flows("SELECT flow_id, " + ", ".join(
    ("0.0e0" if n in ("URG Flag Count", "Bwd Segment Size Avg") else f'"{n}"') + f' AS "{n}"'
    for n in S.EXPECTED_FEATURES) + " FROM flows"))


@query("p8_split_target")
def p8(spark, sf_dir):
    """The target is kept out of the feature list, the features are scaled, and the target is still beside them."""
    from huntlake.operators.scale import Scaler
    f = flows_view(spark, sf_dir).select("flow_id", *[c(n) for n in S.EXPECTED_FEATURES], "is_apt")
    cols = feat.feature_columns(f, "is_apt", exclude=("flow_id",))
    out = Scaler(cols, method="standard").fit(f).transform(f)
    return out.select("flow_id", F.lit(len(cols)).alias("n_features"), *[r6(c(n)).alias(n) for n in cols[:3]], "is_apt")


register("p8_split_target", with_flows("SELECT flow_id, 17 AS n_features, " + ", ".join(
    f'round_even(("{n}" - (SELECT avg("{n}") FROM flows)) / (SELECT stddev_pop("{n}") FROM flows), 6) AS "{n}"'
    for n in S.EXPECTED_FEATURES[:3]) + ", is_apt FROM flows"))


@query("p9_true_positive_filter")
def p9(spark, sf_dir):
    return feat.true_positive_filter(scored(spark, sf_dir)).select("flow_id", "score")


register("p9_true_positive_filter", with_flows(
    "SELECT flow_id, score FROM m WHERE is_apt = 1 AND siem_detection = 1 AND apt_prediction = 1", M_CTE))


@query("p10_apt_rows_first")
def p10(spark, sf_dir):
    return feat.apt_rows_first(scored(spark, sf_dir), "flow_id", n=1).select("flow_id", "score", "is_apt")


register("p10_apt_rows_first", with_flows(
    "SELECT flow_id, score, is_apt FROM m WHERE is_apt = 1 ORDER BY flow_id LIMIT 1", M_CTE))


# --- monitoring, batch form --------------------------------------------------------

def _history(spark, sf_dir):
    return W.batch_metrics(scored(spark, sf_dir), "batch", "is_apt", "apt_prediction")


HIST_CTE = """h AS (SELECT batch, samples, """ + ", ".join(
    f"{e} AS {k}" for k, e in _metrics_sql().items()) + """ FROM (
  SELECT batch, count(*) AS samples, count_if(is_apt = 1 AND apt_prediction = 1) AS tp,
    count_if(is_apt = 0 AND apt_prediction = 1) AS fp, count_if(is_apt = 0 AND apt_prediction = 0) AS tn,
    count_if(is_apt = 1 AND apt_prediction = 0) AS fn FROM m GROUP BY batch) x)"""


@query("w1_batch_metrics")
def w1(spark, sf_dir):
    return _history(spark, sf_dir)


register("w1_batch_metrics", with_flows("SELECT * FROM h", M_CTE, HIST_CTE))


@query("w2_drift_flags")
def w2(spark, sf_dir):
    return W.drift_flags(_history(spark, sf_dir)).select("batch", "f1", "baseline_f1", "degraded")


W2_CTE = """fl AS (SELECT batch, samples, f1, (SELECT f1 FROM h ORDER BY batch LIMIT 1) AS baseline_f1,
  coalesce(f1 < (SELECT f1 FROM h ORDER BY batch LIMIT 1) - 0.1, false) AS degraded FROM h)"""

register("w2_drift_flags", with_flows("SELECT batch, f1, baseline_f1, degraded FROM fl", M_CTE, HIST_CTE, W2_CTE))


@query("w3_adaptation_triggers")
def w3(spark, sf_dir):
    out = W.adaptation_triggers(_history(spark, sf_dir), buffer_rows=5000, threshold=0.02)
    return out.select("batch", "baseline_f1", "degraded", "buffered_rows", "retrain")


W3_CTE = """hh AS (SELECT batch, samples, f1, row_number() OVER (ORDER BY batch) AS rn FROM h),
fo AS (SELECT rn, batch, samples, f1, f1 AS baseline_f1, false AS degraded, CAST(0 AS BIGINT) AS buffered_rows, false AS retrain FROM hh WHERE rn = 1
  UNION ALL
  SELECT rn, batch, samples, f1, baseline_f1, degraded, CAST(kept + CASE WHEN degraded THEN samples ELSE 0 END AS BIGINT),
    degraded AND kept + samples >= 5000
  FROM (SELECT n.rn, n.batch, n.samples, n.f1, CASE WHEN p.retrain THEN n.f1 ELSE p.baseline_f1 END AS baseline_f1,
      NOT p.retrain AND coalesce(n.f1 < p.baseline_f1 - 0.02, false) AS degraded, CASE WHEN p.retrain THEN 0 ELSE p.buffered_rows END AS kept
    FROM fo p JOIN hh n ON n.rn = p.rn + 1) s)"""


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


register("w3_adaptation_triggers", _recursive(with_flows("""
SELECT batch, baseline_f1, degraded, buffered_rows, retrain FROM fo""", M_CTE, HIST_CTE, W3_CTE)))


@query("w5_split_batches")
def w5(spark, sf_dir):
    return W.split_batches(flows_view(spark, sf_dir).select("flow_id"), "flow_id", batch_size=200)


register("w5_split_batches", with_flows("""
SELECT flow_id, row_number() OVER (ORDER BY flow_id) AS rn, CAST(floor((row_number() OVER (ORDER BY flow_id) - 1) / 200) AS BIGINT) AS batch
FROM flows"""))


@query("w6_monitor_summary")
def w6(spark, sf_dir):
    out = W.monitor_summary(W.adaptation_triggers(_history(spark, sf_dir), buffer_rows=5000, threshold=0.02))
    return out.select("total_batches", "total_samples", "adaptations", r6(F.col("mean_f1")).alias("mean_f1"),
                      "first_f1", "last_f1", "f1_improvement")


register("w6_monitor_summary", _recursive(with_flows("""
SELECT count(*) AS total_batches, CAST(sum(samples) AS BIGINT) AS total_samples, count_if(retrain) AS adaptations,
  round_even(avg(f1), 6) AS mean_f1, arg_min(f1, batch) AS first_f1, arg_max(f1, batch) AS last_f1,
  arg_max(f1, batch) - arg_min(f1, batch) AS f1_improvement
FROM fo""", M_CTE, HIST_CTE, W3_CTE)))
