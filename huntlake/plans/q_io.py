"""Queries: sources and sinks with read-back (S1-S9, S11). Each query writes data
derived from the driver tables into the shared scratch area, then reads it back
through the reader under test."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from huntlake import schemas as S
from huntlake.functions.cols import c
from huntlake.functions.logs import classify_rule
from huntlake.functions.time import LOG_TIME_FORMAT, iso_timestamp
from huntlake.operators import metrics as V
from huntlake.plans.catalog import query, r6
from huntlake.plans.q_metrics import M_CTE, _metrics_sql, scored
from huntlake.plans.oracle import iso_sql, register, with_flows, with_logs
from huntlake.session import scratch_path
from huntlake.sources import readers as R, sinks as K
from huntlake.sources.tables import flows_view, logs_view

LOG_DOC_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("destination", T.StringType()), T.StructField("event", T.StringType()),
    T.StructField("classification", T.StringType()),
])

TS = '"timestamp"'


@query("s1_scan_log_csv")
def s1(spark, sf_dir):
    path = scratch_path(spark, "logs-csv")
    logs = logs_view(spark, sf_dir)
    logs.select(F.date_format("timestamp", LOG_TIME_FORMAT).alias("t"), "source", "destination", "event") \
        .write.option("header", False).csv(path)
    out = R.scan_log_csv(spark, path)
    return out.select(iso_timestamp("timestamp").alias("timestamp"), "source", "destination", "event")


register("s1_scan_log_csv", with_logs(f"""
SELECT {iso_sql("date_trunc('second', " + TS + ")")} AS "timestamp", source, destination, event FROM logs"""))


@query("s2_scan_flow_csv")
def s2(spark, sf_dir):
    path = scratch_path(spark, "flows-csv")
    flows = flows_view(spark, sf_dir).select(*[c(f.name) for f in S.FLOW_SCHEMA.fields])
    flows.write.option("header", True).csv(path)
    return R.scan_flow_csv(spark, path)


register("s2_scan_flow_csv", with_flows("SELECT " + ", ".join(f'"{f.name}"' for f in S.FLOW_SCHEMA.fields)
                                        + " FROM flows"))


def _log_docs(spark, sf_dir):
    logs = logs_view(spark, sf_dir)
    return logs.select("log_id", "timestamp", "source", "destination", "event",
                       classify_rule("event").alias("classification"))


LOG_DOC_SQL = with_logs(f"""
SELECT {iso_sql(TS)} AS "timestamp", source, destination, event,
  CASE WHEN contains(event, 'APT_attack') THEN 'attaque' ELSE 'normal' END AS classification FROM logs""")


@query("s3_scan_documents")
def s3(spark, sf_dir):
    path = scratch_path(spark, "documents")
    docs = _log_docs(spark, sf_dir)
    K.sink_index(docs.drop("log_id"), path, key_cols=["source", "destination", "event", "timestamp"])
    schema = T.StructType([T.StructField("_id", T.StringType())] + LOG_DOC_SCHEMA.fields)
    return R.scan_documents(spark, path, schema=schema)


register("s3_scan_documents", LOG_DOC_SQL)


@query("s4_scan_index")
def s4(spark, sf_dir):
    path = scratch_path(spark, "index-hits")
    docs = _log_docs(spark, sf_dir)
    src = F.struct(iso_timestamp("timestamp").alias("timestamp"), "source", "destination", "event", "classification")
    docs.select(F.lit("apt-logs").alias("_index"), K.doc_id(["log_id"]).alias("_id"), src.alias("_source")) \
        .write.json(path)
    return R.scan_index(spark, path, source_schema=LOG_DOC_SCHEMA)


register("s4_scan_index", LOG_DOC_SQL)


@query("s5_sink_index")
def s5(spark, sf_dir):
    path = scratch_path(spark, "index")
    K.sink_index(_log_docs(spark, sf_dir), path, key_cols=["log_id"])
    back = spark.read.schema(T.StructType([T.StructField("log_id", T.LongType())] + LOG_DOC_SCHEMA.fields
                                          + [T.StructField("_id", T.StringType())])).json(path)
    return back.select("log_id", "timestamp", "source", "destination", "event", "classification")


register("s5_sink_index", with_logs(f"""
SELECT log_id, {iso_sql(TS)} AS "timestamp", source, destination, event,
  CASE WHEN contains(event, 'APT_attack') THEN 'attaque' ELSE 'normal' END AS classification FROM logs"""))


def _routed(spark, sf_dir):
    index_path, attack_path = scratch_path(spark, "routed-index"), scratch_path(spark, "attack-store")
    K.sink_routed(_log_docs(spark, sf_dir), index_path, attack_path)
    return index_path, attack_path


@query("s6_sink_routed")
def s6(spark, sf_dir):
    index_path, attack_path = _routed(spark, sf_dir)
    idx = spark.read.json(index_path).groupBy("classification").agg(F.count(F.lit(1)).alias("rows")) \
        .select(F.lit("index").alias("store"), "classification", "rows")
    att = spark.read.parquet(attack_path).groupBy("classification").agg(F.count(F.lit(1)).alias("rows")) \
        .select(F.lit("attacks").alias("store"), "classification", "rows")
    return idx.unionByName(att)


register("s6_sink_routed", with_logs("""
SELECT 'index' AS store, classification, count(*) AS "rows" FROM lc GROUP BY classification
UNION ALL SELECT 'attacks', classification, count(*) FROM lc WHERE classification = 'attaque' GROUP BY classification""",
                                     """lc AS (SELECT CASE WHEN contains(event, 'APT_attack') THEN 'attaque' ELSE 'normal' END
  AS classification FROM logs)"""))


@query("s11_list_attacks")
def s11(spark, sf_dir):
    _, attack_path = _routed(spark, sf_dir)
    rows, total = R.list_attacks(spark, attack_path)
    return rows.select("event", iso_timestamp("timestamp").alias("timestamp"))


register("s11_list_attacks", with_logs(f"""
SELECT event, {iso_sql(TS)} AS "timestamp" FROM logs WHERE contains(event, 'APT_attack')"""))


@query("s11_attack_total")
def s11t(spark, sf_dir):
    _, attack_path = _routed(spark, sf_dir)
    return R.list_attacks(spark, attack_path)[1]


register("s11_attack_total", with_logs("SELECT count(*) AS total FROM logs WHERE contains(event, 'APT_attack')"))


@query("s7_sink_detections")
def s7(spark, sf_dir):
    path = scratch_path(spark, "detections")
    preds = scored(spark, sf_dir).select("flow_id", "is_apt", F.col("ml_prob").alias("apt_probability"),
                                         "apt_prediction")
    K.sink_detections(preds, path)
    return spark.read.parquet(path).select("flow_id", "is_apt", "apt_probability", "apt_prediction",
                                           F.col("detection_time").isNotNull().alias("has_detection_time"))


register("s7_sink_detections", with_flows("""
SELECT flow_id, is_apt, ml_prob AS apt_probability, apt_prediction, true AS has_detection_time FROM m""", M_CTE))


@query("s8_sink_predictions_csv")
def s8(spark, sf_dir):
    path = scratch_path(spark, "predictions-csv")
    preds = scored(spark, sf_dir).select("flow_id", "is_apt", F.col("ml_prob").alias("apt_probability"),
                                         "apt_prediction", F.col("score").alias("reconstruction_error"))
    K.sink_predictions_csv(preds, path)
    back = spark.read.option("header", True).csv(path)
    return back.select(F.col("flow_id").cast("long"), F.col("is_apt").cast("int"), F.col("apt_probability").cast("double"),
                       F.col("apt_prediction").cast("int"), F.col("reconstruction_error").cast("double"),
                       F.col("detection_time").isNotNull().alias("has_detection_time"))


register("s8_sink_predictions_csv", with_flows("""
SELECT flow_id, is_apt, ml_prob AS apt_probability, apt_prediction, score AS reconstruction_error,
  true AS has_detection_time FROM m""", M_CTE))


@query("s9_sink_report_json")
def s9(spark, sf_dir):
    path = scratch_path(spark, "report")
    wide = V.binary_metrics_wide(scored(spark, sf_dir), "is_apt", "apt_prediction")

    def cell(t, p, n):
        return F.struct(F.lit(t).alias("truth"), F.lit(p).alias("predicted"), F.col(n).alias("count"))
    report = wide.select(F.struct("accuracy", "precision", "recall", "f1").alias("metrics"),
                         F.array(cell(0, 0, "tn"), cell(0, 1, "fp"), cell(1, 0, "fn"), cell(1, 1, "tp"))
                         .alias("confusion_matrix"))
    K.sink_report_json(report, path)
    back = spark.read.json(path)
    return back.select(*[r6(F.col(f"metrics.{k}")).alias(k) for k in V.METRICS], F.explode("confusion_matrix").alias("cell")) \
        .select(*V.METRICS, "cell.truth", "cell.predicted", "cell.count")


register("s9_sink_report_json", with_flows("SELECT " + ", ".join(f"round_even({e}, 6) AS {k}" for k, e in _metrics_sql().items())
                                           + """, truth, predicted, count FROM cc, (
  SELECT CAST(0 AS BIGINT) AS truth, CAST(0 AS BIGINT) AS predicted, tn AS count FROM cc UNION ALL SELECT 0, 1, fp FROM cc
  UNION ALL SELECT 1, 0, fn FROM cc UNION ALL SELECT 1, 1, tp FROM cc) cells""", M_CTE, """cc AS (SELECT count_if(is_apt = 1 AND apt_prediction = 1) AS tp, count_if(is_apt = 0 AND apt_prediction = 1) AS fp,
  count_if(is_apt = 0 AND apt_prediction = 0) AS tn, count_if(is_apt = 1 AND apt_prediction = 0) AS fn FROM m)"""))
