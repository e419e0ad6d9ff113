"""Queries: Structured Streaming (W7-W10, W1-W4 on a stream). Each query lands
data derived from the driver tables as files in the shared scratch area, runs the
streaming query with ``availableNow`` and returns what it wrote, read back."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from huntlake import schemas as S
from huntlake.functions.cols import c
from huntlake.functions.time import LOG_TIME_FORMAT, iso_timestamp
from huntlake.models import classifier as M
from huntlake.operators.metrics import binary_metrics_wide
from huntlake.operators.sample import hash_split
from huntlake.plans.catalog import query, r6
from huntlake.plans.oracle import iso_sql, register, with_flows, with_logs
from huntlake.session import scratch_path
from huntlake.sources.tables import flows_view, logs_view
from huntlake.streaming import delta as SD, ingest as SI, monitor as SM, windows as SW

TS = '"timestamp"'


def _log_csv_files(spark, sf_dir):
    """The log view as header-less CSV files, one file set per day."""
    path = scratch_path(spark, "log-stream-csv")
    logs = logs_view(spark, sf_dir)
    logs.select(F.date_format("timestamp", LOG_TIME_FORMAT).alias("t"), "source", "destination", "event",
                F.to_date("timestamp").alias("day")) \
        .repartition("day").drop("day").write.option("header", False).csv(path)
    return path


def _log_parquet_files(spark, sf_dir):
    path = scratch_path(spark, "log-stream-parquet")
    logs_view(spark, sf_dir).repartition(8, F.to_date("timestamp")).write.parquet(path)
    return path


def _log_stream(spark, path, watermark="10 minutes"):
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path).withWatermark("timestamp", watermark)


@query("w7_stream_log_ingest")
def w7(spark, sf_dir):
    src = _log_csv_files(spark, sf_dir)
    index_path, attack_path = scratch_path(spark, "w7-index"), scratch_path(spark, "w7-attacks")
    q = SI.start_log_ingest(spark, src, index_path, attack_path, scratch_path(spark, "w7-ckpt"))
    q.awaitTermination()
    return spark.read.parquet(index_path).select(iso_timestamp("timestamp").alias("timestamp"), "source",
                                                 "destination", "event", "classification")


register("w7_stream_log_ingest", with_logs(f"""
SELECT {iso_sql("date_trunc('second', " + TS + ")")} AS "timestamp", source, destination, event,
  CASE WHEN contains(event, 'APT_attack') THEN 'attaque' ELSE 'normal' END AS classification FROM logs"""))


def _w8(seconds):
    def fn(spark, sf_dir):
        src = _log_parquet_files(spark, sf_dir)
        out = scratch_path(spark, "w8-out")
        q = SW.start_flow_windows(spark, _log_stream(spark, src), out, scratch_path(spark, "w8-ckpt"),
                                  window=f"{seconds} seconds")
        q.awaitTermination()
        res = SW.latest_windows(spark, out)
        return res.select("flow_id", "window_start", "packets", "flow_duration", "flow_packets_per_sec",
                          r6(F.col("flow_mean_time_delta")).alias("flow_mean_time_delta"), "flow_direction_ratio")
    return fn


def _w8_sql(seconds):
    return with_logs(f"""
SELECT flow_id, CAST(b * {seconds} AS BIGINT) AS window_start, count(*) AS packets,
  CASE WHEN count(*) > 1 THEN max(t) - min(t) END AS flow_duration,
  CASE WHEN count(*) > 1 THEN CASE WHEN max(t) - min(t) > 0 THEN count(*) / (max(t) - min(t)) ELSE 0 END END AS flow_packets_per_sec,
  round_even(CASE WHEN count(*) > 1 THEN (max(t) - min(t)) / (count(*) - 1) END, 6) AS flow_mean_time_delta,
  CASE WHEN count(*) > 1 THEN CASE WHEN count_if(p = 'TCP') + count_if(p = 'UDP') > 0
    THEN count_if(p = 'TCP') / (count_if(p = 'TCP') + count_if(p = 'UDP')) ELSE 0.5 END END AS flow_direction_ratio
FROM (SELECT coalesce(source, 'nan') || '_' || coalesce(destination, 'nan') AS flow_id, epoch_us({TS}) / 1e6 AS t,
        upper(coalesce(protocol, 'nan')) AS p, CAST(floor(epoch_us({TS}) / 1e6 / {seconds}) AS BIGINT) AS b FROM logs) x
GROUP BY flow_id, b""")


query("w8_stream_flow_windows_60s")(_w8(60))
register("w8_stream_flow_windows_60s", _w8_sql(60))
query("w8_stream_flow_windows_1d")(_w8(86400))
register("w8_stream_flow_windows_1d", _w8_sql(86400))


SESSION_GAP_S = 7200


@query("w8_stream_flow_sessions")
def w8s(spark, sf_dir):
    """Sessions that the watermark has closed by the end of the stream."""
    src, out = _log_parquet_files(spark, sf_dir), scratch_path(spark, "w8-sessions")
    SW.start_flow_windows(spark, _log_stream(spark, src), out, scratch_path(spark, "w8-sessions-ckpt"), session_gap=f"{SESSION_GAP_S} seconds").awaitTermination()
    micros = F.unix_micros("session_start").alias("session_start_us"), F.unix_micros("session_end").alias("session_end_us")
    return SW.latest_windows(spark, out).select("flow_id", *micros, "packets", "flow_duration", r6(F.col("flow_mean_time_delta")).alias("flow_mean_time_delta"))


register("w8_stream_flow_sessions", with_logs(f"""
SELECT flow_id, min(us) AS session_start_us, max(us) + {SESSION_GAP_S * 1_000_000} AS session_end_us, count(*) AS packets,
  CASE WHEN count(*) > 1 THEN max(t) - min(t) END AS flow_duration,
  round_even(CASE WHEN count(*) > 1 THEN (max(t) - min(t)) / (count(*) - 1) END, 6) AS flow_mean_time_delta
FROM (SELECT *, sum(CASE WHEN us - before <= {SESSION_GAP_S * 1_000_000} THEN 0 ELSE 1 END) OVER (PARTITION BY flow_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS session
      FROM (SELECT coalesce(source, 'nan') || '_' || coalesce(destination, 'nan') AS flow_id, epoch_us({TS}) AS us, epoch_us({TS}) / 1e6 AS t,
              lag(epoch_us({TS})) OVER (PARTITION BY coalesce(source, 'nan') || '_' || coalesce(destination, 'nan') ORDER BY {TS}) AS before FROM logs) a) b
GROUP BY flow_id, session
HAVING max(us) + {SESSION_GAP_S * 1_000_000} <= (SELECT max(epoch_us({TS})) // 1000 * 1000 - 600000000 FROM logs)"""))


@query("w7_quarantine")
def w7q(spark, sf_dir):
    """Lines without a readable time are kept aside, whether or not a place for them was named."""
    path, index_path = scratch_path(spark, "w7-odd-csv"), scratch_path(spark, "w7-odd-index")
    time = F.when(F.col("log_id") % 7 == 0, F.concat(F.lit("at "), F.col("log_id").cast("string"))).otherwise(F.date_format("timestamp", LOG_TIME_FORMAT))
    logs_view(spark, sf_dir).select(time, "source", "destination", "event").write.option("header", False).csv(path)
    SI.start_log_ingest(spark, path, index_path, scratch_path(spark, "w7-odd-attacks"), scratch_path(spark, "w7-odd-ckpt")).awaitTermination()
    lost = spark.read.parquet(SI.quarantine_of(index_path)).select(F.lit("quarantine").alias("store"), F.col("raw").alias("line"))
    return lost.unionByName(spark.read.parquet(index_path).groupBy().count().select(F.lit("index").alias("store"), F.col("count").cast("string").alias("line")))


register("w7_quarantine", with_logs("""
SELECT 'quarantine' AS store, 'at ' || log_id || ',' || source || ',' || destination || ',' || event AS line FROM logs WHERE log_id % 7 = 0
UNION ALL SELECT 'index', CAST(count(*) AS VARCHAR) FROM logs WHERE log_id % 7 <> 0"""))


@query("w9_stream_flow_delta")
def w9(spark, sf_dir):
    src = _log_parquet_files(spark, sf_dir)
    out = scratch_path(spark, "w9-out")
    stream = SD.stream_flow_delta(_log_stream(spark, src), "source", "destination", key_col="log_id")
    q = (stream.writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", scratch_path(spark, "w9-ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out).select(F.col("row_key").alias("log_id"), "flow_id", "time_delta")


register("w9_stream_flow_delta", with_logs(f"""
SELECT log_id, flow_id, t - lag(t) OVER (PARTITION BY flow_id ORDER BY t, log_id) AS time_delta
FROM (SELECT log_id, coalesce(source, 'nan') || '_' || coalesce(destination, 'nan') AS flow_id,
        epoch_us({TS}) / 1e6 AS t FROM logs) x"""))


def _features(spark, sf_dir):
    return flows_view(spark, sf_dir).select("flow_id", *[c(n) for n in S.EXPECTED_FEATURES], "is_apt")


@query("w10_stream_score")
def w10(spark, sf_dir):
    return _stream_scored(spark, sf_dir)[0]


@query("w10_stream_equals_batch")
def w10b(spark, sf_dir):
    """Rows scored on the stream against the same rows scored as a batch by the same model."""
    streamed, model, flows = _stream_scored(spark, sf_dir)
    columns = ["flow_id", "is_apt", "apt_probability", "apt_prediction"]
    batch = M.score(model, flows).select(*columns)
    return streamed.agg(F.count(F.lit(1)).alias("row_count")).join(streamed.select(*columns).exceptAll(batch).agg(F.count(F.lit(1)).alias("differing")))


register("w10_stream_equals_batch", with_flows("SELECT count(*) AS row_count, 0 AS differing FROM flows"))


def _stream_scored(spark, sf_dir):
    flows = _features(spark, sf_dir)
    model = M.fit_scorer(flows, S.EXPECTED_FEATURES, "is_apt", "flow_id")
    src = scratch_path(spark, "w10-in")
    flows.write.parquet(src)
    stream = spark.readStream.schema(flows.schema).option("maxFilesPerTrigger", 2).parquet(src)
    out = scratch_path(spark, "w10-out")
    q = (SM.score_stream(model, stream).select("flow_id", "is_apt", "apt_probability", "apt_prediction")
         .writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", scratch_path(spark, "w10-ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out), model, flows


PERIODS, DROP = 5, 0.002


def _period():
    return (F.col("flow_id") % 100003) % PERIODS


def _monitor(spark, rows, mode, **hooks):
    """Runs the monitor over ``rows`` period after period: each period's files are added to
    the watched folder and one run of the stream takes them as one micro-batch."""
    staged, src = scratch_path(spark, "w-periods"), scratch_path(spark, "w-watched")
    rows.write.partitionBy("period").parquet(staged)
    monitor = SM.StreamMonitor(spark, scratch_path(spark, "w-monitor"), threshold=DROP, buffer_rows=1000, mode=mode, **hooks)
    schema, checkpoint = rows.drop("period").schema, scratch_path(spark, "w-monitor-ckpt")
    for period in range(PERIODS):
        spark.read.schema(schema).parquet(f"{staged}/period={period}").write.parquet(f"{src}/p{period}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(src)
        SM.start_monitor(stream, monitor, checkpoint).awaitTermination()
    return monitor.history()


PER_CTE = f"""per AS (SELECT (flow_id % 100003) % {PERIODS} AS batch, count(*) AS samples,
  coalesce(2.0e0 * count_if(is_apt = 1 AND p = 1) / nullif(count_if(is_apt = 1) + count_if(p = 1), 0), 0) AS f1
  FROM (SELECT *, CASE WHEN "Packet Length Std" / 210.0e0 > 0.5 THEN 1 ELSE 0 END AS p FROM flows) x GROUP BY 1)"""


@query("w1_w4_stream_monitor")
def w1s(spark, sf_dir):
    """A detector whose predictions come with the rows; retrains are recorded only."""
    from huntlake.plans.q_metrics import scored
    rows = scored(spark, sf_dir).select("flow_id", "is_apt", "apt_prediction", _period().alias("period"))
    return _monitor(spark, rows, "buffer").select(
        "batch", "samples", r6(F.col("f1")).alias("f1"), r6(F.col("baseline_f1")).alias("baseline_f1"), "degraded",
        "buffered_rows", "retrained")


register("w1_w4_stream_monitor", with_flows(f"""
SELECT batch, samples, round_even(f1, 6) AS f1, round_even(baseline, 6) AS baseline_f1, degraded, buffered AS buffered_rows,
  retrained FROM walk""", PER_CTE,
    f"""walk AS (
  WITH RECURSIVE w AS (
    SELECT batch, samples, f1, f1 AS baseline, false AS degraded, CAST(0 AS HUGEINT) AS buffered, false AS retrained
    FROM per WHERE batch = 0
    UNION ALL
    SELECT n.batch, n.samples, n.f1, n.baseline, n.f1 < n.baseline - {DROP},
      n.before + CASE WHEN n.f1 < n.baseline - {DROP} THEN n.samples ELSE 0 END,
      n.f1 < n.baseline - {DROP} AND n.before + n.samples >= 1000
    FROM (SELECT s.batch, s.samples, s.f1, CASE WHEN w.retrained THEN s.f1 ELSE w.baseline END AS baseline,
            CASE WHEN w.retrained THEN 0 ELSE w.buffered END AS before
          FROM w JOIN per s ON s.batch = w.batch + 1) n)
  SELECT batch, samples, f1, baseline, degraded, CAST(buffered AS BIGINT) AS buffered, retrained FROM w)"""))


@query("w4_stream_immediate_retrain")
def w4s(spark, sf_dir):
    """A fixed rule scores until a batch is worse than the first; that batch trains a
    boosted model, which scores the batches after it."""
    models = scratch_path(spark, "w4-models")
    prob = c("Packet Length Std") / F.lit(210.0)

    def score(batch, version):
        if version is None:
            return batch.withColumn("apt_prediction", F.when(prob > 0.5, 1).otherwise(0))
        return M.score(PipelineModel.load(f"{models}/{version}"), batch)

    def retrain(rows, version):
        held_in, held_out = hash_split(rows, "flow_id", 0.8)
        model = M.fit_scorer(held_in, S.EXPECTED_FEATURES, "is_apt", "flow_id")
        model.write().overwrite().save(f"{models}/{version}")
        return float(binary_metrics_wide(M.score(model, held_out), "is_apt", "apt_prediction").first()["f1"])

    rows = _features(spark, sf_dir).withColumn("period", _period())
    seen = _monitor(spark, rows, "immediate", score=score, retrain=retrain)
    rule = F.col("model_version").isNull()
    return seen.select("batch", "samples", F.when(rule, r6(F.col("f1"))).alias("rule_f1"), F.when(rule, F.col("retrained")).alias("first_retrain"),
                       (~rule).alias("refitted"), F.when(~rule, F.col("f1") > 0.5).alias("better"))


register("w4_stream_immediate_retrain", with_flows(f"""
SELECT batch, samples, CASE WHEN batch <= coalesce(cut, batch) THEN round_even(f1, 6) END AS rule_f1,
  CASE WHEN batch <= coalesce(cut, batch) THEN batch = coalesce(cut, -1) END AS first_retrain,
  batch > coalesce(cut, batch) AS refitted, CASE WHEN batch > coalesce(cut, batch) THEN true END AS better
FROM per, (SELECT min(batch) AS cut FROM per WHERE f1 < (SELECT f1 FROM per WHERE batch = 0) - {DROP}) q""", PER_CTE))
