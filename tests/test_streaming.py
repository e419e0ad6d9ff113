"""Streaming = batch: several micro-batches, one late row,
and a restart from the checkpoint without duplicates."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from huntlake.functions.time import LOG_TIME_FORMAT
from huntlake.operators import flow as FL
from huntlake.session import scratch_path
from huntlake.sources.tables import logs_view
from huntlake.streaming import delta as SD, ingest as SI, monitor as SM, windows as SW

SMALL = "/root/testdata/sf0.001"


def _day_files(spark, fmt="parquet"):
    """The log view as one folder per day, written in time order."""
    logs = logs_view(spark, SMALL)
    base = scratch_path(spark, "stream-days")
    days = sorted(r[0] for r in logs.select(F.to_date("timestamp")).distinct().collect())
    for i, d in enumerate(days):
        part = logs.where(F.to_date("timestamp") == F.lit(d)).coalesce(1)
        if fmt == "parquet":
            part.write.parquet(f"{base}/d{i:03d}")
        else:
            part.select(F.date_format("timestamp", LOG_TIME_FORMAT), "source", "destination", "event") \
                .write.option("header", False).csv(f"{base}/d{i:03d}")
    return base, len(days)


def test_windows_multi_batch_equal_batch(spark):
    base, n_days = _day_files(spark)
    schema = logs_view(spark, SMALL).schema
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 3)
              .option("recursiveFileLookup", True).parquet(base).withWatermark("timestamp", "3650 days"))
    out = scratch_path(spark, "stream-win")
    q = SW.start_flow_windows(spark, stream, out, scratch_path(spark, "stream-win-ckpt"), window="86400 seconds")
    q.awaitTermination()
    assert spark.read.parquet(out).select("batch_id").distinct().count() > 1
    got = {(r["flow_id"], r["window_start"]): r["packets"] for r in SW.latest_windows(spark, out).collect()}
    batch = FL.flow_window_agg(logs_view(spark, SMALL), "source", "destination", "timestamp", window_seconds=86400,
                               order_key="log_id")
    want = {(r["flow_id"], r["window_start"]): r["packets"] for r in batch.collect()}
    assert got == want


def test_late_row_is_dropped(spark):
    schema = "timestamp timestamp, source string, destination string, protocol string"
    base = scratch_path(spark, "late")
    t0 = dt.datetime(2024, 1, 1, 12, 0)
    spark.createDataFrame([(t0, "a", "b", "tcp"), (t0 + dt.timedelta(hours=2), "a", "b", "tcp")], schema) \
        .coalesce(1).write.parquet(f"{base}/f1")
    stream = (spark.readStream.schema(spark.read.parquet(f"{base}/f1").schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", True).parquet(base).withWatermark("timestamp", "10 minutes"))
    out, ckpt = scratch_path(spark, "late-out"), scratch_path(spark, "late-ckpt")
    SW.start_flow_windows(spark, stream, out, ckpt, window="60 seconds").awaitTermination()
    # second file: one row far behind the watermark, one new row
    spark.createDataFrame([(t0 - dt.timedelta(hours=1), "a", "b", "tcp"), (t0 + dt.timedelta(hours=3), "a", "b", "tcp")],
                          schema).coalesce(1).write.parquet(f"{base}/f2")
    stream = (spark.readStream.schema(spark.read.parquet(f"{base}/f1").schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", True).parquet(base).withWatermark("timestamp", "10 minutes"))
    q = SW.start_flow_windows(spark, stream, out, ckpt, window="60 seconds")
    q.awaitTermination()
    assert sum(SW.late_groups(q).values()) == 1
    starts = {r["window_start"] for r in SW.latest_windows(spark, out).collect()}
    late = int((t0 - dt.timedelta(hours=1)).replace(tzinfo=dt.timezone.utc).timestamp())
    assert late not in starts and len(starts) == 3


def test_ingest_restart_no_duplicates(spark):
    base, _ = _day_files(spark, fmt="csv")
    index, attacks, ckpt = scratch_path(spark, "ri"), scratch_path(spark, "ra"), scratch_path(spark, "rc")
    reader_path = base + "/*"
    SI.start_log_ingest(spark, reader_path, index, attacks, ckpt, max_files_per_trigger=4).awaitTermination()
    first = spark.read.parquet(index).count()
    SI.start_log_ingest(spark, reader_path, index, attacks, ckpt, max_files_per_trigger=4).awaitTermination()
    assert spark.read.parquet(index).count() == first == logs_view(spark, SMALL).count()
    n_att = logs_view(spark, SMALL).where(F.col("event").contains("APT_attack")).count()
    assert spark.read.parquet(attacks).count() == n_att


def test_keyed_state_delta_multi_batch_equal_batch(spark):
    base, _ = _day_files(spark)
    schema = logs_view(spark, SMALL).schema
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 2)
              .option("recursiveFileLookup", True).parquet(base).withWatermark("timestamp", "3650 days"))
    out = scratch_path(spark, "sd")
    q = (SD.stream_flow_delta(stream, "source", "destination", key_col="log_id").writeStream.format("parquet")
         .option("path", out).option("checkpointLocation", scratch_path(spark, "sd-ckpt"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = {r["row_key"]: r["time_delta"] for r in spark.read.parquet(out).collect()}
    batch = FL.flow_features(logs_view(spark, SMALL), "source", "destination", "timestamp", order_key="log_id")
    want = {r["log_id"]: r["time_delta"] for r in batch.collect()}
    # the stream cannot know a flow stays single-row, so it keeps NULL only for first rows
    assert all(got[k] == v for k, v in want.items() if v is not None)
    assert os.path.basename(out)


def test_ingest_quarantines_bad_lines(spark):
    base = scratch_path(spark, "bad-lines")
    spark.createDataFrame([("2024-01-01 00:00:01", "10.0.0.1", "10.0.0.2", "APT_attack_port_scan"),
                           ("yesterday", "10.0.0.1", "10.0.0.2", "user_login")],
                          "t string, s string, d string, e string").coalesce(1) \
        .write.option("header", False).csv(base)
    index, attacks, quarantine = scratch_path(spark, "qi"), scratch_path(spark, "qa"), scratch_path(spark, "qq")
    SI.start_log_ingest(spark, base, index, attacks, scratch_path(spark, "qc"),
                        quarantine_path=quarantine).awaitTermination()
    assert spark.read.parquet(index).count() == 1 and spark.read.parquet(attacks).count() == 1
    assert [r["raw"] for r in spark.read.parquet(quarantine).collect()] == ["yesterday,10.0.0.1,10.0.0.2,user_login"]


def _monitor_batch(spark, hits, misses):
    rows = [(1, 1)] * hits + [(1, 0)] * misses + [(0, 0)] * 10
    return spark.createDataFrame(rows, "is_apt int, apt_prediction int")


def test_monitor_survives_a_failure_between_its_writes(spark):
    good, bad = _monitor_batch(spark, 20, 0), _monitor_batch(spark, 10, 10)
    seen = []

    def retrain(rows, version):
        seen.append(rows.count())
        if len(seen) == 1:
            raise RuntimeError("executor lost")  # after the buffer write, before the history row
        return 0.9

    m = SM.StreamMonitor(spark, scratch_path(spark, "mon"), threshold=0.1, buffer_rows=50, retrain=retrain)
    assert m.history().count() == 0
    m(good, 0)
    m(bad, 1)
    with pytest.raises(RuntimeError):
        m(bad, 2)
    m(bad, 2)
    m(bad, 2)  # a replay of a recorded batch
    m(bad, 3)  # sets the new baseline
    m(_monitor_batch(spark, 0, 20), 4)
    got = [(r.batch, r.degraded, r.buffered_rows, r.retrained, r.model_version) for r in m.history().orderBy("batch").collect()]
    assert got == [(0, False, 0, False, None), (1, True, 30, False, None), (2, True, 60, True, None),
                   (3, False, 0, False, 2), (4, True, 30, False, 2)]
    assert seen == [60, 60]


def test_monitor_immediate_takes_the_new_f1_as_baseline(spark):
    good, bad = _monitor_batch(spark, 20, 0), _monitor_batch(spark, 10, 10)
    m = SM.StreamMonitor(spark, scratch_path(spark, "mon"), mode="immediate", retrain=lambda rows, version: 0.6)
    for i, batch in enumerate([good, bad, bad, spark.createDataFrame([], good.schema)]):
        m(batch, i)
    got = [(r.degraded, r.retrained, round(r.baseline_f1, 3)) for r in m.history().orderBy("batch").collect()]
    assert got == [(False, False, 1.0), (True, True, 1.0), (False, False, 0.6)]
    with pytest.raises(ValueError):
        SM.StreamMonitor(spark, "x", mode="never")


def test_sessions_merge_over_batches_and_equal_the_batch_result(spark):
    src, schema = scratch_path(spark, "sessions"), "timestamp timestamp, source string, destination string, protocol string"
    from datetime import datetime, timedelta
    start = datetime(2024, 1, 1)
    # a: 0 and 100 are apart by more than the gap until 50 arrives; b: two sessions; the last rows close all
    files = [[(0, "a"), (100, "a"), (0, "b")], [(50, "a"), (500, "b")], [(5000, "z")], [(9000, "z")]]
    out, checkpoint = scratch_path(spark, "sessions-out"), scratch_path(spark, "sessions-ckpt")
    rows = []
    for k, part in enumerate(files):
        made = [(start + timedelta(seconds=t), s, "x", "tcp") for t, s in part]
        rows += made
        spark.createDataFrame(made, schema).coalesce(1).write.parquet(f"{src}/f{k}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(src).withWatermark("timestamp", "200 seconds")
        SW.start_flow_windows(spark, stream, out, checkpoint, session_gap="60 seconds").awaitTermination()
    got = {tuple(r) for r in SW.latest_windows(spark, out).select("flow_id", "session_start", "session_end", "packets", "flow_duration").collect()}
    batch = SW.windowed_flow_counts(spark.createDataFrame(rows, schema), "source", "destination", session_gap="60 seconds")
    want = {tuple(r) for r in batch.select("flow_id", "session_start", "session_end", "packets", "flow_duration").collect() if r.session_start < start + timedelta(seconds=8000)}
    assert got == want and ("a_x", start, start + timedelta(seconds=160), 3, 100.0) in got and len(got) == 4


def test_lines_without_a_time_are_kept_without_a_named_place(spark):
    from huntlake.streaming import ingest
    src, index = scratch_path(spark, "odd-lines"), scratch_path(spark, "odd-index")
    spark.createDataFrame([("never", "a", "b", "user_login"), (None, "c", "d", "APT_attack_x")], "t string, s string, d string, e string").write.csv(src)
    ingest.start_log_ingest(spark, src, index, scratch_path(spark, "odd-attacks"), scratch_path(spark, "odd-ckpt")).awaitTermination()
    assert {r.raw for r in spark.read.parquet(ingest.quarantine_of(index)).collect()} == {"never,a,b,user_login", "c,d,APT_attack_x"}


def test_sessions_that_all_stay_open_give_an_empty_result(spark):
    src, schema = scratch_path(spark, "open-sessions"), "timestamp timestamp, source string, destination string, protocol string"
    start = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(start + dt.timedelta(seconds=s), "a", "x", "TCP") for s in range(0, 600, 30)], schema).write.parquet(src)
    out, stream = scratch_path(spark, "open-sessions-out"), spark.readStream.schema(schema).parquet(src).withWatermark("timestamp", "10 minutes")
    SW.start_flow_windows(spark, stream, out, scratch_path(spark, "open-sessions-ckpt"), session_gap="60 seconds").awaitTermination()
    found = SW.latest_windows(spark, out)
    assert found.columns[:4] == ["flow_id", "session_start", "session_end", "packets"] and found.count() == 0
