"""Flow measures per tumbling, sliding or session event-time window on a
stream, with a watermark. Late rows (behind the watermark) are dropped by Spark,
which adds up the rows of a micro-batch per window before it looks at the watermark:
``late_groups`` reports how many such sums each micro-batch dropped.

Output uses update mode through ``foreachBatch``: each micro-batch appends the
windows it changed, tagged with the batch id; ``latest_windows`` keeps the most
recent version of every (flow, window), which equals the batch result once the
stream has caught up. Sessions may still grow and merge until the watermark passes their
end, so they use append mode: each is written once, when it is closed, under its own start
and end. Sessions that are open when the stream stops are in its state, not in the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from huntlake.functions.cols import c
from huntlake.operators.flow import flow_key


def windowed_flow_counts(df: DataFrame, src_col: str, dst_col: str, time_col: str = "timestamp",
                         window: str = "60 seconds", slide: str | None = None, session_gap: str | None = None,
                         protocol_col: str | None = "protocol") -> DataFrame:
    """Per (flow, window): packets, duration, packets/s, mean gap, TCP/UDP ratio. A window is named
    by ``window_start``, a session (``session_gap``) by the times ``session_start`` and ``session_end``.

    The mean gap telescopes to duration / (packets - 1); the std of gaps needs
    row order and is left to the batch operator (H7) or the keyed-state W9.
    """
    keyed = df.withColumn("flow_id", flow_key(src_col, dst_col))
    if session_gap:
        win = F.session_window(c(time_col), session_gap)
    elif slide:
        win = F.window(c(time_col), window, slide)
    else:
        win = F.window(c(time_col), window)
    t = F.unix_micros(c(time_col)).cast("double") / 1e6
    aggs = [F.count(F.lit(1)).alias("packets"), F.min(t).alias("tmin"), F.max(t).alias("tmax")]
    if protocol_col:
        up = F.upper(F.coalesce(c(protocol_col), F.lit("nan")))
        aggs += [F.count_if(up == "TCP").alias("tcp"), F.count_if(up == "UDP").alias("udp")]
    g = keyed.groupBy(win.alias("window"), F.col("flow_id")).agg(*aggs)
    n, dur = F.col("packets"), F.col("tmax") - F.col("tmin")
    single = n <= 1
    named = [F.col("window.start").alias("session_start"), F.col("window.end").alias("session_end")] if session_gap else [
        (F.unix_micros(F.col("window.start")) / 1_000_000).cast("long").alias("window_start")]
    cols = [
        F.col("flow_id"),
        *named,
        n.alias("packets"),
        F.when(single, None).otherwise(dur).alias("flow_duration"),
        F.when(single, None).otherwise(F.when(dur > 0, n / dur).otherwise(F.lit(0.0))).alias("flow_packets_per_sec"),
        F.when(single, None).otherwise(dur / (n - 1)).alias("flow_mean_time_delta"),
    ]
    if protocol_col:
        tot = F.col("tcp") + F.col("udp")
        cols.append(F.when(single, None).otherwise(F.when(tot > 0, F.col("tcp") / tot).otherwise(F.lit(0.5)))
                    .alias("flow_direction_ratio"))
    return g.select(*cols)


def start_flow_windows(spark: SparkSession, stream: DataFrame, out_path: str, checkpoint: str,
                       src_col: str = "source", dst_col: str = "destination", window: str = "60 seconds",
                       available_now: bool = True, session_gap: str | None = None, **kwargs):
    """Start W8 writing versions of changed windows, or closed sessions, to ``out_path``."""
    agg = windowed_flow_counts(stream, src_col, dst_col, window=window, session_gap=session_gap, **kwargs)

    def sink(batch: DataFrame, batch_id: int) -> None:
        # a folder of its own: a micro-batch without rows still leaves a file with the columns, so the result can be read back empty
        batch.write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/batch_id={batch_id}")

    writer = agg.writeStream.outputMode("append" if session_gap else "update").foreachBatch(sink).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def latest_windows(spark: SparkSession, out_path: str) -> DataFrame:
    """The newest version of each (flow, window) written by ``start_flow_windows``; sessions have one."""
    versions = spark.read.parquet(out_path)
    if "session_start" in versions.columns:
        return versions.drop("batch_id")
    cols = [n for n in versions.columns if n not in ("flow_id", "window_start", "batch_id")]
    latest = versions.groupBy("flow_id", "window_start").agg(
        F.max_by(F.struct(*cols), F.col("batch_id")).alias("v"))
    return latest.select("flow_id", "window_start", "v.*")


def late_groups(query) -> dict[int, int]:
    """{micro-batch: groups of late rows dropped behind the watermark}, for the micro-batches
    whose progress Spark still holds (``spark.sql.streaming.numRecentProgressUpdates``)."""
    return {p["batchId"]: sum(op["numRowsDroppedByWatermark"] for op in p["stateOperators"]) for p in query.recentProgress}
