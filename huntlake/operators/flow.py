"""Keyed, time-ordered flow operators (H1-H8).

Scale design (one flow may hold a third of all rows):

* Rows are split by (flow, time bucket), and a bucket that holds very many rows into
  slices of time by its volume. ``lag`` runs inside each of them, so a hot flow spreads
  over many tasks, however short the time it was busy. The statistics branch shuffles only the key
  columns (flow, bucket, time, order key) by the same (flow, bucket) key; the
  row branch carries the input columns once.
* A small table with one row per (flow, bucket) carries what crosses bucket
  borders: the previous bucket's last time (the first row's predecessor) and the
  partial sums of deltas. Flow statistics are exact sums over that table
  (the mean of consecutive deltas telescopes to duration / (n - 1); the sample
  std comes from the sum and sum of squares of all deltas).
* Statistics return to the rows through the (flow, bucket) key that the rows are
  already partitioned by, so the row side is not shuffled again for the join
  (the statistics side is one row per flow and bucket: broadcast by AQE when
  small, otherwise shuffled to match).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from huntlake.functions.cols import c
from huntlake.functions.time import epoch_seconds

FLOW_FEATURES = ["flow_packets_count", "flow_duration", "flow_packets_per_sec",
                 "flow_mean_time_delta", "flow_std_time_delta", "flow_direction_ratio"]

HOT_ROWS = 1_000_000       # rows of a (flow, time bucket) beyond which it is cut
SLICES = 64                # slices of time for each HOT_ROWS rows, so that a burst inside the bucket spreads too
MAX_SLICES = 1 << 20
HOT_BUCKETS = 10_000       # heaviest buckets that are cut


def flow_key(src: str | Column, dst: str | Column) -> Column:
    """H1: ``src_dst`` text key; missing parts become text so no row is dropped."""
    s = c(src) if isinstance(src, str) else src
    d = c(dst) if isinstance(dst, str) else dst
    return F.concat_ws("_", F.coalesce(s.cast("string"), F.lit("nan")),
                       F.coalesce(d.cast("string"), F.lit("nan")))


def _with_buckets(df: DataFrame, key_col: str, time_col: str, order_key: str, bucket_seconds: int, hot_rows: int) -> DataFrame:
    """Adds __t (epoch s) and __b, a bucket that grows with time within a flow.

    A (flow, time bucket) with more than ``hot_rows`` rows is cut into equal slices of time,
    ``SLICES`` for each ``hot_rows`` rows it holds, so that its volume decides over how many
    tasks it spreads; rows without a time are cut by a hash. Only the heaviest
    ``HOT_BUCKETS`` are cut, which bounds the broadcast: one below them holds less than
    that share of all rows.
    """
    wide = F.lit(float(bucket_seconds))
    base = df.withColumn("__t", epoch_seconds(c(time_col)))
    base = base.withColumn("__h", F.coalesce(F.floor(F.col("__t") / wide).cast("long"), F.lit(-1)))
    heavy = base.groupBy(c(key_col).alias("__hk"), F.col("__h").alias("__hh")).agg(F.count(F.lit(1)).alias("__hn")) \
        .where(F.col("__hn") > hot_rows).orderBy(F.desc("__hn"), "__hk", "__hh").limit(HOT_BUCKETS) \
        .select("__hk", "__hh", F.least(F.ceil(F.col("__hn") / hot_rows) * SLICES, F.lit(MAX_SLICES)).alias("__parts"))
    base = base.join(F.broadcast(heavy), (c(key_col) == F.col("__hk")) & (F.col("__h") == F.col("__hh")), "left")
    slice_ = F.when(F.col("__t").isNull(), F.pmod(F.xxhash64(c(order_key)), F.col("__parts"))) \
        .otherwise(F.least(F.floor((F.col("__t") / wide - F.col("__h")) * F.col("__parts")), F.col("__parts") - 1))
    return base.withColumn("__b", F.col("__h") * MAX_SLICES + F.coalesce(slice_, F.lit(0))).drop("__h", "__hk", "__hh", "__parts")


def _bucketed_lag(df: DataFrame, key_col: str, time_col: str, order_key: str,
                  bucket_seconds: int, hot_rows: int) -> DataFrame:
    """Adds __t (epoch s), __b (bucket) and __d (delta to the previous row in the bucket)."""
    base = _with_buckets(df, key_col, time_col, order_key, bucket_seconds, hot_rows)
    w = Window.partitionBy(c(key_col), F.col("__b")).orderBy(F.col("__t"), c(order_key))
    return base.withColumn("__d", F.col("__t") - F.lag("__t").over(w))


def _bucket_table(lagged: DataFrame, key_col: str, protocol_col: str | None,
                  extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per (flow, bucket): counts, bounds, delta sums, carry-in from the
    previous bucket of the same group (the flow, or the flow and ``extra`` keys)."""
    aggs = [F.count(F.lit(1)).alias("__n"), F.min("__t").alias("__tmin"), F.max("__t").alias("__tmax"),
            F.sum("__d").alias("__sd"), F.sum(F.col("__d") * F.col("__d")).alias("__sdd")]
    if protocol_col:
        aggs += [F.count_if(c(protocol_col) == "TCP").alias("__tcp"),
                 F.count_if(c(protocol_col) == "UDP").alias("__udp")]
    fb = lagged.groupBy(c(key_col).alias("__k"), *[F.col(e) for e in extra], F.col("__b").alias("__kb")).agg(*aggs)
    wb = Window.partitionBy("__k", *extra).orderBy("__kb")
    fb = fb.withColumn("__carry", F.lag("__tmax").over(wb))
    return fb.withColumn("__cross", F.col("__tmin") - F.col("__carry"))


def _measures(n: Column, tmin: Column, tmax: Column, sd: Column, sdd: Column,
              tcp: Column | None, udp: Column | None) -> list[Column]:
    duration = tmax - tmin
    m = n - 1  # number of deltas
    mean = F.try_divide(sd, m.cast("double"))
    var = F.try_divide(sdd - F.try_divide(sd * sd, m.cast("double")), (m - 1).cast("double"))
    std = F.sqrt(F.greatest(var, F.lit(0.0)))
    single = n <= 1

    def only_multi(x: Column) -> Column:
        return F.when(single, F.lit(None)).otherwise(x)

    cols = [
        only_multi(n).cast("long").alias("flow_packets_count"),
        only_multi(duration).cast("double").alias("flow_duration"),
        only_multi(F.when(duration > 0, n / duration).otherwise(F.lit(0.0))).cast("double")
        .alias("flow_packets_per_sec"),
        only_multi(mean).cast("double").alias("flow_mean_time_delta"),
        only_multi(F.when(m >= 2, std)).cast("double").alias("flow_std_time_delta"),
    ]
    if tcp is not None:
        total = tcp + udp
        ratio = F.when(total > 0, tcp / total).otherwise(F.lit(0.5))
        cols.append(only_multi(ratio).cast("double").alias("flow_direction_ratio"))
    return cols


def _flow_table(fb: DataFrame, has_proto: bool, extra: tuple[str, ...] = ()) -> DataFrame:
    aggs = [F.sum("__n").alias("n"), F.min("__tmin").alias("tmin"), F.max("__tmax").alias("tmax"),
            (F.coalesce(F.sum("__sd"), F.lit(0.0)) + F.coalesce(F.sum("__cross"), F.lit(0.0))).alias("sd"),
            (F.coalesce(F.sum("__sdd"), F.lit(0.0))
             + F.coalesce(F.sum(F.col("__cross") * F.col("__cross")), F.lit(0.0))).alias("sdd")]
    if has_proto:
        aggs += [F.sum("__tcp").alias("tcp"), F.sum("__udp").alias("udp")]
    g = fb.groupBy("__k", *extra).agg(*aggs)
    return g.select("__k", *extra, F.col("n").alias("__packets"),
                    *_measures(F.col("n"), F.col("tmin"), F.col("tmax"), F.col("sd"), F.col("sdd"),
                               F.col("tcp") if has_proto else None, F.col("udp") if has_proto else None))


def flow_features(df: DataFrame, src_col: str = "source_ip", dst_col: str = "destination_ip",
                  time_col: str = "timestamp", order_key: str | None = None,
                  protocol_col: str | None = "protocol", key_col: str = "flow_id",
                  bucket_seconds: int = 3600, hot_rows: int = HOT_ROWS) -> DataFrame:
    """H1-H6, H8: per-row ``time_delta`` plus per-flow statistics on every row.

    Flows of one row get no statistics and no delta (NULL), like the detector.
    ``flow_direction_ratio`` needs a protocol column and compares 'TCP'/'UDP'
    case-sensitively (apply N6 first for lower-case input).
    """
    if not all(x in df.columns for x in (src_col, dst_col, time_col)):
        return df
    order_key = order_key or time_col
    proto = protocol_col if protocol_col and protocol_col in df.columns else None
    keyed = df.withColumn(key_col, flow_key(src_col, dst_col))
    lagged = _bucketed_lag(keyed, key_col, time_col, order_key, bucket_seconds, hot_rows)
    fb = _bucket_table(lagged, key_col, proto)
    # flow totals as window sums over the (small) bucket table: same partitioning as
    # the carry window, so no second aggregation and join of that table
    wf = Window.partitionBy("__k")
    cross = F.coalesce(F.col("__cross"), F.lit(0.0))
    per_bucket = fb.select(
        "__k", "__kb", "__carry",
        *_measures(F.sum("__n").over(wf), F.min("__tmin").over(wf), F.max("__tmax").over(wf),
                   F.coalesce(F.sum("__sd").over(wf), F.lit(0.0)) + F.sum(cross).over(wf),
                   F.coalesce(F.sum("__sdd").over(wf), F.lit(0.0)) + F.sum(cross * cross).over(wf),
                   F.sum("__tcp").over(wf) if proto else None, F.sum("__udp").over(wf) if proto else None))
    flows = per_bucket
    out = lagged.join(per_bucket, (c(key_col) == F.col("__k")) & (F.col("__b") == F.col("__kb")), "left")
    delta = F.when(F.col("flow_packets_count").isNull(), F.lit(None)) \
        .otherwise(F.coalesce(F.col("__d"), F.col("__t") - F.col("__carry"))).cast("double")
    keep = [c(n) for n in keyed.columns]
    feats = [F.col(n) for n in FLOW_FEATURES if n in flows.columns]
    return out.select(*keep, delta.alias("time_delta"), *feats)


def flow_stats(df: DataFrame, src_col: str, dst_col: str, time_col: str,
               order_key: str | None = None, protocol_col: str | None = "protocol",
               key_col: str = "flow_id", bucket_seconds: int = 3600, hot_rows: int = HOT_ROWS) -> DataFrame:
    """H4-H6 as one row per flow (the aggregate behind ``flow_features``)."""
    order_key = order_key or time_col
    proto = protocol_col if protocol_col and protocol_col in df.columns else None
    keyed = df.withColumn(key_col, flow_key(src_col, dst_col))
    lagged = _bucketed_lag(keyed, key_col, time_col, order_key, bucket_seconds, hot_rows)
    flows = _flow_table(_bucket_table(lagged, key_col, proto), proto is not None)
    return flows.drop("__packets").withColumnRenamed("__k", key_col)


def flow_window_agg(df: DataFrame, src_col: str, dst_col: str, time_col: str,
                    window_seconds: int = 60, order_key: str | None = None,
                    protocol_col: str | None = "protocol", key_col: str = "flow_id", hot_rows: int = HOT_ROWS) -> DataFrame:
    """H7: the flow measures per flow and tumbling window of ``window_seconds``.

    Output: flow key, window_start (epoch seconds), packets, measures (NULL for a
    window holding a single row). Long windows are cut into sub-buckets of at
    most an hour (when the window is a whole number of hours) with the same
    carry-over as ``flow_features``, and a heavy one into slices of time.
    """
    order_key = order_key or time_col
    proto = protocol_col if protocol_col and protocol_col in df.columns else None
    sub = 3600 if window_seconds > 3600 and window_seconds % 3600 == 0 else window_seconds
    keyed = df.withColumn(key_col, flow_key(src_col, dst_col))
    lagged = _bucketed_lag(keyed, key_col, time_col, order_key, sub, hot_rows)
    lagged = lagged.withColumn("__w", (F.floor(F.col("__t") / window_seconds) * window_seconds).cast("long"))
    fb = _bucket_table(lagged, key_col, proto, extra=("__w",))
    flows = _flow_table(fb, proto is not None, extra=("__w",))
    feats = [n for n in FLOW_FEATURES if n in flows.columns]
    return flows.select(F.col("__k").alias(key_col), F.col("__w").alias("window_start"),
                        F.col("__packets").alias("packets"), *feats)


def flow_union(*frames: DataFrame) -> DataFrame:
    """H8: concatenation of per-flow frames with possibly different columns."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
