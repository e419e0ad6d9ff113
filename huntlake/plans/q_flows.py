"""Queries: flow operators on ``logs`` (H1-H8) and threat heuristics on ``flows``."""

from __future__ import annotations

from pyspark.sql import functions as F

from huntlake import schemas as S
from huntlake.functions.cols import c
from huntlake.functions.net import protocol_upper
from huntlake.operators import flow as FL
from huntlake.operators.heuristics import engineer_apt_features
from huntlake.plans.catalog import query, r6
from huntlake.plans.oracle import register, with_flows, with_logs
from huntlake.sources.tables import flows_view, logs_view

EXACT_FEATS = ["flow_duration", "flow_packets_per_sec", "flow_direction_ratio"]
AGG_FEATS = ["flow_mean_time_delta", "flow_std_time_delta"]


def _feats():
    """Per-flow measures: exact arithmetic passes through, aggregated sums are rounded."""
    return [F.col(n) for n in EXACT_FEATS] + [r6(F.col(n)).alias(n) for n in AGG_FEATS]


def _logs_upper(spark, sf_dir):
    logs = logs_view(spark, sf_dir)
    return logs.select("log_id", "timestamp", "source", "destination",
                       protocol_upper("protocol").alias("protocol"))


@query("h1_h6_flow_features")
def h_features(spark, sf_dir):
    out = FL.flow_features(_logs_upper(spark, sf_dir), "source", "destination", "timestamp",
                           order_key="log_id", protocol_col="protocol")
    return out.select("log_id", "flow_id", "time_delta",
                      "flow_packets_count", *_feats())


_L_CTE = """l AS (SELECT log_id, coalesce(source, 'nan') || '_' || coalesce(destination, 'nan') AS flow_id,
  epoch_us("timestamp") / 1e6 AS t, upper(coalesce(protocol, 'nan')) AS protocol FROM logs)"""


def _measures_sql(n="n", dur="dur", dmean="dmean", dstd="dstd", tcp="tcp", udp="udp"):
    one = f"CASE WHEN {n} > 1 THEN"
    return f"""{one} {n} END AS flow_packets_count,
  {one} {dur} END AS flow_duration,
  {one} CASE WHEN {dur} > 0 THEN {n} / {dur} ELSE 0 END END AS flow_packets_per_sec,
  round_even({one} {dmean} END, 6) AS flow_mean_time_delta,
  round_even({one} {dstd} END, 6) AS flow_std_time_delta,
  {one} CASE WHEN {tcp} + {udp} > 0 THEN {tcp} / ({tcp} + {udp}) ELSE 0.5 END END AS flow_direction_ratio"""


register("h1_h6_flow_features", with_logs(f"""
SELECT d.log_id, d.flow_id, CASE WHEN n > 1 THEN dl END AS time_delta,
  {_measures_sql()}
FROM d JOIN s USING (flow_id)""", _L_CTE,
    "d AS (SELECT *, t - lag(t) OVER (PARTITION BY flow_id ORDER BY t, log_id) AS dl FROM l)",
    """s AS (SELECT flow_id, count(*) AS n, max(t) - min(t) AS dur, avg(dl) AS dmean, stddev_samp(dl) AS dstd,
  count_if(protocol = 'TCP') AS tcp, count_if(protocol = 'UDP') AS udp FROM d GROUP BY flow_id)"""))


@query("h4_h6_flow_stats")
def h_stats(spark, sf_dir):
    out = FL.flow_stats(_logs_upper(spark, sf_dir), "source", "destination", "timestamp",
                        order_key="log_id", protocol_col="protocol")
    return out.select("flow_id", "flow_packets_count", *_feats())


register("h4_h6_flow_stats", with_logs(f"""
SELECT flow_id, {_measures_sql()}
FROM (SELECT flow_id, count(*) AS n, max(t) - min(t) AS dur, avg(dl) AS dmean, stddev_samp(dl) AS dstd,
  count_if(protocol = 'TCP') AS tcp, count_if(protocol = 'UDP') AS udp FROM d GROUP BY flow_id) s""", _L_CTE,
    "d AS (SELECT *, t - lag(t) OVER (PARTITION BY flow_id ORDER BY t, log_id) AS dl FROM l)"))


def _window_query(seconds):
    def fn(spark, sf_dir):
        out = FL.flow_window_agg(_logs_upper(spark, sf_dir), "source", "destination", "timestamp",
                                 window_seconds=seconds, order_key="log_id", protocol_col="protocol")
        return out.select("flow_id", "window_start", "packets", "flow_packets_count",
                          *_feats())
    return fn


def _window_sql(seconds):
    return with_logs(f"""
SELECT flow_id, b * {seconds} AS window_start, count(*) AS packets,
  {_measures_sql(n="count(*)", dur="(max(t) - min(t))", dmean="avg(dl)", dstd="stddev_samp(dl)",
                 tcp="count_if(protocol = 'TCP')", udp="count_if(protocol = 'UDP')")}
FROM d GROUP BY flow_id, b""", _L_CTE,
        f"b0 AS (SELECT *, CAST(floor(t / {seconds}) AS BIGINT) AS b FROM l)",
        "d AS (SELECT *, t - lag(t) OVER (PARTITION BY flow_id, b ORDER BY t, log_id) AS dl FROM b0)")


query("h7_flow_window_60s")(_window_query(60))
register("h7_flow_window_60s", _window_sql(60))
query("h7_flow_window_1d")(_window_query(86400))
register("h7_flow_window_1d", _window_sql(86400))


@query("h8_flow_union")
def h_union(spark, sf_dir):
    """Per-protocol flow frames (the UDP/ICMP one has no direction ratio) concatenated by name."""
    logs = _logs_upper(spark, sf_dir)
    tcp = FL.flow_features(logs.where(F.col("protocol") == "TCP"), "source", "destination", "timestamp",
                           order_key="log_id", protocol_col="protocol")
    other = FL.flow_features(logs.where(F.col("protocol") != "TCP").drop("protocol"), "source",
                             "destination", "timestamp", order_key="log_id", protocol_col=None)
    out = FL.flow_union(tcp, other)
    return out.select("log_id", "flow_id", "flow_packets_count", "flow_duration", "flow_direction_ratio")


register("h8_flow_union", with_logs("""
SELECT log_id, flow_id, CASE WHEN n > 1 THEN n END AS flow_packets_count,
  CASE WHEN n > 1 THEN dur END AS flow_duration,
  CASE WHEN n > 1 AND g = 'TCP' THEN 1.0e0 END AS flow_direction_ratio
FROM (SELECT *, count(*) OVER (PARTITION BY g, flow_id) AS n,
             max(t) OVER (PARTITION BY g, flow_id) - min(t) OVER (PARTITION BY g, flow_id) AS dur
      FROM (SELECT *, CASE WHEN protocol = 'TCP' THEN 'TCP' ELSE 'OTHER' END AS g FROM l) x) y""", _L_CTE))


# --- A1-A9 on flows ----------------------------------------------------------------

HEUR_DOUBLES = ["flow_time_regularity", "total_flags", "packet_size_variation"]
HEUR_FLAGS = ["is_long_connection", "is_scan_connection", "potential_beaconing", "potential_data_exfil",
              "unusual_flags", "high_size_variation", "is_exfiltration"]


@query("a1_a9_threat_heuristics")
def a_heur(spark, sf_dir):
    flows = flows_view(spark, sf_dir).select("flow_id", *[c(n) for n in S.EXPECTED_FEATURES], "Stage")
    out = engineer_apt_features(flows, exact=True)
    return out.select("flow_id", *HEUR_FLAGS, *HEUR_DOUBLES)


def _a_sql():
    ratio = 'coalesce("Packet Length Std" / nullif("Packet Length Mean", 0), 0)'
    flags = " + ".join(f'coalesce("{n}", 0)' for n in S.EXPECTED_FEATURES if "Flag Count" in n)
    return with_flows(f"""
SELECT flow_id,
  coalesce("Flow Duration" > 600, false) AS is_long_connection,
  coalesce("Flow Duration" < 1, false) AS is_scan_connection,
  {ratio} AS flow_time_regularity,
  coalesce({ratio} < 0.1, false) AS potential_beaconing,
  coalesce("Flow Bytes/s" > q, false) AS potential_data_exfil,
  0.0e0 + {flags} AS total_flags,
  coalesce("RST Flag Count" > 0 AND "ACK Flag Count" = 0, false) AS unusual_flags,
  {ratio} AS packet_size_variation,
  coalesce({ratio} > 0.5, false) AS high_size_variation,
  CAST(coalesce(contains(lower("Stage"), 'exfiltration'), false) AS INTEGER) AS is_exfiltration
FROM flows, (SELECT quantile_cont("Flow Bytes/s", 0.95) AS q FROM flows) thr""")


register("a1_a9_threat_heuristics", _a_sql())


@query("a2_a3_flow_beaconing")
def a_beacon(spark, sf_dir):
    """A2/A3 on real flow statistics: regularity of inter-arrival times per log flow."""
    out = FL.flow_features(_logs_upper(spark, sf_dir), "source", "destination", "timestamp",
                           order_key="log_id", protocol_col="protocol")
    out = engineer_apt_features(out.select("log_id", "flow_id", "flow_duration", "flow_mean_time_delta",
                                           "flow_std_time_delta"))
    return out.select("log_id", "is_long_connection", "is_scan_connection", "potential_beaconing",
                      r6(F.col("flow_time_regularity")).alias("flow_time_regularity"))


register("a2_a3_flow_beaconing", with_logs("""
SELECT log_id, coalesce(dur > 600, false) AS is_long_connection, coalesce(dur < 1, false) AS is_scan_connection,
  coalesce(coalesce(dstd / nullif(dmean, 0), 0) < 0.1, false) AS potential_beaconing,
  round_even(coalesce(dstd / nullif(dmean, 0), 0), 6) AS flow_time_regularity
FROM (SELECT d.log_id, CASE WHEN n > 1 THEN s.dur END AS dur, CASE WHEN n > 1 THEN dmean END AS dmean,
        CASE WHEN n > 1 THEN dstd END AS dstd FROM d JOIN s USING (flow_id)) z""", _L_CTE,
    "d AS (SELECT *, t - lag(t) OVER (PARTITION BY flow_id ORDER BY t, log_id) AS dl FROM l)",
    """s AS (SELECT flow_id, count(*) AS n, max(t) - min(t) AS dur, avg(dl) AS dmean, stddev_samp(dl) AS dstd
  FROM d GROUP BY flow_id)"""))
