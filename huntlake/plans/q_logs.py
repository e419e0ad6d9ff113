"""Queries over the ``logs`` view: rules, keyword/text features, time, network."""

from __future__ import annotations

from pyspark.sql import functions as F

from huntlake import schemas as S
from huntlake.functions import logs as L, time as tfn
from huntlake.functions.cols import c
from huntlake.operators import features as feat, roles
from huntlake.plans.catalog import query, r6
from huntlake.plans.oracle import iso_sql, register, with_logs
from huntlake.sources.tables import logs_view


# --- flagship: attacks per source -------------------------------------------

def attacks_by_source(spark, sf_dir):
    logs = logs_view(spark, sf_dir)
    attacks = logs.withColumn("classification", L.classify_rule("event")) \
                  .where(F.col("classification") == S.LABEL_ATTACK)
    return attacks.groupBy("source").agg(
        F.count(F.lit(1)).alias("attack_count"),
        F.countDistinct("destination").alias("destinations"),
        tfn.iso_timestamp(F.min("timestamp")).alias("first_seen"),
        tfn.iso_timestamp(F.max("timestamp")).alias("last_seen"),
    )


query("attacks_by_source")(attacks_by_source)
register("attacks_by_source", with_logs(f"""
SELECT source, count(*) AS attack_count, count(DISTINCT destination) AS destinations,
  {iso_sql('min("timestamp")')} AS first_seen, {iso_sql('max("timestamp")')} AS last_seen
FROM logs WHERE CASE WHEN contains(event, 'APT_attack') THEN 'attaque' ELSE 'normal' END = 'attaque'
GROUP BY source"""))


# --- P1 / S6 counts -----------------------------------------------------------

@query("p1_classify_rule")
def p1(spark, sf_dir):
    return logs_view(spark, sf_dir).select("log_id", "event", L.classify_rule("event").alias("classification"))


register("p1_classify_rule", with_logs("""
SELECT log_id, event, CASE WHEN contains(event, 'APT_attack') THEN 'attaque' ELSE 'normal' END AS classification
FROM logs"""))


@query("p2_keyword_features")
def p2(spark, sf_dir):
    return logs_view(spark, sf_dir).select("log_id", *L.keyword_features("event"))


def _p2_sql():
    tok = "string_split(lower(event), '_')"

    def has(w):
        return f"list_contains({tok}, '{w}')"

    def cnt(w):
        return f"CAST(len(list_filter({tok}, lambda x: x = '{w}')) AS DOUBLE)"

    def bit(cond):
        return f"CASE WHEN {cond} THEN 1.0e0 ELSE 0.0e0 END"

    cols = {
        "Flow Duration": f"CASE WHEN {has('exfiltration')} THEN 80000.0e0 ELSE 4000.0e0 END",
        "Total Fwd Packet": cnt("fwd"),
        "Total Bwd packets": cnt("bwd"),
        "Flow Bytes/s": f"CASE WHEN {has('exfiltration')} OR {has('c2')} THEN 850.0e0 ELSE 150.0e0 END",
        "Flow Packets/s": f"CASE WHEN {has('scan')} THEN 300.0e0 ELSE 50.0e0 END",
        "Packet Length Mean": f"CASE WHEN {has('ack')} THEN 700.0e0 ELSE 400.0e0 END",
        "Packet Length Std": "50.0e0", "Packet Length Variance": "1200.0e0",
        "FIN Flag Count": bit(has("fin")), "SYN Flag Count": bit(f"{has('syn')} OR {has('scan')}"),
        "RST Flag Count": bit(has("rst")), "PSH Flag Count": bit(has("psh")),
        "ACK Flag Count": bit(has("ack")), "URG Flag Count": "0.0e0",
        "Average Packet Size": "900.0e0", "Fwd Segment Size Avg": "1000.0e0",
        "Bwd Segment Size Avg": "900.0e0",
    }
    sel = ",\n  ".join(f'{expr} AS "{name}"' for name, expr in cols.items())
    return with_logs(f"SELECT log_id,\n  {sel}\nFROM logs")


register("p2_keyword_features", _p2_sql())


@query("p3_text_features")
def p3(spark, sf_dir):
    return logs_view(spark, sf_dir).select("log_id", *L.text_features("event"))


register("p3_text_features", with_logs("""
SELECT log_id, CAST(length(event) AS INTEGER) AS event_length,
  CAST((length(event) - length(replace(event, 'APT_attack', ''))) / length('APT_attack') AS INTEGER) AS marker_count,
  CAST(length(event) - length(replace(event, '_', '')) AS INTEGER) AS underscore_count
FROM logs"""))


@query("p4_anomaly_to_label")
def p4(spark, sf_dir):
    logs = logs_view(spark, sf_dir).select("log_id", *L.text_features("event"))
    return logs.select("log_id", L.anomaly_to_label(F.col("marker_count") > 0).alias("classification"))


register("p4_anomaly_to_label", with_logs("""
SELECT log_id, CASE WHEN length(event) - length(replace(event, 'APT_attack', '')) > 0 THEN 'attaque'
  ELSE 'normal' END AS classification FROM logs"""))


@query("s6_routed_counts")
def s6_counts(spark, sf_dir):
    """S6 routing outcome: rows per destination store (index gets all, attack store the attacks)."""
    logs = logs_view(spark, sf_dir).withColumn("classification", L.classify_rule("event"))
    return logs.groupBy("classification").agg(F.count(F.lit(1)).alias("rows"))


register("s6_routed_counts", with_logs("""
SELECT CASE WHEN contains(event, 'APT_attack') THEN 'attaque' ELSE 'normal' END AS classification,
  count(*) AS "rows" FROM logs GROUP BY 1"""))


@query("s10_iso_timestamp")
def s10(spark, sf_dir):
    return logs_view(spark, sf_dir).select("log_id", tfn.iso_timestamp("timestamp").alias("iso_time"))


register("s10_iso_timestamp", with_logs(f'SELECT log_id, {iso_sql(chr(34) + "timestamp" + chr(34))} AS iso_time FROM logs'))


@query("s12_conform_features")
def s12(spark, sf_dir):
    feats = logs_view(spark, sf_dir).select("log_id", *L.keyword_features("event"))
    partial = feats.drop("URG Flag Count", "Fwd Segment Size Avg", "Bwd Segment Size Avg") \
        .withColumn("unexpected", F.lit(1.0))
    return feat.conform_features(partial, keep=("log_id",))


def _s12_sql():
    src = _p2_sql()
    cols = []
    for name in S.EXPECTED_FEATURES:
        if name in ("URG Flag Count", "Fwd Segment Size Avg", "Bwd Segment Size Avg"):
            cols.append(f'0.0e0 AS "{name}"')
        else:
            cols.append(f'"{name}"')
    # reuse the P2 statement as a sub-select
    return f"SELECT log_id, {', '.join(cols)} FROM ({src}) p2"


register("s12_conform_features", _s12_sql())


# --- time ------------------------------------------------------------------------

@query("t2_t4_time_features")
def t_feats(spark, sf_dir):
    logs = logs_view(spark, sf_dir)
    out = feat.handle_timestamps(logs.select("log_id", "timestamp"), ["timestamp"])
    return out.withColumn("timestamp_days_since_ref", r6(F.col("timestamp_days_since_ref")))


register("t2_t4_time_features", with_logs("""
SELECT log_id, CAST(hour("timestamp") AS INTEGER) AS timestamp_hour, CAST(day("timestamp") AS INTEGER) AS timestamp_day,
  CAST(month("timestamp") AS INTEGER) AS timestamp_month, CAST(isodow("timestamp") - 1 AS INTEGER) AS timestamp_dayofweek,
  CAST(weekofyear("timestamp") AS INTEGER) AS timestamp_weekofyear,
  round_even((epoch_us("timestamp") - epoch_us(TIMESTAMP '2020-01-01 00:00:00')) / 86400e6, 6) AS timestamp_days_since_ref,
  CASE WHEN hour("timestamp") <= 5 THEN 'night' WHEN hour("timestamp") <= 11 THEN 'morning'
       WHEN hour("timestamp") <= 17 THEN 'afternoon' WHEN hour("timestamp") <= 23 THEN 'evening' END
    AS timestamp_time_category
FROM logs"""))


@query("t1_t6_parse_coerce")
def t_parse(spark, sf_dir):
    logs = logs_view(spark, sf_dir)
    text = F.date_format("timestamp", tfn.LOG_TIME_FORMAT)
    junk = F.when(F.col("log_id") % 7 == 0, F.lit("not a time")).otherwise(text)
    return logs.select(
        "log_id",
        tfn.iso_timestamp(tfn.parse_timestamp(text)).alias("parsed"),
        tfn.iso_timestamp(tfn.coerce_timestamp(junk)).alias("coerced"),
    )


register("t1_t6_parse_coerce", with_logs(f"""
SELECT log_id, {iso_sql("date_trunc('second', " + chr(34) + "timestamp" + chr(34) + ")")} AS parsed,
  CASE WHEN log_id % 7 = 0 THEN NULL ELSE {iso_sql("date_trunc('second', " + chr(34) + "timestamp" + chr(34) + ")")} END AS coerced
FROM logs"""))


# --- network -----------------------------------------------------------------

@query("n1_n7_network_features")
def n_feats(spark, sf_dir):
    logs = logs_view(spark, sf_dir).select("log_id", "source", "destination", "dst_port", "protocol")
    out = feat.handle_ip_addresses(logs, ["source", "destination"])
    return feat.handle_ports_and_protocols(out, ["dst_port"], ["protocol"])


def _n_sql():
    def octet(col):
        return f"TRY_CAST(nullif(regexp_extract({col}, '(\\d+)\\.', 1), '') AS DOUBLE)"

    def cat(col):
        return (f"CASE WHEN {col} IS NULL THEN 'unknown' WHEN starts_with({col}, '10.') OR starts_with({col}, '192.168.') "
                f"OR starts_with({col}, '172.') THEN 'private' ELSE 'public' END")
    p = "CAST(dst_port AS DOUBLE)"
    protos = ", ".join(f"coalesce(contains(upper(coalesce(protocol, 'nan')), '{x}'), false) AS protocol_is_{x}"
                       for x in S.PROTOCOLS)
    return with_logs(f"""
SELECT log_id, source, destination, {p} AS dst_port, upper(coalesce(protocol, 'nan')) AS protocol,
  {octet('source')} AS source_first_octet, {cat('source')} AS source_category,
  {octet('destination')} AS destination_first_octet, {cat('destination')} AS destination_category,
  CASE WHEN {p} > -1 AND {p} <= 1023 THEN 'well-known' WHEN {p} > 1023 AND {p} <= 49151 THEN 'registered'
       WHEN {p} > 49151 AND {p} <= 65535 THEN 'dynamic' END AS dst_port_category,
  coalesce({p} IN (22, 23, 53, 80, 443, 445, 3389), false) AS dst_port_is_service,
  {protos}
FROM logs""")


register("n1_n7_network_features", _n_sql())


@query("r1_r4_column_roles")
def r_roles(spark, sf_dir):
    logs = logs_view(spark, sf_dir)
    return roles.column_roles(logs)


register("r1_r4_column_roles", with_logs("""
SELECT * FROM (VALUES ('timestamp', 'time'), ('dst_port', 'port'), ('protocol', 'protocol')) v(column_name, role)
UNION ALL
SELECT column_name, 'ip' AS role FROM (
  SELECT 'source' AS column_name, bool_or(contains(source, '.') AND length(regexp_replace(source, '[^0-9]', '', 'g')) > 3) AS hit FROM logs
  UNION ALL
  SELECT 'destination', bool_or(contains(destination, '.') AND length(regexp_replace(destination, '[^0-9]', '', 'g')) > 3) FROM logs
) WHERE hit"""))


@query("a5_uncommon_port")
def a5(spark, sf_dir):
    from huntlake.functions.heuristics import uncommon_port
    logs = logs_view(spark, sf_dir)
    return logs.select("log_id", "dst_port", uncommon_port(c("dst_port")).alias("uncommon_port"))


register("a5_uncommon_port", with_logs("""
SELECT log_id, dst_port, NOT coalesce(dst_port IN (22, 53, 80, 443, 8080, 8443), false) AS uncommon_port FROM logs"""))
