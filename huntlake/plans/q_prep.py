"""Queries: fitted preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from huntlake import schemas as S
from huntlake.functions.cols import c, zero_safe_ratio
from huntlake.functions.logs import classify_rule
from huntlake.operators import encode as E, impute as I, label as LB, scale as Z
from huntlake.plans.catalog import query, r6
from huntlake.plans.oracle import register, with_flows, with_logs
from huntlake.sources.tables import flows_view, logs_view

FEATS = S.EXPECTED_FEATURES


def _flows17(spark, sf_dir):
    return flows_view(spark, sf_dir).select("flow_id", *[c(n) for n in FEATS])


def _logs_cat(spark, sf_dir):
    logs = logs_view(spark, sf_dir)
    return logs.select("log_id", "source", "event", "protocol",
                       F.col("dst_port").cast("string").alias("port_text"),
                       classify_rule("event").alias("classification"))


LOGS_CAT_CTE = """lc AS (SELECT log_id, source, event, protocol, CAST(dst_port AS VARCHAR) AS port_text,
  CASE WHEN contains(event, 'APT_attack') THEN 'attaque' ELSE 'normal' END AS classification FROM logs)"""


# --- missing values ------------------------------------------------------------------

@query("i1_impute_mean")
def i1(spark, sf_dir):
    out = I.impute_mean(_flows17(spark, sf_dir), exclude=("flow_id",))
    return out.select("flow_id", *[r6(c(n)).alias(n) for n in FEATS])


def _fill_sql(agg):
    cols = ", ".join(f'round_even(coalesce("{n}", (SELECT {agg.format(x=chr(34) + n + chr(34))} FROM flows)), 6) AS "{n}"'
                     for n in FEATS)
    return with_flows(f"SELECT flow_id, {cols} FROM flows")


register("i1_impute_mean", _fill_sql("avg({x})"))


@query("i2_impute_median")
def i2(spark, sf_dir):
    out = I.impute_median(_flows17(spark, sf_dir), exclude=("flow_id",))
    return out.select("flow_id", *[r6(c(n)).alias(n) for n in FEATS])


register("i2_impute_median", _fill_sql("quantile_cont({x}, 0.5)"))


@query("i4_impute_mode")
def i4(spark, sf_dir):
    out = I.impute_mode(_logs_cat(spark, sf_dir).select("log_id", "port_text"), exclude=())
    return out


register("i4_impute_mode", with_logs("""
SELECT log_id, coalesce(port_text, (SELECT port_text FROM lc WHERE port_text IS NOT NULL
  GROUP BY port_text ORDER BY count(*) DESC, port_text LIMIT 1)) AS port_text FROM lc""", LOGS_CAT_CTE))


@query("i5_impute_constant")
def i5(spark, sf_dir):
    return I.impute_constant(_logs_cat(spark, sf_dir).select("log_id", "port_text"))


register("i5_impute_constant", with_logs("SELECT log_id, coalesce(port_text, 'unknown') AS port_text FROM lc",
                                         LOGS_CAT_CTE))


@query("i6_zero_safe_ratio")
def i6(spark, sf_dir):
    f = _flows17(spark, sf_dir)
    return f.select("flow_id", zero_safe_ratio(c("Flow Bytes/s"), c("Packet Length Mean")).alias("bytes_per_len"))


register("i6_zero_safe_ratio", with_flows("""
SELECT flow_id, coalesce("Flow Bytes/s" / nullif("Packet Length Mean", 0), 0) AS bytes_per_len FROM flows"""))


# --- encoding ------------------------------------------------------------------------

CAT_COLS = ["source", "event", "protocol", "port_text", "classification"]


@query("e1_value_counts")
def e1(spark, sf_dir):
    return E.value_counts(_logs_cat(spark, sf_dir), CAT_COLS)


register("e1_value_counts", with_logs(" UNION ALL ".join(
    f"SELECT '{n}' AS column_name, {n} AS value, count(*) AS count FROM lc WHERE {n} IS NOT NULL GROUP BY {n}"
    for n in CAT_COLS), LOGS_CAT_CTE))


@query("e2_top_k_other")
def e2(spark, sf_dir):
    df = _logs_cat(spark, sf_dir)
    info = E.fit_categories(df, ["source", "event"])
    return df.select("log_id", E.top_k_other(c("source"), info["source"]).alias("source"),
                     E.top_k_other(c("event"), info["event"]).alias("event"))


TOP_SOURCE_CTE = """top AS (SELECT source FROM lc WHERE source IS NOT NULL GROUP BY source
  ORDER BY count(*) DESC, source LIMIT 10)"""

register("e2_top_k_other", with_logs("""
SELECT log_id, CASE WHEN source IN (SELECT source FROM top) THEN source ELSE 'other' END AS source, event
FROM lc""", LOGS_CAT_CTE, TOP_SOURCE_CTE))


@query("e3_onehot_drop_first")
def e3(spark, sf_dir):
    df = _logs_cat(spark, sf_dir).select("log_id", "event", "protocol", "port_text")
    return E.encode_categorical(df, "onehot")


def _onehot_sql():
    events = sorted(S.NORMAL_EVENTS + S.ATTACK_EVENTS)
    protos = sorted(["tcp", "udp", "icmp"])
    ports = sorted(str(p) for p in [22, 23, 53, 80, 443, 445, 3389, 8080, 1024, 50000])
    cols = [f"coalesce(event = '{v}', false) AS \"event_{v}\"" for v in events[1:]]
    cols += [f"coalesce(protocol = '{v}', false) AS \"protocol_{v}\"" for v in protos[1:]]
    cols += [f"coalesce(port_text = '{v}', false) AS \"port_text_{v}\"" for v in ports[1:]]
    return with_logs(f"SELECT log_id, {', '.join(cols)} FROM lc", LOGS_CAT_CTE)


register("e3_onehot_drop_first", _onehot_sql())


@query("e4_label_encode")
def e4(spark, sf_dir):
    df = _logs_cat(spark, sf_dir).select("log_id", "source", "event", "port_text")
    return E.encode_categorical(df, "label")


register("e4_label_encode", with_logs("""
SELECT log_id,
  CAST(CASE WHEN s IS NULL THEN -1 ELSE (SELECT count(DISTINCT s2) FROM (SELECT CASE WHEN source IN (SELECT source FROM top)
       THEN source ELSE 'other' END AS s2 FROM lc) q WHERE s2 < s) END AS INTEGER) AS source,
  CAST(CASE WHEN event IS NULL THEN -1 ELSE (SELECT count(DISTINCT e2.event) FROM lc e2 WHERE e2.event < lc2.event) END AS INTEGER) AS event,
  CAST(CASE WHEN port_text IS NULL THEN -1 ELSE (SELECT count(DISTINCT p2.port_text) FROM lc p2 WHERE p2.port_text < lc2.port_text) END AS INTEGER) AS port_text
FROM (SELECT log_id, event, port_text, CASE WHEN source IN (SELECT source FROM top) THEN source ELSE 'other' END AS s
      FROM lc) lc2""", LOGS_CAT_CTE, TOP_SOURCE_CTE))


@query("e5_binary_encode")
def e5(spark, sf_dir):
    df = _logs_cat(spark, sf_dir).select("log_id", "classification", "protocol")
    return E.encode_categorical(df, "binary")


register("e5_binary_encode", with_logs("""
SELECT log_id, CAST(classification = (SELECT classification FROM lc GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
  AS INTEGER) AS classification, protocol FROM lc""", LOGS_CAT_CTE))


@query("e6_onehot_align")
def e6(spark, sf_dir):
    df = _logs_cat(spark, sf_dir).select("log_id", "event")
    model = E.CategoricalEncoder(["event"], method="onehot").fit(df)
    attacks = df.where(F.col("event").startswith("APT_attack"))
    return model.transform(attacks)


def _e6_sql():
    events = sorted(S.NORMAL_EVENTS + S.ATTACK_EVENTS)
    cols = [f"coalesce(event = '{v}', false) AS \"event_{v}\"" for v in events[1:]]
    return with_logs(f"SELECT log_id, {', '.join(cols)} FROM lc WHERE starts_with(event, 'APT_attack')",
                     LOGS_CAT_CTE)


register("e6_onehot_align", _e6_sql())


# --- scaling -------------------------------------------------------------------------

@query("z1_scale_standard")
def z1(spark, sf_dir):
    out = Z.scale_standard(_flows17(spark, sf_dir), exclude=("flow_id",))
    return out.select("flow_id", *[r6(c(n)).alias(n) for n in FEATS])


def _scale_sql(center, scale, where_fit="", where_apply=""):
    stats = ", ".join(f'{center.format(x=chr(34) + n + chr(34))} AS c{i}, {scale.format(x=chr(34) + n + chr(34))} AS s{i}'
                      for i, n in enumerate(FEATS))
    cols = ", ".join(f'round_even(("{n}" - c{i}) / coalesce(nullif(s{i}, 0), 1), 6) AS "{n}"' for i, n in enumerate(FEATS))
    return with_flows(f"SELECT flow_id, {cols} FROM flows, (SELECT {stats} FROM flows {where_fit}) st {where_apply}")


register("z1_scale_standard", _scale_sql("avg({x})", "stddev_pop({x})"))


@query("z2_scale_robust")
def z2(spark, sf_dir):
    out = Z.scale_robust(_flows17(spark, sf_dir), exclude=("flow_id",))
    return out.select("flow_id", *[r6(c(n)).alias(n) for n in FEATS])


register("z2_scale_robust", _scale_sql("quantile_cont({x}, 0.5)",
                                       "(quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25))"))


@query("z3_fit_then_transform")
def z3(spark, sf_dir):
    flows = flows_view(spark, sf_dir).select("flow_id", "Stage", *[c(n) for n in FEATS])
    model = Z.Scaler(FEATS, method="robust").fit(flows.where(F.col("Stage") == "normal"))
    out = model.transform(flows.where(F.col("Stage") != "normal"))
    return out.select("flow_id", *[r6(c(n)).alias(n) for n in FEATS])


register("z3_fit_then_transform", _scale_sql(
    "quantile_cont({x}, 0.5)", "(quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25))",
    where_fit="WHERE \"Stage\" = 'normal'", where_apply="WHERE \"Stage\" <> 'normal'"))


# --- labelling -----------------------------------------------------------------------

@query("l1_label_from_stage")
def l1(spark, sf_dir):
    flows = flows_view(spark, sf_dir).select("flow_id", "Stage")
    return LB.label_from_stage(flows, target="label")


register("l1_label_from_stage", with_flows("""
SELECT flow_id, "Stage", CAST(coalesce(contains(lower("Stage"), 'exfiltration'), false) AS INTEGER) AS label FROM flows"""))

FLOW_COLS_R4 = ["Flow Duration", "Total Fwd Packet", "Flow Bytes/s", "Flow Packets/s", "Packet Length Mean",
                "Packet Length Std", "Packet Length Variance", "Average Packet Size"]


def _outlier_sql_cte():
    stats = ", ".join(f'avg("{n}") AS m{i}, stddev_samp("{n}") AS s{i}' for i, n in enumerate(FLOW_COLS_R4))
    terms = " + ".join(f'CASE WHEN abs(("{n}" - m{i}) / nullif(s{i}, 0)) > 2.5 THEN 1 ELSE 0 END'
                       for i, n in enumerate(FLOW_COLS_R4))
    return (f"oc AS (SELECT flow_id, CAST({terms} AS INTEGER) AS outlier_count "
            f"FROM flows, (SELECT {stats} FROM flows) st)")


@query("l2_l3_outlier_label")
def l23(spark, sf_dir):
    df = _flows17(spark, sf_dir)
    out = LB.label_from_outliers(LB.zscore_outlier_count(df), target="label")
    return out.select("flow_id", "outlier_count", "label")


register("l2_l3_outlier_label", with_flows(
    "SELECT flow_id, outlier_count, CASE WHEN outlier_count >= 3 THEN 1 ELSE 0 END AS label FROM oc",
    _outlier_sql_cte()))


@query("l4_label_balance")
def l4(spark, sf_dir):
    df = _flows17(spark, sf_dir)
    out = LB.label_statistical(df, target="label")
    return out.select("flow_id", "outlier_count", "label")


register("l4_label_balance", with_flows("""
SELECT flow_id, outlier_count,
  CASE WHEN rate > 0.1 OR pos = 0 THEN CASE WHEN outlier_count >= p95 THEN 1 ELSE 0 END ELSE l3 END AS label
FROM (SELECT *, CASE WHEN outlier_count >= 3 THEN 1 ELSE 0 END AS l3 FROM oc) x,
     (SELECT avg(CASE WHEN outlier_count >= 3 THEN 1.0 ELSE 0.0 END) AS rate,
             sum(CASE WHEN outlier_count >= 3 THEN 1 ELSE 0 END) AS pos,
             quantile_cont(outlier_count, 0.95) AS p95 FROM oc) st""", _outlier_sql_cte()))


@query("l1_l4_label_auto")
def l_auto(spark, sf_dir):
    """Labels by the stage where there is one, else by the outliers of the features."""
    staged = LB.label_auto(flows_view(spark, sf_dir).select("flow_id", "Stage")).select("flow_id", F.lit("stage").alias("branch"), "is_apt")
    return staged.unionByName(LB.label_auto(_flows17(spark, sf_dir)).select("flow_id", F.lit("outliers").alias("branch"), "is_apt"))


register("l1_l4_label_auto", with_flows("""
SELECT flow_id, 'stage' AS branch, CAST(coalesce(contains(lower("Stage"), 'exfiltration'), false) AS INTEGER) AS is_apt FROM flows
UNION ALL
SELECT flow_id, 'outliers', CASE WHEN rate > 0.1 OR pos = 0 THEN CASE WHEN outlier_count >= p95 THEN 1 ELSE 0 END ELSE l3 END
FROM (SELECT *, CASE WHEN outlier_count >= 3 THEN 1 ELSE 0 END AS l3 FROM oc) x,
     (SELECT avg(CASE WHEN outlier_count >= 3 THEN 1.0 ELSE 0.0 END) AS rate,
             sum(CASE WHEN outlier_count >= 3 THEN 1 ELSE 0 END) AS pos,
             quantile_cont(outlier_count, 0.95) AS p95 FROM oc) st""", _outlier_sql_cte()))


@query("l5_label_variance_p95")
def l5(spark, sf_dir):
    df = _flows17(spark, sf_dir)
    return LB.label_variance_p95(df, target="label").select("flow_id", "label")


register("l5_label_variance_p95", with_flows("""
SELECT flow_id, CASE WHEN "Packet Length Variance" > (SELECT quantile_cont("Packet Length Variance", 0.95) FROM flows)
  THEN 1 ELSE 0 END AS label FROM flows"""))


@query("i3_impute_knn")
def i3(spark, sf_dir):
    """I3 on the whole flow table (every row is a donor); checked against a NumPy
    brute force in tests/test_operators.py (the SQL form is a full cross product)."""
    from huntlake.operators.knn import impute_knn
    out = impute_knn(_flows17(spark, sf_dir), FEATS, "flow_id", k=5)
    return out.select("flow_id", r6(c("Flow Bytes/s")).alias("Flow Bytes/s"))
