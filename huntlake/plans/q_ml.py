"""Queries: models (M1-M15) and sampling.

Boosted trees are fitted with the library's rounds and early stopping on all labelled rows.
The forest of the stage classifier (M10) is fitted on at most ``FIT_ROWS`` rows, drawn by a
hash of the key; everything else reads the whole tables.
"""

from __future__ import annotations

import json

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from huntlake import schemas as S
from huntlake.functions import logs as L
from huntlake.functions.cols import c
from huntlake.models import classifier as M, tuning as U
from huntlake.models.encoder import LinearAutoencoder, encoded_columns, reconstruction_error_column
from huntlake.models.iforest import IsolationForest
from huntlake.models.preprocess import preprocess_pipeline
from huntlake.operators import metrics as V, sample as X
from huntlake.operators.scale import Scaler
from huntlake.plans.catalog import query, r6
from huntlake.plans.oracle import register, with_flows, with_logs
from huntlake.sources.tables import flows_view, logs_view

FEATS = S.EXPECTED_FEATURES


def _flows_model_input(spark, sf_dir):
    """The 17 features with missing values imputed (I2), as the detector feeds its models."""
    from huntlake.operators.impute import impute_median
    df = flows_view(spark, sf_dir).select("flow_id", *[c(n) for n in FEATS], "Stage", "is_apt")
    return impute_median(df, FEATS)


# --- M1 ------------------------------------------------------------------------------

@query("m1_isolation_forest")
def m1(spark, sf_dir):
    logs = logs_view(spark, sf_dir).select("log_id", "event", *L.text_features("event"))
    cols = ["event_length", "marker_count", "underscore_count"]
    model = IsolationForest(cols, key="log_id").fit(logs)
    out = model.transform(logs)
    return out.select("log_id", "event", "anomaly_score", "is_anomaly",
                      L.anomaly_to_label("is_anomaly").alias("classification"))


# --- M2-M7 ---------------------------------------------------------------------------

def _scaled_flows(spark, sf_dir):
    df = _flows_model_input(spark, sf_dir)
    return Scaler(FEATS, method="robust").fit(df).transform(df)


@query("m2_m4_encoder")
def m2(spark, sf_dir):
    df = _scaled_flows(spark, sf_dir)
    model = LinearAutoencoder(FEATS).fit(df)
    k = len(model.get_state()["components"])
    out = model.transform(df)
    return out.select("flow_id", "reconstruction_error", "is_anomaly", *[f"encoded_{i}" for i in range(k)])


# Fixed literal encoder (2 components x 3 features) shared by the Spark query and its SQL.
FIXED_ENCODER = {
    "cols": ["Packet Length Mean", "Packet Length Std", "Flow Packets/s"],
    "mean": [400.0, 110.0, 25.0],
    "components": [[0.6, 0.8, 0.0], [0.0, 0.0, 1.0]],
}


def _lit(v: float) -> str:
    t = repr(float(v))
    return t if ("e" in t or "inf" in t or "nan" in t) else t + "e0"


def _fixed_error_sql() -> str:
    """Same arithmetic, in the same order, as ``reconstruction_error_column``."""
    st = FIXED_ENCODER
    ys = [f"(coalesce(\"{name}\", 0.0e0) - {_lit(st['mean'][j])})" for j, name in enumerate(st["cols"])]
    y2 = "0.0e0"
    for y in ys:
        y2 = f"({y2} + {y} * {y})"
    e2 = "0.0e0"
    for e in _fixed_encoded_sql(bare=True):
        e2 = f"({e2} + {e} * {e})"
    return f"(greatest({y2} - {e2}, 0.0e0) / {_lit(len(st['cols']))})"


def _fixed_encoded_sql(bare: bool = False) -> list[str]:
    st = FIXED_ENCODER
    out = []
    for i, comp in enumerate(st["components"]):
        e = "0.0e0"
        for j, name in enumerate(st["cols"]):
            if comp[j] != 0.0:
                e = f"({e} + {_lit(comp[j])} * (coalesce(\"{name}\", 0.0e0) - {_lit(st['mean'][j])}))"
        out.append(e if bare else f"{e} AS encoded_{i}")
    return out


@query("m3_reconstruction_error")
def m3(spark, sf_dir):
    df = flows_view(spark, sf_dir)
    return df.select("flow_id", r6(reconstruction_error_column(FIXED_ENCODER)).alias("reconstruction_error"),
                     *[r6(col).alias(f"encoded_{i}") for i, col in enumerate(encoded_columns(FIXED_ENCODER))])


register("m3_reconstruction_error", with_flows(
    f"SELECT flow_id, round_even({_fixed_error_sql()}, 6) AS reconstruction_error, "
    + ", ".join(f"round_even({e.rsplit(' AS ', 1)[0]}, 6) AS {e.rsplit(' AS ', 1)[1]}" for e in _fixed_encoded_sql())
    + " FROM flows"))


@query("m5_m6_anomaly_threshold")
def m5(spark, sf_dir):
    df = flows_view(spark, sf_dir).select("flow_id", reconstruction_error_column(FIXED_ENCODER))
    thr = V.anomaly_threshold(df, "reconstruction_error", 0.95)
    return df.select("flow_id", F.lit(thr).alias("threshold"),
                     (F.col("reconstruction_error") > F.lit(thr)).alias("is_anomaly")) \
        .withColumn("threshold", r6(F.col("threshold")))


register("m5_m6_anomaly_threshold", with_flows(f"""
SELECT flow_id, round_even(t, 6) AS threshold, e > t AS is_anomaly
FROM (SELECT flow_id, {_fixed_error_sql()} AS e FROM flows) x,
     (SELECT quantile_cont({_fixed_error_sql()}, 0.95) AS t FROM flows) q"""))


@query("m2b_deep_encoder")
def m2b(spark, sf_dir):
    """The non-linear encoder, trained and applied; four mini-batches an epoch."""
    from huntlake.models.deep_encoder import DeepAutoencoder
    df = _scaled_flows(spark, sf_dir)
    out = DeepAutoencoder(FEATS, key="flow_id", steps=4).fit(df).transform(df)
    return out.select("flow_id", "reconstruction_error", "is_anomaly", *[n for n in out.columns if n.startswith("encoded_")])


@query("m7_stack_features")
def m7(spark, sf_dir):
    from huntlake.models.encoder import stack_features
    df = _scaled_flows(spark, sf_dir)
    model = LinearAutoencoder(FEATS, k=4).fit(df)
    out = stack_features(model.transform(df), FEATS, k=4)
    return out.select("flow_id", vector_to_array("features").alias("features"))


# --- M8-M14 --------------------------------------------------------------------------

def _scorer(spark, sf_dir):
    """(boosted trees fitted on a training split, all flows)."""
    data = flows_view(spark, sf_dir).select("flow_id", *[c(n) for n in FEATS], "is_apt")
    train, _ = X.hash_split(data, "flow_id", 0.8, 42)
    return M.fit_scorer(train, FEATS, "is_apt", "flow_id"), data


@query("m8_m9_score")
def m9(spark, sf_dir):
    model, data = _scorer(spark, sf_dir)
    return M.score(model, data).select("flow_id", "is_apt", "apt_probability", "apt_prediction")


@query("m9_score")
def m9b(spark, sf_dir):
    """Fit and score; the fit is part of the query."""
    model, data = _scorer(spark, sf_dir)
    return M.score(model, data.drop("is_apt")).select("flow_id", "apt_probability", "apt_prediction")


@query("m10_stage_classifier")
def m10(spark, sf_dir):
    flows = _flows_model_input(spark, sf_dir)
    model = M.stage_classifier().fit(M.bounded_rows(flows, "flow_id", M.FIT_ROWS))
    logs = logs_view(spark, sf_dir).select("log_id", "event", *L.keyword_features("event"))
    return M.predict_stage(model, logs).select("log_id", "event", "predicted_stage")


@query("m11_feature_importance")
def m11(spark, sf_dir):
    model, _ = _scorer(spark, sf_dir)
    return M.feature_importance(model.stages[-1], top_n=20)


@query("m12_explain_rows")
def m12(spark, sf_dir):
    model, data = _scorer(spark, sf_dir)
    flagged = M.score(model, data).where(F.col("apt_prediction") == 1)
    return M.explain_rows(model.stages[-1], flagged, "flow_id", top_k=5)


@query("m13_tune")
def m13(spark, sf_dir):
    """50 trials over the whole space, valued on all held-out rows."""
    rows = M.with_validation_flag(flows_view(spark, sf_dir).select("flow_id", *[c(n) for n in FEATS], "is_apt"), "flow_id")
    _, tried = U.tune(rows, FEATS, "is_apt", "is_validation", "flow_id", n_trials=50)
    found = [(k, json.dumps(p, sort_keys=True), v, n) for k, (p, v, n) in enumerate(tried)]
    return spark.createDataFrame(found, "trial int, params string, validation_auc double, rounds int")


@query("m13_tuning_invariants")
def m13_invariants(spark, sf_dir):
    """All trials of the tuning: how many, all parameters in range, the best no worse than the first, an AUC for each."""
    found = m13(spark, sf_dir).withColumn("p", F.from_json("params", ", ".join(f"{d.name} {'string' if d.choices else 'double'}" for d in U.SPACE)))
    inside = F.lit(True)
    for d in U.SPACE:
        x = F.col(f"p.{d.name}")
        inside = inside & (x.isin(*d.choices) if d.choices else (x >= d.low) & (x <= d.high))
    auc = F.col("validation_auc")
    return found.agg(F.count(F.lit(1)).alias("trials"), F.count_if(inside).alias("in_range"), F.count_if((auc > 0.5) & (auc <= 1)).alias("valued"),
                     (F.max(auc) >= F.max(F.when(F.col("trial") == 0, auc))).alias("best_is_best"))


register("m13_tuning_invariants", "SELECT 50 AS trials, 50 AS in_range, 50 AS valued, true AS best_is_best")

# Cut points of the one-split model, and a tree over two features, shared by the queries and their SQL.
SPLIT_CUTS = {"Total Fwd Packet": [60.0, 120.0, 160.0, 200.0], "Flow Bytes/s": [10000.0, 30000.0, 60000.0], "RST Flag Count": [0.0]}
FIXED_TREE = {"feat": [0, -1, 1, -1, -1], "thr": [150.0, 0.0, 0.0, 0.0, 0.0], "left": [1, -1, 3, -1, -1], "right": [2, -1, 4, -1, -1], "value": [0.0, -0.5, 0.0, 0.25, 1.5],
              "cover": [100.0, 70.0, 30.0, 10.0, 20.0], "gain": [1.0, 0.0, 1.0, 0.0, 0.0], "missing_left": [True, False, True, False, False]}


@query("m8_first_split")
def m8_first_split(spark, sf_dir):
    """The one split of a tree of depth 1 over given cut points: feature, threshold, gain, side of missing values, leaf values and covers."""
    from huntlake.models import boosting as B
    cuts = list(SPLIT_CUTS.values())
    blocks = B.packed_blocks(flows_view(spark, sf_dir), list(SPLIT_CUTS), "is_apt", cuts, "flow_id")
    (run,) = B.fit_many(blocks, cuts, [{"rounds": 1, "depth": 1, "subsample": 1.0, "colsample": 1.0, "eta": 1.0}])
    t = run.trees[0]
    row = (list(SPLIT_CUTS)[t["feat"][0]], float(t["thr"][0]), float(t["gain"][0]), bool(t["missing_left"][0]), *[float(t[k][n]) for n in (1, 2) for k in ("value", "cover")])
    found = spark.createDataFrame([row], "feature string, threshold double, gain double, missing_left boolean, left_value double, left_cover double, right_value double, right_cover double")
    return found.select(*[r6(F.col(n)).alias(n) if t == "double" else n for n, t in found.dtypes])


def _split_candidates() -> str:
    return " UNION ALL ".join(
        f"""SELECT {i} AS f, '{name}' AS feature, {k} AS k, {cut}e0 AS threshold, {to_left} AS missing_left, CAST(is_apt AS DOUBLE) AS y,
        CASE WHEN "{name}" IS NULL THEN {to_left} ELSE "{name}" <= {cut}e0 END AS goes_left FROM flows"""
        for i, (name, cuts) in enumerate(SPLIT_CUTS.items()) for k, cut in enumerate(cuts) for to_left in ("false", "true"))


# alpha 0.1 and lambda 1; at margin 0 a row has gradient 0.5 - y and hessian 0.25
register("m8_first_split", with_flows("""
SELECT feature, threshold, round_even(gain, 6) AS gain, missing_left, round_even(-gl / (hl + 1), 6) AS left_value, round_even(hl, 6) AS left_cover,
  round_even(-gr / (hr + 1), 6) AS right_value, round_even(hr, 6) AS right_cover
FROM (SELECT *, gl * gl / (hl + 1) + gr * gr / (hr + 1) - gt * gt / (hl + hr + 1) AS gain
      FROM (SELECT f, k, feature, threshold, missing_left, hl, hr, sign(l) * greatest(abs(l) - 0.1e0, 0) AS gl, sign(r) * greatest(abs(r) - 0.1e0, 0) AS gr,
              sign(l + r) * greatest(abs(l + r) - 0.1e0, 0) AS gt FROM sides) a)
WHERE hl >= 1 AND hr >= 1 ORDER BY round_even(gain, 6) DESC, f, missing_left, k LIMIT 1""",
    f"""sides AS (SELECT f, feature, k, threshold, missing_left, sum(CASE WHEN goes_left THEN 0.5e0 - y ELSE 0 END) AS l, sum(CASE WHEN goes_left THEN 0 ELSE 0.5e0 - y END) AS r,
  sum(CASE WHEN goes_left THEN 0.25e0 ELSE 0 END) AS hl, sum(CASE WHEN goes_left THEN 0 ELSE 0.25e0 END) AS hr
  FROM ({_split_candidates()}) c GROUP BY f, feature, k, threshold, missing_left)"""))


@query("m12_shapley_fixed_tree")
def m12_fixed(spark, sf_dir):
    """Shapley values of a given tree for every flow, missing values included."""
    from huntlake.models.boosting import BoostedTreesModel
    names = ["Total Fwd Packet", "RST Flag Count"]
    told = M.explain_rows(BoostedTreesModel.from_state({"features": names, "trees": [FIXED_TREE]}), flows_view(spark, sf_dir), "flow_id", top_k=2)

    def own(name):
        return F.filter("top_contributions", lambda t: t["name"] == name)[0]["contribution"]

    return told.select("flow_id", r6(F.col("base_value")).alias("base_value"), r6(F.col("raw_margin")).alias("raw_margin"), r6(own(names[0])).alias("packets"), r6(own(names[1])).alias("resets"))


# The Shapley value of two features from the four expectations of the tree.
register("m12_shapley_fixed_tree", with_flows("""
SELECT flow_id, round_even(e0, 6) AS base_value, round_even(e12, 6) AS raw_margin, round_even(((e1 - e0) + (e12 - e2)) / 2, 6) AS packets,
  round_even(((e2 - e0) + (e12 - e1)) / 2, 6) AS resets
FROM (SELECT flow_id, 0.7e0 * -0.5e0 + 0.1e0 * 0.25e0 + 0.2e0 * 1.5e0 AS e0, CASE WHEN a THEN -0.5e0 ELSE 0.25e0 / 3 + 1.5e0 * 2 / 3 END AS e1,
        0.7e0 * -0.5e0 + 0.3e0 * CASE WHEN b THEN 0.25e0 ELSE 1.5e0 END AS e2, CASE WHEN a THEN -0.5e0 WHEN b THEN 0.25e0 ELSE 1.5e0 END AS e12
      FROM (SELECT flow_id, coalesce("Total Fwd Packet" <= 150, true) AS a, coalesce("RST Flag Count" <= 0, true) AS b FROM flows) x) y"""))


@query("m14_train_detector")
def m14(spark, sf_dir):
    df = _flows_model_input(spark, sf_dir)
    _, _, metrics = M.train_detector(df, target="is_apt", key="flow_id")
    return metrics


# --- M15 -----------------------------------------------------------------------------

@query("m15_preprocess_flows")
def m15(spark, sf_dir):
    df = flows_view(spark, sf_dir).select("flow_id", "flow_start", *[c(n) for n in FEATS], "Stage", "is_apt")
    model = preprocess_pipeline(target="is_apt", exclude=("flow_id",)).fit(df)
    out = model.transform(df)
    return out.select("flow_id", r6(c("Flow Bytes/s")).alias("Flow Bytes/s"), "potential_data_exfil",
                      "Stage_lateral", "Stage_normal", r6(c("is_exfiltration")).alias("is_exfiltration"))


register("m15_preprocess_flows", with_flows("""
SELECT flow_id, round_even((fb - m) / coalesce(nullif(iqr, 0), 1), 6) AS "Flow Bytes/s",
  coalesce(fb > p95, false) AS potential_data_exfil,
  coalesce("Stage" = 'lateral', false) AS "Stage_lateral", coalesce("Stage" = 'normal', false) AS "Stage_normal",
  round_even((ex - em) / coalesce(nullif(eiqr, 0), 1), 6) AS is_exfiltration
FROM imp, st""", """imp AS (SELECT flow_id, coalesce("Flow Bytes/s", (SELECT quantile_cont("Flow Bytes/s", 0.5) FROM flows)) AS fb,
  "Stage", CAST(coalesce(contains(lower("Stage"), 'exfiltration'), false) AS INTEGER) AS ex FROM flows)""",
    """st AS (SELECT quantile_cont(fb, 0.5) AS m, quantile_cont(fb, 0.75) - quantile_cont(fb, 0.25) AS iqr,
  quantile_cont(fb, 0.95) AS p95, quantile_cont(ex, 0.5) AS em, quantile_cont(ex, 0.75) - quantile_cont(ex, 0.25) AS eiqr
  FROM imp)"""))


# --- X1-X4 ---------------------------------------------------------------------------

@query("x1_stratified_split")
def x1(spark, sf_dir):
    df = flows_view(spark, sf_dir).select("flow_id", "is_apt")
    train, test = X.stratified_split(df, "flow_id", "is_apt", 0.8, 42)
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test"))) \
        .groupBy("split", "is_apt").agg(F.count(F.lit(1)).alias("count"))


register("x1_stratified_split", with_flows("""
SELECT 'train' AS split, is_apt, CAST(round(0.8 * count(*)) AS BIGINT) AS count FROM flows GROUP BY is_apt
UNION ALL SELECT 'test', is_apt, count(*) - CAST(round(0.8 * count(*)) AS BIGINT) FROM flows GROUP BY is_apt"""))


@query("x2_hash_split")
def x2(spark, sf_dir):
    df = flows_view(spark, sf_dir).select("flow_id", "is_apt")
    train, test = X.hash_split(df, "flow_id", 0.8, 42)
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))


@query("x3_smote")
def x3(spark, sf_dir):
    df = _flows_model_input(spark, sf_dir)
    return X.smote(df, "flow_id", "is_apt", FEATS, minority=1, ratio=0.7, k=5)


@query("x3_class_weights")
def x3w(spark, sf_dir):
    df = flows_view(spark, sf_dir).select("flow_id", "is_apt")
    w = X.class_weights(df, "is_apt")
    return w.groupBy("is_apt").agg(F.first("weight").alias("weight"), F.count(F.lit(1)).alias("count")) \
        .withColumn("weight", r6(F.col("weight")))


register("x3_class_weights", with_flows("""
SELECT is_apt, round_even((SELECT count(*) FROM flows) / (2.0 * count(*)), 6) AS weight, count(*) AS count
FROM flows GROUP BY is_apt"""))


@query("x4_class_distribution")
def x4(spark, sf_dir):
    return X.class_distribution(flows_view(spark, sf_dir), "Stage")


register("x4_class_distribution", with_flows('SELECT "Stage" AS label, count(*) AS count FROM flows GROUP BY "Stage"'))


@query("s13_model_store")
def s13(spark, sf_dir):
    """The fitted preparation pipeline saved, loaded back and applied (the
    loaded model must reproduce M15's pinned columns)."""
    from huntlake.session import scratch_path
    from huntlake.sources import model_store
    df = flows_view(spark, sf_dir).select("flow_id", "flow_start", *[c(n) for n in FEATS], "Stage", "is_apt")
    path = scratch_path(spark, "s13-model")
    model_store.save_model(preprocess_pipeline(target="is_apt", exclude=("flow_id",)).fit(df), path)
    out = model_store.load_model(path).transform(df)
    return out.select("flow_id", r6(c("Flow Bytes/s")).alias("Flow Bytes/s"), "potential_data_exfil",
                      "Stage_lateral", "Stage_normal", r6(c("is_exfiltration")).alias("is_exfiltration"))


from huntlake.plans.oracle import ORACLE as _ORACLE  # noqa: E402

register("s13_model_store", _ORACLE["m15_preprocess_flows"])


# --- end-to-end flows of the three log detectors ---------------

@query("m10_p5_log_suspects")
def log_suspects(spark, sf_dir):
    """Stage predictor: P2 keyword features -> M10 stage classifier -> P5 non-benign rows
    in the suspects store (S6), read back. The stages it learns are those that log keywords
    can show: busy flows that open connections (SYN) are reconnaissance, all others normal."""
    from huntlake.session import scratch_path
    from huntlake.sources import sinks as K
    busy = (c("SYN Flag Count") == 1) & (c("Flow Packets/s") > 25)
    flows = _flows_model_input(spark, sf_dir).withColumn("Stage", F.when(busy, "reconnaissance").otherwise("normal"))
    model = M.stage_classifier().fit(M.bounded_rows(flows, "flow_id", M.FIT_ROWS))
    logs = logs_view(spark, sf_dir).select("log_id", "timestamp", "source", "destination", "event",
                                           *L.keyword_features("event"))
    path = scratch_path(spark, "suspects")
    staged = M.predict_stage(model, logs).select("log_id", "source", "destination", "event", "predicted_stage")
    K.sink_suspects(staged, path, benign="normal")
    return spark.read.parquet(path)


register("m10_p5_log_suspects", with_logs("""
SELECT log_id, source, destination, event, 'reconnaissance' AS predicted_stage FROM logs WHERE event LIKE '%\\_scan' ESCAPE '\\'"""))


@query("m1_s6_log_detector")
def log_detector(spark, sf_dir):
    """Forest detector: S1 CSV scan -> P3 text features -> M1 isolation forest ->
    P4 label -> S6 routed writes; returns the routed stores read back."""
    from huntlake.functions.time import LOG_TIME_FORMAT
    from huntlake.session import scratch_path
    from huntlake.sources import readers as R, sinks as K
    src = scratch_path(spark, "detector-csv")
    logs_view(spark, sf_dir).select(F.date_format("timestamp", LOG_TIME_FORMAT), "source", "destination",
                                    "event").write.option("header", False).csv(src)
    logs = R.scan_log_csv(spark, src)
    feats = logs.select("*", *L.text_features("event"), F.xxhash64("timestamp", "source", "destination", "event")
                        .alias("row_key"))
    cols = ["event_length", "marker_count", "underscore_count"]
    scored = IsolationForest(cols, key="row_key").fit(feats).transform(feats)
    labelled = scored.withColumn("classification", L.anomaly_to_label("is_anomaly")) \
        .select("timestamp", "source", "destination", "event", "is_anomaly", "classification")
    index_path, attack_path = scratch_path(spark, "detector-index"), scratch_path(spark, "detector-attacks")
    K.sink_routed(labelled, index_path, attack_path)
    idx = spark.read.json(index_path).groupBy("classification").agg(F.count(F.lit(1)).alias("rows")) \
        .select(F.lit("index").alias("store"), "classification", "rows")
    att = spark.read.parquet(attack_path).groupBy("classification").agg(F.count(F.lit(1)).alias("rows")) \
        .select(F.lit("attacks").alias("store"), "classification", "rows")
    return idx.unionByName(att)


# --- what must hold for every fit, as one checked row ---------------------------------

@query("m1_forest_invariants")
def m1_invariants(spark, sf_dir):
    """Every row has a score in (0, 1], and the flagged rows are those with the highest scores."""
    out, s = m1(spark, sf_dir), F.col("anomaly_score")
    flagged, rest = F.min(F.when(F.col("is_anomaly"), s)), F.max(F.when(~F.col("is_anomaly"), s))
    return out.agg(F.count(F.lit(1)).alias("row_count"), F.count_if((s > 0) & (s <= 1)).alias("scored"),
                   F.coalesce(flagged > rest, F.lit(True)).alias("highest_flagged"),
                   (F.count_if("is_anomaly") < F.count(F.lit(1)) / 2).alias("minority_flagged"))


register("m1_forest_invariants", with_logs(
    "SELECT count(*) AS row_count, count(*) AS scored, true AS highest_flagged, true AS minority_flagged FROM logs"))


@query("m2_m7_encoder_invariants")
def m2_invariants(spark, sf_dir):
    """The mean error is the variance that the components leave, the encodings have mean 0
    and the fitted variances, and the stacked vector is the columns side by side."""
    from huntlake.models.encoder import stack_features
    df = _scaled_flows(spark, sf_dir)
    model = LinearAutoencoder(FEATS, k=4).fit(df)
    explained = model.get_state()["explained_variance"]
    out = stack_features(model.transform(df), FEATS, k=4)
    n, codes = F.count(F.lit(1)), [F.col(f"encoded_{i}") for i in range(4)]
    total = sum((F.var_samp(c(name)) for name in FEATS), F.lit(0.0))
    left = F.avg("reconstruction_error") * len(FEATS) * n / (n - 1)
    near = lambda a, b: F.abs(a - b) <= 1e-6 * (1 + F.abs(b))
    same_codes = F.lit(True)
    for code, variance in zip(codes, explained):
        same_codes = same_codes & (F.abs(F.avg(code)) < 1e-6) & near(F.var_samp(code), F.lit(variance))
    whole = vector_to_array("features") == F.array(*[c(name).cast("double") for name in FEATS], F.col("reconstruction_error"), *codes)
    return out.agg(n.alias("row_count"), F.count_if(whole).alias("stacked"), near(left, total - sum(explained)).alias("error_is_rest"),
                   same_codes.alias("encodings_fit"))


register("m2_m7_encoder_invariants", with_flows(
    "SELECT count(*) AS row_count, count(*) AS stacked, true AS error_is_rest, true AS encodings_fit FROM flows"))


@query("m8_m12_model_invariants")
def m8_invariants(spark, sf_dir):
    """Probabilities and labels of the boosted trees (M8, M9), importances (M11), and
    contributions that add up to the margin (M12); the labels of unseen rows are right."""
    model, data = _scorer(spark, sf_dir)
    p, y = F.col("apt_probability"), F.col("apt_prediction")
    scored = M.score(model, data)
    unseen = X.hash_bucket("flow_id", 42) >= int(0.8 * X.BUCKETS)
    counts = scored.agg(F.count(F.lit(1)).alias("row_count"), F.count_if((p >= 0) & (p <= 1) & ((p > 0.5) == (y == 1))).alias("scored"),
                        (F.count_if(unseen & (y == F.col("is_apt"))) > 0.99 * F.count_if(unseen)).alias("unseen_right"),
                        F.count_if(y == 1).alias("flagged"))
    names = M.feature_importance(model.stages[-1], None).agg(
        F.count(F.lit(1)).alias("features"), (F.abs(F.sum("importance") - 1) < 1e-6).alias("importance_is_whole"))
    told = M.explain_rows(model.stages[-1], scored.where(y == 1), "flow_id")
    told = told.agg(F.count_if(F.abs(F.col("base_value") + F.col("contribution_sum") - F.col("raw_margin")) < 1e-6).alias("explained"))
    return counts.join(names).join(told).select("row_count", "scored", "unseen_right", "features", "importance_is_whole",
                                                (F.col("explained") == F.col("flagged")).alias("all_explained"))


register("m8_m12_model_invariants", with_flows("""
SELECT count(*) AS row_count, count(*) AS scored, true AS unseen_right, 17 AS features, true AS importance_is_whole,
  true AS all_explained FROM flows"""))


@query("m14_training_report")
def m14_report(spark, sf_dir):
    """The result document of a training, written as JSON (S9) and read back."""
    from huntlake.session import scratch_path
    from huntlake.sources import sinks as K
    df = _flows_model_input(spark, sf_dir)
    model, _, metrics = M.train_detector(df)
    path = scratch_path(spark, "training-report")
    K.sink_report_json(M.training_report(model, metrics, M.score(model, df)), path)
    back = spark.read.json(path)
    errors = F.col("reconstruction_errors")
    f1 = F.filter("performance", lambda r: (r["detector"] == "classifier") & (r["metric"] == "f1"))[0]["value"]
    return back.select(F.size("performance").alias("metrics"), (F.size("feature_importance") > 17).alias("stacked_features"),
                       ((errors["min"] <= errors["mean"]) & (errors["anomaly_threshold"] <= errors["max"])).alias("errors_ordered"),
                       (f1 > 0.9).alias("classifier_good"))


register("m14_training_report",
         "SELECT 10 AS metrics, true AS stacked_features, true AS errors_ordered, true AS classifier_good")


@query("x2_x3_sampling_invariants")
def sampling_invariants(spark, sf_dir):
    """Every row is in one part and the parts have their share. X3: exactly the missing
    rows, each inside the range of the minority in every feature."""
    split = x2(spark, sf_dir).agg(F.count(F.lit(1)).alias("row_count"), F.count_if(F.col("split") == "train").alias("n"))
    twice = x2(spark, sf_dir).groupBy("flow_id").agg(F.count_distinct("split").alias("parts")).agg(
        F.count_if(F.col("parts") > 1).alias("in_both"))
    made, minority = x3(spark, sf_dir), _flows_model_input(spark, sf_dir).where("is_apt = 1")
    hull = minority.agg(*[f(c(n)).alias(f"{t}{i}") for i, n in enumerate(FEATS) for f, t in ((F.min, "lo"), (F.max, "hi"))])
    inside = F.lit(True)
    for i, n in enumerate(FEATS):
        inside = inside & (c(n) >= F.col(f"lo{i}") - 1e-6) & (c(n) <= F.col(f"hi{i}") + 1e-6)
    made = made.join(F.broadcast(hull)).agg(F.count(F.lit(1)).alias("made"), F.count_if(inside).alias("inside"))  # hull: one row
    share = F.abs(F.col("n") / F.col("row_count") - 0.8) < 0.01
    return split.join(twice).join(made).select("row_count", share.alias("share_ok"), "in_both", "made", "inside")


register("x2_x3_sampling_invariants", with_flows("""
SELECT count(*) AS row_count, true AS share_ok, 0 AS in_both, CAST(need AS BIGINT) AS made, CAST(need AS BIGINT) AS inside
FROM flows, (SELECT greatest(round_even(0.7 * count_if(is_apt <> 1), 0) - count_if(is_apt = 1), 0) AS need FROM flows) q
GROUP BY need"""))
