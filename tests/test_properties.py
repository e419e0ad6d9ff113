"""Properties: invariants, save/load, plan checks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from huntlake import schemas as S
from huntlake.functions.cols import c
from huntlake.models import classifier as M
from huntlake.models.encoder import LinearAutoencoder
from huntlake.models.iforest import IsolationForest
from huntlake.models.preprocess import preprocess_pipeline
from huntlake.operators import flow as FL, impute as I, metrics as V, monitor as W, sample as X, stats
from huntlake.session import scratch_path
from huntlake.sources import model_store
from huntlake.sources.tables import flows_view, logs_view

SMALL = "/root/testdata/sf0.001"
FEATS = S.EXPECTED_FEATURES


def _sorted(df):
    return sorted(tuple(r) for r in df.collect())


def test_flow_features_invariant_under_repartition(spark):
    logs = logs_view(spark, SMALL)
    a = FL.flow_features(logs, "source", "destination", "timestamp", order_key="log_id")
    b = FL.flow_features(logs.repartition(7, "event"), "source", "destination", "timestamp", order_key="log_id")
    cols = ["log_id", "time_delta", "flow_packets_count", "flow_duration"]
    assert _sorted(a.select(*cols)) == _sorted(b.select(*cols))


def test_auc_bounds_and_symmetry(spark):
    df = flows_view(spark, SMALL).select("is_apt", F.coalesce(c("Flow Bytes/s"), F.lit(0.0)).alias("s"))
    auc = V.roc_auc(df, "is_apt", "s").first()[0]
    flipped = V.roc_auc(df.withColumn("s", -F.col("s")), "is_apt", "s").first()[0]
    assert 0.0 <= auc <= 1.0 and math.isclose(auc + flipped, 1.0, abs_tol=1e-12)


def test_roc_auc_matches_rank_statistic(spark):
    pdf = flows_view(spark, SMALL).select("is_apt", F.coalesce(c("Flow Bytes/s"), F.lit(0.0)).alias("s")).toPandas()
    ranks = pdf["s"].rank(method="average")
    pos = pdf["is_apt"] == 1
    n1, n0 = pos.sum(), (~pos).sum()
    expected = (ranks[pos].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)
    got = V.roc_auc(spark.createDataFrame(pdf), "is_apt", "s").first()[0]
    assert math.isclose(got, expected, rel_tol=1e-12)


def test_hash_and_stratified_splits_disjoint_complete(spark):
    df = flows_view(spark, SMALL).select("flow_id", "is_apt")
    tr, te = X.hash_split(df, "flow_id", 0.8)
    a, b = {r[0] for r in tr.collect()}, {r[0] for r in te.collect()}
    assert not (a & b) and tr.count() + te.count() == df.count()
    tr, te = X.stratified_split(df, "flow_id", "is_apt", 0.8)
    counts = {r[0]: r[1] for r in df.groupBy("is_apt").count().collect()}
    trc = {r[0]: r[1] for r in tr.groupBy("is_apt").count().collect()}
    assert all(trc[k] == round(0.8 * v) for k, v in counts.items())
    assert tr.count() + te.count() == df.count()


def test_exact_quantiles_match_numpy(spark):
    df = flows_view(spark, SMALL)
    cols = ["Flow Bytes/s", "FIN Flag Count", "Packet Length Mean"]
    got = stats.exact_quantiles(df, cols, [0.0, 0.25, 0.5, 0.95, 1.0])
    pdf = df.select(*[c(n) for n in cols]).toPandas()
    for n in cols:
        want = np.percentile(pdf[n].dropna().to_numpy(), [0, 25, 50, 95, 100])
        assert np.allclose(got[n], want, rtol=1e-12, atol=0), n


def test_exact_quantiles_of_flags_nulls_and_weights(spark):
    flag = spark.range(400_000).select((F.col("id") % 2).cast("double").alias("f"), F.lit(None).cast("double").alias("none"),
                                       F.when(F.col("id") == 7, F.lit(float("nan"))).otherwise(F.lit(3.0)).alias("same"))
    got = stats.exact_quantiles(flag, ["f", "none", "same"], [0.25, 0.5, 0.75])
    assert got == {"f": [0.0, 0.5, 1.0], "none": [None] * 3, "same": [3.0] * 3}
    weighted = spark.createDataFrame([(1.0, 3), (2.0, 1)], "x double, w long")
    assert stats.quantiles(weighted, ["x"], [0.5, 1.0], weight="w") == {"x": [1.0, 2.0]}
    assert stats.quantiles(weighted.limit(0), ["x"], [0.5]) == {"x": [None]}


def test_forest_is_the_same_after_repartition_and_draws_small_shares(spark):
    df = spark.range(20_000).select("id", (F.col("id") % 97).cast("double").alias("a"), F.when(F.col("id") % 5 == 0, None).otherwise(F.col("id") % 89).cast("double").alias("b"))
    one = IsolationForest(["a", "b"], key="id", n_trees=10).fit(df)
    two = IsolationForest(["a", "b"], key="id", n_trees=10).fit(df.repartition(7))
    assert one.get_state()["offset"] == two.get_state()["offset"]
    assert one.transform(df).where("anomaly_score is null").count() == 0
    with pytest.raises(ValueError):
        IsolationForest(["a", "b"]).fit(df)
    share = 1e-7  # as of a few billion rows: the draw still takes its part
    drawn = F.shiftrightunsigned(F.xxhash64(F.col("id"), F.lit(0), F.lit(42)), 1) <= F.lit(int(share * (1 << 63)))
    assert 0 < spark.range(100_000_000).where(drawn).count() < 40


def test_retrain_fold_clears_the_buffer_and_takes_a_new_baseline(spark):
    def fires(f1, samples, **kw):
        rows = [(k, s, f) for k, (f, s) in enumerate(zip(f1, samples))]
        out = W.adaptation_triggers(spark.createDataFrame(rows, "batch long, samples long, f1 double").repartition(3), **kw).orderBy("batch").collect()
        return [(r.degraded, r.buffered_rows, r.retrain) for r in out]

    got = fires([0.9, 0.5, 0.5, 0.5, 0.2, 0.2], [700] * 6, buffer_rows=1000)
    assert got == [(False, 0, False), (True, 700, False), (True, 1400, True), (False, 0, False), (True, 700, False), (True, 1400, True)]
    assert fires([None, 0.5, 0.1], [10, 10, 10], buffer_rows=10)[2] == (True, 10, True)
    both = spark.createDataFrame([("a", 0, 5, 0.9), ("a", 1, 5, 0.1), ("b", 0, 5, 0.1), ("b", 1, 5, 0.1)], "m string, batch long, samples long, f1 double")
    assert {(r.m, r.batch): r.retrain for r in W.adaptation_triggers(both, 5, model="m").collect()} == {("a", 0): False, ("a", 1): True, ("b", 0): False, ("b", 1): False}


def test_bad_lines_vectors_and_text_ports_are_kept(spark, tmp_path):
    from pyspark.ml.linalg import Vectors

    from huntlake.functions.heuristics import uncommon_port
    from huntlake.sources.readers import scan_log_csv
    from huntlake.sources.sinks import sink_predictions_csv

    (tmp_path / "log.csv").write_text("not a time,1.1.1.1,2.2.2.2,user_login\n")
    _, bad = scan_log_csv(spark, str(tmp_path / "log.csv"), with_quarantine=True)
    assert [r.raw for r in bad.collect()] == ["not a time,1.1.1.1,2.2.2.2,user_login"]
    sink_predictions_csv(spark.createDataFrame([(1, Vectors.dense(0.25, 0.75))], ["id", "probability"]), str(tmp_path / "out"), with_time=False)
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).first().probability == "[0.25,0.75]"
    ports = spark.createDataFrame([("80",), ("4444",), ("x",), (None,)], "p string")
    assert [r[0] for r in ports.select(uncommon_port("p")).collect()] == [False, True, True, True]


def test_unknown_imputation_strategy_is_an_error(spark):
    with pytest.raises(ValueError, match="closest"):
        I.MissingValueImputer(["Flow Bytes/s"], numeric_strategy="closest").fit(flows_view(spark, SMALL))


def test_knn_strategy_equals_impute_knn(spark):
    from huntlake.operators.knn import impute_knn
    draw = np.random.default_rng(7)
    rows = [(i, *[None if draw.random() < 0.1 else float(v) for v in draw.normal(size=4)]) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, d double")
    cols = ["a", "b", "c", "d"]
    model = I.MissingValueImputer(cols, numeric_strategy="knn", categorical_strategy="none").fit(df)
    filled = {r[0]: r[1:] for r in model.transform(df).collect()}
    same = {r[0]: r[1:] for r in impute_knn(df, cols, "id", group_rows=40).collect()}
    assert len(filled) == len(same) == 300
    assert all(v is not None and abs(v - w) < 1e-9 for k in filled for v, w in zip(filled[k], same[k]))


def test_knn_counts_copies_and_falls_back_to_the_mean(spark):
    from huntlake.operators.knn import impute_knn
    rows = [(1, 0.0, 10.0), (2, 0.0, 10.0), (3, 1.0, 40.0), (4, 9.0, 100.0), (5, 0.0, None), (6, None, None), (7, float("nan"), 40.0)]
    df = spark.createDataFrame(rows, "id int, a double, b double")
    out = {r.id: (r.a, r.b) for r in impute_knn(df, ["a", "b"], "id", k=3, group_rows=2).collect()}
    assert out[5] == (0.0, 20.0)
    assert out[6] == (2.0, 40.0)
    assert out[1] == (0.0, 10.0) and len(out) == 7
    empty = impute_knn(df.where("id > 99"), ["a", "b"], "id")
    assert empty.count() == 0 and empty.columns == df.columns
    nothing = spark.createDataFrame([(1, 1.0, None)], "id int, a double, b double")
    assert impute_knn(nothing, ["a", "b"], "id").first().b is None


def test_pipeline_save_load_roundtrip(spark):
    df = flows_view(spark, SMALL).select("flow_id", *[c(n) for n in FEATS], "Stage", "is_apt")
    model = preprocess_pipeline(target="is_apt", exclude=("flow_id",)).fit(df)
    path = scratch_path(spark, "model-store")
    model_store.save_model(model, path, config={"scaling": "robust"})
    loaded = model_store.load_model(path)
    a = model.transform(df).select("flow_id", "Flow Bytes/s", "Stage_normal", "potential_data_exfil")
    b = loaded.transform(df).select("flow_id", "Flow Bytes/s", "Stage_normal", "potential_data_exfil")
    assert _sorted(a) == _sorted(b)
    assert model_store.load_manifest(spark, path).first()["success"]


def test_encoder_full_rank_reconstructs(spark):
    df = I.impute_median(flows_view(spark, SMALL).select(*[c(n) for n in FEATS[:6]]))
    model = LinearAutoencoder(FEATS[:6], k=6, threshold_quantile=None).fit(df)
    errs = [r[0] for r in model.transform(df).select("reconstruction_error").collect()]
    assert max(errs) < 1e-6
    small = LinearAutoencoder(FEATS[:6], k=2).fit(df).transform(df)
    assert small.where("reconstruction_error < 0").count() == 0


def test_explanations_sum_to_margin(spark):
    df = flows_view(spark, SMALL).select("flow_id", *[c(n) for n in FEATS], "is_apt")
    model = M.BoostedTrees(FEATS, label="is_apt", key="flow_id", rounds=4, depth=3).fit(df)
    ex = M.explain_rows(model, df, "flow_id", top_k=5)
    raw = model.transform(df).select("flow_id", F.col("raw_margin").alias("m"))
    # sf0.001 repeats one flow_id: compare on unique keys only
    unique = df.groupBy("flow_id").count().where("count = 1").select("flow_id")
    joined = ex.join(raw, "flow_id").join(unique, "flow_id").collect()
    assert joined
    for r in joined:
        assert math.isclose(r["base_value"] + r["contribution_sum"], r["raw_margin"], abs_tol=1e-9)
        assert math.isclose(r["raw_margin"], r["m"], abs_tol=1e-9)
        assert len(r["top_contributions"]) == 5


def test_isolation_forest_flags_planted_outliers(spark):
    rng = np.random.default_rng(0)
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(size=(500, 2)))]
    pts += [(1000 + i, 12.0 + i, -12.0) for i in range(5)]
    df = spark.createDataFrame(pts, "id long, a double, b double")
    model = IsolationForest(["a", "b"], key="id", contamination=0.05, score_distinct=False).fit(df)
    out = model.transform(df)
    flagged = {r["id"] for r in out.where("is_anomaly").collect()}
    assert all(1000 + i in flagged for i in range(5))
    assert abs(len(flagged) - 0.05 * 505) <= 3


def test_smote_rows_stay_in_minority_hull(spark):
    df = I.impute_median(flows_view(spark, SMALL).select("flow_id", *[c(n) for n in FEATS], "is_apt"), FEATS)
    syn = X.smote(df, "flow_id", "is_apt", FEATS, minority=1, ratio=0.2, k=3)
    counts = {r[0]: r[1] for r in df.groupBy("is_apt").count().collect()}
    need = round(0.2 * counts[0]) - counts[1]
    assert syn.count() == need
    lo = df.where("is_apt = 1").agg(*[F.min(c(n)).alias(n) for n in FEATS]).first()
    hi = df.where("is_apt = 1").agg(*[F.max(c(n)).alias(n) for n in FEATS]).first()
    s_lo = syn.agg(*[F.min(c(n)).alias(n) for n in FEATS]).first()
    s_hi = syn.agg(*[F.max(c(n)).alias(n) for n in FEATS]).first()
    assert all(s_lo[n] >= lo[n] - 1e-9 and s_hi[n] <= hi[n] + 1e-9 for n in FEATS)


def test_hot_flow_is_cut_by_volume(spark):
    # one flow holds all rows of one hour, most of them within a minute, some without a time
    rows = [("a", "b", None if i % 50 == 0 else 1_700_000_000 + (i * 7919 % 3000 if i % 5 == 0 else i * 7919 % 61), "TCP" if i % 3 else "UDP", i)
            for i in range(2000)] + [("x", "y", 1_700_000_000 + 10 * i, "UDP", 5000 + i) for i in range(5)]
    df = spark.createDataFrame(rows, "source string, destination string, s long, protocol string, id long") \
        .withColumn("timestamp", F.timestamp_seconds("s"))
    args = dict(src_col="source", dst_col="destination", time_col="timestamp", order_key="id")
    cut = FL._with_buckets(df.withColumn("k", FL.flow_key("source", "destination")), "k", "timestamp", "id", 3600, 100)
    sizes = [r["count"] for r in cut.where("k = 'a_b'").groupBy("__b").count().collect()]
    assert len(sizes) > 20 and max(sizes) < 400

    def rounded(out):
        return sorted((tuple(None if v is None else round(v, 6) if isinstance(v, float) else v for v in r) for r in out.collect()), key=str)
    for whole, hot in [(FL.flow_features(df, **args), FL.flow_features(df, **args, hot_rows=100)),
                       (FL.flow_window_agg(df, **args, window_seconds=60), FL.flow_window_agg(df, **args, window_seconds=60, hot_rows=20)),
                       (FL.flow_stats(df, **args), FL.flow_stats(df, **args, hot_rows=100))]:
        assert rounded(whole) == rounded(hot)


def test_smote_is_independent_of_partitions(spark):
    rows = [(i, float(i % 7), float(i * i % 31), 1) for i in range(100)] + [(1000 + i, 0.0, 0.0, 0) for i in range(1330)]
    df = spark.createDataFrame(rows, "id int, a double, b double, y int")
    old, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (8, 100, 300):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.append(sorted(tuple(r) for r in X.smote(df.repartition(n), "id", "y", ["a", "b"], ratio=1.0).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert len(seen[0]) == 1230 and seen[0] == seen[1] == seen[2]
    assert X.smote(df.where("y = 0 or id = 5"), "id", "y", ["a", "b"]).count() == 0


def test_smote_blocks_and_copy_runs_change_nothing(spark, monkeypatch):
    rows = [(i, float(i % 7), float(i * i % 31), 1) for i in range(40)] + [(1000 + i, 0.0, 0.0, 0) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, a double, b double, y int")
    whole = sorted(tuple(r) for r in X.smote(df, "id", "y", ["a", "b"]).collect())
    monkeypatch.setattr(X, "BLOCK_ROWS", 6)
    monkeypatch.setattr(X, "COPY_ROWS", 5)
    assert sorted(tuple(r) for r in X.smote(df, "id", "y", ["a", "b"]).collect()) == whole and len(whole) == 460


def test_encoder_covariance_matches_numpy(spark):
    import numpy as np
    from huntlake.models.encoder import fit_pca
    rows = [(float(i % 5), float(i % 3) if i % 4 else None, float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    x = np.array([[0.0 if v is None else v for v in r] for r in rows])
    want = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1][:2]
    assert np.allclose(fit_pca(df, ["a", "b", "c"], 2)["explained_variance"], want)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_curves_have_no_single_partition_exchange(spark):
    df = flows_view(spark, SMALL).select("is_apt", F.coalesce(c("Flow Bytes/s"), F.lit(0.0)).alias("s"))
    plan = _plan(V.roc_curve(df, "is_apt", "s"))
    assert "SinglePartition" not in plan


def test_native_operators_have_no_python(spark):
    from huntlake.functions import logs as L, net
    from huntlake.operators.heuristics import engineer_apt_features
    logs = logs_view(spark, SMALL)
    q = logs.select(*L.keyword_features("event"), *net.protocol_flags("protocol", "p"),
                    net.ip_category("source").alias("cat"))
    flows = engineer_apt_features(flows_view(spark, SMALL), exfil_bytes_threshold=1.0)
    for df in (q, flows):
        plan = _plan(df)
        assert "Python" not in plan and "ArrowEval" not in plan


def test_scan_prunes_and_pushes(spark):
    logs = logs_view(spark, SMALL).where(F.col("log_id") > 100).select("log_id", "event")
    plan = logs._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(event_id), GreaterThan(event_id,100)]" in plan
    assert "ReadSchema: struct<event_id:bigint,event_type:string>" in plan


def test_robust_scaling_centres_medians(spark):
    from huntlake.operators import scale as Z
    df = I.impute_median(flows_view(spark, SMALL).select(*[c(n) for n in FEATS]))
    out = Z.scale_robust(df)
    med = stats.quantiles(out, FEATS, [0.5])
    assert all(abs(v[0]) < 1e-12 for v in med.values())


def test_metrics_invariant_under_repartition(spark):
    df = flows_view(spark, SMALL).select("is_apt", "siem_detection",
                                         F.coalesce(c("Flow Bytes/s"), F.lit(0.0)).alias("s"))
    a = V.roc_auc(df, "is_apt", "s").first()[0]
    b = V.roc_auc(df.repartition(5, "siem_detection"), "is_apt", "s").first()[0]
    assert math.isclose(a, b, rel_tol=1e-12)
    m1 = _sorted(V.binary_metrics(df, "is_apt", "siem_detection"))
    m2 = _sorted(V.binary_metrics(df.repartition(3), "is_apt", "siem_detection"))
    assert m1 == m2
