"""Boosted trees, scoring, stage classifier, importance, explanations and the
end-to-end training. The driver holds fitted models (trees, weights, category lists) only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huntlake import schemas as S
from huntlake.functions.cols import c
from huntlake.models import trees as Tr
from huntlake.models.boosting import BoostedTrees, BoostedTreesModel
from huntlake.models.encoder import LinearAutoencoder
from huntlake.models.preprocess import fit_preprocess
from huntlake.operators import metrics as V
from huntlake.operators.sample import BUCKETS, class_weights, hash_bucket, hash_split, smote
from huntlake.session import compiled_code, scratch_path

# Rows that the forest of the stage classifier is fitted on in the queries, at most.
FIT_ROWS = 20_000


def with_validation_flag(df: DataFrame, key: str, fraction: float = 0.2, seed: int = 43) -> DataFrame:
    """Marks the rows that early stopping validates on, by a hash of the key."""
    return df.withColumn("is_validation", hash_bucket(key, seed) < int(fraction * BUCKETS))


def bounded_rows(df: DataFrame, key: str, rows: int | None, seed: int = 44) -> DataFrame:
    """A hash sample of about ``rows`` labelled rows for a fit (all of them if there are fewer, or if None)."""
    n = df.count() if rows else 0
    if not rows or n <= rows:
        return df
    whole = F.xxhash64(c(key), F.lit(seed))
    return df.where(whole <= int(rows / n * 2.0 ** 64 - 2.0 ** 63))


def fit_scorer(df: DataFrame, features: list[str], target: str, key: str, **params) -> PipelineModel:
    """M8: boosted trees on all labelled rows, a fifth of them for early stopping on the AUC.
    Rows without a value of a feature go the way each split has learned for them."""
    data = with_validation_flag(df, key)
    return PipelineModel(stages=[BoostedTrees(features, label=target, key=key, validation="is_validation", **params).fit(data)])


def score(model, df: DataFrame, threshold: float = 0.5, prob_col: str = "apt_probability",
          pred_col: str = "apt_prediction") -> DataFrame:
    """M9: probability of the positive class and the strict threshold label."""
    out = model.transform(df)
    p = F.col("probability") if dict(out.dtypes)["probability"] == "double" else vector_to_array(F.col("probability")).getItem(1)
    return out.withColumn(prob_col, p).withColumn(pred_col, F.when(F.col(prob_col) > threshold, 1).otherwise(0))


def feature_importance(model: BoostedTreesModel, top_n: int | None = 20) -> DataFrame:
    """Importance per named feature (gain-based, normalised), descending."""
    from pyspark.sql import SparkSession
    df = SparkSession.getActiveSession().createDataFrame(list(model.importance().items()), "feature string, importance double")
    df = df.orderBy(F.desc("importance"), F.asc("feature"))
    return df.limit(top_n) if top_n else df


def stage_classifier(features: list[str] = None, stage_col: str = "Stage", num_trees: int = 50,
                     max_depth: int = 8, seed: int = 42) -> Pipeline:
    """Multi-class stage prediction with the decoded label ``predicted_stage``."""
    features = features or S.EXPECTED_FEATURES
    indexer = StringIndexer(inputCol=stage_col, outputCol="stage_index", stringOrderType="alphabetAsc",
                            handleInvalid="keep")
    assembler = VectorAssembler(inputCols=features, outputCol="stage_features", handleInvalid="keep")
    rf = RandomForestClassifier(featuresCol="stage_features", labelCol="stage_index", numTrees=num_trees,
                                maxDepth=max_depth, seed=seed, predictionCol="stage_prediction",
                                probabilityCol="stage_probability", rawPredictionCol="stage_raw")
    return Pipeline(stages=[indexer, assembler, rf])


def predict_stage(model: PipelineModel, df: DataFrame) -> DataFrame:
    labels = model.stages[0].labels
    out = model.transform(df)
    decode = IndexToString(inputCol="stage_prediction", outputCol="predicted_stage", labels=labels)
    return decode.transform(out).drop("stage_features", "stage_probability", "stage_raw", "stage_prediction")


# --- M12: Shapley values of the margin ------------------------------------------------

def explain_rows(model: BoostedTreesModel, df: DataFrame, key: str, top_k: int = 5) -> DataFrame:
    """Base value (expected margin), raw margin, the sum of all Shapley values and the ``top_k``
    largest by absolute value (ties in feature order) for every row of ``df``;
    base value + sum == raw margin. Rows keep their key as it is, null or repeated."""
    grown, names = model.trees(), model.features()
    base = Tr.expected_margin(grown)
    d = len(names)

    def explain(batches):
        told = pa.array(names, pa.string())
        for batch in batches:
            n = batch.num_rows
            x = np.column_stack([np.asarray(batch.column(i + 1).to_numpy(zero_copy_only=False), np.float64) for i in range(d)]) if d else np.zeros((n, 0))
            values = Tr.shapley_values(grown, x)
            order = np.argsort(-np.abs(values), axis=1, kind="stable")[:, :top_k]
            picked = pa.StructArray.from_arrays(
                [told.take(pa.array(order.ravel())), pa.array(np.take_along_axis(x, order, 1).ravel(), from_pandas=True), pa.array(np.take_along_axis(values, order, 1).ravel())],
                ["name", "value", "contribution"])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * order.shape[1], pa.int32()), picked)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(n, base)), pa.array(Tr.margins(grown, x)), pa.array(values.sum(1)), lists],
                                             [key, "base_value", "raw_margin", "contribution_sum", "top_contributions"])

    rows = df.select(c(key), *[c(f).cast("double").alias(f"x{i}") for i, f in enumerate(names)])
    kind = dict(df.dtypes)[key]
    return rows.mapInArrow(explain, f"`{key}` {kind}, base_value double, raw_margin double, contribution_sum double, "
                                    "top_contributions array<struct<name: string, value: double, contribution: double>>")


# --- M14: end-to-end training ------------------------------------------------------

def train_detector(df: DataFrame, target: str = "is_apt", key: str = "flow_id", exclude: tuple[str, ...] = (),
                   k: int | None = None, test_fraction: float = 0.2, seed: int = 42, threshold: float = 0.5,
                   balance: bool = True, smote_ratio: float | None = None, fit_rows: int | None = None, **params):
    """Split -> fit preparation -> encoder (+threshold) -> boosted trees on the features,
    the error and the encodings -> metrics on the held-out split. Returns (PipelineModel, feature names, metrics).

    A fifth of the training rows validates for early stopping. Classes are balanced by
    weights, or, with ``smote_ratio``, by synthetic minority rows (X3) beside the rows the
    trees are fitted on. ``fit_rows`` bounds the labelled rows of the trees by a hash
    sample; preparation, encoder and metrics see all rows. Metrics hold the classifier
    and the encoder's flag side by side (V9).
    """
    # Neither the rows nor the prepared ones are kept: they are several times as wide as what they come from.
    compiled_code(df.sparkSession)
    train, test = hash_split(df, key, 1.0 - test_fraction, seed)
    prep, names = fit_preprocess(train, target=target, exclude=(key,) + tuple(exclude))
    ptrain = prep.transform(train)
    enc = LinearAutoencoder(names, k=k).fit(ptrain)
    stack_cols = names + ["reconstruction_error"] + [f"encoded_{i}" for i in range(len(enc.get_state()["components"]))]
    stacked = with_validation_flag(enc.transform(bounded_rows(ptrain, key, fit_rows)), key)
    weight, row_key = None, key
    if smote_ratio is not None:
        numeric = stacked.select(c(key), *[c(n).cast("double").alias(n) for n in stack_cols], c(target).cast("double").alias("label"),
                                 "is_validation")
        made = smote(numeric.where(~F.col("is_validation")), key, "label", stack_cols, 1.0, smote_ratio, seed=seed)
        stacked, row_key = numeric.drop(key).unionByName(made.drop("synthetic").withColumn("is_validation", F.lit(False))), None
    else:
        stacked = stacked.withColumn("label", c(target).cast("double"))
        if balance:
            stacked, weight = class_weights(stacked, "label", "weight"), "weight"
    stacked = stacked.select(*([c(key)] if row_key else []), *[c(n) for n in stack_cols], "label", "is_validation", *([weight] if weight else []))
    boosted = BoostedTrees(stack_cols, label="label", key=row_key, weight=weight, validation="is_validation", **params).fit(stacked)
    model = PipelineModel(stages=list(prep.stages) + [enc, boosted])
    return model, stack_cols, detector_metrics(score(model, test, threshold), target)


def detector_metrics(scored: DataFrame, target: str = "is_apt") -> DataFrame:
    """V9 on rows scored by a trained detector: classifier and encoder, with their ROC AUC.
    The five columns that it needs are written once, so that the rows are scored once."""
    path = scratch_path(scored.sparkSession, "detector-scored")
    scored.select(c(target), "apt_prediction", "is_anomaly", "apt_probability", "reconstruction_error").write.parquet(path)
    scored = scored.sparkSession.read.parquet(path)
    return V.combined_vs_encoder(scored, target, "apt_prediction", "is_anomaly", "apt_probability", "reconstruction_error")


def training_report(model: PipelineModel, metrics: DataFrame, scored: DataFrame) -> DataFrame:
    """The result document of a training as one nested row for S9: feature importance,
    summary of the reconstruction errors with the threshold, and the metrics."""
    threshold = model.stages[-2].get_state()["threshold"]
    importance = feature_importance(model.stages[-1], None).agg(
        F.sort_array(F.collect_list(F.struct("importance", "feature")), asc=False).alias("feature_importance"))
    errors = V.error_summary(scored, {"reconstruction_error": "reconstruction_error"}, None).select(
        F.struct("mean", "std", "min", "max", F.lit(threshold).alias("anomaly_threshold")).alias("reconstruction_errors"))
    performance = metrics.agg(F.sort_array(F.collect_list(F.struct("detector", "metric", "value"))).alias("performance"))
    return importance.join(errors).join(performance)
