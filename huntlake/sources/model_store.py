"""Model store. Fitted pipelines (Spark ML stages and this library's stages,
whose fitted values are JSON params) are saved and loaded as one PipelineModel;
a small parquet table records what was saved."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession


def save_model(model: PipelineModel, path: str, config: dict | None = None, overwrite: bool = True) -> dict:
    """Save the pipeline and a one-row manifest next to it; returns the manifest."""
    writer = model.write()
    if overwrite:
        writer = writer.overwrite()
    writer.save(f"{path}/pipeline")
    manifest = {
        "saved_at": dt.datetime.now(dt.timezone.utc).isoformat(),
        "stages": json.dumps([type(s).__name__ for s in model.stages]),
        "config": json.dumps(config or {}, sort_keys=True),
        "success": True,
    }
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([manifest]).write.mode("overwrite").parquet(f"{path}/manifest")
    return manifest


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(f"{path}/pipeline")


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/manifest")
