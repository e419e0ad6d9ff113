"""Continuous log ingest. Log files arriving in a folder are parsed, classified
(P1, P3) and routed (S6) micro-batch by micro-batch.

Exactly-once output: each micro-batch writes into its own ``batch_id=<n>``
partition with dynamic partition overwrite, so a replay after a failure replaces
the batch's files instead of duplicating them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from huntlake import schemas as S
from huntlake.functions import logs as L
from huntlake.functions.time import LOG_TIME_FORMAT


def read_log_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None,
                    watermark: str = "10 minutes", time_format: str = LOG_TIME_FORMAT) -> DataFrame:
    """Streaming S1: header-less CSV files; event time is a TIMESTAMP with a watermark."""
    reader = spark.readStream.schema(S.LOG_SCHEMA_RAW).option("header", False)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.csv(path)
    parsed = raw.withColumn("raw_time", F.col("timestamp")) \
                .withColumn("timestamp", F.try_to_timestamp(F.col("timestamp"), F.lit(time_format)))
    return parsed.withWatermark("timestamp", watermark)


def enrich_logs(df: DataFrame) -> DataFrame:
    """P1 + P3 on a (streaming or batch) log frame."""
    return df.select("*", L.classify_rule("event").alias("classification"), *L.text_features("event"))


def quarantine_of(index_path: str) -> str:
    """Where lines that do not parse go unless told otherwise."""
    return index_path.rstrip("/") + "-quarantine"


def _write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    (df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
       .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path))


def start_log_ingest(spark: SparkSession, in_path: str, index_path: str, attack_path: str,
                     checkpoint: str, available_now: bool = True, max_files_per_trigger: int | None = None,
                     watermark: str = "10 minutes", quarantine_path: str | None = None):
    """Start the W7 query: every parsed row to the index, attacks to the attack store, lines
    whose time does not parse to the quarantine (``quarantine_of(index_path)`` if no path is given)."""
    quarantine_path = quarantine_path or quarantine_of(index_path)
    stream = read_log_stream(spark, in_path, max_files_per_trigger, watermark)

    def route(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            good = enrich_logs(batch.where(F.col("timestamp").isNotNull()).drop("raw_time"))
            _write_batch(good, index_path, batch_id)
            _write_batch(good.where(F.col("classification") == S.LABEL_ATTACK), attack_path, batch_id)
            _write_batch(batch.where(F.col("timestamp").isNull()).select(
                F.concat_ws(",", "raw_time", "source", "destination", "event").alias("raw")),
                quarantine_path, batch_id)
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(route).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
