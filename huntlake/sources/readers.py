"""Readers (S1-S4, S11). Explicit schemas everywhere; inference only on request."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from huntlake import schemas as S
from huntlake.functions.time import LOG_TIME_FORMAT

CORRUPT = "_corrupt_record"


def scan_log_csv(spark: SparkSession, path: str, time_format: str = LOG_TIME_FORMAT,
                 with_quarantine: bool = False):
    """Header-less CSV of (timestamp, source, destination, event).

    Rows that do not parse are kept aside: with ``with_quarantine=True`` the call
    returns (good, bad) where bad holds the raw text of the malformed lines.
    The timestamp is parsed strictly with ``time_format`` (T6).
    """
    schema = T.StructType(S.LOG_SCHEMA_RAW.fields + [T.StructField(CORRUPT, T.StringType())])
    raw = (spark.read.schema(schema).option("header", False).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", CORRUPT).csv(path))
    text = F.concat_ws(",", *[F.coalesce(F.col(n).cast("string"), F.lit("")) for n in ("timestamp", "source", "destination", "event")])
    parsed = raw.withColumn("__raw", F.coalesce(F.col(CORRUPT), text)).withColumn("timestamp", F.try_to_timestamp(F.col("timestamp"), F.lit(time_format)))
    bad_row = F.col(CORRUPT).isNotNull() | F.col("timestamp").isNull()
    good = parsed.where(~bad_row).drop(CORRUPT, "__raw")
    if not with_quarantine:
        return good
    bad = parsed.where(bad_row).select(F.col("__raw").alias("raw"))
    return good, bad


def scan_flow_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
                  infer: bool = False) -> DataFrame:
    """Header CSV of flow records; explicit schema by default (inference is opt-in)."""
    reader = spark.read.option("header", True)
    if infer:
        return reader.option("inferSchema", True).csv(path)
    return reader.schema(schema or S.FLOW_SCHEMA).option("enforceSchema", False).csv(path)


def scan_documents(spark: SparkSession, path: str, schema: T.StructType | None = None,
                   predicate=None, limit: int | None = None) -> DataFrame:
    """S3: a document collection exported as JSON Lines; the union of keys becomes
    the columns, ``_id`` is dropped. Predicate and limit are pushed to the scan."""
    reader = spark.read.schema(schema) if schema is not None else spark.read.option("samplingRatio", 1.0)
    df = reader.json(path)
    if predicate is not None:
        df = df.where(predicate)
    if limit is not None:
        df = df.limit(limit)
    return df.drop("_id")


def scan_index(spark: SparkSession, path: str, source_schema: T.StructType | None = None,
               size: int | None = None) -> DataFrame:
    """Search-index hits (``{_index, _id, _source: {...}}`` lines); the
    ``_source`` documents become the rows."""
    if source_schema is not None:
        schema = T.StructType([T.StructField("_index", T.StringType()), T.StructField("_id", T.StringType()),
                               T.StructField("_source", source_schema)])
        hits = spark.read.schema(schema).json(path)
    else:
        hits = spark.read.json(path)
    out = hits.select("_source.*")
    return out.limit(size) if size is not None else out


def list_attacks(spark: SparkSession, path: str, fmt: str = "parquet") -> tuple[DataFrame, DataFrame]:
    """Attacks read back from the attack store: (event, timestamp) rows and their total."""
    store = spark.read.format(fmt).load(path)
    rows = store.select("event", "timestamp")
    total = store.agg(F.count(F.lit(1)).alias("total"))
    return rows, total
