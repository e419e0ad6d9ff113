"""Column-role detection from the schema.

Roles come from name fragments, guarded by type (driver reads ``df.schema``
only). The IP check is the one data pass: one aggregation over all candidates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from huntlake import schemas as S
from huntlake.functions.cols import c

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
                 T.DecimalType)
TIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType, T.StringType)


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, NUMERIC_TYPES)


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    """Numeric columns by type, in schema order (booleans are not numeric)."""
    return [f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name not in exclude]


def string_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def _name_match(name: str, keywords: list[str]) -> bool:
    low = name.lower()
    return any(k in low for k in keywords)


def detect_time_cols(df: DataFrame, keywords: list[str] | None = None,
                     check_type: bool = True) -> list[str]:
    """Time-like names; numeric columns such as ``flow_mean_time_delta`` are skipped."""
    keywords = keywords or S.TIME_KEYWORDS_ALL
    out = []
    for f in df.schema.fields:
        if _name_match(f.name, keywords) and (not check_type or isinstance(f.dataType, TIME_TYPES)):
            out.append(f.name)
    return out


def ip_candidates(df: DataFrame, keywords: list[str] | None = None) -> list[str]:
    keywords = keywords or S.IP_KEYWORDS_ALL
    return [f.name for f in df.schema.fields
            if _name_match(f.name, keywords) and not isinstance(f.dataType, (T.BooleanType,))]


def ip_evidence(df: DataFrame, candidates: list[str]) -> DataFrame:
    """One-row frame: for each candidate, does any value contain '.' and more than 3 digits."""
    aggs = []
    for name in candidates:
        text = c(name).cast("string")
        looks = text.contains(".") & (F.regexp_count(text, F.lit(r"[0-9]")) > 3)
        aggs.append(F.coalesce(F.bool_or(looks), F.lit(False)).alias(name))
    return df.agg(*aggs)


def detect_ip_cols(df: DataFrame, keywords: list[str] | None = None) -> list[str]:
    """R2: IP columns by name and content (all rows checked, deterministic)."""
    candidates = ip_candidates(df, keywords)
    if not candidates:
        return []
    row = ip_evidence(df, candidates).first()
    return [name for name in candidates if row[name]]


def detect_port_cols(df: DataFrame) -> list[str]:
    """Names containing 'port' (not the derived category/flag columns)."""
    return [f.name for f in df.schema.fields
            if _name_match(f.name, S.PORT_KEYWORDS) and not isinstance(f.dataType, T.BooleanType)
            and not f.name.endswith(("_category", "_is_service"))]


def detect_protocol_cols(df: DataFrame) -> list[str]:
    """Names containing 'protocol' / 'proto'."""
    return [f.name for f in df.schema.fields
            if _name_match(f.name, S.PROTOCOL_KEYWORDS) and isinstance(f.dataType, T.StringType)]


def detect_flow_cols(df: DataFrame) -> list[str]:
    """Case-sensitive flow-statistic names with a numeric type."""
    return [f.name for f in df.schema.fields
            if any(k in f.name for k in S.FLOW_KEYWORDS) and is_numeric(f.dataType)]


def column_roles(df: DataFrame) -> DataFrame:
    """All roles as a (column_name, role) table; IP roles come from the data pass."""
    spark = df.sparkSession
    rows = [(n, "time") for n in detect_time_cols(df)]
    rows += [(n, "port") for n in detect_port_cols(df)]
    rows += [(n, "protocol") for n in detect_protocol_cols(df)]
    rows += [(n, "flow") for n in detect_flow_cols(df)]
    schema = "column_name string, role string"
    static = spark.createDataFrame(rows, schema)
    candidates = ip_candidates(df)
    if not candidates:
        return static
    ev = ip_evidence(df, candidates)
    stacked = ev.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("column_name"), c(n).alias("hit")) for n in candidates])).alias("s"))
    ips = stacked.where(F.col("s.hit")).select(F.col("s.column_name").alias("column_name"),
                                              F.lit("ip").alias("role"))
    return static.unionByName(ips)
