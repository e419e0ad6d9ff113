"""Date / time column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from huntlake import schemas as S
from huntlake.functions.cols import as_col

LOG_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


def coerce_timestamp(x: str | Column) -> Column:
    """Anything to TIMESTAMP; unparsable text becomes NULL (never raises)."""
    col = as_col(x)
    return F.coalesce(F.try_to_timestamp(col.cast("string")), F.lit(None).cast("timestamp")) \
        .cast("timestamp")


def to_ts(x: str | Column) -> Column:
    """TIMESTAMP_NTZ / TIMESTAMP / text to TIMESTAMP in the session zone."""
    return as_col(x).cast("timestamp")


def parse_timestamp(x: str | Column, fmt: str = LOG_TIME_FORMAT) -> Column:
    """Strict parse of log time text with the log format."""
    return F.to_timestamp(as_col(x), fmt)


def time_parts(x: str | Column, prefix: str) -> list[Column]:
    """Hour, day, month, day of week (Monday=0), ISO week."""
    ts = to_ts(x)
    return [
        F.hour(ts).alias(f"{prefix}_hour"),
        F.dayofmonth(ts).alias(f"{prefix}_day"),
        F.month(ts).alias(f"{prefix}_month"),
        F.weekday(ts).alias(f"{prefix}_dayofweek"),
        F.weekofyear(ts).alias(f"{prefix}_weekofyear"),
    ]


def days_since_ref(x: str | Column, ref: str = S.REFERENCE_DATE) -> Column:
    """Fractional days since the reference date."""
    micros = F.unix_micros(to_ts(x)) - F.unix_micros(F.to_timestamp(F.lit(ref)))
    return micros.cast("double") / F.lit(86400e6)


def time_category(x: str | Column) -> Column:
    """T4: night / morning / afternoon / evening from the hour (right-closed bins)."""
    h = F.hour(to_ts(x))
    expr = F.when(h.isNull() | (h <= -1), F.lit(None).cast("string"))
    for upper, label in S.TIME_CATEGORY_BINS:
        expr = expr.when(h <= upper, F.lit(label))
    return expr.otherwise(F.lit(None).cast("string"))


def iso_timestamp(x: str | Column) -> Column:
    """ISO-8601 text; fractional seconds only when non-zero."""
    ts = to_ts(x)
    micros = F.pmod(F.unix_micros(ts), F.lit(1000000))
    frac = F.when(micros == 0, F.lit("")).otherwise(
        F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0")))
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), frac)


def epoch_seconds(x: str | Column) -> Column:
    """Seconds since epoch as double (for windows and comparisons)."""
    return F.unix_micros(to_ts(x)).cast("double") / F.lit(1e6)
