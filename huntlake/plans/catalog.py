"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Every query reads the driver tables through the fixture views, so its work grows
with the data. Doubles that come out of aggregations are rounded to 6 places in
the query wrapper only (the library operators return full precision), so that the
DuckDB oracle and Spark agree regardless of summation order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def r6(col):
    """Round half to even at 6 decimals in binary arithmetic, rint(x * 1e6) / 1e6:
    the oracle's ``round_even(x, 6)``, and cheap codegen math (no BigDecimal)."""
    return F.rint(col.cast("double") * 1e6) / 1e6


def load_all() -> None:
    """Import every catalog module so that its queries register."""
    from huntlake.plans import q_logs, q_flows, q_prep, q_metrics, q_io, q_ml, q_stream  # noqa: F401
