"""Stable row positions of file tables, and alignment of two tables by position.

Spark tells for every row of a file its file and its row number in it. The rows of all files
in the order of their paths number the table without a sort of the rows and without a key: one
count per file (no data column is read) gives each file its first position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huntlake.functions.cols import c
from huntlake.operators.prefix import running_sums


PART_ROWS = 500_000  # of the left table in a task of the alignment, about


def with_position(df: DataFrame, out: str = "position") -> DataFrame:
    """Adds the 0-based position of each row. ``df`` comes straight from whole files: columns may be chosen, rows not be filtered, joined or grouped."""
    rows = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    files = rows.groupBy("__file").agg((F.max("__row") + 1).alias("__n"))  # one row a file
    firsts = running_sums(files, ["__file"], ["__n"], descending=False).select(
        F.col("__file"), (F.col("cum___n") - F.col("__n")).cast("long").alias("__first"))
    # one small row a file: sent to the rows, for a shuffle by file would bring all rows of a file into one task
    return rows.join(F.broadcast(firsts), "__file").withColumn(out, F.col("__first") + F.col("__row")).drop("__file", "__row", "__first")


def align_by_position(left: DataFrame, right: DataFrame, out: str = "position") -> tuple[DataFrame, DataFrame]:
    """Rows of equal position side by side, and the rows of ``left`` beyond the end of ``right``.
    Column names must differ: which side's value would be kept is not for this function to say."""
    if both := set(left.columns) & set(right.columns):
        raise ValueError(f"columns on both sides: {sorted(both)}")
    # as many parts as rows ask for, so that what a task sorts does not grow with the tables
    parts = left.count() // PART_ROWS + 1
    a, b = (with_position(df, out).repartition(parts, c(out)) for df in (left, right))
    return a.join(b, out), a.join(b.select(c(out)), out, "left_anti")
