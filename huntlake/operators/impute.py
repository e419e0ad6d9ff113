"""Missing values (I1-I5; the neighbour search of I3 is in ``operators.knn``).

Numeric strategy 'mean' / 'median' fits one aggregation over all numeric
columns; categorical 'mode' fits one value-count job over all string columns
(smallest value wins ties); 'constant' needs no fit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huntlake import schemas as S
from huntlake.functions.cols import c, nan_to_null
from huntlake.operators import roles
from huntlake.operators.fitted import JsonEstimator, JsonModel
from huntlake.operators.knn import donor_vectors, fill_from_neighbours
from huntlake.operators.stats import quantiles
from huntlake.session import scratch_path


def value_counts_long(df: DataFrame, cols: list[str]) -> DataFrame:
    """E1 machinery: (column_name, value, count) for all columns in one job (nulls excluded)."""
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("column_name"), c(n).cast("string").alias("value")) for n in cols
    ])).alias("s")).select("s.column_name", "s.value").where(F.col("value").isNotNull())
    return stacked.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("count"))


def modes(df: DataFrame, cols: list[str]) -> dict[str, str | None]:
    """I4 fit: most frequent non-null value per column, smallest value on ties."""
    if not cols:
        return {}
    vc = value_counts_long(df, cols)
    best = vc.groupBy("column_name").agg(
        F.min_by("value", F.struct((-F.col("count")).alias("neg"), F.col("value"))).alias("mode"))
    found = {r["column_name"]: r["mode"] for r in best.collect()}
    return {n: found.get(n) for n in cols}


class MissingValueImputerModel(JsonModel):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        st = self.get_state()
        num, cat = st.get("numeric", {}), st.get("categorical", {})
        if knn := st.get("knn"):
            donors = dataset.sparkSession.read.parquet(knn["path"])
            dataset = fill_from_neighbours(dataset, knn["cols"], donors, knn["k"])
        cols = []
        for n in dataset.columns:
            if n in num and num[n] is not None:
                # a filled integral column becomes double, like a pandas column that held NaN
                cols.append(F.coalesce(nan_to_null(c(n)).cast("double"), F.lit(float(num[n]))).alias(n))
            elif n in cat and cat[n] is not None:
                cols.append(F.coalesce(c(n), F.lit(cat[n])).alias(n))
            else:
                cols.append(c(n))
        return dataset.select(*cols)


class MissingValueImputer(JsonEstimator):
    """I1-I5. numeric_strategy: mean | median | knn | none; categorical: constant | mode | none.

    'knn' keeps the distinct donor vectors as a table in the shared folder; the fitted
    model names that table and needs it for as long as it is used."""
    model_class = MissingValueImputerModel

    def default_options(self):
        return {"numeric_strategy": "mean", "categorical_strategy": "constant",
                "fill_value": S.UNKNOWN_CATEGORY, "exact": True, "exclude": [], "n_neighbors": 5}

    def fit_state(self, dataset: DataFrame) -> dict:
        o = self.get_options()
        exclude = tuple(o["exclude"])
        given = self.get_cols()
        num_cols = [n for n in roles.numeric_columns(dataset, exclude) if not given or n in given]
        cat_cols = [n for n in roles.string_columns(dataset, exclude) if not given or n in given]
        numeric = {}
        for name, known in (("numeric_strategy", ("mean", "median", "knn", "none")), ("categorical_strategy", ("constant", "mode", "none"))):
            if o[name] not in known:
                raise ValueError(f"{name} {o[name]!r} is not one of {', '.join(known)}")
        if o["numeric_strategy"] == "mean":
            aggs = [F.avg(nan_to_null(c(n))).alias(f"m{i}") for i, n in enumerate(num_cols)]
            row = dataset.agg(*aggs).first() if aggs else None
            numeric = {n: row[f"m{i}"] for i, n in enumerate(num_cols)} if row else {}
        elif o["numeric_strategy"] == "median":
            qs = quantiles(dataset, num_cols, [0.5], exact=o["exact"])
            numeric = {n: v[0] for n, v in qs.items()}
        neighbours = None
        if o["numeric_strategy"] == "knn" and num_cols:
            path = scratch_path(dataset.sparkSession, "knn-donors")
            donor_vectors(dataset, num_cols).write.parquet(path)
            neighbours = {"cols": num_cols, "path": path, "k": o["n_neighbors"]}
        categorical = {}
        if o["categorical_strategy"] == "constant":
            categorical = {n: o["fill_value"] for n in cat_cols}
        elif o["categorical_strategy"] == "mode":
            categorical = modes(dataset, cat_cols)
        return {"numeric": numeric, "categorical": categorical, "knn": neighbours}


def columns_with_nulls(df: DataFrame, cols: list[str]) -> list[str]:
    """Which of ``cols`` hold a NULL or NaN (one cheap counting pass)."""
    if not cols:
        return []
    row = df.agg(*[F.count_if(nan_to_null(c(n)).isNull()).alias(f"n{i}") for i, n in enumerate(cols)]).first()
    return [n for i, n in enumerate(cols) if row[f"n{i}"] > 0]


def _one_shot(df: DataFrame, cols, exclude, strategy: str, exact: bool = True) -> DataFrame:
    """Fit and transform the same frame: only columns that have gaps need a statistic."""
    cols = cols or roles.numeric_columns(df, tuple(exclude))
    todo = columns_with_nulls(df, cols)
    if not todo:
        return df
    return MissingValueImputer(todo, numeric_strategy=strategy, categorical_strategy="none",
                               exclude=list(exclude), exact=exact).fit(df).transform(df)


def impute_mean(df: DataFrame, cols: list[str] | None = None, exclude=()) -> DataFrame:
    """I1 (use ``MissingValueImputer`` to fit once and reuse on other frames)."""
    return _one_shot(df, cols, exclude, "mean")


def impute_median(df: DataFrame, cols: list[str] | None = None, exclude=(), exact=True) -> DataFrame:
    """I2 (exact median = linear interpolation at 0.5)."""
    return _one_shot(df, cols, exclude, "median", exact)


def impute_mode(df: DataFrame, cols: list[str] | None = None, exclude=()) -> DataFrame:
    """I4."""
    return MissingValueImputer(cols, numeric_strategy="none", categorical_strategy="mode",
                               exclude=list(exclude)).fit(df).transform(df)


def impute_constant(df: DataFrame, cols: list[str] | None = None, value: str = S.UNKNOWN_CATEGORY,
                    exclude=()) -> DataFrame:
    """Categorical NULL -> constant ('unknown'; the v1 detector used 'missing')."""
    cols = cols or roles.string_columns(df, tuple(exclude))
    return df.fillna(value, subset=cols) if cols else df
