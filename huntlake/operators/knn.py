"""K-nearest-neighbour imputation (uniform mean of the k nearest donors under the
NaN-aware Euclidean distance sqrt(d / present * sum of squared differences)).

Exact and distributed. A query is a distinct vector and a column it lacks; the donors are the
distinct vectors of the fit set. Donors lie in cells of a k-d tree whose cuts come from a bounded
sample (it decides where a donor lies, never what is found), and every cell has a box: the range
of each column. Each query first meets the donors of its own cell; the k-th distance found there
rules out every cell whose box is farther away, and the query then meets the donors of the cells
that are left. Inside a task the same is done with small leaves. A box's distance adds up the
same columns in the same order as a donor's, so rounding cannot make it the larger one.

Nothing but the sample and the boxes goes through the driver. Groups are bounded on both sides:
a cell that many queries meet does so in several groups. The cost follows the cells a query cannot
rule out; for vectors without any near neighbours these are all, as for a plain search.

Ties go to the donor with the smallest key; donors with equal vectors count as often as
they occur, under the smallest of their keys. A row without any known value gets the mean
of the donors; a column that no donor has stays NULL.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from huntlake.functions.cols import c, nan_to_null
from huntlake.session import cut_lineage, scratch_path

GROUP_ROWS = 8192  # donors of a cell, on average, and queries of a group
MOST_CELLS = 8192  # beyond that many, cells grow
SAMPLED = 16  # rows a cell of the sample that places the cuts
LEAF_ROWS = 128  # donors of a leaf inside a task
TILE_ROWS = 4096  # queries whose distances to the leaves are held at a time


def _vector(cols: list[str]) -> Column:
    return F.array(*[nan_to_null(c(n).cast("double")) for n in cols])


def _hash(vec: str) -> Column:
    """Hash of a vector; a missing value counts (hashing an array skips its nulls)."""
    return F.xxhash64(F.transform(vec, lambda v: F.coalesce(v.cast("string"), F.lit("?"))))


def _matrix(vectors, d: int) -> np.ndarray:
    return pc.list_flatten(vectors).to_numpy(zero_copy_only=False).reshape(-1, d)


def _distances(recv: np.ndarray, donors: np.ndarray) -> np.ndarray:
    """(r x d) vs (m x d) -> (r x m) distances, infinite where no column is known to both.
    Summed column after column, so a pair has the same distance in every tile and ties stay ties."""
    sq, present = np.zeros((len(recv), len(donors))), np.zeros((len(recv), len(donors)), np.int32)
    for j in range(recv.shape[1]):
        diff = np.subtract.outer(recv[:, j], donors[:, j])
        np.multiply(diff, diff, out=diff)
        known = ~np.isnan(diff)
        if known.all():
            present += 1
        else:
            present += known
            diff[~known] = 0.0
        sq += diff
    with np.errstate(invalid="ignore", divide="ignore"):
        dist = np.sqrt(sq * recv.shape[1] / present)
    dist[present == 0] = np.inf
    return dist


# cells and boxes -----------------------------------------------------------------------------

@dataclass
class Boxes:
    """Of each group of donors: the range of every column (NaN if none knows it), and whether all know it."""

    low: np.ndarray
    high: np.ndarray
    full: np.ndarray

    def distances(self, x: np.ndarray, which: slice = slice(None)) -> np.ndarray:
        """(r x boxes): no donor of a box is nearer, under the same rounding."""
        low, high, full = self.low[which], self.high[which], self.full[which]
        sq, present = np.zeros((len(x), len(low))), np.zeros((len(x), len(low)), np.int32)
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            for j in range(x.shape[1]):
                both = np.logical_and.outer(~np.isnan(x[:, j]), ~np.isnan(low[:, j]))
                present += both
                gap = np.fmax(np.fmax(np.subtract.outer(x[:, j], high[:, j]), -np.subtract.outer(x[:, j], low[:, j])), 0.0)
                sq += np.where(both & full[:, j], gap * gap, 0.0)
            dist = np.sqrt(sq * x.shape[1] / present)
        dist[present == 0] = np.inf
        return dist


def _cut(x: np.ndarray, weight: np.ndarray) -> tuple[int, float] | None:
    """(column, threshold) that parts the rows: by the column that spreads most, first into known and missing; None if they are alike."""
    known = ~np.isnan(x)
    many = np.maximum(known.sum(0), 1)
    with np.errstate(invalid="ignore", over="ignore"):
        apart = np.where(known, x - np.where(known, x, 0.0).sum(0) / many, 0.0)
        spread = np.nan_to_num(np.sqrt(np.einsum("ij,ij->j", apart, apart) / many), nan=1e300, posinf=1e300) * weight * many
    for j in np.argsort(-spread, kind="stable"):
        if spread[j] <= 0:
            return None
        if not known[:, j].all():
            return int(j), np.inf
        low, middle = np.partition(x[:, j], (0, (len(x) - 1) // 2))[[0, (len(x) - 1) // 2]]
        top = x[:, j].max()
        if middle == top:  # the larger half is one value
            middle = x[x[:, j] < top, j].max() if low < top else top
        if middle < top:
            return int(j), float(middle)
    return None


@dataclass
class Cells:
    """A k-d tree; rows with at most the threshold go left, those without a value right. ``column`` is -1 at a cell, whose number is ``cell``."""

    column: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    cell: np.ndarray

    @classmethod
    def grown(cls, x: np.ndarray, weight: np.ndarray, rows: int) -> "tuple[Cells, list[np.ndarray]]":
        """The tree whose cells hold at most ``rows`` of the rows of ``x``, if they differ, and the rows of each cell."""
        nodes, members, stack = [], [], [(np.arange(len(x)), -1, 3)]
        while stack:
            own, parent, side = stack.pop()
            if parent >= 0:
                nodes[parent][side] = len(nodes)
            cut = _cut(x[own], weight) if len(own) > rows else None
            if cut is None:
                nodes.append([-1, 0.0, -1, -1, len(members)])
                members.append(own)
            else:
                goes = x[own, cut[0]] <= cut[1]
                stack += [(own[~goes], len(nodes), 3), (own[goes], len(nodes), 2)]
                nodes.append([*cut, -1, -1, -1])
        column, threshold, left, right, cell = zip(*nodes)
        return cls(np.array(column), np.array(threshold, float), np.array(left), np.array(right), np.array(cell)), members

    def place(self, x: np.ndarray, missing_left: bool = False) -> np.ndarray:
        """Cell of each row."""
        node, rows = np.zeros(len(x), int), np.arange(len(x))
        while (self.column[node] >= 0).any():
            inner = self.column[node] >= 0
            values, at = x[rows, np.maximum(self.column[node], 0)], self.threshold[node]
            left = ~(values > at) if missing_left else values <= at
            node = np.where(inner, np.where(left, self.left[node], self.right[node]), node)
        return self.cell[node]

    def node_boxes(self, boxes: Boxes) -> Boxes:
        """Boxes of all nodes from those of the cells."""
        d = boxes.low.shape[1]
        low, high, full = np.full((len(self.column), d), np.nan), np.full((len(self.column), d), np.nan), np.zeros((len(self.column), d), bool)
        for node in range(len(self.column) - 1, -1, -1):  # children stand after their parent
            if self.column[node] < 0:
                own = self.cell[node]
                low[node], high[node], full[node] = boxes.low[own], boxes.high[own], boxes.full[own]
            else:
                a, b = self.left[node], self.right[node]
                low[node], high[node], full[node] = np.fmin(low[a], low[b]), np.fmax(high[a], high[b]), full[a] & full[b]
        return Boxes(low, high, full)

    def within(self, x: np.ndarray, radius: np.ndarray, nodes: Boxes) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of all cells whose box is within the row's radius; a box at an infinite distance never is."""
        found, stack = [(np.zeros(0, int), np.zeros(0, int))], [(0, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            dist = nodes.distances(x[rows], slice(node, node + 1))[:, 0]
            rows = rows[(dist <= radius[rows]) & np.isfinite(dist)]
            if len(rows) and self.column[node] < 0:
                found.append((rows, np.full(len(rows), self.cell[node])))
            elif len(rows):
                stack += [(self.left[node], rows), (self.right[node], rows)]
        row, cell = zip(*found)
        return np.concatenate(row), np.concatenate(cell)


def _boxes_of(x: np.ndarray, members: list[np.ndarray]) -> Boxes:
    low = np.array([np.fmin.reduce(x[own], axis=0) for own in members])
    high = np.array([np.fmax.reduce(x[own], axis=0) for own in members])
    return Boxes(low, high, np.array([~np.isnan(x[own]).any(0) for own in members]))


def nearest(x: np.ndarray, radius: np.ndarray, donors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(distances, donors), r x k in ascending order, of the k nearest donors within the radius, the first on ties;
    infinite, and -1, where there are no more."""
    weight = (~np.isnan(x)).mean(0) if len(x) else np.ones(x.shape[1])
    _, members = Cells.grown(donors, weight, LEAF_ROWS)
    members = [np.sort(own) for own in members]
    boxes = _boxes_of(donors, members)
    best, at = np.full((len(x), k), np.inf), np.full((len(x), k), len(donors))
    for start in range(0, len(x), TILE_ROWS):
        tile = slice(start, start + TILE_ROWS)
        far = boxes.distances(x[tile])
        order = np.argsort(far, axis=1, kind="stable")
        rows = np.arange(len(far))
        for step in range(len(members)):  # the nearest leaf of each row, the second one, ...
            leaf = order[rows, step]
            dist = far[rows, leaf]
            still = (dist <= np.minimum(radius[tile][rows], best[tile][rows, -1])) & np.isfinite(dist)
            rows, leaf = rows[still], leaf[still]
            if not len(rows):
                break
            by_leaf = np.argsort(leaf, kind="stable")
            for own in np.split(by_leaf, np.flatnonzero(np.diff(leaf[by_leaf])) + 1):
                there, who = members[leaf[own[0]]], rows[own] + start
                dist = _distances(x[who], donors[there])
                dist = np.concatenate([best[who], np.where(dist <= radius[who, None], dist, np.inf)], axis=1)
                which = np.concatenate([at[who], np.broadcast_to(there, (len(who), len(there)))], axis=1)
                which[~np.isfinite(dist)] = len(donors)
                if dist.shape[1] > 4 * k:  # only those up to the k-th distance need sorting
                    limit = np.partition(dist, k - 1, axis=1)[:, k - 1:k]
                    keep = max(k, int((dist <= limit).sum(1).max()))
                    if keep < dist.shape[1]:
                        some = np.argpartition(dist, keep - 1, axis=1)[:, :keep]
                        dist, which = np.take_along_axis(dist, some, 1), np.take_along_axis(which, some, 1)
                first = np.lexsort((which, dist), axis=1)[:, :k]
                best[who], at[who] = np.take_along_axis(dist, first, 1), np.take_along_axis(which, first, 1)
    at[~np.isfinite(best)] = -1
    return best, at


# Spark ---------------------------------------------------------------------------------------

def donor_vectors(df: DataFrame, cols: list[str], key: str | None = None) -> DataFrame:
    """(vec, dk, n): the distinct vectors of ``df``, the smallest key of each (the vector
    itself as text without a key column) and how often it occurs."""
    vec = _vector(cols)
    rows = df.select(vec.alias("vec"), (c(key) if key else vec.cast("string")).alias("dk"))
    return rows.groupBy("vec").agg(F.min("dk").alias("dk"), F.count(F.lit(1)).alias("n"))


def _meet(queries: DataFrame, donors: DataFrame, d: int, k: int, group_rows: int) -> DataFrame:
    """(vec, col, near): the up to ``k`` nearest donors of the cells ``g`` that the queries
    (vec, col, radius, g) name, those beyond the radius left out; one row a query and cell with any."""
    spark = queries.sparkSession
    sizes = [(r["g"], -(-r["count"] // group_rows)) for r in queries.groupBy("g").count().collect()]  # at most a row a cell
    parts = F.broadcast(spark.createDataFrame(sizes, "g long, parts long"))
    left = queries.join(parts, "g").select("vec", "col", "radius", "g", F.pmod(_hash("vec"), F.col("parts")).alias("r"))
    right = donors.join(parts, "g").select("vec", "dk", "n", "g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("r"))
    key_type = donors.schema["dk"].dataType
    near_type = T.StructType([T.StructField("dist", T.DoubleType()), T.StructField("dk", key_type),
                              T.StructField("value", T.DoubleType()), T.StructField("n", T.LongType())])
    found = T.StructType([T.StructField("vec", T.ArrayType(T.DoubleType())), T.StructField("col", T.IntegerType()),
                          T.StructField("near", T.ArrayType(near_type))])

    def best(asked: pa.Table, near: pa.Table) -> pa.Table:
        asked, near = asked.combine_chunks(), near.combine_chunks()
        x, dx, n = _matrix(asked["vec"], d), _matrix(near["vec"], d), near["n"].to_numpy()
        column, radius = asked["col"].to_numpy(), asked["radius"].to_numpy()
        rank = pc.rank(near["dk"], null_placement="at_start", tiebreaker="dense").to_numpy()
        vecs, cols, lengths, values = [], [], [], []
        for j in np.unique(column):
            own, has = np.flatnonzero(column == j), np.flatnonzero(~np.isnan(dx[:, j]))
            has = has[np.lexsort((n[has], dx[has, j], rank[has]))]  # first on ties, as in the merge
            if not len(has):
                continue
            dist, at = nearest(x[own], radius[own], dx[has], k)
            row, place = np.nonzero(at >= 0)
            many = (at >= 0).sum(1)
            chosen = has[at[row, place]]
            vecs.append(own[many > 0])
            cols.append(np.full(int((many > 0).sum()), j, np.int32))
            lengths.append(many[many > 0])
            values.append((dist[row, place], chosen, dx[chosen, j]))
        if not vecs:
            vecs, cols, lengths, values = [np.zeros(0, int)], [np.zeros(0, np.int32)], [np.zeros(0, int)], [(np.zeros(0), np.zeros(0, int), np.zeros(0))]
        dist, chosen, value = (np.concatenate(v) for v in zip(*values))
        told = pa.StructArray.from_arrays([pa.array(dist), _one(near["dk"].take(pa.array(chosen))), pa.array(value), pa.array(n[chosen], pa.int64())], ["dist", "dk", "value", "n"])
        ends = np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
        return pa.table([asked["vec"].take(pa.array(np.concatenate(vecs))), pa.array(np.concatenate(cols)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), told)],
                        names=["vec", "col", "near"])

    return left.groupBy("g", "r").cogroup(right.groupBy("g", "r")).applyInArrow(best, found)


def _one(column) -> pa.Array:
    column = column.combine_chunks()
    return column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _cells(donors: DataFrame, n_donors: int, d: int, known: np.ndarray, group_rows: int) -> tuple[Cells, DataFrame]:
    """Cells of about ``group_rows`` donors, and the donors with their cell ``g``."""
    wanted = min(MOST_CELLS, -(-n_donors // group_rows))
    sample = np.zeros((0, d))
    if wanted > 1:
        taken = donors.select("vec").sample(min(1.0, SAMPLED * wanted / n_donors), seed=42).limit(2 * SAMPLED * wanted).toArrow()
        sample = _matrix(taken["vec"], d)
    cells, _ = Cells.grown(sample, known, max(1, len(sample) // max(1, wanted)))

    def place(batches):
        for batch in batches:
            at = cells.place(_matrix(batch.column(0), d))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], ["vec", "dk", "n", "g"])

    schema = T.StructType([*donors.select("vec", "dk", "n").schema.fields, T.StructField("g", T.LongType())])
    return cells, donors.select("vec", "dk", "n").mapInArrow(place, schema)


def fill_from_neighbours(df: DataFrame, cols: list[str], donors: DataFrame, k: int = 5,
                         group_rows: int = GROUP_ROWS) -> DataFrame:
    """Fills NULL and NaN in ``cols`` from ``donors`` (of ``donor_vectors`` on the same columns)."""
    d, spark = len(cols), df.sparkSession
    vec = _vector(cols)
    # not deterministic in the optimizer's eyes, so that it keeps no constraints on it: over aliased columns they double with each one
    gaps = F.when(F.spark_partition_id() >= 0, F.exists(vec, lambda v: v.isNull()))
    means = donors.agg(F.count(F.lit(1)).alias("rows"), *[F.count(F.col("vec")[j]).alias(f"n{j}") for j in range(d)], *[
        (F.sum(F.col("vec")[j] * F.col("n")) / F.sum(F.when(F.col("vec")[j].isNotNull(), F.col("n")))).alias(f"m{j}") for j in range(d)]).first()
    n_donors = means["rows"]
    if n_donors == 0:
        return df
    filling = [j for j in range(d) if means[f"n{j}"]]

    def ask(batches):  # in Python: filters on the vector would be pushed down and drawn into the expressions of all columns
        for batch in batches:
            x = _matrix(batch.column(0), d)
            row, at = np.nonzero(np.isnan(x[:, filling]) & ~np.isnan(x).all(1)[:, None])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(np.array(filling, np.int32)[at])], ["vec", "col"])

    queries = cut_lineage(df.where(gaps).select(vec.alias("vec")).distinct().mapInArrow(ask, "vec array<double>, col int"))
    asked = queries.agg(F.count(F.lit(1)).alias("rows"), *[F.count(F.col("vec")[j]).alias(f"n{j}") for j in range(d)]).first()

    def filled(fill) -> list[Column]:
        return [F.coalesce(nan_to_null(c(n).cast("double")), fill(cols.index(n)), F.lit(means[f"m{cols.index(n)}"])).alias(n)
                if n in cols else c(n) for n in df.columns]

    # complete rows are not moved at all
    whole = df.where(~gaps).select(*filled(lambda j: F.lit(None).cast("double")))
    if asked["rows"] == 0:  # nothing that a distance could fill
        return whole.unionByName(df.where(gaps).select(*filled(lambda j: F.lit(None).cast("double"))))
    cells, placed = _cells(donors, n_donors, d, np.array([asked[f"n{j}"] for j in range(d)]) / asked["rows"], group_rows)
    ranges = placed.groupBy("g").agg(F.count(F.lit(1)).alias("rows"), *[f(F.col("vec")[j]).alias(f"{t}{j}") for j in range(d) for f, t in ((F.min, "lo"), (F.max, "hi"), (F.count, "n"))]).toPandas()
    low, high, full = np.full((cells.cell.max() + 1, d), np.nan), np.full((cells.cell.max() + 1, d), np.nan), np.zeros((cells.cell.max() + 1, d), bool)
    at = ranges["g"].to_numpy()
    for j in range(d):
        low[at, j], high[at, j], full[at, j] = ranges[f"lo{j}"].to_numpy(float), ranges[f"hi{j}"].to_numpy(float), ranges[f"n{j}"] == ranges["rows"]
    nodes = cells.node_boxes(Boxes(low, high, full))
    schema = "vec array<double>, col int, radius double, g long"

    def home(batches):
        for batch in batches:
            g = cells.place(_matrix(batch.column(0), d), missing_left=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(g), np.inf)), pa.array(g, pa.int64())], ["vec", "col", "radius", "g"])

    def others(batches):
        for batch in batches:
            x = _matrix(batch.column(0), d)
            row, g = cells.within(x, batch.column(2).to_numpy(zero_copy_only=False), nodes)
            other = g != cells.place(x, missing_left=True)[row]
            row, g = row[other], g[other]
            yield pa.RecordBatch.from_arrays([*[col.take(pa.array(row)) for col in batch.columns], pa.array(g, pa.int64())], ["vec", "col", "radius", "g"])

    near = cut_lineage(_meet(queries.mapInArrow(home, schema), placed, d, k, group_rows))
    radius = F.when(F.size("near") == k, F.col("near")[k - 1]["dist"]).otherwise(F.lit(float("inf")))
    bounded = near.select("vec", "col", radius.alias("radius"))
    if len(at) > 1:
        # a query whose own cell has no donor for it is still unbounded
        rest = queries.join(bounded, (queries["col"] == bounded["col"]) & queries["vec"].eqNullSafe(bounded["vec"]), "left_anti")
        bounded = bounded.unionByName(rest.select("vec", "col", F.lit(float("inf")).alias("radius")))
        near = near.unionByName(_meet(bounded.mapInArrow(others, schema), placed, d, k, group_rows))
    merged = near.groupBy("vec", "col").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    start = F.struct(F.lit(k).cast("long").alias("room"), F.lit(0.0).alias("total"))

    def add(acc, s):
        used = F.least(acc["room"], s["n"])
        return F.struct((acc["room"] - used).alias("room"), (acc["total"] + used * s["value"]).alias("total"))

    fills = merged.select("vec", "col", F.aggregate("near", start, add, lambda acc: acc["total"] / (k - acc["room"])).alias("fill"))
    wide = fills.groupBy("vec").agg(*[F.max(F.when(F.col("col") == j, F.col("fill"))).alias(f"__fill{j}") for j in range(d)])
    mended = df.where(gaps).join(wide.withColumnRenamed("vec", "__vec"), vec == F.col("__vec"), "left") \
        .select(*filled(lambda j: F.col(f"__fill{j}")))
    return whole.unionByName(mended)


def impute_knn(df: DataFrame, cols: list[str], key: str, k: int = 5, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Fills NULLs in ``cols`` with the mean of the k nearest donors that have the
    column (ties broken by donor key); the fit set is ``df`` itself."""
    path = scratch_path(df.sparkSession, "knn-donors")  # read five times
    donor_vectors(df, cols, key).write.parquet(path)
    return fill_from_neighbours(df, cols, df.sparkSession.read.parquet(path), k, group_rows)
