"""Operator 8: near-duplicate vectors by Euclidean p-stable hashing and exact cosine.

A vector is normalised; then cosine >= c is a distance of at most sqrt(2 - 2c). Each
table quantises ``k`` Gaussian projections with random offsets into cells of width
``cell``; near vectors often share all k cells, far ones rarely. ``k`` follows from the
number of vectors (expected far collisions of a vector in a table stay about
``far_per_bucket``) and the number of tables from the wanted recall at the threshold
itself. Every pair in a bucket is checked by its cosine in double precision; a pair is
counted in the first table where it meets, so link counts are exact over found pairs.

Equal vectors are one class with a multiplicity (grouped with partial sums). Buckets
give back counts and a spanning forest, never pairs. A bucket of more than ``block``
classes is dealt out as pairs of sub-blocks, so no task holds it whole and no pair of
it is lost.

Defined results: a vector that is null, empty, zero or holds a null or non-finite
component links with nothing and is its own component; so does a row without id, whose
component_id and kept are null. Vectors of different lengths never link. Repeated rows
count as other vectors; rows that share an id are one node. Empty tables are fine.
Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huntlake.llm.components import connected_components
from huntlake.llm.textkit import forest, run_edges, runs
from huntlake.session import cut_lineage

CELL, FAR_PER_BUCKET, RECALL, BLOCK = 2.0, 200, 0.95, 4096


def collision(distance: float, cell: float = CELL) -> float:
    """Chance that a quantised projection puts two vectors at this distance in one cell."""
    r = cell / distance
    phi = 0.5 * (1 + math.erf(-r / math.sqrt(2)))
    return 1 - 2 * phi - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def table_shape(vectors: int, cosine: float, far_per_bucket: int = FAR_PER_BUCKET, recall: float = RECALL) -> tuple[int, int]:
    """(projections a table, tables) for this many vectors."""
    near, far = collision(math.sqrt(2 - 2 * cosine)), collision(math.sqrt(2))
    k = max(4, math.ceil(math.log(max(1, vectors) / far_per_bucket + 1) / -math.log(far)))
    return k, math.ceil(math.log(1 - recall) / math.log(1 - near ** k))


def _bucket_keys(unit: np.ndarray, k: int, tables: int, seed: int) -> np.ndarray:
    """A 32-bit key of each vector's cells in each table."""
    rng = np.random.Generator(np.random.PCG64([seed, unit.shape[1]]))
    cells = np.floor((unit @ rng.standard_normal((unit.shape[1], k * tables)) + rng.uniform(0, CELL, k * tables)) / CELL)
    cells = cells.astype(np.int64).view(np.uint64).reshape(len(unit), tables, k)
    key = np.full((len(unit), tables), unit.shape[1], np.uint64)
    for j in range(k):
        key = (key ^ cells[:, :, j]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return (key >> np.uint64(32)).astype(np.uint32)


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def count_links(ids: np.ndarray, weight: np.ndarray, unit: np.ndarray, keys: np.ndarray, table: int, side: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Over one bucket: each member's weighted number of links first met in this table, and its forest root."""
    n, total, left, right = len(ids), np.zeros(len(ids), np.int64), [], []
    crossed = len(np.unique(side)) > 1
    for at in range(0, n, 512):
        i, j = np.nonzero(unit[at:at + 512] @ unit.T >= cosine)
        i += at
        ok = (i < j) & ((side[i] != side[j]) if crossed else True)
        i, j = i[ok], j[ok]
        ok = (keys[i, table] == keys[j, table]) & ~(keys[i, :table] == keys[j, :table]).any(1)
        i, j = i[ok], j[ok]
        np.add.at(total, i, weight[j])
        np.add.at(total, j, weight[i])
        left.append(i)
        right.append(j)
    return total, forest(n, np.concatenate(left), np.concatenate(right))


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.9,
                 recall: float = RECALL, block: int = BLOCK, seed: int = 8) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    vec = F.col(vec_col).cast("array<double>")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec"))
    usable = F.coalesce(F.col("vec_id").isNotNull() & finite & F.exists("vec", lambda x: x != 0), F.lit(False))
    classes = cut_lineage(rows.where(usable).groupBy("vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")))
    k, tables = table_shape(classes.count(), cosine, recall=recall)

    def hashed(batches):
        for batch in batches:
            lists = batch.column(2)
            sizes = np.asarray(lists.value_lengths())
            for size in np.unique(sizes):
                part = np.flatnonzero(sizes == size)
                got = batch.take(pa.array(part))
                values = np.array(got.column(2).flatten()).reshape(len(part), size)
                keys = _bucket_keys(_unit(values), k, tables, seed)
                yield pa.RecordBatch.from_arrays([got.column(0), got.column(1), got.column(2), pa.array([x.tobytes() for x in keys], pa.binary()),
                                                  pa.array(list((keys.astype(np.int64) << 16) | np.arange(tables)), pa.list_(pa.int64()))], ["rep", "weight", "vec", "cells", "buckets"])

    hashes = cut_lineage(classes.select("rep", "weight", "vec").mapInArrow(hashed, "rep long, weight long, vec array<double>, cells binary, buckets array<long>"))
    narrow = hashes.select(F.explode("buckets").alias("bucket"), "rep")
    sizes = narrow.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / block).cast("long")
    own = F.pmod(F.xxhash64("rep"), parts)
    met = narrow.join(sizes, "bucket").select("bucket", "rep", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("other"))
    met = met.withColumn("key", F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")))
    # one row where both sub-blocks are the same
    met = met.join(hashes.drop("buckets"), "rep").select("key", "rep", "weight", "vec", "cells", (F.col("bucket").bitwiseAND(F.lit(0xFFFF).cast("long"))).alias("t"), "own")

    def check(batches):
        for batch in runs(batches, "key"):
            keys, ids, weights = (batch.column(i).to_numpy() for i in (0, 1, 2))
            table, side = batch.column(5).to_numpy(), batch.column(6).to_numpy()
            out = []
            for a, b in zip(*run_edges(keys)):
                if b - a > 1:
                    unit = _unit(np.array(batch.column(3).slice(a, b - a).flatten()).reshape(b - a, -1))
                    cells = np.frombuffer(b"".join(batch.column(4).slice(a, b - a).to_pylist()), np.uint32).reshape(b - a, tables)
                    n, root = count_links(ids[a:b], weights[a:b], unit, cells, int(table[a]), side[a:b], cosine)
                    hit = np.flatnonzero(n)
                    out.append((ids[a:b][hit], n[hit], ids[a:b][root[hit]]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["rep", "n", "root"])

    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = cut_lineage(met.repartition(n, "key").sortWithinPartitions("key", "rep").mapInArrow(check, "rep long, n long, root long"))
    counts = links.groupBy("rep").agg(F.sum("n").alias("n"))
    parts = connected_components(links, "rep", "root").select(F.col("node").alias("rep"), "component")
    known = classes.join(counts, "rep", "left").join(parts, "rep", "left").select(
        "vec", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = rows.where(usable).join(known, "vec").select("vec_id", "n_links", "component_id")
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
