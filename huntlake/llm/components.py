"""Connected components of a link table by alternating star contraction.

Each round points every node at the smallest neighbour it knows, first for larger
then for smaller neighbours; the number of rounds grows with the logarithm of the
longest chain. Minima are grouped aggregates with partial sums on the map side; a
node with very many links only makes its join skewed, which adaptive execution
splits. The table is checkpointed in the shared folder once a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huntlake.session import cut_lineage


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """(node, component): the smallest node of the component, for every node that has a link.

    ``links`` may be empty, hold loops, nulls (ignored), repeated and mirrored rows.
    """
    x, y = F.col(a), F.col(b)
    stars = cut_lineage(links.where(x.isNotNull() & y.isNotNull() & (x != y))
                        .select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct())
    seen = _signature(stars)
    for _ in range(max_rounds):
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = cut_lineage(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        now = _signature(stars)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _signature(stars: DataFrame) -> tuple:
    return tuple(stars.agg(F.count("u"), F.bit_xor(F.xxhash64("u", "v"))).first())
