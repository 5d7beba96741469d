"""Connected components of an edge table, distributed: nothing about the graph reaches the driver but a count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.llm.common import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node of its component.

    Alternating large-star and small-star steps (Kiveris et al. 2014): each step is one join-free
    grouping on a node, and the number of steps grows with the logarithm of the longest path. Hot
    nodes are pre-aggregated: the minimum of a neighbourhood is a partial aggregate, and the join
    that hands it back is a plain equi-join whose hot keys adaptive execution can split.
    Self loops, repeated edges and an empty table are fine; null ends are dropped.
    """
    ends = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    given = cut(ends.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    nodes = given.select(F.col("u").alias("node")).union(given.select("v"))
    pairs = given.where("u <> v")
    size = _weight(pairs)
    for _ in range(rounds):
        if size == (0, None):
            break
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        # large star leaves v > m; small star links the smaller neighbours of v and v itself to their minimum
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        linked = large.join(least, "v")
        small = linked.select(F.col("m").alias("u"), F.col("u").alias("v")).union(least.select(F.col("m").alias("u"), "v")).where("u <> v").distinct()
        pairs = cut(small)
        now = _weight(pairs)
        if now == size:
            break
        size = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = pairs.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("root"))
    return nodes.distinct().join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def _weight(pairs: DataFrame) -> tuple:
    """Changes with every step until the stars are done: the number of edges and a hash sum over them."""
    row = pairs.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("h")).head()
    return row.n, row.h
