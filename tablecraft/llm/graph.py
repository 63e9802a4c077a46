"""Connected components as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecraft.session import materialise


def _smallest(edges: DataFrame) -> DataFrame:
    """(``_n``, ``_least``): the smallest of a node and its neighbours."""
    return edges.groupBy(F.col("_u").alias("_n")).agg(F.min("_v").alias("_low")).select(
        "_n", F.least("_n", "_low").alias("_least"))


def components(edges: DataFrame) -> DataFrame:
    """(``_n``, ``_root``) for every node of the edges (``_u``, ``_v``): the smallest node it is connected to.

    Alternates the two star steps: each node's larger, then its smaller neighbours are hung on its smallest
    neighbour. Edges stay as many as nodes at most, rounds grow with the logarithm of the longest path, every
    round is a written table. Minima are combined before the shuffle, so a node with a third of all edges is no bottleneck there, and in the join
    adaptive execution can split it.
    """
    edges = materialise(edges.filter(F.col("_u") != F.col("_v")).select(
        F.greatest("_u", "_v").alias("_u"), F.least("_u", "_v").alias("_v")).distinct())
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("_v").alias("_u"), F.col("_u").alias("_v")))
        large = both.join(_smallest(both), F.col("_u") == F.col("_n")).filter(F.col("_v") > F.col("_u"))
        large = materialise(large.select(F.col("_v").alias("_u"), F.col("_least").alias("_v")).distinct())
        small = large.join(_smallest(large), F.col("_u") == F.col("_n"))
        small = small.select(F.explode(F.array(F.struct(F.col("_u").alias("_u"), F.col("_least").alias("_v")),
                                               F.struct(F.col("_v").alias("_u"), F.col("_least").alias("_v")))).alias("_e"))
        edges = materialise(small.select("_e.*").filter(F.col("_u") != F.col("_v")).distinct())
        last, state = state, _state(edges)
        if state == last:
            break
    roots = edges.select("_v").distinct().select(F.col("_v").alias("_n"), F.col("_v").alias("_root"))
    return edges.select(F.col("_u").alias("_n"), F.col("_v").alias("_root")).unionByName(roots)


def _state(edges: DataFrame) -> tuple:
    mark = F.pmod(F.xxhash64("_u", "_v"), F.lit(1 << 40))
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(mark)).first())
