"""Table relation graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecraft.functions import fixed_values as fixed
from tablecraft.functions.scalars import starts_with_any
from tablecraft.operators.attach import BROADCAST_BYTES, measured
from tablecraft.session import materialise

# Levels after which the paths of a table tree are written.
CUT = 6


def module_list(models: DataFrame, excludes: list[str] | None = None) -> DataFrame:
    """Business modules: the upper-case first part of the names of permanent base models."""
    kept = models.filter(~F.col("transient") & (F.col("state") == "base"))
    modules = kept.select(F.upper(F.substring_index("model", ".", 1)).alias("table_name")).distinct()
    name = F.col("table_name")
    wanted = (~starts_with_any(name, fixed.MODULE_EXCLUDES if excludes is None else excludes)
              & name.rlike("^[A-Z]") & (F.length(name) > 2))
    return modules.filter(wanted).select(
        F.lit(1).alias("level"), F.lit(None).cast("string").alias("parent_table"), "table_name", name.alias("path"))


def business_edges(edges: DataFrame, excludes: list[str] | None = None) -> DataFrame:
    """Relations with no technical table on either end."""
    technical = fixed.RELATION_EXCLUDES if excludes is None else excludes
    return edges.filter(~starts_with_any(F.col("source_table"), technical)
                        & ~starts_with_any(F.col("target_table"), technical))


def table_hierarchy(edges: DataFrame, tables: DataFrame, root: str, max_level: int = 5) -> DataFrame:
    """Tables reached from a module's own tables along relations, one row per path.

    A path starts with the module name, so the module's own tables, which have no parent,
    share one path and are not shown. Rows with equal paths continue alike: they are made one right after the
    first step, from where on paths differ, because each relation between two tables is taken
    once. The relations are written once and broadcast if measured small, so the later steps move
    no rows; every ``CUT`` levels the paths are written, and the walk ends when there are none.
    """
    allowed = edges.filter(~starts_with_any(F.col("target_table"), fixed.TREE_STEP_EXCLUDES))
    steps, size = measured(allowed.select("source_table", "target_table").distinct())
    steps = F.broadcast(steps) if size <= BROADCAST_BYTES else steps
    own = tables.filter(F.col("table_name").like(f"{root.lower()}_%") & ~starts_with_any(F.col("table_name"), fixed.TREE_ROOT_EXCLUDES))
    # Same path means same table; the lowest shown parent name stands for all of them.
    shown = F.when(~_hidden("source_table"), F.col("source_table"))
    first = own.select("table_name").join(steps, F.col("table_name") == F.col("source_table")).groupBy("target_table").agg(F.min(shown).alias("parent_table"))
    front = materialise(first.select(F.lit(2).alias("level"), "parent_table", F.col("target_table").alias("table_name"),
                                     F.concat_ws(" -> ", F.lit(root.upper()), "target_table").alias("path")))
    found = front if max_level > 1 else front.limit(0)
    for level in range(3, max_level + 1):
        front = front.select("table_name", "path").join(steps, F.col("table_name") == F.col("source_table")).select(
            F.lit(level).alias("level"), shown.alias("parent_table"), F.col("target_table").alias("table_name"),
            F.concat_ws(" -> ", "path", "target_table").alias("path"))
        if level % CUT == 0:
            front = materialise(front)
            if front.isEmpty():
                break
        found = found.unionByName(front)
    return found.filter(~_hidden("table_name") & F.col("parent_table").isNotNull())


def _hidden(name: str) -> Column:
    return reduce(lambda a, b: a | b, [F.col(name).like(p) for p in fixed.TREE_HIDDEN])
