"""Helpers shared by the operators of this package."""

from __future__ import annotations

from functools import reduce

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablecraft.operators.attach import estimated_bytes
from tablecraft.session import materialise, scratch_path

BLANK = r"[\x20\x09-\x0D]+"
BROADCAST_BYTES = 32 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else changed."""
    return F.translate(text, UPPER, LOWER)


def row_key(*cols: str) -> list[Column]:
    """128 bits that name a row by some of its columns; equal for equal rows, never null."""
    marks = [F.col(f"`{c}`").isNull() for c in cols]
    values = [F.col(f"`{c}`") for c in cols]
    return [F.xxhash64(*values, *marks).alias("_key1"), F.xxhash64(F.lit(77), *marks, *values).alias("_key2")]


def written(df: DataFrame, name: str, paths: list[str] | None = None) -> DataFrame:
    """A table in the shared folder, read more than once; its path is added to ``paths``."""
    path = scratch_path(df.sparkSession, name)
    if paths is not None:
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def measured(df: DataFrame) -> tuple[DataFrame, int]:
    """The computed frame and its size in bytes."""
    saved = materialise(df)
    return saved, int(saved.agg(estimated_bytes(saved)).first()[0] or 0)


def share(df: DataFrame, value):
    """A broadcast of any object whose classes need not be importable in tasks; read it with ``shared``."""
    return df.sparkSession.sparkContext.broadcast(cloudpickle.dumps(value))


def shared(broadcast):
    return cloudpickle.loads(broadcast.value)


def small_or_shuffled(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The computed frame, to be broadcast only if it was measured to be at most ``limit`` bytes.

    Beyond that it meets the other side by key, where adaptive execution splits hot keys.
    Only for frames of numbers, strings and other flat columns.
    """
    saved, size = measured(df)
    return F.broadcast(saved) if size <= limit else saved


def running_before(df: DataFrame, group: list[str], order: list[Column | str], value: Column, name: str) -> DataFrame:
    """Adds, per group, the sum of ``value`` over the rows that come earlier in ``order``.

    The rows are dealt out by ranges of (group, order); a group of any size spans as many
    tasks as it needs, and only one total per group and range is summed in one place.
    """
    keys = [F.col(g) for g in group]
    tasks = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = df.withColumn("_value", value.cast("double") if name.startswith("_d") else value)
    parts = materialise(parts.repartitionByRange(tasks, *keys, *order).withColumn("_range", F.spark_partition_id()))
    totals = parts.groupBy(*group, "_range").agg(F.sum("_value").alias("_total"))
    before = Window.partitionBy(*group, F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_start", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
    inside = Window.partitionBy(*group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_within", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    same = reduce(lambda a, b: a & b, [parts[c].eqNullSafe(totals[c]) for c in [*group, "_range"]])
    joined = parts.join(totals, same, "left")
    return joined.select(*[parts[c] for c in df.columns], (F.col("_start") + F.col("_within")).alias(name))
