"""Attach one row per group to the rows of the groups, whatever the sizes."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecraft.session import materialise

# A group table, or the hot groups of a larger one, of at most this estimated size is broadcast.
BROADCAST_BYTES = 64 * 1024 * 1024
# A key with more rows than one task should handle.
HOT_ROWS = 5_000_000
SALTS = 1024


def hot_keys(df: DataFrame, keys: list[str]) -> DataFrame | None:
    """The keys with more than ``HOT_ROWS`` rows, or None when there is none.

    Rows are counted per key on the map side first. There is at most one such key for every
    ``HOT_ROWS`` rows.
    """
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > HOT_ROWS)
    found = materialise(counted.select(*keys))
    return None if found.isEmpty() else found


def attach(df: DataFrame, groups: DataFrame, keys: list[str], null_safe: bool = True,
           broadcast_bytes: int = BROADCAST_BYTES, size: float | None = None,
           rows: str | None = None) -> DataFrame:
    """Left join of ``groups``, which has one row per value of ``keys``.

    The group table is computed first and its size is known before the rows move. A small
    one is broadcast and the rows stay where they are. Otherwise rows and groups meet by
    key, except for hot keys: their rows take their values from a broadcast of just these
    groups, if these are measured small too, and, like rows with NULL keys that match
    nothing, are spread over salts. Hot groups too wide to broadcast are left to the skew
    join, which can split the row side of a left join. ``size`` gives the bytes of a group table that was ``measured`` before.
    ``rows`` names a column of the group table that counts its rows and is not attached; then hot keys are known from it, else the
    rows are counted.
    """
    values = [c for c in groups.columns if c not in (*keys, rows)]
    saved, size = measured(groups) if size is None else (groups, size)
    if size <= broadcast_bytes:
        return left_join(df, F.broadcast(saved.drop(rows) if rows else saved), keys, null_safe).select(*_names(df), *values)

    if rows:
        hot, size = measured(saved.filter(F.col(rows) > HOT_ROWS).drop(rows))
        hot, saved = None if size == 0 else hot, saved.drop(rows)
    else:
        largest = hot_keys(df if null_safe else df.dropna(subset=keys), keys)
        hot, size = (None, 0) if largest is None else measured(left_join(largest, saved, keys, null_safe))
    hot = hot if size <= BROADCAST_BYTES else None
    if hot is None and null_safe:
        return left_join(df, saved, keys, null_safe).select(*_names(df), *values)

    marked, alone = df.withColumn("_hot", F.lit(False)), F.lit(False)
    if hot is not None:
        hot = hot.withColumn("_hot", F.lit(True))
        hot = hot.select(*keys, "_hot", *[F.col(v).alias(f"_hot_{v}") for v in values])
        marked = left_join(df, F.broadcast(hot), keys, null_safe)
        alone = F.coalesce("_hot", F.lit(False))
    if not null_safe:
        alone = alone | reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    spread = F.pmod(F.xxhash64(*hashable(df)), F.lit(SALTS)) + 1
    salted = marked.withColumn("_salt", F.when(alone, spread).otherwise(0))
    joined = left_join(salted, saved.withColumn("_salt", F.lit(0).cast("bigint")), [*keys, "_salt"], null_safe)
    if hot is None:
        return joined.select(*_names(df), *values)
    return joined.select(*_names(df), *[
        F.when(F.col("_hot"), F.col(f"_hot_{v}")).otherwise(F.col(v)).alias(v) for v in values])


def keep_matching(df: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` is among the first column of ``values`` (semi join)."""
    found = values.select(F.col(values.columns[0]).alias(column)).distinct().withColumn("_found", F.lit(True))
    return attach(df, found, [column], null_safe=False).filter(F.col("_found")).drop("_found")


def left_join(df: DataFrame, groups: DataFrame, keys: list[str], null_safe: bool) -> DataFrame:
    """Left join by equal column names that keeps the columns of ``df`` as they are."""
    other = groups.select(*[F.col(k).alias(f"_g_{k}") for k in keys], *[c for c in groups.columns if c not in keys])
    pairs = [(df[k], F.col(f"_g_{k}")) for k in keys]
    same = reduce(lambda a, b: a & b, [a.eqNullSafe(b) if null_safe else a == b for a, b in pairs])
    return df.join(other, same, "left").drop(*[f"_g_{k}" for k in keys])


def measured(df: DataFrame) -> tuple[DataFrame, float]:
    """The computed frame and its estimated bytes, counted while it is written."""
    size = Observation()
    saved = materialise(df.observe(size, estimated_bytes(df).alias("bytes")))
    return saved, size.get.get("bytes", math.inf)


def estimated_bytes(groups: DataFrame) -> Column:
    """Rows times a fixed width, plus the bytes in strings and binaries; nested values by eight times their JSON text.

    JSON spends at least two bytes on a list element, so nested values are never taken for smaller than they are.
    """
    lengths = []
    for f in groups.schema:
        value = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            lengths.append(F.octet_length(value))
        elif isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType, T.VariantType)):
            lengths.append(8 * F.octet_length(F.to_json(F.struct(value.alias("v")))))
    row = reduce(lambda a, b: a + b, [F.coalesce(n, F.lit(0)).cast("bigint") for n in lengths], F.lit(16 * len(groups.columns)).cast("bigint"))
    return F.coalesce(F.sum(row.cast("bigint")), F.lit(0).cast("bigint"))


def hashable(df: DataFrame) -> list[Column]:
    return [F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]


def _names(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in df.columns]
