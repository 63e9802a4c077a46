"""Window operators written so that one key holding much of the data stays distributable."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecraft.operators.attach import attach
from tablecraft.session import materialise


def first_per(df: DataFrame, keys: list[str], order_by: list[Column]) -> DataFrame:
    """First row of each key in the given order.

    Filtering a row number at 1 lets Spark keep one row per key on the map side, before
    the shuffle, so a key with very many rows does not move as a whole.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by))
    return df.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")


def latest_by(df: DataFrame, keys: list[str], version: str, *ties: str) -> DataFrame:
    """Row with the highest version of each key."""
    return first_per(df, keys, [F.col(c).desc() for c in (version, *ties)])


def with_group_stats(df: DataFrame, keys: list[str], *stats: Column) -> DataFrame:
    """Attach aggregates of a row's group to the row; NULL keys form a group.

    Aggregate and attach instead of an unordered window: the aggregate combines on the
    map side, where a window would put a whole group into one task.
    """
    return attach(df, df.groupBy(*keys).agg(*stats, F.count(F.lit(1)).alias("_group_rows")), keys, rows="_group_rows")


def any_in_group(df: DataFrame, cond: Column, by: list[str], alias: str) -> DataFrame:
    """Whether the condition holds on any row of the row's group."""
    return with_group_stats(df, by, F.bool_or(cond).alias(alias))


def min_max_scale(df: DataFrame, value: str, by: list[str], alias: str = "scaled") -> DataFrame:
    """(value - min) / (max - min) within the group; NULL when all values are equal."""
    stats = with_group_stats(df, by, F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    scaled = F.when(span != 0, (F.col(value) - F.col("_lo")) / span)
    return stats.withColumn(alias, scaled).drop("_lo", "_hi")


def step_lag(df: DataFrame, ts: str, by: list[str], ties: list[str], alias: str = "step_seconds") -> DataFrame:
    """Seconds since the previous row of the same group, in order of ``ts`` and ``ties``.

    The rows are dealt out once, by ranges of group, time and ties, so a group of any size, even one
    whose rows all have one time, spans as many tasks as it needs. Each task runs over its sorted rows; only a
    first row lacks what came before its border, and takes it from the last row of the range before, one row a range.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.withColumns({"_key": F.struct(*by) if by else F.lit(0), "_time": F.col(ts).cast("timestamp")})
    placed = placed.repartitionByRange(tasks, *by, ts, *ties).sortWithinPartitions(*by, ts, *ties)
    kind = T.StructType([*placed.schema, T.StructField("_prev", T.TimestampType()), T.StructField("_range", T.IntegerType()),
                         T.StructField("_first", T.BooleanType()), T.StructField("_last", T.BooleanType())])
    ranged = materialise(placed.mapInArrow(_previous_times, kind))
    ends = ranged.filter("_last").select("_key", "_time", "_range")
    ends = ends.select(F.col("_key").alias("_end_key"), F.col("_time").alias("_end"), F.lead("_range").over(Window.orderBy("_range")).alias("_into"))
    same = F.col("_first") & (F.col("_range") == F.col("_into")) & F.col("_key").eqNullSafe(F.col("_end_key"))
    joined = ranged.join(F.broadcast(ends), same, "left")  # a row for each range at most
    micros = F.unix_micros("_time") - F.unix_micros(F.coalesce("_prev", "_end"))
    return joined.select(*df.columns, (micros / F.lit(1e6)).alias(alias))


def _previous_times(batches):
    """Adds the time of the row before within a range, the range's number and marks of its first and last row."""
    number, key, time, held = TaskContext.get().partitionId(), None, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            yield _marked(held, number, last=False)
        keys, times = batch.column("_key"), batch.column("_time")
        same = np.append(key is not None and keys[0].as_py() == key[0], _equal_before(keys))
        before = pa.concat_arrays([pa.array([time], times.type), times[:-1]])
        prev = pc.if_else(pa.array(same), before, pa.scalar(None, times.type))
        first = np.zeros(batch.num_rows, bool)
        first[0] = key is None
        held = batch, prev, first
        key, time = (keys[-1].as_py(),), times[-1].as_py()
    if held is not None:
        yield _marked(held, number, last=True)


def _equal_before(keys: pa.Array) -> np.ndarray:
    """Whether each key after the first equals the one before it; nulls, and NaNs, are equal."""
    equal = np.ones(max(0, len(keys) - 1), bool)
    for column in keys.flatten() if pa.types.is_struct(keys.type) else [keys]:
        codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        equal &= codes[1:] == codes[:-1]
    return equal


def _marked(held, number: int, last: bool) -> pa.RecordBatch:
    batch, prev, first = held
    ends = np.zeros(batch.num_rows, bool)
    ends[-1] = last
    columns = [prev, pa.array(np.full(batch.num_rows, number, np.int32)), pa.array(first), pa.array(ends)]
    return pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "_prev", "_range", "_first", "_last"])


def page_rows(df: DataFrame, order_by: list[str], offset: int, size: int, shallow: int = 10_000) -> DataFrame:
    """Rows ``offset`` < row number <= ``offset + size`` in order of a unique key, numbered as ``rn``.

    A page near the start is a top-k. For a deep page the key range that holds it is
    narrowed first, about 60-fold per pass, until a top-k over that range is cheap. Only
    cut points and counts reach the driver; the range of a single key reaches the scan as a
    filter. NULL keys come first, as in a sort, at any depth.
    """
    if not order_by:
        raise ValueError("pagination needs an order key")
    source, skip = df, offset
    rows = None
    while skip + size > shallow:
        source, skip, left = _narrow(source, order_by, skip, size)
        if left == rows:
            break
        rows = left
    page = source.orderBy(*order_by).offset(skip).limit(size)
    number = F.row_number().over(Window.orderBy(*order_by)) + F.lit(offset)
    return page.withColumn("rn", number)


def _narrow(df: DataFrame, order_by: list[str], offset: int, size: int) -> tuple[DataFrame, int, int]:
    """The slices of ``df`` that hold the page, the rows to skip in them, and their row count."""
    # A struct is never NULL and compares its NULL fields as lowest.
    key = F.struct(*order_by) if len(order_by) > 1 else F.col(order_by[0])
    keys = df.select(key.alias("k"))
    kind = keys.schema["k"].dataType
    sample = keys.filter(F.col("k").isNotNull()).orderBy(F.xxhash64("k"), "k").limit(1024).orderBy("k")
    bounds = [_literal(r["k"], kind) for r in sample.collect()[::16]]
    inner = F.when(F.col("k").isNotNull(), _slice_number(F.col("k"), bounds, 0, len(bounds)))
    located = keys.select(F.coalesce(inner, F.lit(0)).alias("slice"))
    counts = {r["slice"]: r["n"] for r in located.groupBy("slice").agg(F.count("*").alias("n")).collect()}
    before, seen, held, wanted = 0, 0, 0, []
    for number in range(len(bounds) + 1):
        rows = counts.get(number, 0)
        if rows and seen < offset + size and seen + rows > offset:
            before = before if wanted else seen
            wanted.append(number)
            held += rows
        seen += rows
    if not wanted:
        return df.limit(0), 0, 0
    low, high = wanted[0], wanted[-1]
    part = df
    if low > 0:
        part = part.filter(key >= bounds[low - 1])
    if high < len(bounds):
        part = part.filter(key < bounds[high] if low > 0 else (key < bounds[high]) | key.isNull())
    return part, offset - before, held


def _slice_number(key: Column, bounds: list, low: int, high: int) -> Column:
    """How many of the sorted bounds are at most ``key``, by halving."""
    if low == high:
        return F.lit(low)
    mid = (low + high) // 2
    return F.when(key < bounds[mid], _slice_number(key, bounds, low, mid)).otherwise(
        _slice_number(key, bounds, mid + 1, high))


def _literal(value, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        return F.struct(*[_literal(v, f.dataType).alias(f.name) for v, f in zip(value, kind)])
    return F.lit(value).cast(kind)
