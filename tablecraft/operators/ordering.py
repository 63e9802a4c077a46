"""Sorting, ranges and profiles."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecraft.functions.fixed_values import DATE_LIKE_COLUMNS


def sort_sheet(df: DataFrame, col: str, desc: bool = False, limit: int | None = 1000,
               ties: list[str] | None = None, as_text: bool = False) -> DataFrame:
    """Sheet order by one column; the grid form compares the trimmed text of the cell."""
    key = F.trim(F.col(col).cast("string")) if as_text else F.col(col)
    ordered = df.orderBy(key.desc() if desc else key.asc(), *(ties or []))
    return ordered if limit is None else ordered.limit(limit)


def head(df: DataFrame, n: int = 100, order_by: list[Column] | None = None) -> DataFrame:
    return (df.orderBy(*order_by) if order_by else df).limit(n)


def summary_and_list(summary: DataFrame, listing: DataFrame, order_by: list[Column]) -> DataFrame:
    """One summary row followed by the list in its own order.

    ``order_by`` refers to columns both sides share; the summary keeps the first place.
    """
    both = summary.withColumn("_part", F.lit(0)).unionByName(listing.withColumn("_part", F.lit(1)))
    return both.orderBy("_part", *order_by).drop("_part")


def range_slice(df: DataFrame, field: str | None, lo=None, hi=None, fields: list[str] | None = None) -> DataFrame:
    """Rows whose date lies in [lo, hi]; a bound of None is open; without a field, all rows.

    Written as a half-open range on the column itself, so that it reaches the scan as a
    pushed filter; a timestamp of day ``hi`` is still inside.
    """
    out = df
    if field is not None:
        kind = df.schema[field].dataType.simpleString()
        kind = kind if kind.startswith("timestamp") else "date"
        if lo is not None:
            out = out.filter(F.col(field) >= F.to_date(F.lit(str(lo))).cast(kind))
        if hi is not None:
            out = out.filter(F.col(field) < F.date_add(F.to_date(F.lit(str(hi))), 1).cast(kind))
    return out.select(*fields) if fields else out


def range_profile(df: DataFrame, pattern: str = DATE_LIKE_COLUMNS) -> DataFrame:
    """Row count, and min and max of every column with a date-like name."""
    cols = [c for c in df.columns if re.fullmatch(pattern, c)]
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        *[F.min(c).alias(f"min_{c}") for c in cols],
        *[F.max(c).alias(f"max_{c}") for c in cols])
