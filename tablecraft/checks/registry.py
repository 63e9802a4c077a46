"""Registry of queries and helpers shared by them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    """Register a query; ``sql`` is the same query for DuckDB, where it can be written."""
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 4, **special: int) -> DataFrame:
    """Double columns rounded, so that the order of additions does not show; -1 keeps a column."""
    places = {c: special.get(c, digits) if t == "double" else -1 for c, t in df.dtypes}
    return df.select(*[F.col(f"`{c}`") if n < 0 else F.round(F.col(f"`{c}`"), n).alias(c) for c, n in places.items()])


def ts_text(col: str | Column) -> Column:
    """Timestamp as text with microseconds."""
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS")


TS_SQL = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"
AS_OF = "2024-01-31 00:00:00"
