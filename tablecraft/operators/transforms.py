"""Row and column transforms on a whole DataFrame."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecraft.functions.scalars import contains_text
from tablecraft.operators.windows import first_per


def filter_rows(df: DataFrame, cond: str) -> DataFrame:
    return df.filter(F.expr(cond))


def dedup(df: DataFrame, fields: list[str], order_by: list[Column] | None = None) -> DataFrame:
    """One row per value of ``fields``: any row, or the first by ``order_by``."""
    return first_per(df, fields, order_by) if order_by else df.dropDuplicates(fields)


def drop_columns(df: DataFrame, fields: list[str]) -> DataFrame:
    return df.drop(*fields)


def add_column(df: DataFrame, name: str, value: str = "-", at: int | None = None) -> DataFrame:
    """A constant column at the end or at position ``at``."""
    at = len(df.columns) if at is None else at
    return df.select(*df.columns[:at], F.lit(value).alias(name), *df.columns[at:])


def prefix_columns(df: DataFrame, table: str) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(f"{table}_{c}") for c in df.columns])


def select_matching(df: DataFrame, pattern: str) -> DataFrame:
    """Columns whose name contains a match of the regular expression."""
    return df.select(*[f"`{c}`" for c in df.columns if re.search(pattern, c)])


def stringify_key(df: DataFrame, pk: str) -> DataFrame:
    """A floating key becomes text, so that equality on it is well defined."""
    if isinstance(df.schema[pk].dataType, (T.FloatType, T.DoubleType)):
        return df.withColumn(pk, F.col(pk).cast("string"))
    return df


def search_rows(df: DataFrame, query: str, col: str | None = None) -> DataFrame:
    """Rows with the text in one column, or in any column."""
    if not query:
        return df
    return df.filter(contains_text([col] if col else df.columns, query))


def encode_binary(df: DataFrame) -> DataFrame:
    """Binary columns as base64 text."""
    return df.select(*[
        F.base64(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.BinaryType) else F.col(f.name)
        for f in df.schema
    ])


def preview(df: DataFrame, n: int = 10, order_by: list[Column] | None = None) -> DataFrame:
    """First ``n`` rows, by a key when one is given."""
    return (df.orderBy(*order_by) if order_by else df).limit(n)
