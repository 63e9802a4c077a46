"""Column expressions used by the transformation steps."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def casing(col: str, mode: str) -> Column:
    """UPPER or LOWER; any other mode leaves the column as it is."""
    change = {"UPPER": F.upper, "LOWER": F.lower}.get(mode.upper())
    return (change(F.col(col)) if change else F.col(col)).alias(col)


def calculate(field: str, expr: str) -> Column:
    """Arithmetic over columns and literals, written as a Spark SQL expression.

    Division by zero is an error in Spark SQL; write ``nullif`` or ``try_divide`` for NULL.
    """
    return F.expr(expr).alias(field)


def case_set(field: str, cond: str, value: str, is_new: bool = False) -> Column:
    """``value`` where ``cond`` holds; otherwise NULL (new field) or the old value."""
    rest = F.lit(None) if is_new else F.col(field)
    return F.when(F.expr(cond), F.expr(value)).otherwise(rest).alias(field)


def split_to(field: str, sep: str, names: list[str]) -> list[Column]:
    """Piece i of the text becomes field i; NULL counts as 'UNKNOWN', a missing piece is NULL."""
    text = F.coalesce(F.col(field).cast("string"), F.lit("UNKNOWN"))
    pieces = F.split(text, re.escape(sep))
    return [F.get(pieces, F.lit(i)).alias(name) for i, name in enumerate(names)]


# Target type of each conversion offered to users.
CONVERSIONS = {"bool": "boolean", "str": "string", "int": "bigint", "float": "double"}


def convert(field: str, to: str) -> Column:
    """Convert to bool, date, str, int or float; text that does not convert becomes NULL."""
    if to == "date":
        return F.try_to_timestamp(F.col(field).cast("string")).alias(field)
    return F.col(field).try_cast(CONVERSIONS[to]).alias(field)


def contains_text(cols: list[str], query: str) -> Column:
    """Case-insensitive substring match in any of ``cols``; NULL counts as ''."""
    wanted = F.lit(query.lower())
    hits = [F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), wanted) for c in cols]
    return reduce(lambda a, b: a | b, hits, F.lit(False))


def number_or_zero(col: str | Column) -> Column:
    """Numeric value of a cell; NULL, NaN and text that is no number count as 0."""
    value = (F.col(col) if isinstance(col, str) else col).try_cast("double")
    return F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0))


def label_or(col: str, missing: str) -> Column:
    """Display label of a cell, with ``missing`` for NULL."""
    return F.coalesce(F.col(col).cast("string"), F.lit(missing))


def starts_with_any(col: Column, prefixes: list[str]) -> Column:
    """One pattern for all prefixes: a filter that is pushed below the expression of ``col`` computes it once, not once per prefix."""
    return col.rlike("^(?:" + "|".join(map(re.escape, prefixes)) + ")") if prefixes else F.lit(False)


def normalised_id(col: Column) -> Column:
    """Trimmed, lower-case id with runs of blanks and underscores as one underscore."""
    return F.lower(F.regexp_replace(F.trim(col), r"[_\s]+", "_"))
