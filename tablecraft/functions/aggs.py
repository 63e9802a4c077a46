"""Aggregate specifications and their Spark expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Agg:
    """One aggregate: ``kind`` of ``col`` named ``alias``.

    ``q`` serves quantile, ``other`` the second column of corr and cov, ``order_by`` the
    key that makes first, last and implode well defined.
    """

    kind: str
    col: str
    alias: str
    q: float = 0.5
    other: str | None = None
    order_by: str | None = None

    @property
    def rank(self) -> float | None:
        """The quantile asked for, or None when this is not an order statistic."""
        if self.kind == "median":
            return 0.5
        return self.q if self.kind == "quantile" else None


def as_agg(spec) -> Agg:
    return spec if isinstance(spec, Agg) else Agg(*spec)


def agg_column(agg: Agg) -> Column:
    """The built-in expression for ``agg`` (order statistics are computed elsewhere)."""
    c = F.col(agg.col)
    key = F.col(agg.order_by) if agg.order_by else None
    if agg.kind in ("first", "last") and key is None:
        raise ValueError(f"{agg.kind} needs order_by: row order is undefined otherwise")
    if agg.kind in ("corr", "cov") and agg.other is None:
        raise ValueError(f"{agg.kind} needs a second column")
    makers = {
        "sum": lambda: F.sum(c),
        "mean": lambda: F.avg(c),
        "min": lambda: F.min(c),
        "max": lambda: F.max(c),
        "std": lambda: F.stddev_samp(c),
        "var": lambda: F.var_samp(c),
        "len": lambda: F.count(F.lit(1)),
        "count": lambda: F.count(c),
        # NULL counts as one more value.
        "n_unique": lambda: F.count_distinct(c) + F.max(c.isNull().cast("bigint")),
        "approx_n_unique": lambda: F.approx_count_distinct(c),
        "any": lambda: F.bool_or(c),
        "all": lambda: F.bool_and(c),
        "first": lambda: F.min_by(c, key),
        "last": lambda: F.max_by(c, key),
        "skew": lambda: F.skewness(c),
        "kurtosis": lambda: F.kurtosis(c),
        "corr": lambda: F.corr(c, F.col(agg.other)),
        "cov": lambda: F.covar_samp(c, F.col(agg.other)),
        "implode": lambda: ordered_list(c, key) if key is not None else F.sort_array(F.collect_list(c)),
    }
    if agg.kind not in makers:
        raise ValueError(f"unknown aggregate: {agg.kind}")
    return makers[agg.kind]().alias(agg.alias)


def ordered_list(value: Column, order: Column) -> Column:
    """Values of a group as a list in the order of ``order``.

    The list is one cell, so it suits groups that are small by meaning (lines of an
    order, columns of a table).
    """
    pairs = F.array_sort(F.collect_list(F.struct(order.alias("k"), value.alias("v"))))
    return F.transform(pairs, lambda p: p["v"])


def count_where(cond: Column) -> Column:
    return F.count_if(cond)


def latest_value(value: Column, ts: Column) -> Column:
    """Value of the latest row whose value is not NULL."""
    return F.max_by(value, F.when(value.isNotNull(), ts))
