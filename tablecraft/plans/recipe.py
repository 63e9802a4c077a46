"""Transformation recipes: a list of steps applied as one plan.

Steps act in three groups, whatever their order in the list: aggregates joined back to
every row, then all column steps in one projection in which each sees the input values
only, then filters, de-duplication and drops in list order.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tablecraft.functions import scalars
from tablecraft.functions.aggs import Agg
from tablecraft.operators import transforms
from tablecraft.operators.aggregation import aggregate_back, aggregate_by


@dataclass(frozen=True)
class Aggregate:
    field: str
    agg: Agg


@dataclass(frozen=True)
class Casing:
    field: str
    mode: str

    def columns(self) -> dict[str, Column]:
        return {self.field: scalars.casing(self.field, self.mode)}


@dataclass(frozen=True)
class Calculate:
    field: str
    expr: str

    def columns(self) -> dict[str, Column]:
        return {self.field: scalars.calculate(self.field, self.expr)}


@dataclass(frozen=True)
class CaseSet:
    field: str
    cond: str
    value: str
    is_new: bool = False

    def columns(self) -> dict[str, Column]:
        return {self.field: scalars.case_set(self.field, self.cond, self.value, self.is_new)}


@dataclass(frozen=True)
class Split:
    field: str
    sep: str
    names: tuple[str, ...]

    def columns(self) -> dict[str, Column]:
        return dict(zip(self.names, scalars.split_to(self.field, self.sep, list(self.names))))


@dataclass(frozen=True)
class Convert:
    field: str
    to: str

    def columns(self) -> dict[str, Column]:
        return {self.field: scalars.convert(self.field, self.to)}


@dataclass(frozen=True)
class Filter:
    cond: str

    def apply(self, df: DataFrame) -> DataFrame:
        return transforms.filter_rows(df, self.cond)


@dataclass(frozen=True)
class Dedup:
    fields: tuple[str, ...]
    order_by: tuple[str, ...] = ()

    def apply(self, df: DataFrame) -> DataFrame:
        return transforms.dedup(df, list(self.fields), [F.col(c) for c in self.order_by] or None)


@dataclass(frozen=True)
class Drop:
    fields: tuple[str, ...]

    def apply(self, df: DataFrame) -> DataFrame:
        return transforms.drop_columns(df, list(self.fields))


def apply_recipe(df: DataFrame, steps: list) -> DataFrame:
    """All steps as one plan."""
    return _applied(df, steps, lambda rows: rows)


@dataclass
class StepCounts:
    """Rows before and after each step of a recipe that can change their number, counted while the result is computed.

    To be read after an action on the recipe's result; nothing is computed for it.
    """

    steps: list
    seen: list[Observation]

    def report(self) -> list[dict]:
        """Step, rows in, rows out and their difference of each such step, then of the recipe as a whole."""
        rows = [o.get.get("rows", 0) for o in self.seen]
        named = [(type(s).__name__.lower(), a, b) for s, a, b in zip(self.steps, rows, rows[1:])]
        return [{"step": name, "rows_in": a, "rows_out": b, "rows_changed": b - a} for name, a, b in [*named, ("recipe", rows[0], rows[-1])]]


def apply_counted(df: DataFrame, steps: list) -> tuple[DataFrame, StepCounts]:
    """``apply_recipe`` and the counts of its steps."""
    seen: list[Observation] = []

    def observed(rows: DataFrame) -> DataFrame:
        seen.append(Observation())
        return rows.observe(seen[-1], F.count(F.lit(1)).alias("rows"))
    out = _applied(df, steps, observed)
    return out, StepCounts([s for s in steps if hasattr(s, "apply")], seen)


def _applied(df: DataFrame, steps: list, observed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    back: dict[str, list[Agg]] = {}
    for step in steps:
        if isinstance(step, Aggregate):
            back.setdefault(step.field, []).append(step.agg)
    out = aggregate_back(df, list(back.items())) if back else df

    made = [item for step in steps if hasattr(step, "columns") for item in step.columns().items()]
    twice = [name for name, n in Counter(name for name, _ in made).items() if n > 1]
    if twice:
        raise ValueError(f"column set more than once: {', '.join(twice)}")
    if made:
        out = out.withColumns(dict(made))
    out = observed(out)
    for step in steps:
        if hasattr(step, "apply"):
            out = observed(step.apply(out))
    return out


def apply_recipes(tables: dict[str, DataFrame], recipes: dict[str, list]) -> dict[str, DataFrame]:
    """Each table with its own steps; a table without steps is unchanged."""
    return {name: apply_recipe(df, recipes.get(name, [])) for name, df in tables.items()}


def preview_recipe(df: DataFrame, steps: list, at: int, order_by: list[str] | None = None) -> DataFrame:
    """What step ``at`` does, on a few rows.

    An aggregate shows its groups (20 rows), a CaseSet the rows its condition matches, a
    Split or Calculate the rows with a result (5 rows each), de-duplication and filters 20
    rows, a drop 2 rows. Aggregates whose names the step, or a column step before it, uses are
    there as in the run, where aggregates come first.
    """
    step = steps[at]
    if isinstance(step, Aggregate):
        same = [s.agg for s in steps if isinstance(s, Aggregate) and s.field == step.field]
        return _few(aggregate_by(df, step.field, same), [step.field] if order_by else None, 20)
    earlier = [s for s in steps[:at] if hasattr(s, "columns")]
    used = " ".join(map(repr, [*earlier, step]))
    aggregates = [s for s in steps if isinstance(s, Aggregate) and re.search(rf"\b{re.escape(s.agg.alias)}\b", used)]
    before = apply_recipe(df, [*aggregates, *earlier])
    if isinstance(step, CaseSet):
        return _few(before.filter(F.expr(step.cond)).withColumns(step.columns()), order_by, 5)
    if isinstance(step, Split):
        return _few(before.filter(F.col(step.field).isNotNull()).withColumns(step.columns()), order_by, 5)
    if isinstance(step, Calculate):
        return _few(before.withColumns(step.columns()).filter(F.col(step.field).isNotNull()), order_by, 5)
    if hasattr(step, "columns"):
        return _few(before.withColumns(step.columns()), order_by, 20)
    return _few(step.apply(before), order_by, 2 if isinstance(step, Drop) else 20)


def _few(df: DataFrame, order_by: list[str] | None, n: int) -> DataFrame:
    return transforms.preview(df, n, [F.col(c) for c in order_by] if order_by else None)
