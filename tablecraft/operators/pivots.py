"""Hierarchical pivot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecraft.functions.scalars import contains_text, label_or, number_or_zero
from tablecraft.operators.attach import attach, keep_matching
from tablecraft.session import materialise

TOTAL = "TOTAL"


def filter_in(df: DataFrame, allowed: dict[str, list | DataFrame]) -> DataFrame:
    """Keep rows whose value is allowed in every listed field the data has.

    An empty list does not filter. A list becomes a filter the scan can use; a DataFrame
    of values becomes a semi join.
    """
    out = df
    for field, values in allowed.items():
        if field not in df.columns:
            continue
        if isinstance(values, DataFrame):
            out = keep_matching(out, values, field)
        elif values:
            is_text = dict(df.dtypes)[field] == "string"
            out = out.filter(F.col(field).isin([str(v) if is_text else v for v in values]))
    return out


def calc_field(df: DataFrame, name: str, expr: str) -> DataFrame:
    """Arithmetic over columns in which NULL, NaN and non-numbers count as 0, like the result.

    Division by zero is an error in Spark SQL; ``try_divide`` gives 0 here.
    """
    clean = df.select(F.struct("*").alias("_row"), *[
        number_or_zero(f"`{f.name}`").alias(f.name) for f in df.schema
        if isinstance(f.dataType, (T.NumericType, T.StringType, T.BooleanType))])
    return clean.select(F.col("_row"), number_or_zero(F.expr(expr)).alias(name)).select("_row.*", name)


def pivot_search(df: DataFrame, query: str, rows: list[str]) -> DataFrame:
    """Rows with the text in any row field of the pivot."""
    return df.filter(contains_text(rows, query)) if query else df


def pivot_long(df: DataFrame, rows: list[str], cols: list[str], vals: list[str]) -> DataFrame:
    """Sum, count and max per row prefix (grand total included), column key and value field.

    One row per node, column key (plus TOTAL) and field. ``level`` counts the labels in
    use; labels below it are NULL. The finest cells are aggregated first, combining on
    the map side; only these cells, not the input rows, are expanded to all prefixes.
    """
    key = F.concat_ws(" | ", *[label_or(c, "N/A") for c in cols]) if cols else F.lit("Value")
    cells = df.select(
        *[label_or(r, "N/A").alias(f"_r{i}") for i, r in enumerate(rows)], key.alias("col_key"),
        *[number_or_zero(v).alias(f"_v{i}") for i, v in enumerate(vals)])
    labels = [f"_r{i}" for i in range(len(rows))]
    finest = cells.groupBy(*labels, "col_key").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(f"_v{i}").alias(f"_s{i}") for i in range(len(vals))],
        *[F.max(f"_v{i}").alias(f"_m{i}") for i in range(len(vals))])

    prefixes = [labels[:n] for n in range(len(labels) + 1)]
    sets = [[F.col(c) for c in (*p, *k)] for p in prefixes for k in (["col_key"], [])]
    level = sum([1 - F.grouping(c).cast("int") for c in labels], F.lit(0))
    rolled = finest.groupingSets(sets, *labels, "col_key").agg(
        F.sum("_n").alias("_n"),
        *[F.sum(f"_s{i}").alias(f"_s{i}") for i in range(len(vals))],
        *[F.max(f"_m{i}").alias(f"_m{i}") for i in range(len(vals))],
        level.alias("level"), F.grouping("col_key").alias("_total"))
    fields = F.array(*[
        F.struct(F.lit(v).alias("field"), F.col(f"_s{i}").alias("sum"), F.col("_n").alias("count"),
                 F.col(f"_m{i}").alias("max")) for i, v in enumerate(vals)])
    return rolled.select(
        "level", *[F.col(f"_r{i}").alias(r) for i, r in enumerate(rows)],
        F.when(F.col("_total") == 1, TOTAL).otherwise(F.col("col_key")).alias("col_key"),
        F.inline(fields))


def pivot_measure(mode: str) -> Column:
    """The shown measure of a cell: sum, avg, count or max; 0 where there is none."""
    measures = {
        "sum": F.col("sum"),
        "avg": F.when(F.col("count") > 0, F.col("sum") / F.col("count")),
        "count": F.col("count").cast("double"),
        "max": F.col("max"),
    }
    if mode not in measures:
        raise ValueError(f"unknown measure: {mode}")
    return F.coalesce(measures[mode], F.lit(0.0))


def pivot_wide(long: DataFrame, rows: list[str], mode: str = "sum", keys: list[str] | None = None,
               fields: list[str] | None = None) -> DataFrame:
    """One row per node in tree order, one column per column key in sorted order, TOTAL last.

    With several fields the columns are named ``<key>_<field>``. Keys and fields that are
    not given are looked up in the grand total row, one value per shown column; the cells are
    written first, so that they are computed once.
    """
    if keys is None or fields is None:
        long = materialise(long)
        shown = long.filter(F.col("level") == 0).select("col_key", "field").distinct().collect()
        keys = keys if keys is not None else {r["col_key"] for r in shown} - {TOTAL}
        fields = fields if fields is not None else {r["field"] for r in shown}
    fields = sorted(fields)
    columns = {(k if len(fields) == 1 else f"{k}_{f}"): (F.col("col_key") == k) & (F.col("field") == f)
               for k in [*sorted(keys), TOTAL] for f in fields}
    cells = long.withColumn("_x", pivot_measure(mode)).groupBy("level", *rows)
    out = cells.agg(*[F.coalesce(F.max(F.when(hit, F.col("_x"))), F.lit(0.0)).alias(name)
                      for name, hit in columns.items()])
    return out.orderBy(*[F.col(r).asc_nulls_first() for r in rows])


def pivot_heat(long: DataFrame, mode: str = "sum") -> DataFrame:
    """Cells with ``heat`` = (value - min) / (max - min) per column key and field over all nodes.

    A node without the cell shows 0, so 0 takes part when cells are missing. TOTAL cells
    and flat columns have no heat.
    """
    cells = materialise(long.withColumn("value", pivot_measure(mode)))
    nodes = cells.filter(F.col("col_key") == TOTAL).groupBy("field").agg(F.count(F.lit(1)).alias("_nodes"))
    stats = (cells.filter(F.col("col_key") != TOTAL).groupBy("col_key", "field")
             .agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"), F.count(F.lit(1)).alias("_cells"))
             .join(nodes, "field"))
    gap = F.when(F.col("_cells") < F.col("_nodes"), F.lit(0.0))
    stats = stats.select("col_key", "field", F.least("_lo", gap).alias("_lo"), F.greatest("_hi", gap).alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    return (attach(cells, stats, ["col_key", "field"])
            .withColumn("heat", F.when(span != 0, (F.col("value") - F.col("_lo")) / span))
            .select(*long.columns, "value", "heat"))


def pivot_export(long: DataFrame, rows: list[str], path: str, mode: str = "sum",
                 keys: list[str] | None = None, fields: list[str] | None = None) -> DataFrame:
    """Write all nodes as flat CSV in tree order, values rounded half up; returns what is written, computed once."""
    wide = pivot_wide(long, rows, mode, keys, fields)
    labels = [F.when(F.col("level") == i + 1, F.col(r)) for i, r in enumerate(rows)]
    label = F.coalesce(*labels, F.lit("Grand Total"))
    values = [c for c in wide.columns if c not in ("level", *rows)]
    flat = wide.select(label.alias("Dimensions"), *[
        F.floor(F.col(f"`{c}`") + 0.5).alias("Grand Total" if c == TOTAL else c) for c in values])
    flat = materialise(flat)
    flat.write.mode("overwrite").option("header", True).csv(path)
    return flat
