"""Grouped, joined-back, nested and chart aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablecraft.functions.aggs import Agg, agg_column, as_agg
from tablecraft.functions.scalars import label_or, number_or_zero
from tablecraft.operators.attach import attach
from tablecraft.session import materialise


def aggregate_by(df: DataFrame, field: str, aggs: list) -> DataFrame:
    """One row per value of ``field`` with the given aggregates."""
    specs = [as_agg(a) for a in aggs]
    plain = [a for a in specs if a.rank is None]
    ranked = [a for a in specs if a.rank is not None]
    out = df.groupBy(field).agg(*[agg_column(a) for a in plain]) if plain else df.select(field).distinct()
    if ranked:
        values = exact_quantiles(df, field, ranked).withColumnRenamed(field, "_g")
        out = out.join(values, out[field].eqNullSafe(values["_g"]), "left").drop("_g")
    return out.select(field, *[a.alias for a in specs])


def aggregate_back(df: DataFrame, specs: list[tuple[str, list]]) -> DataFrame:
    """Aggregates per field, attached to every row of that field's group.

    ``specs`` is a list of (field, aggregates). Aggregates of the same field are computed
    together and attached once. Rows with a NULL field get NULL aggregates.
    """
    by_field: dict[str, list[Agg]] = {}
    for field, aggs in specs:
        by_field.setdefault(field, []).extend(as_agg(a) for a in aggs)
    # NULL keys match nothing, so they need no aggregate.
    out = df
    for field, aggs in by_field.items():
        groups = aggregate_by(df.filter(F.col(field).isNotNull()), field, [*aggs, Agg("len", field, "_group_rows")])
        out = attach(out, groups, [field], null_safe=False, rows="_group_rows")
    return out


def exact_quantiles(df: DataFrame, field: str, ranked: list[Agg]) -> DataFrame:
    """Exact quantiles with linear interpolation per group, over one or more columns.

    The distinct (group, column, value) triples with their counts are range-partitioned,
    so a large group spans many partitions of even size. The counts per group and
    partition, one row each, tell which partitions hold the wanted ranks; only there are
    values numbered.
    """
    cols = list(dict.fromkeys(a.col for a in ranked))
    values = F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("v")) for i, c in enumerate(cols)])
    triples = (df.select(F.col(field).alias("g"), F.inline(values)).filter(F.col("v").isNotNull())
               .groupBy("g", "i", "v").agg(F.count(F.lit(1)).alias("c")))
    ranged = materialise(triples.repartitionByRange("g", "i", "v").withColumn("p", F.spark_partition_id()))

    # Rows of a group in each partition it spans, before it, and in all.
    group = Window.partitionBy("g", "i")
    upto = group.orderBy("p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = (ranged.groupBy("g", "i", "p").agg(F.sum("c").alias("rows"))
             .withColumns({"after": F.sum("rows").over(upto), "n": F.sum("rows").over(group)})
             .withColumn("before", F.col("after") - F.col("rows")))

    # A quantile lies between the values at two neighbouring ranks.
    wishes = []
    for a in ranked:
        pos = F.lit(float(a.rank)) * (F.col("n") - 1)
        for idx in (F.floor(pos), F.ceil(pos)):
            held = (F.col("i") == cols.index(a.col)) & (idx >= F.col("before")) & (idx < F.col("after"))
            wishes.append(F.when(held, F.struct(F.lit(a.alias).alias("name"), pos.alias("pos"), idx.alias("idx"))))
    placed = (spans.withColumn("wishes", F.array_distinct(F.array_compact(F.array(*wishes)))).filter(F.size("wishes") > 0)
              .select(F.col("g").alias("_g"), F.col("i").alias("_i"), F.col("p").alias("_p"), "before", "wishes"))

    # Number the values of these partitions and take the wanted ones.
    same = ranged["g"].eqNullSafe(placed["_g"]) & (ranged["i"] == placed["_i"]) & (ranged["p"] == placed["_p"])
    part = Window.partitionBy("g", "i", "p").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = ranged.join(placed, same).withColumn("end", F.col("before") + F.sum("c").over(part))
    picked = numbered.select("g", "v", "c", "end", F.inline("wishes")).filter(
        (F.col("idx") < F.col("end")) & (F.col("idx") >= F.col("end") - F.col("c")))

    quantiles = []
    for a in ranked:
        mine = F.col("name") == a.alias
        low, high = F.min(F.when(mine, F.col("v"))), F.max(F.when(mine, F.col("v")))
        pos = F.max(F.when(mine, F.col("pos")))
        quantiles.append((low + (high - low) * (pos - F.floor(pos))).alias(a.alias))
    return picked.groupBy("g").agg(*quantiles).withColumnRenamed("g", field)


def distinct_values(df: DataFrame, field: str) -> DataFrame:
    return df.select(field).distinct()


def chart_series(df: DataFrame, x: str, y: str, agg: str, order_by: list[Column] | None = None,
                 limit: int | None = 50) -> DataFrame:
    """(label, value) pairs of a chart: count, sum, avg, max or min per label.

    ``agg='none'`` gives the first ``limit`` rows, by ``order_by`` where given; None gives all.
    """
    if agg == "none":
        rows = df.orderBy(*order_by) if order_by else df
        rows = rows if limit is None else rows.limit(limit)
        return rows.select(label_or(x, "").alias("label"), number_or_zero(y).alias("value"))
    values = {"count": None, "sum": F.sum, "avg": F.avg, "max": F.max, "min": F.min}
    if agg not in values:
        raise ValueError(f"unknown chart aggregate: {agg}")
    value = values[agg]
    cells = df.select(label_or(x, "null").alias("label"), number_or_zero(y).alias("y"))
    measure = value("y") if value else F.count(F.lit(1)).cast("double")
    return cells.groupBy("label").agg(measure.alias("value"))


def columns_by_table(catalog: DataFrame) -> DataFrame:
    """Per table, its columns as a JSON array of objects in order of the column name."""
    details = ["column_name", "original_column_name", "data_type", "semantic_concept", "confidence_score",
               "description"]
    cols = F.sort_array(F.collect_list(F.struct(*[c for c in details if c in catalog.columns])))
    return catalog.groupBy("table_name").agg(F.to_json(cols).alias("columns_json"))


def tables_by_source(catalog: DataFrame, key: str = "pipeline", namespace: str | None = None) -> DataFrame:
    """Per source (of a namespace), its tables as a JSON object of table name -> list of {name, type}.

    A row per source; an object of all sources would put a whole namespace into one cell.
    """
    if namespace is not None:
        catalog = catalog.filter(F.col("namespace") == namespace.replace("-", "_"))
    cols = F.sort_array(F.collect_list(F.struct(F.col("column_name").alias("name"), F.col("data_type").alias("type"))))
    tables = catalog.groupBy(key, "table_name").agg(cols.alias("cols"))
    entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct("table_name", "cols"))))
    return tables.groupBy(key).agg(F.to_json(entries).alias("tables_json"))
