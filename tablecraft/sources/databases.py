"""Relational databases over JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecraft.functions.fixed_values import TEXT_READ_TYPES

FETCH_SIZE = "10000"


def output_name(table: str) -> str:
    """``schema.table`` -> ``schema_table``."""
    return table.replace(".", "_")


def read_tables(spark: SparkSession, url: str, tables: list[str], pks: list[str] | None = None,
                partition: dict[str, tuple[str, int]] | None = None, **options) -> dict[str, DataFrame]:
    """One DataFrame per table, keyed by its output name.

    ``partition`` maps a table to (numeric column, number of parallel reads); the range of
    the column is asked from the database, so that slices cover all rows. Filters, columns
    and limits of later steps are pushed to the database.
    """
    frames = {}
    for i, table in enumerate(tables):
        reader = spark.read.format("jdbc").options(url=url, dbtable=table, fetchsize=FETCH_SIZE, **options)
        if partition and table in partition:
            column, slices = partition[table]
            query = f"SELECT MIN({column}) AS LO, MAX({column}) AS HI FROM {table}"
            bounds = spark.read.format("jdbc").options(url=url, query=query, **options).load().first()
            if bounds[0] is not None:
                reader = reader.options(partitionColumn=column, lowerBound=int(bounds[0]),
                                        upperBound=int(bounds[1]) + 1, numPartitions=slices)
        frame = reader.load()
        if pks and pks[i] is not None:
            frame = _text_key(frame, pks[i])
        frames[output_name(table)] = frame
    return frames


def _text_key(df: DataFrame, pk: str) -> DataFrame:
    from tablecraft.operators.transforms import stringify_key
    return stringify_key(df, pk)


def jdbc_projection(columns: DataFrame) -> DataFrame:
    """(column_name, data_type, position) to one SELECT list per ``table_name``.

    Types Spark cannot read are turned into text or a plain timestamp by the database.
    """
    name = F.concat(F.lit("["), F.col("column_name"), F.lit("]"))
    kind = F.lower("data_type")
    item = (F.when(kind.isin(TEXT_READ_TYPES), F.concat(F.lit("CAST("), name, F.lit(" AS NVARCHAR(MAX)) AS "), name))
            .when(kind == "datetimeoffset", F.concat(F.lit("CAST("), name, F.lit(" AS datetime2) AS "), name))
            .when(kind == "time", F.concat(F.lit("CONVERT(VARCHAR, "), name, F.lit(", 108) AS "), name))
            .otherwise(name))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("position").alias("k"), item.alias("v"))))
    return columns.groupBy("table_name").agg(
        F.array_join(F.transform(ordered, lambda p: p["v"]), ", ").alias("select_list"))


def sql_over_jdbc(spark: SparkSession, url: str, sql: str, **options) -> DataFrame:
    """A query run by the database itself."""
    return spark.read.format("jdbc").options(url=url, query=sql, fetchsize=FETCH_SIZE, **options).load()


def write_table(df: DataFrame, url: str, table: str, mode: str = "append", connections: int | None = None,
                **options) -> None:
    """Write to a database table; ``connections`` bounds the parallel writers."""
    out = df.coalesce(connections) if connections else df
    out.write.format("jdbc").options(url=url, dbtable=table, batchsize=FETCH_SIZE, **options).mode(mode).save()
