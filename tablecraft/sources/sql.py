"""User SQL, and user functions as sources: frames built on the driver, or parts read in tasks."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tablecraft.sinks.loads import merge_load
from tablecraft.sources.files import FORMATS, format_options


def run_sql(spark: SparkSession, sql: str, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """A query over named DataFrames; ``df.columns`` is its field list.

    The names stand for the frames in this query only; temporary views of these names are
    as they were afterwards.
    """
    named = tables or {}
    before = {name: spark.table(name) for name in named
              if any(t.isTemporary and t.name == name.lower() for t in spark.catalog.listTables(pattern=name))}
    try:
        for name, df in named.items():
            df.createOrReplaceTempView(name)
        return spark.sql(sql)
    finally:
        for name in named:
            spark.catalog.dropTempView(name)
        for name, df in before.items():
            df.createOrReplaceTempView(name)


def sql_over_files(spark: SparkSession, sql: str, files: dict[str, tuple[str, str]]) -> DataFrame:
    """A query straight over files: name -> (format, path)."""
    tables = {name: spark.read.format(FORMATS[fmt]).options(**format_options(fmt)).load(path)
              for name, (fmt, path) in files.items()}
    return run_sql(spark, sql, tables)


def from_source(spark: SparkSession, fn: Callable[[SparkSession], DataFrame], target: str, pk: list[str] | None,
                load_id: str) -> DataFrame:
    """Merge the DataFrame a user function builds, like any other source."""
    return merge_load(spark, target, fn(spark), pk, load_id)


def read_parts(spark: SparkSession, read: Callable[[object], Iterable], parts: Sequence, schema: T.StructType | str) -> DataFrame:
    """A user function as a partitioned source: ``read`` is called in a task for each of ``parts`` and gives its records.

    Records are tuples in the order of ``schema``, dicts by its names (a missing one is NULL), or whole Arrow batches. A part must be something that can be
    pickled, such as a page number, a date or a path, and ``read`` must give the same records again when a task is repeated. User code
    runs in Python workers; the driver only holds the list of parts.
    """
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = kind.names

    class Reader(DataSourceReader):
        def partitions(self):
            return [InputPartition(p) for p in parts]

        def read(self, partition):
            for record in read(partition.value):
                yield tuple(record.get(n) for n in names) if isinstance(record, dict) else record

    class Source(DataSource):
        @classmethod
        def name(cls):
            return label

        def schema(self):
            return kind

        def reader(self, schema):
            return Reader()

    label = f"parts_{uuid.uuid4().hex}"
    spark.dataSource.register(Source)
    return spark.read.format(label).load() if parts else spark.createDataFrame([], kind)


def from_parts(spark: SparkSession, read: Callable[[object], Iterable], parts: Sequence, schema: T.StructType | str, target: str,
               pk: list[str] | None, load_id: str) -> DataFrame:
    """Merge what a user function reads part by part in tasks."""
    return merge_load(spark, target, read_parts(spark, read, parts, schema), pk, load_id)
