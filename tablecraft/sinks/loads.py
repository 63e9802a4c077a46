"""Loads into evolving Parquet tables.

A table is a folder with ``data/`` and ``versions/``. Every load writes new files below
``data/`` and then one small file in ``versions/`` that lists the files the table now
consists of, so readers see a load wholly or not at all and a failed load leaves the
table as it was. One writer at a time is assumed.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecraft.operators.attach import BROADCAST_BYTES, attach, estimated_bytes, measured
from tablecraft.operators.joins import ForeignKey, join_tree, wide_table
from tablecraft.operators.transforms import dedup
from tablecraft.session import delete_folder, file_sizes, list_names, materialise, read_text, write_text

LOAD_ID = "_load_id"
# Size of a data file, the share of it below which a file is small, and how many small ones may gather.
FILE_BYTES = 256 << 20
SMALL_SHARE = 0.25
SMALL_FILES = 32
KEEP_VERSIONS = 10


@dataclass(frozen=True)
class LoadReport:
    """What one load did: rows of the batch, rows of it that are in the table now and their difference, stored rows that
    gave way, and files that were rewritten and added."""

    rows_in: int = 0
    rows_out: int = 0
    rows_changed: int = 0
    rows_replaced: int = 0
    files_rewritten: int = 0
    files_added: int = 0


@dataclass
class TableState:
    """Files (below ``data/``) with their bytes, and the schema, as of one version."""

    version: int = 0
    schema: T.StructType | None = None
    files: dict[str, int] = field(default_factory=dict)
    report: LoadReport = LoadReport()


def table_name(source: str) -> str:
    """Table name for ``schema.table`` or for a file pattern."""
    return re.sub(r"[ *.]", "_", source)


def stamp_load(df: DataFrame, load_id: str) -> DataFrame:
    return df.withColumn(LOAD_ID, F.lit(load_id))


def evolve(old: DataFrame, new: DataFrame) -> DataFrame:
    """All rows of both; a column one side lacks is NULL there.

    Numbers widen; a column that is text on one side only becomes text.
    """
    kinds = dict(old.dtypes)
    for name, kind in new.dtypes:
        if name in kinds and kinds[name] != kind and "string" in (kinds[name], kind):
            old = old.withColumn(name, F.col(name).cast("string"))
            new = new.withColumn(name, F.col(name).cast("string"))
    return old.unionByName(new, allowMissingColumns=True)


def merge_load(spark: SparkSession, target: str, df: DataFrame, pk: list[str] | None, load_id: str, order_by: list[Column] | None = None,
               file_bytes: int = FILE_BYTES, keep_better: bool = False) -> DataFrame:
    """Rows of ``df`` replace target rows with the same key; without a key they are added.

    The batch is computed and written once and measured on the way. A semi join of the stored
    keys with the batch's (broadcast, if these were measured small) finds the files that hold
    replaced keys; the range of the batch's first key reaches that scan as a filter. Only
    these files are read whole; what stays of them and the batch are dealt out by ranges of the key, sorted, into as
    many files as their measured bytes call for, so that a later batch of near keys finds few files again.

    Of several batch rows with one key, one stays: the first by ``order_by``, else any. With ``keep_better``
    a stored row stays as well when it comes first by ``order_by``, so batches may arrive in any order.
    A key with a NULL replaces nothing. ``load_report`` tells what was done.
    """
    state = read_state(spark, target)
    batch = stamp_load(df, load_id)
    schema = merged_schema(spark, state, batch)
    retyped = bool(state.schema) and any(schema[f.name].dataType != f.dataType for f in state.schema)
    batch, seen = _as_schema(batch, schema), Observation()
    batch = batch.observe(seen, F.count(F.lit(1)).alias("rows"))
    if not pk:
        added = _write(spark, target, state, batch, "added")
        rewritten = set(state.files) if retyped else _small_files({**state.files, **added}, file_bytes)
        rest = {}
        if rewritten:  # many small files become few, and a changed type is stored alike in all files
            old = _as_schema(_read(spark, target, state.schema if retyped else schema, rewritten), schema)
            count = math.ceil(sum({**state.files, **added}[f] for f in rewritten) / file_bytes)
            rest = _write(spark, target, state, old.coalesce(count), "rest")
        files = {f: n for f, n in {**state.files, **added}.items() if f not in rewritten} | rest
        rows = seen.get.get("rows", 0)
        return _publish(spark, target, TableState(state.version + 1, schema, files, LoadReport(rows, rows, 0, 0, len(rewritten), len(added) + len(rest))))

    first, size = pk[0], Observation()
    fresh = dedup(batch, pk, order_by)
    fresh = materialise(fresh.observe(size, F.count(F.lit(1)).alias("rows"), estimated_bytes(fresh).alias("bytes"),
                                      estimated_bytes(fresh.select(*pk)).alias("key_bytes"), F.min(first).alias("low"), F.max(first).alias("high")))
    found = size.get
    keys, few = fresh.select(*pk), found.get("key_bytes", math.inf) <= BROADCAST_BYTES
    keys = F.broadcast(keys) if few else keys
    replaced = {}
    if state.files and found.get("rows", 1):
        stored = spark.read.schema(state.schema).parquet(*_paths(target, state.files))
        if not retyped and isinstance(schema[first].dataType, (T.IntegralType, T.StringType, T.DateType)) and found.get("low") is not None:
            stored = stored.filter(F.col(f"`{first}`").between(found["low"], found["high"]))
        stored = stored.select(*[F.col(f"`{k}`").cast(schema[k].dataType).alias(k) for k in pk], F.col("_metadata.file_name").alias("_file"))
        replaced = {r["_file"]: r["count"] for r in stored.join(keys, pk, "left_semi").groupBy("_file").count().collect()}
    small = _small_files(state.files, file_bytes)
    touched = set(state.files) if retyped else {f for f in state.files if f.rpartition("/")[2] in replaced} | small
    rows = fresh
    if touched:
        old = _as_schema(_read(spark, target, state.schema, touched), schema)
        if keep_better:
            rows = dedup(old.join(keys, pk, "left_semi").select(*old.columns).unionByName(fresh), pk, order_by)
        rows = rows.unionByName(old.join(keys, pk, "left_anti").select(*old.columns))
    count = max(1, math.ceil((found.get("bytes", 0) + sum(state.files[f] for f in touched)) / file_bytes))
    rows = rows.repartition(1) if count == 1 else rows.repartitionByRange(count, *pk)
    added = _write(spark, target, state, rows.sortWithinPartitions(*pk), "merged")
    files = {f: n for f, n in state.files.items() if f not in touched} | added
    rows_in, rows_out = seen.get.get("rows", 0), found.get("rows", 0)
    report = LoadReport(rows_in, rows_out, rows_out - rows_in, sum(replaced.values()), len(touched), len(added))
    return _publish(spark, target, TableState(state.version + 1, schema, files, report))


def replace_load(spark: SparkSession, target: str, df: DataFrame, load_id: str) -> DataFrame:
    """The table becomes exactly the rows of ``df``."""
    state, seen = read_state(spark, target), Observation()
    rows = stamp_load(df, load_id).observe(seen, F.count(F.lit(1)).alias("rows"))
    files = _write(spark, target, state, rows, "whole")
    count = seen.get.get("rows", 0)
    return _publish(spark, target, TableState(state.version + 1, rows.schema, files, LoadReport(count, count, 0, 0, 0, len(files))))


def load_report(spark: SparkSession, target: str) -> LoadReport:
    """What the latest load of the table did."""
    return read_state(spark, target).report


def refresh_wide(tables: dict[str, DataFrame], fks: list[ForeignKey], load_ids: list[str]) -> DataFrame:
    """Wide rows in which any table's row came with one of the loads.

    Before the join every table is cut to the rows that can stand in such a wide row:
    the fresh ones and those tied to a fresh row of another table. What ties them is
    passed from table to table as key sets about as large as the loads, so that the big
    tables are scanned but do not move. A parent that arrives after its child gives the
    child a second wide row.
    """
    edges = join_tree(list(tables), fks)
    passed: dict[tuple[str, str], tuple[DataFrame, float]] = {}
    cut = {name: _tied_rows(name, None, tables, edges, load_ids, passed) for name in tables}
    marks = [f"{n}_{LOAD_ID}" for n, t in tables.items() if LOAD_ID in t.columns]
    fresh = reduce(lambda a, b: a | b, [F.col(m).isin(load_ids) for m in marks], F.lit(False))
    return wide_table(cut, fks).filter(fresh).drop(*marks)


def _tied_rows(name: str, came_from: str | None, tables: dict[str, DataFrame], edges: list[ForeignKey],
               load_ids: list[str], passed: dict[tuple[str, str], tuple[DataFrame, float]]) -> DataFrame:
    """Fresh rows of a table and rows tied to fresh rows beyond its other neighbours.

    ``passed`` keeps the key sets that went from one table to another, written once and measured.
    """
    rows, wanted = tables[name], F.lit(False)
    if LOAD_ID in rows.columns:
        wanted = F.col(LOAD_ID).isin(load_ids)
    for i, edge in enumerate(edges):
        if name not in (edge.child, edge.parent):
            continue
        other, mine, theirs = ((edge.parent, edge.columns, edge.parent_columns) if edge.child == name
                               else (edge.child, edge.parent_columns, edge.columns))
        if other == came_from:
            continue
        if (other, name) not in passed:
            tied = _tied_rows(other, name, tables, edges, load_ids, passed)
            passed[other, name] = measured(tied.select(*[F.col(t).alias(m) for m, t in zip(mine, theirs)]).distinct())
        keys, size = passed[other, name]
        rows = attach(rows, keys.withColumn(f"_tied{i}", F.lit(True)), list(mine), null_safe=False, size=size)
        wanted = wanted | F.coalesce(f"_tied{i}", F.lit(False))
    return rows.filter(wanted).select(*tables[name].columns)


def wide_load(spark: SparkSession, target: str, tables: dict[str, DataFrame], fks: list[ForeignKey],
              load_ids: list[str]) -> DataFrame:
    """Create the wide table, or append the rows of the given loads when it exists."""
    if not read_state(spark, target).version:
        plain = {n: t.drop(LOAD_ID) for n, t in tables.items()}
        return replace_load(spark, target, wide_table(plain, fks), load_ids[-1])
    return merge_load(spark, target, refresh_wide(tables, fks, load_ids), None, load_ids[-1])


def write_store(df: DataFrame, folder: str, table: str, mode: str = "overwrite") -> str:
    """One Parquet folder per table name; returns its path."""
    path = f"{folder.rstrip('/')}/{table_name(table)}"
    df.write.mode(mode).parquet(path)
    return path


def read_target(spark: SparkSession, target: str) -> DataFrame:
    """The table as of its latest version."""
    state = read_state(spark, target)
    if not state.version:
        raise ValueError(f"no table at {target}")
    return _read(spark, target, state.schema, state.files)


def drop_old_versions(spark: SparkSession, target: str, keep: int = KEEP_VERSIONS) -> list[str]:
    """Delete data files that none of the last ``keep`` versions lists; returns their names, or that of a folder that held nothing else.

    Files of a load that has not published its version yet are left alone. Every ``KEEP_VERSIONS`` loads it is done by the load itself.
    """
    numbers = _version_numbers(spark, target)
    if not numbers:
        return []
    listed = {f for n in numbers[-keep:] for f in _load_state(spark, target, n).files}
    dropped = []
    for folder in list_names(spark, f"{target}/data"):
        if int(re.match(r"v(\d+)", folder)[1]) > numbers[-1]:
            continue
        inside = [f"{folder}/{n}" for n in file_sizes(spark, f"{target}/data/{folder}")]
        unlisted = [f for f in inside if f not in listed]
        dropped += [folder] if len(unlisted) == len(inside) else unlisted
    for name in dropped:
        delete_folder(spark, f"{target}/data/{name}")
    return dropped


def read_state(spark: SparkSession, target: str) -> TableState:
    numbers = _version_numbers(spark, target)
    return _load_state(spark, target, numbers[-1]) if numbers else TableState()


def _version_numbers(spark: SparkSession, target: str) -> list[int]:
    return sorted(int(n.removesuffix(".json")) for n in list_names(spark, f"{target}/versions") if n.endswith(".json"))


def _load_state(spark: SparkSession, target: str, number: int) -> TableState:
    saved = json.loads(read_text(spark, f"{target}/versions/{number}.json"))
    return TableState(number, T.StructType.fromJson(saved["schema"]), saved["files"], LoadReport(**saved["report"]))


def merged_schema(spark: SparkSession, state: TableState, batch: DataFrame) -> T.StructType:
    """Schema of the table once the batch is in."""
    if state.schema is None:
        return batch.schema
    return evolve(spark.createDataFrame([], state.schema), batch.limit(0)).schema


def _publish(spark: SparkSession, target: str, state: TableState) -> DataFrame:
    saved = {"schema": state.schema.jsonValue(), "files": state.files, "report": asdict(state.report)}
    write_text(spark, f"{target}/versions/{state.version}.json", json.dumps(saved))
    if state.version % KEEP_VERSIONS == 0:
        drop_old_versions(spark, target, KEEP_VERSIONS)
    return _read(spark, target, state.schema, state.files)


def _as_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema`` in its order and types; a missing one is NULL."""
    return df.select(*[(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                       for f in schema])


def _small_files(files: dict[str, int], file_bytes: int) -> set[str]:
    """The small files, once there are more than ``SMALL_FILES`` of them."""
    small = {f for f, n in files.items() if n < SMALL_SHARE * file_bytes}
    return small if len(small) > SMALL_FILES else set()


def _write(spark: SparkSession, target: str, state: TableState, rows: DataFrame, name: str) -> dict[str, int]:
    """Write rows into a folder of the next version; the files with rows and their bytes."""
    folder = f"v{state.version + 1}-{name}"
    rows.write.mode("overwrite").parquet(f"{target}/data/{folder}")
    return {f"{folder}/{n}": size for n, size in file_sizes(spark, f"{target}/data/{folder}").items()}


def _paths(target: str, files) -> list[str]:
    return [f"{target}/data/{f}" for f in sorted(files)]


def _read(spark: SparkSession, target: str, schema: T.StructType, files) -> DataFrame:
    return spark.read.schema(schema).parquet(*_paths(target, files)) if files else spark.createDataFrame([], schema)
