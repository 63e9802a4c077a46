"""File sources."""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Iterator
from typing import BinaryIO
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyarrow import csv, fs
from pyspark.errors import AnalysisException, PySparkTypeError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from tablecraft.functions.fixed_values import STAGING_SUFFIX, SYSTEM_PREFIX

FORMATS = {"csv": "csv", "jsonl": "json", "ndjson": "json", "json": "json", "parquet": "parquet"}
# Rows of a Parquet file that a task reads one after another, and rows it holds at a time.
PART_ROWS = 500_000
BATCH_ROWS = 10_000
# How much of a text file its schema is taken from.
SAMPLE_BYTES = 1 << 20
S3_ANONYMOUS = {"fs.s3a.aws.credentials.provider": "org.apache.hadoop.fs.s3a.AnonymousAWSCredentialsProvider"}


def file_glob(pattern: str) -> str:
    """``stem.ext`` -> ``stem*.ext``: one pattern covers all parts of an export."""
    stem, dot, ext = pattern.rpartition(".")
    return f"{stem}*.{ext}" if dot else f"{pattern}*"


def format_options(fmt: str, schema: T.StructType | str | None = None) -> dict:
    options = {}
    if fmt == "csv":
        options = {"header": True, "inferSchema": schema is None}
    elif fmt == "json":
        options = {"multiLine": True}
    return options


def read_files(spark: SparkSession, base: str, pattern: str, fmt: str, schema: T.StructType | str | None = None,
               ignore_corrupt: bool = False, anonymous: bool = False, partitioned: bool = False, **options) -> DataFrame:
    """All files below ``base`` whose name matches ``pattern`` with ``*`` before the extension.

    ``fmt`` is csv, parquet, jsonl (one record per line) or json (one document per file).
    ``base`` may be a local folder, hdfs or s3a. A given schema saves the inference pass
    and is needed with ``ignore_corrupt``, which skips unreadable files. ``anonymous``
    reads a public bucket without credentials. ``partitioned`` says that the folders below
    ``base`` are named ``<column>=<value>``: the columns are kept, and filters on them skip folders.
    """
    if ignore_corrupt and schema is None:
        raise ValueError("ignore_corrupt needs a schema: inference would read the bad file")
    reader = spark.read.format(FORMATS[fmt]).options(
        pathGlobFilter=file_glob(pattern), recursiveFileLookup=not partitioned, ignoreCorruptFiles=ignore_corrupt,
        **format_options(fmt, schema), **(S3_ANONYMOUS if anonymous else {}), **options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(base)


def file_schemas(spark: SparkSession, base: str, pattern: str, open_file: Callable[[str], BinaryIO] | None = None) -> DataFrame:
    """(file, position, column, type) of every matching file; one row of NULLs if it is of no known kind or cannot be parsed.

    One job lists the files and reads them in tasks: of a Parquet file the footer, of CSV and JSON lines the first ``SAMPLE_BYTES``, of a
    JSON document the whole. Types are those of that sample. ``open_file`` opens a path for reading at any place; by default
    pyarrow's file systems do (local, HDFS, S3 and others by their own credentials). Errors other than of the format, such
    as a lost connection, are raised. Files without a byte are not listed.
    """
    listing = (spark.read.format("binaryFile").options(pathGlobFilter=pattern, recursiveFileLookup=True).load(base).select("path"))
    opener = open_file or _open_anywhere

    def describe(batches):
        for batch in batches:
            rows = [row for path in batch.column(0).to_pylist() for row in _file_columns(path, opener)]
            names = ("file", "position", "column", "type")
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int32(), pa.string(), pa.string()))], list(names))

    return listing.mapInArrow(describe, "file string, position int, column string, type string")


def parquet_ranges(path: str, tasks: int = 8) -> list[tuple]:
    """A Parquet file or folder as parts for ``read_range``: ranges of rows, at least ``tasks`` of them if there are rows
    for it, and of at most ``PART_ROWS``. Only the footers are read."""
    found = ds.dataset(path, format="parquet")
    files = [(f.path, [(g.id, g.num_rows) for g in f.row_groups]) for f in found.get_fragments()]
    step = max(1, min(PART_ROWS, -(-sum(n for _, groups in files for _, n in groups) // tasks)))
    parts = []
    for file, groups in files:
        spans, count = [], 0
        for group, n in groups:
            spans.append((group, count, count + n))
            count += n
        for first in range(0, count, step):
            last = min(first + step, count)
            held = [(group, start) for group, start, end in spans if start < last and end > first]
            parts.append((found.filesystem, file, [group for group, _ in held], first - held[0][1], last - held[0][1]))
    return parts


def read_range(part: tuple, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of a part, ``BATCH_ROWS`` at a time; of the file only the row groups with these rows are read, as a stream."""
    system, file, groups, first, last = part
    with system.open_input_file(file) as opened:
        seen = 0
        for batch in pq.ParquetFile(opened, buffer_size=1 << 20).iter_batches(BATCH_ROWS, groups, columns, use_threads=False):
            start, seen = seen, seen + batch.num_rows
            if seen > first:
                yield batch.slice(max(0, first - start), min(last, seen) - max(first, start))
            if seen >= last:
                break


def _open_anywhere(path: str) -> BinaryIO:
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem().open_input_file(unquote("/" + rest.lstrip("/")))
    system, inside = fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}:{rest}")
    return system.open_input_file(inside)


def _file_columns(path: str, open_file: Callable[[str], BinaryIO]) -> list[tuple]:
    fmt = FORMATS.get(path.rpartition(".")[2].lower())
    unknown = [(path, None, None, None)]
    if fmt is None:
        return unknown
    with open_file(path) as file:
        try:
            if fmt == "parquet":
                schema = pq.ParquetFile(file).schema_arrow
            elif fmt == "csv":
                schema = _narrowed(csv.read_csv(_first_lines(file)))
            elif path.lower().endswith(".json"):
                schema = _narrowed(_document_table(file.read()), by_name=True)
            else:
                schema = _narrowed(_document_table(_first_lines(file).read()), by_name=True)
        except (pa.ArrowInvalid, UnicodeDecodeError, ValueError):
            return unknown
    return [(path, i, f.name, _type_name(f.type)) for i, f in enumerate(schema)]


def _first_lines(file: BinaryIO) -> io.BytesIO:
    """The whole lines of the first ``SAMPLE_BYTES``, or the first line if it is longer."""
    data = file.read(SAMPLE_BYTES)
    while data and b"\n" not in data and (more := file.read(SAMPLE_BYTES)):
        data += more
    end = data.rfind(b"\n")
    return io.BytesIO(data if len(data) < SAMPLE_BYTES or end < 0 else data[:end + 1])


def _document_table(data: bytes) -> pa.Table:
    """Records of one JSON document (a list of them or one), or of JSON lines."""
    try:
        found = json.loads(data)
        found = found if isinstance(found, list) else [found]
    except ValueError:
        found = [json.loads(line) for line in data.splitlines() if line.strip()]
    if not all(isinstance(r, dict) for r in found):
        raise ValueError("no records")
    names = dict.fromkeys(n for r in found for n in r)
    return pa.table({n: [r.get(n) for r in found] for n in names})


def _narrowed(table: pa.Table, by_name: bool = False) -> pa.Schema:
    """The schema with whole numbers of 32 bits as such, as the readers infer them from CSV; JSON columns come by name."""
    fields = []
    for f, column in zip(table.schema, table.columns):
        if not by_name and pa.types.is_int64(f.type) and len(column):
            low, high = pc.min_max(column).as_py().values()
            if low is not None and -(1 << 31) <= low and high < 1 << 31:
                f = f.with_type(pa.int32())
        fields.append(f.with_type(pa.string()) if pa.types.is_null(f.type) else f)
    return pa.schema(sorted(fields, key=lambda f: f.name) if by_name else fields)


def _type_name(kind: pa.DataType) -> str:
    """Name of a type as Spark writes it; what it has no type for keeps pyarrow's name."""
    try:
        return from_arrow_type(kind, prefer_timestamp_ntz=True).simpleString()
    except PySparkTypeError:
        return str(kind)


def table_inventory(tables: dict[str, DataFrame], hidden_prefix: str = SYSTEM_PREFIX,
                    hidden_suffix: str = STAGING_SUFFIX) -> DataFrame:
    """(schema_name, table_name, column_name, data_type, column_count, row_count), in name order.

    Tables are named ``schema.table`` or ``table``; system tables and staging schemas are
    left out. Row counts come from file footers where the format has them.
    """
    parts = []
    for full_name, df in tables.items():
        schema, _, name = full_name.rpartition(".")
        if name.startswith(hidden_prefix) or schema.endswith(hidden_suffix):
            continue
        cols = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("data_type")) for c, t in df.dtypes])
        parts.append(df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(schema).alias("schema_name"), F.lit(name).alias("table_name"),
            F.lit(len(df.columns)).alias("column_count"), "row_count", F.inline(cols)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.orderBy("schema_name", "table_name", "column_name")


def catalog_tables(spark: SparkSession, db: str | None = None) -> dict[str, DataFrame]:
    """The session catalog's tables of a database as named DataFrames."""
    found = {}
    for t in spark.catalog.listTables(db) if db else spark.catalog.listTables():
        try:
            name = t.name if t.isTemporary else f"{t.namespace[0]}.{t.name}"
            found[name] = spark.table(name)
        except AnalysisException:  # a view whose source is gone
            continue
    return found
