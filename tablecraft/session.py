"""Session set-up and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tablecraft", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    Shuffle partitions are left to the caller or cluster: adaptive execution coalesces
    small ones and splits skewed ones at run time.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
        "spark.checkpoint.compress": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, named by ``spark.checkpoint.dir``.

    Only a local master falls back to a temporary folder; a cluster without the setting
    is an error, because a machine-local folder is lost together with its executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    known = context.getCheckpointDir()
    if known:
        return known.rstrip("/").rsplit("/", 1)[0]
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="tablecraft-")
    context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared checkpoint folder and cut its lineage.

    Used where a later step reads ``df`` more than once and relies on both reads seeing
    the same partitioning; the written copy survives the loss of executors.
    """
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def _open_folder(spark: SparkSession, path: str):
    """Hadoop path and the file system it lies on, be it local, hdfs or an object store."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none when it does not exist."""
    where, system = _open_folder(spark, path)
    return [s.getPath().getName() for s in system.listStatus(where)] if system.exists(where) else []


def file_sizes(spark: SparkSession, path: str) -> dict[str, int]:
    """Data files in a folder with their bytes; marks and hidden files are left out."""
    where, system = _open_folder(spark, path)
    found = system.listStatus(where) if system.exists(where) else []
    return {s.getPath().getName(): s.getLen() for s in found if s.isFile() and s.getPath().getName()[0] not in "_."}


def read_text(spark: SparkSession, path: str) -> str:
    where, system = _open_folder(spark, path)
    stream = system.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file under its final name only when it is complete."""
    where, system = _open_folder(spark, path)
    draft = where.suffix(".draft")
    stream = system.create(draft, True)
    stream.write(bytearray(text.encode("utf-8")))
    stream.close()
    if not system.rename(draft, where):
        raise RuntimeError(f"{path} is there already: another writer?")


def delete_folder(spark: SparkSession, path: str) -> None:
    where, system = _open_folder(spark, path)
    system.delete(where, True)
