"""Streaming forms of ingest, merge, log parsing and log volume."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecraft.operators.logs import in_run, line_kind, log_rows, parse_log_lines, time_bucket
from tablecraft.sinks.loads import FILE_BYTES, merge_load
from tablecraft.streaming.run_state import OUTPUT, RunState

LOG_LINE_SCHEMA = "line string, logger_name string, ts timestamp"
RUN_LINE_SCHEMA = "line string, logger_name string, ts timestamp, line_number long"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
KEYED_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drain(stream: DataFrame, sink: str, checkpoint: str, fmt: str = "parquet") -> None:
    """Write all that is available, then stop; the next call continues from there."""
    query = (stream.writeStream.format(fmt).outputMode("append")
             .option("path", sink).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def stream_merge(stream: DataFrame, target: str, pk: list[str], checkpoint: str,
                 order_by: list | None = None, file_bytes: int = FILE_BYTES) -> None:
    """Merge each micro-batch by key. A replayed batch replaces its own rows, so it is harmless.

    With ``order_by`` the first row of a key stays whichever micro-batch brings it; without, the latest batch's row.
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        merge_load(batch.sparkSession, target, batch, pk, f"batch-{batch_id}", order_by, file_bytes, keep_better=bool(order_by))

    query = (stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def stream_logs(spark: SparkSession, folder: str, sink: str, checkpoint: str) -> None:
    """Parse log lines that arrive as JSON files of (line, logger_name, ts)."""
    lines = spark.readStream.schema(LOG_LINE_SCHEMA).json(folder)
    drain(parse_log_lines(lines), sink, checkpoint)


def run_lines(lines: DataFrame, keep_days: float = 7) -> DataFrame:
    """A stream of (line, logger_name, ts, line_number) to log rows, as ``parse_run_lines`` gives them for whole runs.

    A run's state outlives the micro-batch and is forgotten once the run has been silent for ``keep_days``. Within a micro-batch
    lines go by ``ts`` and ``line_number``; micro-batches must come in order. A run's lines of one micro-batch meet in a
    task, so its size is to be bounded at the source, as by ``maxFilesPerTrigger``. Needs the key-value state store, see ``stream_runs``.
    """
    known = in_run(F.col("logger_name"))
    key = F.when(known, F.col("logger_name")).otherwise(F.concat(F.lit("no run "), F.pmod(F.xxhash64("line", "ts"), F.lit(64))))
    marked = lines.select("line", "logger_name", "ts", "line_number", line_kind(F.trim("line")).alias("kind"), known.alias("in_run"),
                          key.alias("key"), F.current_timestamp().alias("arrived")).filter(F.col("kind") != "skip")
    state = RunState(int(keep_days * 86_400_000))
    return log_rows(marked.withWatermark("arrived", "0 seconds").groupBy("key").transformWithState(state, OUTPUT, "Append", "EventTime"))


def stream_runs(spark: SparkSession, folder: str, sink: str, checkpoint: str, keep_days: float = 7, files_per_trigger: int = 1000) -> None:
    """Log rows of runs whose lines arrive as JSON files of (line, logger_name, ts, line_number), with the error state of each run."""
    lines = spark.readStream.schema(RUN_LINE_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(folder)
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, KEYED_STORE)
    try:
        drain(run_lines(lines, keep_days), sink, checkpoint)
    finally:
        spark.conf.set(STATE_STORE, before)


def stream_volume(stream: DataFrame, width_seconds: int = 300, delay: str = "10 minutes",
                  ts: str = "timestamp", level: str = "log_level") -> DataFrame:
    """Log rows per time bucket and level, kept up to date as rows arrive.

    A bucket is emitted once the watermark has passed it; the delay bounds the state.
    """
    counted = (stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
               .groupBy(time_bucket(ts, width_seconds).alias("_w"), level).agg(F.count(F.lit(1)).alias("log_count")))
    return counted.select(F.col("_w.start").alias("time_window"), level, "log_count")
