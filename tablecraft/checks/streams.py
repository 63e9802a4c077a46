"""Queries of the streams: files in the shared folder are drained and the result is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablecraft.checks.fixtures import RUN_LOGS_SQL, run_logs
from tablecraft.checks.registry import TS_SQL, check, table, ts_text
from tablecraft.checks.sources import EVENT_RECORD, MESSAGES_SQL, messages
from tablecraft.operators.logs import parse_run_lines
from tablecraft.session import scratch_path
from tablecraft.sinks.loads import read_target
from tablecraft.sources.payloads import decode_messages
from tablecraft.streaming import streams


def source_files(spark, df, name, **options):
    """Write ``df`` as the files of a stream and return the stream over them."""
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).options(**options).parquet(path)


@check("r1_drain_messages", MESSAGES_SQL)
def r1(spark, sf):
    stream = source_files(spark, messages(spark, sf), "messages")
    sink = scratch_path(spark, "drained")
    streams.drain(decode_messages(stream, EVENT_RECORD), sink, scratch_path(spark, "drain-checkpoint"))
    return spark.read.parquet(sink).drop("_kafka_timestamp")


@check("r2_stream_merge", """
    SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""")
def r2(spark, sf):
    # Eight files in two micro-batches; rows of a user are in all of them, in no order.
    events = table(spark, sf, "events").select("user_id", "event_id", "event_type").repartition(8, F.xxhash64("event_id"))
    stream = source_files(spark, events, "events", maxFilesPerTrigger=4)
    target = scratch_path(spark, "merged")
    streams.stream_merge(stream, target, ["user_id"], scratch_path(spark, "merge-checkpoint"), [F.col("event_id").desc()])
    return read_target(spark, target).drop("_load_id")


@check("r3_stream_logs", f"""WITH {RUN_LOGS_SQL}
    SELECT {TS_SQL.format("timestamp")} AS timestamp, execution_id, CASE WHEN id % 2 = 0 THEN 'ERROR' ELSE 'INFO' END AS log_level, message FROM logs""")
def r3(spark, sf):
    folder, sink = scratch_path(spark, "lines"), scratch_path(spark, "parsed")
    line = F.concat(F.when(F.col("id") % 2 == 0, "ERROR:").otherwise(""), "message", F.lit(" |+| "), "extra_data")
    (run_logs(spark, sf).select(line.alias("line"), "logger_name", F.col("timestamp").alias("ts")).write
     .option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").json(folder))
    streams.stream_logs(spark, folder, sink, scratch_path(spark, "logs-checkpoint"))
    return spark.read.parquet(sink).select(ts_text("timestamp").alias("timestamp"), "execution_id", "log_level", "message")


RUN_LINES_SQL = """
    WITH lines AS (
      SELECT user_id, ts, event_id, event_type || ' ' || event_id AS text,
             CASE WHEN event_id % 41 = 0 THEN 'end' WHEN event_id % 37 = 0 THEN 'fatal' WHEN event_id % 7 = 0 THEN 'step' WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'error'
                  WHEN event_type = 'view' THEN 'warning' ELSE 'info' END AS kind,
             row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
    marked AS (SELECT *, min(pos) FILTER (kind IN ('end', 'fatal')) OVER (PARTITION BY user_id) AS ended,
                      min(pos) FILTER (kind IN ('error', 'fatal')) OVER (PARTITION BY user_id) AS failed FROM lines)
    SELECT 'u' || user_id AS execution_id, event_id, CASE kind WHEN 'step' THEN 'dynamic-_cmp ' || text || ' Transformation' ELSE text END AS message,
           CASE WHEN kind = 'warning' THEN 'WARNING' WHEN pos >= coalesce(failed, pos + 1) THEN 'ERROR' ELSE 'INFO' END AS log_level
    FROM marked WHERE kind <> 'end' AND pos <= coalesce(ended, pos) AND (kind <> 'step' OR pos > coalesce(failed, pos))"""


def run_line_table(spark, sf):
    """The events as printed lines: every user is a run with errors, steps, warnings and ends."""
    n, kind = F.col("event_id"), F.col("event_type")
    text = F.concat(kind, F.lit(" "), n)
    line = (F.when(n % 41 == 0, "RUN_SUCCESSFULLY").when(n % 37 == 0, F.concat(F.lit("ERROR:"), text))
            .when(n % 7 == 0, F.concat(F.lit("dynamic-_cmp "), text, F.lit(" Transformation")))
            .when((kind == "error") & (n % 3 == 0), F.concat(F.lit("RUNTIME_ERROR:"), text))
            .when(kind == "view", F.concat(F.lit("RUNTIME_WARNING:"), text)).otherwise(text))
    extra = F.concat(F.lit(' |+| {"event_id": '), n, F.lit("}"))
    ends = (n % 41 == 0) | (n % 7 == 0) & (n % 37 != 0)
    return table(spark, sf, "events").select(
        F.when(ends, line).otherwise(F.concat(line, extra)).alias("line"), F.concat(F.lit("pipeline.ns.load.u"), "user_id").alias("logger_name"),
        F.col("ts").cast("timestamp").alias("ts"), n.alias("line_number"))


def run_rows(rows):
    event = F.coalesce(F.get_json_object("extra_data", "$.event_id"), F.regexp_extract("message", r"(\d+)", 1))
    return rows.select("execution_id", event.cast("bigint").alias("event_id"), "message", "log_level")


@check("l1_run_lines", RUN_LINES_SQL)
def l1_runs(spark, sf):
    path = scratch_path(spark, "run-lines")
    run_line_table(spark, sf).write.parquet(path)
    return run_rows(parse_run_lines(spark.read.parquet(path)))


@check("r3_stream_runs", RUN_LINES_SQL)
def r3_runs(spark, sf):
    """Lines arrive in three micro-batches; most runs fail or end in a later one than they began in."""
    folder, sink = scratch_path(spark, "run-lines"), scratch_path(spark, "run-rows")
    lines, days = run_line_table(spark, sf), F.dayofmonth("ts")
    for part in (days < 5, days.between(5, 14), days > 14):
        lines.filter(part).coalesce(4).write.mode("append").option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").json(folder)
    streams.stream_runs(spark, folder, sink, f"{sink}-checkpoint", files_per_trigger=4)
    return run_rows(spark.read.parquet(sink))


@check("r4_stream_volume", f"""
    SELECT {TS_SQL.format("time_bucket(INTERVAL '1 day', ts)")} AS time_window, event_type, count(*) AS log_count FROM events
    WHERE time_bucket(INTERVAL '1 day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY 1, 2""")
def r4(spark, sf):
    stream = source_files(spark, table(spark, sf, "events").select("ts", "event_type"), "volume")
    sink = scratch_path(spark, "volume-out")
    counts = streams.stream_volume(stream, 86400, "10 minutes", "ts", "event_type")
    streams.drain(counts, sink, scratch_path(spark, "volume-checkpoint"))
    return spark.read.parquet(sink).withColumn("time_window", ts_text("time_window"))
