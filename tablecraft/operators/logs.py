"""Analytics over run logs.

A log table has id, timestamp, namespace, pipeline_id, execution_id, log_level,
logger_name, message, module, line_number and extra_data (JSON text). Where a report
depends on the current time, ``as_of`` gives it; the default is the time of the query.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecraft.functions import fixed_values as fixed
from tablecraft.functions.aggs import latest_value
from tablecraft.functions.scalars import normalised_id, starts_with_any
from tablecraft.operators.attach import attach
from tablecraft.operators.windows import any_in_group, step_lag
from tablecraft.session import materialise

# Days from 1970-01-01 to Monday 2000-01-03, the day time buckets are counted from.
BUCKET_ORIGIN_DAYS = 10959


def _now(as_of: str | None) -> Column:
    return F.to_timestamp(F.lit(as_of)) if as_of else F.current_timestamp()


def _extra(name: str) -> Column:
    return F.get_json_object("extra_data", f"$.{name}")


def _seconds(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1e6)


def _until(as_of: str | None) -> Column:
    """Nothing later than a given ``as_of`` takes part."""
    return F.col("timestamp") <= _now(as_of) if as_of else F.lit(True)


def _since(days: int, as_of: str | None) -> Column:
    return (F.col("timestamp") >= _now(as_of) - F.make_dt_interval(F.lit(days))) & _until(as_of)


def _user_logs(logs: DataFrame, ns: str) -> DataFrame:
    return logs.filter((F.col("namespace") == ns) & ~F.col("pipeline_id").isin(fixed.INTERNAL_LOG_IDS))


def store_logs(logs: DataFrame, path: str, mode: str = "append") -> None:
    """Write log rows in folders by date, sorted by namespace, so that reports read few files."""
    dated = logs.withColumn("log_date", F.to_date("timestamp"))
    # adaptive execution makes as many files a day as the measured bytes call for
    (dated.hint("rebalance", "log_date").sortWithinPartitions("log_date", "namespace")
     .write.mode(mode).partitionBy("log_date").parquet(path))


def stored_logs(spark: SparkSession, path: str, days: int | None = None, as_of: str | None = None) -> DataFrame:
    """Stored log rows, only the folders of the last ``days`` where given."""
    logs = spark.read.parquet(path)
    if days is not None:
        logs = logs.filter(F.col("log_date") >= F.date_sub(F.to_date(_now(as_of)), days))
    return logs.drop("log_date")


def _starts(prefixes: list[str]) -> str:
    return "^(?:" + "|".join(map(re.escape, prefixes)) + ")"


# One pattern a kind, tried in this order; what fits none is info.
LINE_KINDS = [
    ("skip", f"^$|{re.escape(fixed.NOISE)}"),
    ("end", f"{_starts(fixed.END_LINES)}$|{_starts(fixed.END_PREFIXES)}"),
    ("skip", f"{_starts(fixed.CONTROL_LINES)}$|{_starts(fixed.CONTROL_PREFIXES)}"),
    ("step", f"{_starts([fixed.STEP_PREFIX])}.*{re.escape(fixed.STEP_SUFFIX)}$"),
    ("warning", f"{_starts([fixed.WARNING_PREFIX])}|{fixed.TABLE_WARNING}"),
    ("fatal", _starts([fixed.FATAL_PREFIX])),
    ("error", _starts(fixed.ERROR_PREFIXES)),
]


def line_kind(line: Column) -> Column:
    """What a printed line is: skip (for the runner, or blank), end, step, warning, fatal, error or info."""
    kind = F.when(line.isNull(), "skip")
    for name, pattern in LINE_KINDS:
        kind = kind.when(line.rlike(f"(?s){pattern}"), name)
    return kind.otherwise("info")


def in_run(logger_name: Column) -> Column:
    """Whether a logger is named ``pipeline.<namespace...>.<pipeline>.<execution>``."""
    parts = F.split(logger_name, r"\.")
    return F.coalesce((F.size(parts) >= 4) & (F.get(parts, F.lit(0)) == "pipeline"), F.lit(False))


def log_rows(lines: DataFrame) -> DataFrame:
    """(line, logger_name, ts, ``_level``) to log rows: text and extra data apart, ids from the logger's name."""
    prefix = "|".join(re.escape(p) for p in [fixed.WARNING_PREFIX, *fixed.ERROR_PREFIXES])
    text = F.regexp_replace(F.trim("line"), f"^(?:{prefix})", "")
    for word in [*fixed.DROPPED_LEVEL_WORDS, fixed.LOG_TAG]:
        text = F.replace(text, F.lit(word), F.lit(""))
    pieces = F.split(text, re.escape(fixed.LOG_SEPARATOR), 2)

    parts = F.split("logger_name", r"\.")
    known = in_run(F.col("logger_name"))
    rows = lines.select(
        F.col("ts").alias("timestamp"), "logger_name", F.col("_level").alias("log_level"),
        F.trim(F.get(pieces, F.lit(0))).alias("message"), F.get(pieces, F.lit(1)).alias("extra_data"),
        F.when(known, F.array_join(F.slice(parts, F.lit(2), F.size(parts) - 3), ".")).otherwise("global").alias("namespace"),
        F.when(known, F.element_at(parts, -2)).otherwise("system").alias("pipeline_id"),
        F.when(known, F.element_at(parts, -1)).otherwise("na").alias("execution_id"))
    return rows.filter(F.col("message") != "")


def line_level(kind: Column) -> Column:
    """Level of a line by itself; null if it is no log line."""
    return F.when(kind == "warning", "WARNING").when(kind.isin("error", "fatal"), "ERROR").when(kind == "info", "INFO")


def parse_log_lines(lines: DataFrame) -> DataFrame:
    """(line, logger_name, ts) to log rows, each line by itself.

    A prefix sets the level, ``text |+| json`` splits into message and extra data, and a
    logger name ``pipeline.<namespace...>.<pipeline>.<execution>`` gives the ids. Blank lines
    and lines meant for the runner are left out. ``parse_run_lines`` follows the state of whole runs.
    """
    line = F.trim("line")
    silent, warning, error = ("(?s)" + "|".join(p for kind, p in LINE_KINDS if kind in kinds) for kinds in (("skip", "end", "step"), ("warning",), ("fatal", "error")))
    level = F.when(line.rlike(warning), "WARNING").when(line.rlike(error), "ERROR").otherwise("INFO")
    return log_rows(lines.filter(~line.rlike(silent)).withColumn("_level", level))


def parse_run_lines(lines: DataFrame) -> DataFrame:
    """(line, logger_name, ts, line_number) of whole runs to log rows, with the state of their run.

    Lines go by ``ts`` and ``line_number``. From a run's first error on every line is an error, steps too, but for
    warnings. A run ends with a line that starts with ``ERROR:``, which still counts, or with one of its closing lines; what
    comes later is left out. Lines outside of runs are read by themselves. Both positions are minima, combined before the shuffle and
    attached to the rows, so a run of any size is spread over many tasks.
    """
    kind, place = F.col("_kind"), F.struct("ts", "line_number")
    marked = lines.withColumn("_kind", line_kind(F.trim("line"))).filter(kind != "skip")
    runs = marked.filter(in_run(F.col("logger_name")) & kind.isin("end", "fatal", "error")).groupBy("logger_name").agg(
        F.min(F.when(kind.isin("end", "fatal"), place)).alias("_ended"), F.min(F.when(kind.isin("error", "fatal"), place)).alias("_failed"))
    placed = attach(marked, runs, ["logger_name"])
    within = F.col("_ended").isNull() | (place <= F.col("_ended"))
    late = F.col("_failed").isNotNull() & (place > F.col("_failed")) & kind.isin("info", "step", "error", "fatal")
    leveled = placed.filter(within & (kind != "end")).withColumn("_level", F.when(late, "ERROR").otherwise(line_level(kind)))
    return log_rows(leveled.filter(F.col("_level").isNotNull()))


def carry_errors(logs: DataFrame) -> DataFrame:
    """Log rows of whole runs: after a run's first error its INFO rows are errors too; warnings stay.

    Rows of the very time of that error keep their level, and so do rows outside of runs. The
    first error is a minimum, combined before the shuffle and attached to the rows, so a run
    of any size is spread over many tasks.
    """
    run = ["namespace", "pipeline_id", "execution_id"]
    failed = logs.filter((F.col("log_level") == "ERROR") & (F.col("execution_id") != "na"))
    marked = attach(logs, failed.groupBy(*run).agg(F.min("timestamp").alias("_failed_at")), run)
    later = (F.col("log_level") == "INFO") & (F.col("timestamp") > F.col("_failed_at"))
    return marked.withColumn("log_level", F.when(later, "ERROR").otherwise(F.col("log_level"))).drop("_failed_at")


def filter_logs(logs: DataFrame, filters: dict | None = None, as_of: str | None = None) -> DataFrame:
    """Filters by pipeline, execution, level and ``days_back``; an 'All ...' label does nothing."""
    out = logs
    for field, value in (filters or {}).items():
        if field == "days_back":
            out = out.filter(F.col("timestamp") >= F.date_sub(F.to_date(_now(as_of)), int(value)).cast("timestamp")).filter(_until(as_of))
        else:
            column = "log_level" if field == "level" else field
            if value != fixed.ALL_LABELS.get(column):
                out = out.filter(F.col(column) == value)
    return out


def log_view(logs: DataFrame, ns: str | None = None, filters: dict | None = None, as_of: str | None = None) -> DataFrame:
    """Filtered log, newest first; or one namespace's last 30 days, oldest first.

    The namespace view leaves out internal sources and adds ``completed``: whether any of
    the run's shown rows reached the completion stage.
    """
    if ns is None:
        return filter_logs(logs, filters, as_of).orderBy(F.col("timestamp").desc())
    shown = filter_logs(_user_logs(logs, ns).filter(_since(30, as_of)), filters, as_of)
    done = any_in_group(shown, _extra("stage") == fixed.COMPLETION_STAGE, ["execution_id"], "completed")
    return done.select("timestamp", "id", "log_level", "module", "execution_id", "line_number", "message",
                       "namespace", "extra_data", "completed").orderBy("timestamp")


def run_summary(logs: DataFrame, ns: str, filters: dict | None = None, as_of: str | None = None) -> DataFrame:
    """One row per execution of the last 30 days, latest start first."""
    shown = filter_logs(_user_logs(logs, ns).filter(_since(30, as_of)), filters, as_of)
    stage = _extra("stage")
    return (shown.groupBy("execution_id").agg(
        F.any_value("pipeline_id").alias("pipeline_id"),
        F.any_value("namespace").alias("namespace"),
        F.min("timestamp").alias("started_at"),
        F.max("timestamp").alias("ended_at"),
        _seconds(F.max("timestamp"), F.min("timestamp")).alias("duration_seconds"),
        F.count(F.lit(1)).alias("log_rows"),
        latest_value(stage, F.col("timestamp")).alias("last_stage"),
        F.count_if(F.col("log_level") == "ERROR").alias("error_count"),
        F.bool_or(stage == fixed.COMPLETION_STAGE).alias("completed"),
    ).orderBy(F.col("started_at").desc()))


def stuck_runs(logs: DataFrame, hours: int = 1, as_of: str | None = None) -> DataFrame:
    """Runs that started over ``hours`` ago and neither finished nor failed."""
    finished = F.contains("message", F.lit(fixed.FINISHED)) | (_extra("status") == fixed.FINISHED)
    runs = logs.groupBy("pipeline_id", "execution_id").agg(
        F.min("timestamp").alias("started_at"), F.max("timestamp").alias("last_activity"),
        F.count_if(finished).alias("_finished"), F.count_if(F.col("log_level") == "ERROR").alias("_failed"))
    late = F.col("started_at") < _now(as_of) - F.make_dt_interval(hours=F.lit(hours))
    return (runs.filter((F.col("_finished") == 0) & (F.col("_failed") == 0) & late)
            .drop("_finished", "_failed").orderBy(F.col("started_at").desc()))


def timeline(logs: DataFrame, execution_id: str | None = None) -> DataFrame:
    """Steps of one run, or of all runs, with the seconds since the step before."""
    rows = logs if execution_id is None else logs.filter(F.col("execution_id") == execution_id)
    steps = step_lag(rows.select("execution_id", "id", "timestamp", "message", "module"),
                     "timestamp", ["execution_id"], ["id"])
    return steps.orderBy("timestamp", "id") if execution_id is not None else steps


def volume_histogram(logs: DataFrame, width_seconds: int = 300, hours: int = 6, as_of: str | None = None) -> DataFrame:
    """Log rows per time bucket and level over the last ``hours``."""
    recent = logs.filter((F.col("timestamp") > _now(as_of) - F.make_dt_interval(hours=F.lit(hours))) & _until(as_of))
    bucket = time_bucket("timestamp", width_seconds)
    return (recent.groupBy(bucket.alias("_w"), "log_level").agg(F.count(F.lit(1)).alias("log_count"))
            .select(F.col("_w.start").alias("time_window"), "log_level", "log_count")
            .orderBy(F.col("time_window").desc()))


def time_bucket(ts: str, width_seconds: int) -> Column:
    """Tumbling window counted from a Monday, so that week buckets start on Mondays."""
    offset = BUCKET_ORIGIN_DAYS * 86400 % width_seconds
    return F.window(ts, f"{width_seconds} seconds", startTime=f"{offset} seconds")


def health_pivot(logs: DataFrame, levels: list[str] | None = None) -> DataFrame:
    """Rows per pipeline, one column per level; levels that are not given are those of the log, which is read once."""
    counts = logs.groupBy("pipeline_id", "log_level").agg(F.count(F.lit(1)).alias("_rows"))
    if levels is None:
        counts = materialise(counts)
        levels = [r[0] for r in counts.select("log_level").distinct().orderBy("log_level").collect() if r[0] is not None]
    return counts.groupBy("pipeline_id").agg(*[F.coalesce(F.sum(F.when(F.col("log_level") == v, F.col("_rows"))), F.lit(0)).alias(v) for v in levels])


def throughput(logs: DataFrame) -> DataFrame:
    """Average duration, total rows and rows per second per pipeline."""
    rows = F.sum(F.col("_rows").cast("bigint"))
    measured = (logs.select("pipeline_id", _extra("rows").try_cast("int").alias("_rows"),
                            _extra("duration_sec").try_cast("double").alias("_seconds"), _extra("rows").alias("_given"))
                .filter(F.col("_given").isNotNull()))
    return measured.groupBy("pipeline_id").agg(
        F.avg("_seconds").alias("avg_duration"), rows.alias("total_rows"),
        (rows / F.nullif(F.sum("_seconds"), F.lit(0.0))).alias("rows_per_sec"),
    ).orderBy(F.col("rows_per_sec").desc())


def error_hotspots(logs: DataFrame) -> DataFrame:
    """Errors per module with the latest message."""
    return (logs.filter(F.col("log_level").isin("ERROR", "CRITICAL")).groupBy("module").agg(
        F.count(F.lit(1)).alias("error_count"),
        latest_value(F.col("message"), F.col("timestamp")).alias("latest_error_msg"))
        .orderBy(F.col("error_count").desc()))


def execution_ids(logs: DataFrame, ns: str, as_of: str | None = None) -> DataFrame:
    return logs.filter((F.col("namespace") == ns) & _since(30, as_of)).select("execution_id").distinct()


def record_counts(logs: DataFrame, ns: str, as_of: str | None = None, days: int = 7) -> DataFrame:
    """Records per run, from progress lines: the highest count of each resource, summed."""
    lines = logs.filter((F.col("namespace") == ns) & F.col("message").rlike(fixed.PROGRESS_LINE) & _since(days, as_of))
    count = F.regexp_extract("message", fixed.PROGRESS_COUNT, 1).try_cast("int")
    name = F.regexp_extract("message", fixed.PROGRESS_NAME, 1)
    per_resource = lines.groupBy("execution_id", name.alias("resource")).agg(F.max(count).alias("records"))
    return per_resource.groupBy("execution_id").agg(F.sum("records").alias("total_records"))


def run_outcomes(logs: DataFrame, ns: str, as_of: str | None = None, days: int = 7) -> DataFrame:
    """Outcome, end, duration and records of every run of the last ``days``."""
    level = F.upper("log_level")
    runs = (_user_logs(logs, ns).filter(_since(days, as_of))
            .groupBy("execution_id", normalised_id(F.col("pipeline_id")).alias("pipeline_id"))
            .agg(F.count_if(level == "ERROR").alias("_errors"), F.count_if(level == "WARNING").alias("_warnings"),
                 F.max("timestamp").alias("last_run_time"),
                 _seconds(F.max("timestamp"), F.min("timestamp")).alias("duration_seconds")))
    status = F.when(F.col("_errors") > 0, "Failed").when(F.col("_warnings") > 0, "Warning").otherwise("Success")
    return (runs.join(record_counts(logs, ns, as_of, days), "execution_id", "left")
            .select("execution_id", "pipeline_id", status.alias("final_status"), "last_run_time", "duration_seconds",
                    F.coalesce("total_records", F.lit(0)).alias("total_records")))


def run_status(logs: DataFrame, ns: str, as_of: str | None = None, days: int = 7) -> DataFrame:
    """Totals row and one row per pipeline, with runs per day of the last ``days`` as a list.

    Each day's number is a conditional count in the same aggregate, so days without runs
    show 0 and no calendar has to be joined.
    """
    runs = run_outcomes(logs, ns, as_of, days)
    today = F.to_date(_now(as_of))
    day = F.to_date("last_run_time")

    def count_of(status: str) -> Column:
        return F.count_if(F.col("final_status") == status)

    shared = [F.count(F.lit(1)).alias("total_runs"), count_of("Success").alias("success_count"),
              count_of("Failed").alias("failed_count"), count_of("Warning").alias("warning_count")]
    trend = F.array(*[F.count_if(day == F.date_sub(today, days - 1 - i)) for i in range(days)])
    worst = F.when(count_of("Failed") > 0, "Failed").when(count_of("Warning") > 0, "Warning").otherwise("Success")
    # One row per pipeline, computed once; the totals add these rows up.
    per_id = materialise(runs.groupBy("pipeline_id").agg(
        *shared, worst.alias("status_indicator"), trend.alias("trend_data"),
        F.round(F.avg("duration_seconds")).cast("bigint").alias("avg_duration"),
        F.sum("total_records").alias("total_records")))
    counts = ["total_runs", "success_count", "failed_count", "warning_count"]
    totals = per_id.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts],
                        F.sum("total_records").alias("total_records")).select(
        F.lit("ALL").alias("pipeline_id"), *counts,
        F.lit("N/A").alias("status_indicator"), F.array().cast("array<bigint>").alias("trend_data"),
        F.lit(0).cast("bigint").alias("avg_duration"), "total_records")
    both = totals.withColumn("report_type", F.lit("SUMMARY")).unionByName(per_id.withColumn("report_type", F.lit("LIST")))
    return both.orderBy(F.col("report_type").desc(), F.col("failed_count").desc(), F.col("total_runs").desc())


def status_share(status: DataFrame) -> DataFrame:
    """Share of each outcome in percent with one decimal, from the totals row; 0 without runs."""
    shares = [F.coalesce(F.round(100 * F.col(f"{s}_count") / F.nullif(F.col("total_runs"), F.lit(0)), 1), F.lit(0.0))
              .alias(f"{s}_share") for s in ("success", "failed", "warning")]
    return status.filter(F.col("report_type") == "SUMMARY").select(*shares)
