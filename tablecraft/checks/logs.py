"""Queries of the log analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablecraft.checks.fixtures import RUN_LOGS_SQL, run_logs
from tablecraft.checks.registry import AS_OF, TS_SQL, check, rounded, ts_text
from tablecraft.operators import logs as lg
from tablecraft.session import scratch_path

WITH = f"WITH {RUN_LOGS_SQL}"
NOW = f"TIMESTAMP '{AS_OF}'"
USER_LOGS = "namespace = 'ns' AND pipeline_id NOT IN ('system', 'flask_server')"


@check("l1_parse_log_lines", f"""{WITH}
    SELECT {TS_SQL.format("timestamp")} AS ts, namespace, pipeline_id, execution_id, log_level,
           CASE WHEN log_level = 'INFO' THEN message ELSE trim(message || ' at ' || line_number) END AS message,
           CASE WHEN log_level <> 'WARNING' THEN extra_data END AS extra_data
    FROM (SELECT * REPLACE (CASE WHEN id % 7 = 0 THEN 'global' ELSE namespace END AS namespace,
                            CASE WHEN id % 7 = 0 THEN 'system' ELSE pipeline_id END AS pipeline_id,
                            CASE WHEN id % 7 = 0 THEN 'na' ELSE execution_id END AS execution_id) FROM logs)""")
def l1(spark, sf):
    level, message, extra = F.col("log_level"), F.col("message"), F.col("extra_data")
    placed = F.concat(message, F.lit(" at "), "line_number")
    line = (F.when(level == "ERROR", F.concat(F.lit("RUNTIME_ERROR:"), placed, F.lit(" |+| "), extra))
            .when(level == "WARNING", F.concat(F.lit("RUNTIME_WARNING:"), placed))
            .otherwise(F.concat(F.lit("  [PIPELINE_LOG]:DEBUG: "), message, F.lit(" |+| "), extra)))
    logger = F.when(F.col("id") % 7 == 0, "app.worker").otherwise(F.col("logger_name"))
    lines = run_logs(spark, sf).select(line.alias("line"), logger.alias("logger_name"), F.col("timestamp").alias("ts"))
    blank = lines.limit(0).unionByName(lines.select(F.lit("  ").alias("line"), "logger_name", "ts"))
    out = lg.parse_log_lines(lines.unionByName(blank))
    return out.select(ts_text("timestamp").alias("ts"), "namespace", "pipeline_id", "execution_id", "log_level", "message", "extra_data")


@check("l1_carry_errors", f"""{WITH}
    SELECT id, CASE WHEN log_level = 'INFO' AND timestamp > failed_at THEN 'ERROR' ELSE log_level END AS log_level
    FROM (SELECT *, min(CASE WHEN log_level = 'ERROR' THEN timestamp END) OVER (PARTITION BY namespace, pipeline_id, execution_id) AS failed_at FROM logs)""")
def l1_errors(spark, sf):
    return lg.carry_errors(run_logs(spark, sf)).select("id", "log_level")


@check("l0_stored_logs", f"""{WITH}
    SELECT id, execution_id, log_level FROM logs WHERE timestamp >= {NOW}::DATE - 7""")
def l0(spark, sf):
    path = scratch_path(spark, "log-store")
    lg.store_logs(run_logs(spark, sf), path)
    return lg.stored_logs(spark, path, 7, AS_OF).select("id", "execution_id", "log_level")


@check("l2_log_view_filtered", f"""{WITH}
    SELECT id, message FROM logs WHERE log_level = 'ERROR' AND pipeline_id = 'Load 3' AND timestamp >= {NOW}::DATE - 10""")
def l2(spark, sf):
    view = lg.log_view(run_logs(spark, sf), None, {"level": "ERROR", "pipeline_id": "Load 3", "execution_id": "All Runs",
                                                   "days_back": 10}, AS_OF)
    return view.select("id", "message")


@check("l2_log_view_namespace", f"""{WITH}
    SELECT {TS_SQL.format("timestamp")} AS timestamp, id, log_level, module, execution_id, line_number, message, namespace, extra_data,
           bool_or((extra_data->>'$.stage') = 'pipeline_completion') OVER (PARTITION BY execution_id) AS completed
    FROM logs WHERE {USER_LOGS} AND timestamp >= {NOW} - INTERVAL 30 DAY""")
def l2_ns(spark, sf):
    return lg.log_view(run_logs(spark, sf), "ns", {"level": "All Levels"}, AS_OF).withColumn("timestamp", ts_text("timestamp"))


@check("l3_run_summary", f"""{WITH}
    SELECT execution_id, any_value(pipeline_id) AS pipeline_id, any_value(namespace) AS namespace,
           {TS_SQL.format("min(timestamp)")} AS started_at, {TS_SQL.format("max(timestamp)")} AS ended_at,
           round(epoch_us(max(timestamp) - min(timestamp)) / 1e6, 6) AS duration_seconds, count(*) AS log_rows,
           arg_max(extra_data->>'$.stage', timestamp) AS last_stage, count_if(log_level = 'ERROR') AS error_count,
           bool_or((extra_data->>'$.stage') = 'pipeline_completion') AS completed
    FROM logs WHERE {USER_LOGS} AND timestamp >= {NOW} - INTERVAL 30 DAY GROUP BY 1""")
def l3(spark, sf):
    s = lg.run_summary(run_logs(spark, sf), "ns", None, AS_OF)
    return rounded(s.withColumns({c: ts_text(c) for c in ("started_at", "ended_at")}), 6)


@check("l4_stuck_runs", f"""{WITH}
    SELECT pipeline_id, execution_id, {TS_SQL.format("min(timestamp)")} AS started_at, {TS_SQL.format("max(timestamp)")} AS last_activity
    FROM logs GROUP BY 1, 2
    HAVING count_if(message LIKE '%finished%') = 0 AND count_if(log_level = 'ERROR') = 0 AND min(timestamp) < {NOW} - INTERVAL 36 HOUR""")
def l4(spark, sf):
    s = lg.stuck_runs(run_logs(spark, sf), 36, AS_OF)
    return s.withColumns({c: ts_text(c) for c in ("started_at", "last_activity")})


@check("l5_timeline", f"""{WITH}
    SELECT execution_id, id, {TS_SQL.format("timestamp")} AS timestamp, message, module,
           round(epoch_us(timestamp - lag(timestamp) OVER (PARTITION BY execution_id ORDER BY timestamp, id)) / 1e6, 6) AS step_seconds
    FROM logs""")
def l5(spark, sf):
    return rounded(lg.timeline(run_logs(spark, sf)).withColumn("timestamp", ts_text("timestamp")), 6)


@check("l5_timeline_of_run", f"""{WITH}
    SELECT execution_id, id, message, module,
           round(epoch_us(timestamp - lag(timestamp) OVER (ORDER BY timestamp, id)) / 1e6, 6) AS step_seconds
    FROM logs WHERE execution_id = 'e3-4'""")
def l5_run(spark, sf):
    return rounded(lg.timeline(run_logs(spark, sf), "e3-4").drop("timestamp"), 6)


@check("l6_health_pivot", f"""{WITH}
    SELECT pipeline_id, count_if(log_level = 'ERROR') AS ERROR, count_if(log_level = 'INFO') AS INFO, count_if(log_level = 'WARNING') AS WARNING
    FROM logs GROUP BY 1""")
def l6(spark, sf):
    return lg.health_pivot(run_logs(spark, sf))


def volume_sql(width: str, hours: int) -> str:
    return f"""{WITH} SELECT {TS_SQL.format(f"time_bucket(INTERVAL '{width}', timestamp)")} AS time_window, log_level, count(*) AS log_count
               FROM logs WHERE timestamp > {NOW} - INTERVAL {hours} HOUR GROUP BY 1, 2"""


@check("l7_volume_histogram", volume_sql("5 minutes", 72))
def l7(spark, sf):
    return lg.volume_histogram(run_logs(spark, sf), 300, 72, AS_OF).withColumn("time_window", ts_text("time_window"))


@check("l7_volume_by_week", volume_sql("7 days", 720))
def l7_week(spark, sf):
    return lg.volume_histogram(run_logs(spark, sf), 7 * 86400, 720, AS_OF).withColumn("time_window", ts_text("time_window"))


@check("l8_throughput", f"""{WITH}
    SELECT pipeline_id, round(avg(d), 4) AS avg_duration, sum(r)::BIGINT AS total_rows, round(sum(r) / nullif(sum(d), 0), 4) AS rows_per_sec
    FROM (SELECT pipeline_id, (extra_data->>'$.duration_sec')::DOUBLE AS d, (extra_data->>'$.rows')::BIGINT AS r FROM logs)
    WHERE r IS NOT NULL GROUP BY 1""")
def l8(spark, sf):
    return rounded(lg.throughput(run_logs(spark, sf)))


@check("l9_error_hotspots", f"""{WITH}, moved AS (SELECT *, 'mod' || line_number % 20 AS part FROM logs)
    SELECT part AS module, count(*) AS error_count, arg_max(message || id, timestamp) AS latest_error_msg
    FROM moved WHERE log_level IN ('ERROR', 'CRITICAL') GROUP BY 1""")
def l9(spark, sf):
    logs = run_logs(spark, sf).withColumns({"module": F.concat(F.lit("mod"), F.col("line_number") % 20),
                                            "message": F.concat("message", "id")})
    return lg.error_hotspots(logs)


STATUS_SQL = f"""
    totals AS (
      SELECT execution_id, sum(n)::BIGINT AS records FROM (
        SELECT execution_id, regexp_extract(message, '^([a-z_]+):', 1) AS resource, max(regexp_extract(message, '([0-9]+)', 1)::BIGINT) AS n
        FROM logs WHERE namespace = 'ns' AND regexp_matches(message, '^[a-z_]+: +[0-9]+ +\\|') AND timestamp >= {NOW} - INTERVAL 7 DAY
        GROUP BY 1, 2) GROUP BY 1),
    runs AS (
      SELECT l.execution_id, lower(regexp_replace(trim(pipeline_id), '[_\\s]+', '_', 'g')) AS clean,
             CASE max(CASE log_level WHEN 'ERROR' THEN 2 WHEN 'WARNING' THEN 1 ELSE 0 END) WHEN 2 THEN 'Failed' WHEN 1 THEN 'Warning' ELSE 'Success' END AS status,
             max(timestamp) AS last_run, epoch_us(max(timestamp) - min(timestamp)) / 1e6 AS seconds, coalesce(max(records), 0) AS records
      FROM logs l LEFT JOIN totals t ON t.execution_id = l.execution_id
      WHERE {USER_LOGS} AND timestamp >= {NOW} - INTERVAL 7 DAY GROUP BY 1, 2)"""


@check("l10_run_outcomes", f"""{WITH}, {STATUS_SQL}
    SELECT execution_id, clean AS pipeline_id, status AS final_status, round(seconds, 6) AS duration_seconds, records AS total_records FROM runs""")
def l10_runs(spark, sf):
    return rounded(lg.run_outcomes(run_logs(spark, sf), "ns", AS_OF).drop("last_run_time"), 6)


@check("l10_run_status", f"""{WITH}, {STATUS_SQL},
    days AS (SELECT unnest(range(DATE '2024-01-25', DATE '2024-02-01', INTERVAL 1 DAY))::DATE AS d),
    trend AS (
      SELECT c.clean, string_agg(n::VARCHAR, ',' ORDER BY d) AS trend FROM (
        SELECT p.clean, d, (SELECT count(*) FROM runs r WHERE r.clean = p.clean AND r.last_run::DATE = d) AS n
        FROM (SELECT DISTINCT clean FROM runs) p, days) c GROUP BY 1)
    SELECT 'SUMMARY' AS report_type, 'ALL' AS pipeline_id, count(*) AS total_runs, count_if(status = 'Success') AS success_count,
           count_if(status = 'Failed') AS failed_count, count_if(status = 'Warning') AS warning_count, 'N/A' AS status_indicator,
           '' AS trend_data, 0::BIGINT AS avg_duration, sum(records)::BIGINT AS total_records FROM runs
    UNION ALL
    SELECT 'LIST', runs.clean, count(*), count_if(status = 'Success'), count_if(status = 'Failed'), count_if(status = 'Warning'),
           CASE WHEN count_if(status = 'Failed') > 0 THEN 'Failed' WHEN count_if(status = 'Warning') > 0 THEN 'Warning' ELSE 'Success' END,
           any_value(trend), round(avg(seconds))::BIGINT, sum(records)::BIGINT
    FROM runs JOIN trend ON trend.clean = runs.clean GROUP BY 2""")
def l10(spark, sf):
    status = lg.run_status(run_logs(spark, sf), "ns", AS_OF)
    return status.withColumn("trend_data", F.array_join(F.col("trend_data").cast("array<string>"), ","))


@check("l11_record_counts", f"""{WITH}, {STATUS_SQL} SELECT execution_id, records AS total_records FROM totals""")
def l11(spark, sf):
    return lg.record_counts(run_logs(spark, sf), "ns", AS_OF)


@check("l12_execution_ids", f"""{WITH}
    SELECT DISTINCT execution_id FROM logs WHERE namespace = 'ns' AND timestamp >= {NOW} - INTERVAL 30 DAY""")
def l12(spark, sf):
    return lg.execution_ids(run_logs(spark, sf), "ns", AS_OF)


@check("l13_status_share", f"""{WITH}, {STATUS_SQL}
    SELECT round(100 * count_if(status = 'Success') / count(*), 1) AS success_share, round(100 * count_if(status = 'Failed') / count(*), 1) AS failed_share,
           round(100 * count_if(status = 'Warning') / count(*), 1) AS warning_share FROM runs""")
def l13(spark, sf):
    return lg.status_share(lg.run_status(run_logs(spark, sf), "ns", AS_OF))
