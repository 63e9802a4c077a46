"""Log analytics, catalog and relation graph on literal frames."""

import json
import time

from pyspark.sql import functions as F

from tablecraft.functions.scalars import starts_with_any
from tablecraft.operators import catalog as ct
from tablecraft.operators import logs as lg
from tablecraft.operators import relations as rl
from tablecraft.session import scratch_path
from tablecraft.streaming import streams


def log_rows(spark, data):
    cols = "id int, t string, pipeline_id string, execution_id string, log_level string, message string, module string, extra_data string"
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], cols)
    return df.select("*", F.to_timestamp("t").alias("timestamp"), F.lit("ns").alias("namespace"), F.lit(1).alias("line_number")).drop("t")


def test_line_without_extra_and_short_logger_name(spark):
    lines = spark.createDataFrame([("plain text", "pipeline.ns", None), ("ERROR:bad |+| {\"a\": 1}", "pipeline.a.b.load.e1", None), ("   ", "x", None)],
                                  "line string, logger_name string, ts timestamp")
    got = {r["message"]: (r["namespace"], r["pipeline_id"], r["execution_id"], r["log_level"], r["extra_data"]) for r in lg.parse_log_lines(lines).collect()}
    assert got == {"plain text": ("global", "system", "na", "INFO", None), "bad": ("a.b", "load", "e1", "ERROR", '{"a": 1}')}


def test_lines_for_the_runner_are_no_log_lines(spark):
    texts = ["RUN_SUCCESSFULLY", "SHORT_QUERY=__e2e_short_query_:1", "DATA=__dlt__destination__datasetname__:d", "  import pkg_resources", "RUN_SUCCESSFULLY now", None]
    lines = spark.createDataFrame([(t, "pipeline.n.p.e", None) for t in texts], "line string, logger_name string, ts timestamp")
    assert [r["message"] for r in lg.parse_log_lines(lines).collect()] == ["RUN_SUCCESSFULLY now"]


def test_errors_carry_on_within_their_run(spark):
    data = [("2024-01-01 00:00:01", "p", "a", "INFO", "m", "x", "{}"), ("2024-01-01 00:00:02", "p", "a", "ERROR", "m", "x", "{}"),
            ("2024-01-01 00:00:02", "p", "a", "INFO", "m", "x", "{}"), ("2024-01-01 00:00:03", "p", "a", "INFO", "m", "x", "{}"),
            ("2024-01-01 00:00:04", "p", "a", "WARNING", "m", "x", "{}"), ("2024-01-01 00:00:05", "p", "b", "INFO", "m", "x", "{}"),
            ("2024-01-01 00:00:01", "p", "na", "ERROR", "m", "x", "{}"), ("2024-01-01 00:00:05", "p", "na", "INFO", "m", "x", "{}"),
            (None, "p", "a", "INFO", "m", "x", "{}"), ("2024-01-01 00:00:05", None, "c", "ERROR", "m", "x", "{}"),
            ("2024-01-01 00:00:06", None, "c", "INFO", "m", "x", "{}")]
    got = {r["id"]: r["log_level"] for r in lg.carry_errors(log_rows(spark, data)).collect()}
    assert [got[i] for i in range(11)] == ["INFO", "ERROR", "INFO", "ERROR", "WARNING", "INFO", "ERROR", "INFO", "INFO", "ERROR", "ERROR"]


def test_run_status_of_no_runs(spark):
    status = lg.run_status(log_rows(spark, [("2020-01-01 00:00:00", "p", "e", "INFO", "m", "x", "{}")]), "ns", "2024-01-31 00:00:00")
    found = status.collect()
    assert len(found) == 1 and found[0]["total_runs"] == 0 and found[0]["report_type"] == "SUMMARY"
    assert tuple(lg.status_share(status).first()) == (0.0, 0.0, 0.0)


def test_run_status_order_trend_and_records(spark):
    data = [
        ("2024-01-30 10:00:00", "My  Load", "e1", "INFO", "orders: 5 |", "m", "{}"), ("2024-01-30 10:01:00", "my_load", "e1", "INFO", "orders: 9 |", "m", "{}"),
        ("2024-01-29 10:00:00", "My_Load", "e2", "error", "x", "m", "{}"), ("2024-01-30 11:00:00", "other", "e3", "WARNING", "x", "m", "{}"),
        ("2024-01-30 11:00:00", "system", "e4", "ERROR", "x", "m", "{}")]
    found = lg.run_status(log_rows(spark, data), "ns", "2024-01-31 12:00:00").collect()
    assert [r["pipeline_id"] for r in found] == ["ALL", "my_load", "other"]
    mine = found[1]
    assert (mine["total_runs"], mine["failed_count"], mine["status_indicator"], mine["total_records"]) == (2, 1, "Failed", 9)
    assert mine["trend_data"] == [0, 0, 0, 0, 1, 1, 0] and mine["avg_duration"] == 30


def test_stuck_runs_look_at_message_and_status(spark):
    data = [("2024-01-01 00:00:00", "p", "a", "INFO", "start", "m", "{}"), ("2024-01-01 00:00:00", "p", "b", "INFO", "has finished", "m", "{}"),
            ("2024-01-01 00:00:00", "p", "c", "INFO", "x", "m", '{"status": "finished"}'), ("2024-01-01 00:00:00", "p", "d", "ERROR", "x", "m", "{}"),
            ("2024-01-31 00:00:00", "p", "e", "INFO", "new", "m", "{}")]
    assert [r["execution_id"] for r in lg.stuck_runs(log_rows(spark, data), 1, "2024-01-31 00:30:00").collect()] == ["a"]


def test_stored_logs_are_pruned_by_date_and_time(spark):
    path = scratch_path(spark, "logs")
    lg.store_logs(log_rows(spark, [(f"2024-01-{d:02d} 10:00:00", "p", f"e{d}", "INFO", "m", "x", "{}") for d in range(1, 31)]), path)
    recent = lg.stored_logs(spark, path, 7, "2024-01-31 00:00:00")
    ids = lg.execution_ids(recent, "ns", "2024-01-31 00:00:00")
    plan = ids._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(log_date" in plan and "GreaterThanOrEqual(timestamp" in plan and "EqualTo(namespace,ns)" in plan
    assert ids.count() == 7


def test_filters_with_all_labels_do_nothing(spark):
    logs = log_rows(spark, [("2024-01-30 10:00:00", "p", "e", "INFO", "m", "x", "{}")])
    labels = {"pipeline_id": "All Pipelines", "execution_id": "All Runs", "level": "All Levels"}
    assert lg.filter_logs(logs, labels).count() == 1
    assert lg.filter_logs(logs, {"level": "ERROR"}).count() == 0


def test_throughput_without_duration_is_null(spark):
    logs = log_rows(spark, [("2024-01-30 10:00:00", "p", "e", "INFO", "m", "x", '{"rows": "7"}'), ("2024-01-30 10:00:00", "q", "e", "INFO", "m", "x", "{}")])
    assert [tuple(r) for r in lg.throughput(logs).collect()] == [("p", None, 7, None)]


def catalog(spark, data):
    return spark.createDataFrame(data, "table_name string, original_column_name string, data_type string, column_version int, is_deleted int")


def test_catalog_diff_cases(spark):
    old = catalog(spark, [("t", "same", "int", 1, 0), ("t", "typed", "int", 1, 0), ("t", "typed", "text", 2, 0), ("t", "gone", "int", 1, 0),
                          ("t", "dead", "int", 3, 1), ("t", "back", "int", 2, 1), ("absent", "x", "int", 1, 0)])
    new = catalog(spark, [("t", "same", "int", 0, 0), ("t", "typed", "int", 0, 0), ("t", "back", "int", 0, 0), ("u", "first", "int", 0, 0)])
    got = {tuple(r) for r in ct.catalog_diff(old, new).collect()}
    assert got == {("t", "typed", "int", 3, 0), ("t", "gone", "int", 2, 1), ("t", "back", "int", 3, 0), ("u", "first", "int", 1, 0)}


def test_first_rule_wins(spark):
    names = ["customer_id", "email_address", "total_amount", "order_date", "first_name", "STATUS", "phone_number", "misc"]
    cols = spark.createDataFrame([("t", n) for n in names], "table_name string, original_column_name string")
    got = {r["original_column_name"]: r["semantic_concept"] for r in ct.tag_columns(cols).collect()}
    assert got == {"customer_id": "identifier", "email_address": "email", "total_amount": "financial_value", "order_date": "date",
                   "first_name": "name", "STATUS": "status", "phone_number": "phone_number", "misc": None}


def test_mask_secrets(spark):
    df = spark.createDataFrame([('{"user": "u", "token": "t", "url": "pg://u:pw@h"}',), ("pg://u:pw@h/db",), (None,)], "d string")
    got = [r["d"] for r in ct.mask_secrets(df, "d").collect()]
    assert json.loads(got[0]) == {"user": "u", "token": "************", "url": "pg://u:*****@h"}
    assert got[1:] == ["pg://u:*****@h/db", None]


def test_add_missing_is_repeatable(spark):
    once = ct.add_missing(spark.range(1), {"id": "string", "note": "string"})
    assert once.dtypes == [("id", "bigint"), ("note", "string")]
    assert ct.add_missing(once, {"note": "string"}).columns == once.columns


def test_hierarchy_blocks_technical_tables_and_cycles_end(spark):
    edges = spark.createDataFrame([("sale_order", "partner"), ("sale_line", "partner"), ("partner", "country"), ("country", "partner"),
                                   ("sale_order", "mail_box"), ("partner", "res_users")], "source_table string, target_table string")
    tables = spark.createDataFrame([("sale_order",), ("sale_line",), ("stock_move",)], "table_name string")
    got = sorted(tuple(r) for r in rl.table_hierarchy(edges, tables, "sale").collect())
    assert got == [(2, "sale_line", "partner", "SALE -> partner"), (3, "partner", "country", "SALE -> partner -> country"),
                   (4, "country", "partner", "SALE -> partner -> country -> partner"),
                   (5, "partner", "country", "SALE -> partner -> country -> partner -> country")]


def test_business_edges_check_both_ends(spark):
    edges = spark.createDataFrame([("a", "b"), ("mail_x", "b"), ("a", "res_users_log"), ("res_partner", "b")], "source_table string, target_table string")
    assert sorted(tuple(r) for r in rl.business_edges(edges).collect()) == [("a", "b"), ("res_partner", "b")]


RUN_LINES = [
    ("a", 1, "start |+| {\"n\": 1}", "INFO"), ("a", 2, "dynamic-_cmp7 Transformation", None), ("a", 3, "RUNTIME_ERROR:bad", "ERROR"), ("a", 3, "same time", "ERROR"),
    ("a", 4, "RUNTIME_WARNING:w", "WARNING"), ("a", 5, "sawarning: Table 'x' already there", "WARNING"), ("a", 6, "dynamic-_cmp8 Transformation", "ERROR"),
    ("a", 7, "  import pkg_resources", None), ("a", 8, "SHORT_QUERY=__e2e_short_query_:1", None), ("a", 9, "more", "ERROR"), ("a", 10, "RUN_SUCCESSFULLY", None),
    ("a", 11, "after the end", None), ("b", 1, "fine", "INFO"), ("b", 2, "ERROR:fatal", "ERROR"), ("b", 3, "RUNTIME_ERROR:late", None),
    ("c", 1, "x", "INFO"), ("c", 2, "DATA=__dlt__destination__datasetname__:d", None), ("c", 3, "y", None), ("d", 1, "only", "INFO"), ("d", 1, "  ", None), ("d", 2, None, None)]


def run_line_frame(spark, rows):
    named = [(line, f"pipeline.n.p.{run}", f"2024-01-01 00:00:{second:02d}", i) for i, (run, second, line, _) in enumerate(rows)]
    named += [("RUNTIME_ERROR:outside", "worker", "2024-01-01 00:00:01", 100 + len(named)), ("outside", "worker", "2024-01-01 00:00:02", 101 + len(named))]
    frame = spark.createDataFrame(named, "line string, logger_name string, ts string, line_number long")
    return frame.withColumn("ts", F.to_timestamp("ts"))


def wanted_levels(rows):
    strip = ("RUNTIME_ERROR:", "RUNTIME_WARNING:", "ERROR:")
    message = lambda t: next((t[len(p):] for p in strip if t.startswith(p)), t).split(" |+| ")[0]
    found = [(run, message(line), level) for run, _, line, level in rows if level]
    return sorted(found + [("na", "outside", "ERROR"), ("na", "outside", "INFO")])


def levels(df):
    return sorted((r["execution_id"], r["message"], r["log_level"]) for r in df.collect())


def test_run_lines_follow_the_state_of_their_run(spark):
    assert levels(lg.parse_run_lines(run_line_frame(spark, RUN_LINES))) == wanted_levels(RUN_LINES)
    assert lg.parse_run_lines(run_line_frame(spark, RUN_LINES).limit(0)).count() == 0


def test_run_state_outlives_micro_batches(spark):
    folder, sink = scratch_path(spark, "lines"), scratch_path(spark, "rows")
    frame = run_line_frame(spark, RUN_LINES)
    for part in ("line_number < 3", "line_number BETWEEN 3 AND 12", "line_number > 12"):
        frame.filter(part).coalesce(1).write.mode("append").option("timestampFormat", "yyyy-MM-dd HH:mm:ss").json(folder)
        streams.stream_runs(spark, folder, sink, f"{sink}-marks")
    assert levels(spark.read.parquet(sink)) == wanted_levels(RUN_LINES)


def test_silent_runs_are_forgotten(spark):
    folder, sink = scratch_path(spark, "lines"), scratch_path(spark, "rows")
    for n, text in enumerate(["RUNTIME_ERROR:e", "x", "y"]):  # the second batch moves the time on, the timer then drops the state
        run_line_frame(spark, [("r" if n != 1 else "other", 1, text, "")]).coalesce(1).write.mode("append").option("timestampFormat", "yyyy-MM-dd HH:mm:ss").json(folder)
        streams.stream_runs(spark, folder, sink, f"{sink}-marks", keep_days=1e-8)
        time.sleep(0.1)
    got = [r for r in levels(spark.read.parquet(sink)) if r[0] != "na"]
    assert got == [("other", "x", "INFO"), ("r", "e", "ERROR"), ("r", "y", "INFO")]


def test_prefixes_are_plain_text_and_one_expression(spark):
    texts = ["a.b_x", "axb_x", "c+(d", "cc(d", "\\E[z", "É-1", "xa.b_", "\na.b_", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for prefixes in (["a.b_", "c+(", "\\E[", "É-", "a b#"], ["IR"], [""], []):
        got = [r[0] for r in df.select(starts_with_any(F.col("t"), prefixes)).collect()]
        assert got == [bool(prefixes and t.startswith(tuple(prefixes))) if t is not None or not prefixes else None for t in texts]
    # A filter that is pushed below the name must not compute it once for each prefix.
    many = [f"P{i}" for i in range(40)]
    plan = df.select(F.reverse("t").alias("name")).filter(starts_with_any(F.col("name"), many))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("reverse(") <= 3


def test_module_names(spark):
    names = ["sale.order", "Sale.line", "account", "web.x", "ir", "ab.c", "9x.a", "", "stock..x", ".stock", None, "éa.b", "aßb.c"]
    models = spark.createDataFrame([(n, False, "base") for n in names] + [("crm.a", True, "base"), ("hr.a.b", False, "manual"), ("hrm.a.b", False, "base")],
                                   "model string, transient boolean, state string")
    got = sorted(tuple(r) for r in rl.module_list(models).collect())
    assert got == [(1, None, n, n) for n in ("ACCOUNT", "ASSB", "HRM", "SALE", "STOCK")]
