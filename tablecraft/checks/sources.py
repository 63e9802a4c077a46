"""Queries of the sources. Files are written to the shared folder first, from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tablecraft.checks.registry import check, table
from tablecraft.operators.transforms import preview
from tablecraft.plans.recipe import Casing, Dedup, Filter, apply_counted
from tablecraft.session import scratch_path
from tablecraft.sources import databases, files, payloads
from tablecraft.sources.counts import load_delta, with_counts

ORDERS_SQL = """
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders"""
ORDERS_SCHEMA = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate string, o_orderpriority string"


def written_orders(spark, sf, fmt, folder="") -> str:
    """The orders as files ``orders-*.<ext>`` in a fresh folder."""
    base = scratch_path(spark, f"orders-{fmt}")
    o = table(spark, sf, "orders").withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))
    writer = o.write.option("header", True) if fmt == "csv" else o.write
    writer.format(files.FORMATS[fmt]).save(f"{base}/{folder}")
    return base


@check("s1_read_csv", ORDERS_SQL)
def s1_csv(spark, sf):
    return files.read_files(spark, written_orders(spark, sf, "csv"), "part-.csv", "csv", ORDERS_SCHEMA)


@check("s1_read_csv_inferred", ORDERS_SQL)
def s1_inferred(spark, sf):
    df = files.read_files(spark, written_orders(spark, sf, "csv"), "part-.csv", "csv")
    return df.withColumns({"o_orderdate": F.date_format("o_orderdate", "yyyy-MM-dd"),
                           "o_orderkey": F.col("o_orderkey").cast("bigint"), "o_custkey": F.col("o_custkey").cast("bigint")})


@check("s1_read_jsonl", ORDERS_SQL)
def s1_jsonl(spark, sf):
    return files.read_files(spark, written_orders(spark, sf, "jsonl"), "part-.json", "jsonl", ORDERS_SCHEMA)


@check("s1_read_parquet", ORDERS_SQL)
def s1_parquet(spark, sf):
    return files.read_files(spark, written_orders(spark, sf, "parquet"), "part-.parquet", "parquet")


@check("s2_read_json_documents", "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey FROM customer")
def s2(spark, sf):
    # One document per nation: a JSON array over several lines of text.
    base = scratch_path(spark, "customers-json")
    row = F.to_json(F.struct("c_custkey", "c_name", "c_nationkey"))
    docs = (table(spark, sf, "customer").groupBy(F.floor(F.col("c_custkey") / 50).alias("block"))
            .agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list(row), ",\n"), F.lit("\n]")).alias("value")))
    # Each row becomes one file, as a JSON document must be alone in its file.
    docs.write.partitionBy("block").text(base)
    return files.read_files(spark, base, "part-.txt", "json", "c_custkey bigint, c_name string, c_nationkey bigint")


@check("s3_read_nested_skipping_corrupt", ORDERS_SQL)
def s3(spark, sf):
    base = written_orders(spark, sf, "parquet", "year/month")
    spark.createDataFrame([("no parquet",)], "value string").coalesce(1).write.text(f"{base}/broken")
    return files.read_files(spark, base, "part-", "parquet", ORDERS_SCHEMA, ignore_corrupt=True)


@check("s4_read_anonymous", ORDERS_SQL)
def s4(spark, sf):
    # The credentials setting only acts on s3a; a shared folder stands for the bucket.
    return files.read_files(spark, written_orders(spark, sf, "csv"), "part-.csv", "csv", ORDERS_SCHEMA, anonymous=True)


@check("s6_jdbc_projection", """
    WITH cols AS (
      SELECT 'tbl_' || (p_partkey // 20) AS table_name, 'col_' || p_partkey AS c, p_partkey AS pos,
             CASE p_partkey % 5 WHEN 0 THEN 'xml' WHEN 1 THEN 'DateTimeOffset' WHEN 2 THEN 'time' WHEN 3 THEN 'int' ELSE 'geography' END AS kind FROM part)
    SELECT table_name, string_agg(CASE lower(kind) WHEN 'datetimeoffset' THEN 'CAST([' || c || '] AS datetime2) AS [' || c || ']'
      WHEN 'time' THEN 'CONVERT(VARCHAR, [' || c || '], 108) AS [' || c || ']' WHEN 'int' THEN '[' || c || ']'
      ELSE 'CAST([' || c || '] AS NVARCHAR(MAX)) AS [' || c || ']' END, ', ' ORDER BY pos) AS select_list
    FROM cols GROUP BY 1""")
def s6(spark, sf):
    n = F.col("p_partkey")
    kinds = F.array(*[F.lit(k) for k in ("xml", "DateTimeOffset", "time", "int", "geography")])
    return databases.jdbc_projection(table(spark, sf, "part").select(
        F.concat(F.lit("tbl_"), F.floor(n / 20)).alias("table_name"), F.concat(F.lit("col_"), n).alias("column_name"),
        F.element_at(kinds, (n % 5 + 1).cast("int")).alias("data_type"), n.alias("position")))


EVENT_RECORD = "event_id bigint, user_id bigint, event_type string, value double"


def messages(spark, sf):
    """Ten events per message as a JSON array, one single-object message per user, and text that is no JSON."""
    e = table(spark, sf, "events")
    record = F.to_json(F.struct("event_id", "user_id", "event_type", "value"))
    n = F.floor(F.col("event_id") / 10)
    arrays = e.groupBy(n.alias("offset")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(record), ","), F.lit("]")).alias("value"))
    alone = e.filter("event_id % 100 = 0").select((F.col("event_id") + 1_000_000_000).alias("offset"), record.alias("value"))
    broken = e.filter("event_id % 100 = 1").select((F.col("event_id") + 2_000_000_000).alias("offset"), F.concat(F.lit("not json "), "event_id").alias("value"))
    return arrays.unionByName(alone).unionByName(broken).withColumns({
        "topic": F.lit("events"), "partition": (F.col("offset") % 4).cast("int"), "timestamp": F.lit("2024-01-01 00:00:00").cast("timestamp")})


MESSAGES_SQL = """
    SELECT event_id, user_id, event_type, value, event_id // 10 AS _kafka_offset, ((event_id // 10) % 4)::INTEGER AS _kafka_partition, 'events' AS _kafka_topic FROM events
    UNION ALL SELECT event_id, user_id, event_type, value, event_id + 1000000000, ((event_id + 1000000000) % 4)::INTEGER, 'events' FROM events WHERE event_id % 100 = 0"""


@check("s7_decode_messages", MESSAGES_SQL)
def s7(spark, sf):
    return payloads.decode_messages(messages(spark, sf), EVENT_RECORD).drop("_kafka_timestamp")


@check("s7_decode_messages_selector", """
    SELECT event_id, event_type, event_id // 10 AS _kafka_offset FROM events
    UNION ALL SELECT event_id, event_type, event_id + 1000000000 FROM events WHERE event_id % 100 = 0""")
def s7_selector(spark, sf):
    wrapped = messages(spark, sf).withColumn("value", F.concat(F.lit('{"data": '), "value", F.lit("}")))
    return payloads.decode_messages(wrapped, EVENT_RECORD, "data").select("event_id", "event_type", "_kafka_offset")


@check("s8_explode_payloads", "SELECT 'events' AS resource, event_id, user_id, event_type, value FROM events")
def s8(spark, sf):
    record = F.to_json(F.struct("event_id", "user_id", "event_type", "value"))
    pages = table(spark, sf, "events").groupBy(F.floor(F.col("event_id") / 100).alias("page")).agg(
        F.concat(F.lit('{"total": 9, "items": ['), F.array_join(F.collect_list(record), ","), F.lit("]}")).alias("payload"))
    # After every page comes an empty one.
    empty = pages.select("page", F.lit('{"total": 9, "items": []}').alias("payload"))
    both = pages.unionByName(empty).withColumn("resource", F.lit("events"))
    return payloads.explode_payloads(both, EVENT_RECORD, "items", keep=("resource",))


@check("s7_rejected_messages", """
    SELECT event_id + 2000000000 AS _kafka_offset, 'not json ' || event_id AS value, 'no JSON' AS reason FROM events WHERE event_id % 100 = 1""")
def s7_rejected(spark, sf):
    return payloads.rejected_messages(messages(spark, sf), EVENT_RECORD).select("_kafka_offset", "value", "reason")


BROKEN_PAGES = {1: "no JSON", 2: "nothing under items", 3: "no text", 4: "no records"}


def broken_pages(spark, sf):
    """Pages of events of which four in seven cannot be read, each for a reason of its own, and one in seven is empty."""
    record = F.to_json(F.struct("event_id", "user_id", "event_type", "value"))
    page = F.floor(F.col("event_id") / 25)
    pages = table(spark, sf, "events").groupBy(page.alias("page")).agg(F.array_join(F.collect_list(record), ",").alias("rows"))
    whole = F.concat(F.lit('{"items": ['), "rows", F.lit("]}"))
    kind = F.col("page") % 7
    payload = (F.when(kind == 1, F.concat(F.lit("<html>"), whole)).when(kind == 2, F.concat(F.lit('{"error": ['), "rows", F.lit("]}")))
               .when(kind == 3, F.lit(None)).when(kind == 4, '{"items": 7}').when(kind == 5, '{"items": []}').otherwise(whole))
    return pages.select("page", F.lit("events").alias("resource"), payload.alias("payload"))


@check("s8_rejected_payloads", f"""
    SELECT page, CASE page % 7 {" ".join(f"WHEN {k} THEN '{v}'" for k, v in BROKEN_PAGES.items())} END AS reason
    FROM (SELECT DISTINCT event_id // 25 AS page FROM events) WHERE page % 7 BETWEEN 1 AND 4""")
def s8_rejected(spark, sf):
    return payloads.rejected_payloads(broken_pages(spark, sf), EVENT_RECORD, "items", keep=("page",)).select("page", "reason")


@check("s8_page_report", """
    SELECT 'events' AS resource, count(*) AS pages, count_if(page % 7 IN (0, 6)) AS read, count_if(page % 7 = 5) AS empty,
           count_if(page % 7 BETWEEN 1 AND 4) AS rejected, sum(CASE WHEN page % 7 IN (0, 6) THEN n ELSE 0 END)::BIGINT AS records
    FROM (SELECT event_id // 25 AS page, count(*) AS n FROM events GROUP BY 1)""")
def s8_report(spark, sf):
    return payloads.page_report(broken_pages(spark, sf), EVENT_RECORD, "items", by=("resource",))


@check("s9_project_fields", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def s9(spark, sf):
    record = F.to_json(F.struct(F.concat(F.lit("rec"), "c_custkey").alias("id"), F.struct("c_custkey", "c_name", "c_mktsegment").alias("fields")))
    pages = table(spark, sf, "customer").groupBy(F.floor(F.col("c_custkey") / 100)).agg(
        F.concat(F.lit('{"records": ['), F.array_join(F.collect_list(record), ","), F.lit("]}")).alias("payload"))
    return payloads.project_fields(pages, "c_custkey bigint, c_name string, c_mktsegment string")


@check("s10_normalise_id", "SELECT doc_id::VARCHAR AS _id, lang FROM documents")
def s10(spark, sf):
    return payloads.normalise_id(table(spark, sf, "documents").select(F.col("doc_id").alias("_id"), "lang"))


@check("s11_preview", "SELECT page_id, url FROM pages ORDER BY page_id LIMIT 10")
def s11(spark, sf):
    return preview(table(spark, sf, "pages"), 10, [F.col("page_id")]).select("page_id", "url")


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations")
TYPE_SQL = """CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' WHEN 'FLOAT[]' THEN 'array<float>'
           WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(column_type) END"""


@check("s12_file_schemas", " UNION ALL ".join(
    f"""SELECT '{t}.parquet' AS file, column_name AS "column", {TYPE_SQL} AS type FROM (DESCRIBE {t})""" for t in TABLES))
def s12(spark, sf):
    found = files.file_schemas(spark, sf, "*.parquet")
    return found.select(F.element_at(F.split("file", "/"), -1).alias("file"), "column", "type")


@check("s13_table_inventory", " UNION ALL ".join(
    f"""SELECT 'main' AS schema_name, '{t}' AS table_name, column_name, {TYPE_SQL} AS data_type,
        (SELECT count(*) FROM (DESCRIBE {t}))::INTEGER AS column_count, (SELECT count(*) FROM {t}) AS row_count FROM (DESCRIBE {t})"""
    for t in TABLES))
def s13(spark, sf):
    tables = {f"main.{t}": table(spark, sf, t) for t in TABLES}
    hidden = {"main._dlt_loads": tables["main.orders"], "main_staging.orders": tables["main.orders"]}
    return files.table_inventory(tables | hidden)


@check("s1_read_partitioned", """
    SELECT event_id, user_id, value, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE ts::DATE >= DATE '2024-01-10'""")
def s1_partitioned(spark, sf):
    base = scratch_path(spark, "events-by-day")
    e = table(spark, sf, "events").select("event_id", "user_id", "value", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    e.repartition("day").write.partitionBy("day").parquet(base)
    read = files.read_files(spark, base, "part-.parquet", "parquet", "event_id bigint, user_id bigint, value double, day string", partitioned=True)
    return read.filter("day >= '2024-01-10'")


@check("s14_counted_load", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000")
def s14(spark, sf):
    rows_in, _ = with_counts(table(spark, sf, "orders"), f"in-{uuid.uuid4()}")
    rows_out, _ = with_counts(rows_in.filter("o_totalprice > 100000"), f"out-{uuid.uuid4()}")
    return rows_out.select("o_orderkey", "o_totalprice")


@check("s14_recipe_counts", """
    WITH a AS (SELECT * FROM orders), b AS (SELECT * FROM a WHERE o_totalprice > 50000), c AS (SELECT DISTINCT o_custkey, o_orderpriority FROM b),
    d AS (SELECT * FROM c WHERE o_orderpriority <> '5-LOW'),
    n AS (SELECT (SELECT count(*) FROM a) AS a, (SELECT count(*) FROM b) AS b, (SELECT count(*) FROM c) AS c, (SELECT count(*) FROM d) AS d)
    SELECT 1 AS pos, 'filter' AS step, a AS rows_in, b AS rows_out, b - a AS rows_changed FROM n UNION ALL SELECT 2, 'dedup', b, c, c - b FROM n
    UNION ALL SELECT 3, 'filter', c, d, d - c FROM n UNION ALL SELECT 4, 'recipe', a, d, d - a FROM n""")
def s14_recipe(spark, sf):
    """Counts of a recipe of three row steps and one column step, taken while its result is written."""
    steps = [Filter("o_totalprice > 50000"), Casing("o_orderstatus", "lower"), Dedup(("o_custkey", "o_orderpriority")), Filter("o_orderpriority <> '5-LOW'")]
    out, counts = apply_counted(table(spark, sf, "orders"), steps)
    out.write.parquet(scratch_path(spark, "counted-recipe"))
    rows = [(i + 1, *r.values()) for i, r in enumerate(counts.report())]
    return spark.createDataFrame(rows, "pos int, step string, rows_in bigint, rows_out bigint, rows_changed bigint")


@check("s14_load_report", """
    SELECT count(*) AS rows_in, count_if(o_totalprice > 100000) AS rows_out, count_if(o_totalprice > 100000) - count(*) AS rows_changed
    FROM orders""")
def s14_report(spark, sf):
    rows_in, seen_in = with_counts(table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("price")), f"in-{uuid.uuid4()}")
    rows_out, seen_out = with_counts(rows_in.filter("price > 100000"), f"out-{uuid.uuid4()}")
    rows_out.write.parquet(scratch_path(spark, "counted-orders"))
    report = load_delta(seen_in, seen_out)
    return spark.createDataFrame([tuple(report.values())], ", ".join(f"{name} bigint" for name in report))
