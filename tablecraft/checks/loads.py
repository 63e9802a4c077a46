"""Queries of loads and exports. Targets live in the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablecraft.checks.fixtures import TPCH_KEYS
from tablecraft.checks.registry import check, table
from tablecraft.operators.joins import missing_columns
from tablecraft.session import scratch_path
from tablecraft.sinks import export, loads
from tablecraft.sources import files

NEW = "(o_orderstatus = 'F' OR o_orderpriority = '1-URGENT')"
OLD = "o_orderstatus <> 'F'"
MERGED_SQL = f"""
    SELECT o_orderkey, CASE WHEN {NEW} THEN 'NEW' ELSE o_orderstatus END AS o_orderstatus,
           CASE WHEN {NEW} THEN o_custkey END AS extra, CASE WHEN {NEW} THEN '2' ELSE '1' END AS _load_id FROM orders"""


def batches(spark, sf):
    """Two overlapping batches that make up all orders; the second has one more column."""
    o = table(spark, sf, "orders")
    old = o.filter(OLD).select("o_orderkey", "o_orderstatus")
    new = o.filter(NEW).select("o_orderkey", F.lit("NEW").alias("o_orderstatus"), F.col("o_custkey").alias("extra"))
    return old, new


@check("k1_merge_load", MERGED_SQL)
def k1(spark, sf):
    target, (old, new) = scratch_path(spark, "merge"), batches(spark, sf)
    loads.merge_load(spark, target, old, ["o_orderkey"], "1")
    return loads.merge_load(spark, target, new, ["o_orderkey"], "2")


@check("k1_small_batch", """
    SELECT o_orderkey, CASE WHEN o_custkey = 1 THEN -o_totalprice ELSE o_totalprice END AS o_totalprice,
           CASE WHEN o_custkey = 1 THEN '2' ELSE '1' END AS _load_id FROM orders""")
def k1_small(spark, sf):
    """The orders of one customer change in a table of many files."""
    target, o = scratch_path(spark, "small-batch"), table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    loads.merge_load(spark, target, o.drop("o_custkey"), ["o_orderkey"], "1", file_bytes=1 << 20)
    changed = o.filter("o_custkey = 1").select("o_orderkey", (-F.col("o_totalprice")).alias("o_totalprice"))
    return loads.merge_load(spark, target, changed, ["o_orderkey"], "2", file_bytes=1 << 20)


REPORT_SQL = f"""
    WITH o AS (SELECT *, {NEW} AS new, {OLD} AS old FROM orders)
    SELECT count_if(new) AS rows_in, count(DISTINCT CASE WHEN new THEN o_custkey END) AS rows_out,
           count(DISTINCT CASE WHEN new THEN o_custkey END) - count_if(new) AS rows_changed,
           (SELECT count(*) FROM (SELECT o_custkey FROM o WHERE old INTERSECT SELECT o_custkey FROM o WHERE new)) AS rows_replaced FROM o"""


@check("k1_load_report", REPORT_SQL)
def k1_report(spark, sf):
    target, o = scratch_path(spark, "report"), table(spark, sf, "orders")
    for load_id, part in (("1", OLD), ("2", NEW)):
        loads.merge_load(spark, target, o.filter(part).select("o_custkey", "o_orderkey"), ["o_custkey"], load_id)
    report = loads.load_report(spark, target)
    return spark.createDataFrame([(report.rows_in, report.rows_out, report.rows_changed, report.rows_replaced)],
                                 "rows_in bigint, rows_out bigint, rows_changed bigint, rows_replaced bigint")


@check("k1_merge_load_duplicate_keys", """
    SELECT o_custkey, max(o_orderkey) AS o_orderkey, '1' AS _load_id FROM orders GROUP BY 1""")
def k1_duplicates(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    return loads.merge_load(spark, scratch_path(spark, "merge"), o, ["o_custkey"], "1", [F.col("o_orderkey").desc()])


@check("k1_append_without_key", f"""
    SELECT o_orderkey, '1' AS _load_id FROM orders WHERE {OLD} UNION ALL SELECT o_orderkey, '2' FROM orders WHERE {NEW}""")
def k1_append(spark, sf):
    target, (old, new) = scratch_path(spark, "append"), batches(spark, sf)
    loads.merge_load(spark, target, old.select("o_orderkey"), None, "1")
    return loads.merge_load(spark, target, new.select("o_orderkey"), None, "2")


@check("k2_replace_load", f"SELECT o_orderkey, 'NEW' AS o_orderstatus, o_custkey AS extra, '2' AS _load_id FROM orders WHERE {NEW}")
def k2(spark, sf):
    target, (old, new) = scratch_path(spark, "replace"), batches(spark, sf)
    loads.replace_load(spark, target, old, "1")
    return loads.replace_load(spark, target, new, "2")


@check("k3_stamp_load", "SELECT c_custkey, 'load-7' AS _load_id FROM customer")
def k3(spark, sf):
    return loads.stamp_load(table(spark, sf, "customer").select("c_custkey"), "load-7")


@check("k4_evolve", f"""
    SELECT o_orderkey, o_orderstatus, NULL::BIGINT AS extra FROM orders WHERE {OLD}
    UNION ALL SELECT o_orderkey, 'NEW', o_custkey FROM orders WHERE {NEW}""")
def k4(spark, sf):
    return loads.evolve(*batches(spark, sf))


@check("k4_new_column_names", """
    SELECT 'col_' || p_partkey AS column_name FROM part WHERE p_size > 25""")
def k4_names(spark, sf):
    cols = table(spark, sf, "part").select(F.concat(F.lit("col_"), "p_partkey").alias("column_name"), "p_size")
    return missing_columns(cols.select("column_name"), cols.filter("p_size <= 25").select("column_name"))


def stamped(spark, sf):
    """Customers and orders with load ids; the largest orders and the richest customers are new."""
    c = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 9500, "2").otherwise("1").alias("_load_id"))
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_totalprice") > 450000, "2").otherwise("1").alias("_load_id"))
    return {"customer": c, "orders": o}


REFRESH_SQL = """
    SELECT c_custkey AS customer_c_custkey, o_orderkey AS orders_o_orderkey, o_custkey AS orders_o_custkey
    FROM customer FULL OUTER JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 9500 OR o_totalprice > 450000"""


@check("k5_refresh_wide", REFRESH_SQL)
def k5(spark, sf):
    return loads.refresh_wide(stamped(spark, sf), TPCH_KEYS, ["2", "3"])


@check("k6_wide_load", f"""
    SELECT *, '1' AS _load_id FROM (
      SELECT c_custkey AS customer_c_custkey, o_orderkey AS orders_o_orderkey, o_custkey AS orders_o_custkey
      FROM (SELECT * FROM customer WHERE c_acctbal <= 9500) FULL OUTER JOIN (SELECT * FROM orders WHERE o_totalprice <= 450000) ON o_custkey = c_custkey)
    UNION ALL SELECT *, '2' FROM ({REFRESH_SQL})""")
def k6(spark, sf):
    target, tables = scratch_path(spark, "wide"), stamped(spark, sf)
    first = {n: t.filter("_load_id = '1'") for n, t in tables.items()}
    loads.wide_load(spark, target, first, TPCH_KEYS, ["1"])
    return loads.wide_load(spark, target, tables, TPCH_KEYS, ["2"])


@check("k8_write_store", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def k8(spark, sf):
    return spark.read.parquet(loads.write_store(table(spark, sf, "supplier"), scratch_path(spark, "store"), "main.supplier"))


@check("k9_export_csv", """
    SELECT doc_id, text, nullif(source, 'src1') AS source FROM documents""")
def k9(spark, sf):
    path = scratch_path(spark, "csv")
    export.export_csv(table(spark, sf, "documents").select("doc_id", "text", F.nullif("source", F.lit("src1")).alias("source")), path)
    return files.read_files(spark, path, "part-.csv", "csv", "doc_id bigint, text string, source string", multiLine=True, escape='"')


def nested(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.collect_list(F.struct("l_partkey", F.struct("l_suppkey", "l_linenumber").alias("at"))).alias("lines"),
        F.collect_set("l_returnflag").alias("flags"))
    o = table(spark, sf, "orders")
    return o.join(lines, o["o_orderkey"] == lines["l_orderkey"], "left").select(
        "o_orderkey", F.struct(F.col("o_custkey").alias("key"), F.struct(F.col("o_orderstatus").alias("code")).alias("status")).alias("customer"),
        "lines", "flags")


@check("k10_nested_parent", "SELECT o_orderkey, o_custkey AS customer__key, o_orderstatus AS customer__status__code FROM orders")
def k10_parent(spark, sf):
    return export.normalise_nested(nested(spark, sf), "orders", ["o_orderkey"])["orders"]


@check("k10_nested_child", """
    SELECT l_orderkey AS o_orderkey, l_partkey, l_suppkey AS at__l_suppkey, l_linenumber AS at__l_linenumber FROM lineitem""")
def k10_child(spark, sf):
    tables = export.normalise_nested(nested(spark, sf), "orders", ["o_orderkey"])
    return tables["orders__lines"].drop("lines_pos")


@check("k10_nested_values", "SELECT DISTINCT l_orderkey AS o_orderkey, l_returnflag AS value FROM lineitem")
def k10_values(spark, sf):
    return export.normalise_nested(nested(spark, sf), "orders", ["o_orderkey"])["orders__flags"].drop("flags_pos")
