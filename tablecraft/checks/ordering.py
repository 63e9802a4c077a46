"""Queries of sorting, ranges and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablecraft.checks.registry import TS_SQL, check, table, ts_text
from tablecraft.operators import ordering as od


@check("o1_sort_sheet", """
    SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1000""")
def o1(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return od.sort_sheet(o, "o_totalprice", desc=True, ties=["o_orderkey"])


@check("o1_sort_as_text", """
    SELECT p_partkey, p_name FROM part ORDER BY trim(p_partkey::VARCHAR) LIMIT 1000""")
def o1_text(spark, sf):
    return od.sort_sheet(table(spark, sf, "part").select("p_partkey", "p_name"), "p_partkey", as_text=True)


@check("o2_head", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 100")
def o2(spark, sf):
    return od.head(table(spark, sf, "orders"), 100, [F.col("o_orderkey")]).select("o_orderkey", "o_orderstatus")


@check("o4_summary_and_list", """
    SELECT 'ALL' AS brand, count(*) AS n FROM part UNION ALL SELECT p_brand, count(*) FROM part GROUP BY 1""")
def o4(spark, sf):
    p = table(spark, sf, "part")
    listing = p.groupBy(F.col("p_brand").alias("brand")).agg(F.count("*").alias("n"))
    return od.summary_and_list(p.agg(F.count("*").alias("n")).withColumn("brand", F.lit("ALL")), listing, [F.col("n").desc(), F.col("brand")])


@check("o6_range_slice", """
    SELECT event_id, user_id FROM events WHERE ts::DATE BETWEEN DATE '2024-01-10' AND DATE '2024-01-12'""")
def o6(spark, sf):
    return od.range_slice(table(spark, sf, "events"), "ts", "2024-01-10", "2024-01-12", ["event_id", "user_id"])


@check("o6_no_range", "SELECT event_id FROM events")
def o6_all(spark, sf):
    return od.range_slice(table(spark, sf, "events"), None, fields=["event_id"])


@check("o7_range_profile", f"""
    SELECT count(*) AS row_count, {TS_SQL.format("min(ts)")} AS min_ts, {TS_SQL.format("max(ts)")} AS max_ts FROM events""")
def o7(spark, sf):
    p = od.range_profile(table(spark, sf, "events"))
    return p.select("row_count", ts_text("min_ts").alias("min_ts"), ts_text("max_ts").alias("max_ts"))
