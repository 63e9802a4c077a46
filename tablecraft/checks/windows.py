"""Queries of the window operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablecraft.checks.registry import check, rounded, table
from tablecraft.operators import windows as wn


@check("w1_step_lag", """
    SELECT event_id, user_id, round(epoch_us(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6, 6) AS step_seconds
    FROM events""")
def w1(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return rounded(wn.step_lag(e, "ts", ["user_id"], ["event_id"]).select("event_id", "user_id", "step_seconds"), 6)


@check("w2_latest_by", """
    SELECT o_custkey, o_orderkey, o_orderstatus FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def w2(spark, sf):
    return wn.latest_by(table(spark, sf, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey").select(
        "o_custkey", "o_orderkey", "o_orderstatus")


PAGE_SQL = """
    SELECT o_orderkey, o_custkey, rn FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders)
    WHERE rn > 1200 AND rn <= 1500"""


@check("w3_page_rows", PAGE_SQL)
def w3(spark, sf):
    page = wn.page_rows(table(spark, sf, "orders"), ["o_orderkey"], 1200, 300)
    return page.select("o_orderkey", "o_custkey", F.col("rn").cast("bigint").alias("rn"))


@check("w3_page_rows_deep", PAGE_SQL)
def w3_deep(spark, sf):
    page = wn.page_rows(table(spark, sf, "orders"), ["o_orderkey"], 1200, 300, shallow=1000)
    return page.select("o_orderkey", "o_custkey", F.col("rn").cast("bigint").alias("rn"))


@check("w3_page_rows_two_keys", """
    SELECT c_custkey, c_nationkey, rn FROM (SELECT *, row_number() OVER (ORDER BY c_nationkey, c_custkey) AS rn FROM customer)
    WHERE rn > 70 AND rn <= 90""")
def w3_two(spark, sf):
    page = wn.page_rows(table(spark, sf, "customer"), ["c_nationkey", "c_custkey"], 70, 20, shallow=10)
    return page.select("c_custkey", "c_nationkey", F.col("rn").cast("bigint").alias("rn"))


@check("w4_any_in_group", """
    SELECT event_id, bool_or(event_type = 'purchase' AND value > 50) OVER (PARTITION BY nullif(user_id, 7)) AS bought FROM events""")
def w4(spark, sf):
    e = table(spark, sf, "events").withColumn("user_id", F.nullif("user_id", F.lit(7)))
    cond = (F.col("event_type") == "purchase") & (F.col("value") > 50)
    return wn.any_in_group(e, cond, ["user_id"], "bought").select("event_id", "bought")


@check("w5_first_per", """
    SELECT p_brand, p_partkey, p_retailprice FROM part
    QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) = 1""")
def w5(spark, sf):
    return wn.first_per(table(spark, sf, "part"), ["p_brand"], [F.col("p_retailprice"), F.col("p_partkey")]).select(
        "p_brand", "p_partkey", "p_retailprice")


@check("w6_min_max_scale", """
    SELECT p_partkey, round((p_retailprice - min(p_retailprice) OVER w) / nullif(max(p_retailprice) OVER w - min(p_retailprice) OVER w, 0), 6) AS scaled
    FROM part WINDOW w AS (PARTITION BY p_brand)""")
def w6(spark, sf):
    return rounded(wn.min_max_scale(table(spark, sf, "part"), "p_retailprice", ["p_brand"]).select("p_partkey", "scaled"), 6)
