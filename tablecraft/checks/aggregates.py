"""Queries of the aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablecraft.checks.registry import check, rounded, table
from tablecraft.functions.aggs import Agg, count_where, latest_value, ordered_list
from tablecraft.operators import aggregation as ag


@check("a1_aggregate_back", """
    WITH f AS (SELECT l_returnflag AS k, sum(l_quantity) AS qty, avg(l_extendedprice) AS price FROM lineitem GROUP BY 1),
         s AS (SELECT l_suppkey AS k, count(*) AS lines, max(l_discount) AS disc FROM lineitem GROUP BY 1)
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, round(f.qty, 2) AS flag_qty,
           round(f.price, 4) AS flag_price, s.lines AS supp_lines, s.disc AS supp_disc
    FROM lineitem LEFT JOIN f ON l_returnflag = f.k LEFT JOIN s ON l_suppkey = s.k""")
def a1(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag",
                                             "l_quantity", "l_extendedprice", "l_discount")
    out = ag.aggregate_back(li, [
        ("l_returnflag", [Agg("sum", "l_quantity", "flag_qty"), Agg("mean", "l_extendedprice", "flag_price")]),
        ("l_suppkey", [Agg("len", "l_quantity", "supp_lines"), Agg("max", "l_discount", "supp_disc")])])
    return rounded(out.drop("l_quantity", "l_extendedprice", "l_discount"), flag_qty=2)


@check("a1_aggregate_back_null_key", """
    WITH o AS (SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS prio, o_totalprice FROM orders),
         g AS (SELECT prio, max(o_totalprice) AS top FROM o GROUP BY 1)
    SELECT o.o_orderkey, o.prio, g.top FROM o LEFT JOIN g ON o.prio = g.prio""")
def a1_null(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("prio"), "o_totalprice")
    return ag.aggregate_back(o, [("prio", [Agg("max", "o_totalprice", "top")])]).drop("o_totalprice")


@check("a2_aggregate_by", """
    SELECT nullif(l_returnflag, 'R') AS flag, sum(l_quantity) AS qty, count(*) AS n FROM lineitem GROUP BY 1""")
def a2(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("flag", F.nullif("l_returnflag", F.lit("R")))
    return ag.aggregate_by(li, "flag", [("sum", "l_quantity", "qty"), ("len", "l_quantity", "n")])


@check("a3_sum_mean_median_min_max", """
    SELECT l_returnflag, sum(l_quantity) AS s, round(avg(l_extendedprice), 4) AS m,
           round(median(l_extendedprice), 4) AS med, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi
    FROM lineitem GROUP BY 1""")
def a3(spark, sf):
    return rounded(ag.aggregate_by(table(spark, sf, "lineitem"), "l_returnflag", [
        ("sum", "l_quantity", "s"), ("mean", "l_extendedprice", "m"), ("median", "l_extendedprice", "med"),
        ("min", "l_extendedprice", "lo"), ("max", "l_extendedprice", "hi")]))


@check("a4_std_var", """
    SELECT l_linestatus, round(stddev_samp(l_quantity), 4) AS sd, round(var_samp(l_quantity), 4) AS vr
    FROM lineitem GROUP BY 1""")
def a4(spark, sf):
    return rounded(ag.aggregate_by(table(spark, sf, "lineitem"), "l_linestatus",
                                   [("std", "l_quantity", "sd"), ("var", "l_quantity", "vr")]))


@check("a5_quantile", """
    SELECT nullif(o_orderpriority, '5-LOW') AS prio, round(quantile_cont(o_totalprice, 0.9), 4) AS p90,
           round(quantile_cont(o_totalprice, 0.25), 4) AS p25, round(quantile_cont(o_custkey, 0.5), 4) AS mid_cust
    FROM orders GROUP BY 1""")
def a5(spark, sf):
    o = table(spark, sf, "orders").withColumn("prio", F.nullif("o_orderpriority", F.lit("5-LOW")))
    return rounded(ag.aggregate_by(o, "prio", [
        Agg("quantile", "o_totalprice", "p90", q=0.9), Agg("quantile", "o_totalprice", "p25", q=0.25),
        Agg("quantile", "o_custkey", "mid_cust")]))


@check("a5_quantile_per_customer", """
    SELECT o_custkey, round(quantile_cont(o_totalprice, 0.5), 4) AS med, round(quantile_cont(o_totalprice, 0.3), 4) AS p30
    FROM orders GROUP BY 1""")
def a5_many(spark, sf):
    return rounded(ag.aggregate_by(table(spark, sf, "orders"), "o_custkey", [
        Agg("median", "o_totalprice", "med"), Agg("quantile", "o_totalprice", "p30", q=0.3)]))


@check("a6_len_count", """
    SELECT o_custkey, count(*) AS n_rows, count(nullif(o_orderstatus, 'O')) AS n_closed FROM orders GROUP BY 1""")
def a6(spark, sf):
    o = table(spark, sf, "orders").withColumn("closed", F.nullif("o_orderstatus", F.lit("O")))
    return ag.aggregate_by(o, "o_custkey", [("len", "closed", "n_rows"), ("count", "closed", "n_closed")])


@check("a7_n_unique", """
    SELECT l_returnflag, count(DISTINCT s) + max((s IS NULL)::BIGINT) AS n_parts
    FROM (SELECT l_returnflag, CASE WHEN l_partkey % 7 <> 0 THEN l_partkey END AS s FROM lineitem) GROUP BY 1""")
def a7(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("s", F.when(F.col("l_partkey") % 7 != 0, F.col("l_partkey")))
    return ag.aggregate_by(li, "l_returnflag", [("n_unique", "s", "n_parts")])


@check("a8_approx_n_unique", """
    SELECT l_returnflag, count(DISTINCT l_partkey) AS n_parts, true AS within_tenth FROM lineitem GROUP BY 1""")
def a8_approx(spark, sf):
    both = ag.aggregate_by(table(spark, sf, "lineitem"), "l_returnflag", [
        ("approx_n_unique", "l_partkey", "approx"), ("n_unique", "l_partkey", "n_parts")])
    return both.select("l_returnflag", "n_parts", (F.abs(F.col("approx") - F.col("n_parts")) < 0.1 * F.col("n_parts")).alias("within_tenth"))


@check("a8_any_all_first_last", """
    SELECT o_custkey, bool_or(o_totalprice > 450000) AS any_big, bool_and(o_totalprice > 50000) AS all_mid,
           arg_min(o_totalprice, o_orderkey) AS first_price, arg_max(o_totalprice, o_orderkey) AS last_price
    FROM orders GROUP BY 1""")
def a8_flags(spark, sf):
    o = table(spark, sf, "orders").withColumns({"big": F.col("o_totalprice") > 450000, "mid": F.col("o_totalprice") > 50000})
    return ag.aggregate_by(o, "o_custkey", [
        Agg("any", "big", "any_big"), Agg("all", "mid", "all_mid"),
        Agg("first", "o_totalprice", "first_price", order_by="o_orderkey"),
        Agg("last", "o_totalprice", "last_price", order_by="o_orderkey")])


@check("a8_skew_kurtosis_corr_cov", """
    WITH m AS (SELECT p_brand AS b, avg(p_retailprice) AS mu FROM part GROUP BY 1)
    SELECT p_brand,
           round(avg(power(p_retailprice - mu, 3)) / power(avg(power(p_retailprice - mu, 2)), 1.5), 4) AS sk,
           round(avg(power(p_retailprice - mu, 4)) / power(avg(power(p_retailprice - mu, 2)), 2) - 3, 4) AS ku,
           round(corr(p_retailprice, p_size), 4) AS co, round(covar_samp(p_retailprice, p_size), 4) AS cv
    FROM part JOIN m ON p_brand = b GROUP BY 1""")
def a8_moments(spark, sf):
    return rounded(ag.aggregate_by(table(spark, sf, "part"), "p_brand", [
        Agg("skew", "p_retailprice", "sk"), Agg("kurtosis", "p_retailprice", "ku"),
        Agg("corr", "p_retailprice", "co", other="p_size"), Agg("cov", "p_retailprice", "cv", other="p_size")]))


@check("a8_implode", """
    SELECT l_orderkey, array_to_string(list(l_partkey ORDER BY l_partkey), ',') AS parts FROM lineitem GROUP BY 1""")
def a8_implode(spark, sf):
    lists = ag.aggregate_by(table(spark, sf, "lineitem"), "l_orderkey", [("implode", "l_partkey", "parts")])
    return lists.select("l_orderkey", F.array_join(F.col("parts").cast("array<string>"), ",").alias("parts"))


CHART = """SELECT coalesce(nullif(o_orderpriority, '5-LOW'), 'null') AS label, {} AS value FROM orders GROUP BY 1"""


def chart(agg):
    def query(spark, sf):
        o = table(spark, sf, "orders").select(F.nullif("o_orderpriority", F.lit("5-LOW")).alias("x"), F.when(
            F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("y"))
        return rounded(ag.chart_series(o, "x", "y", agg), 2)
    return query


for kind, sql in {
    "count": "count(*)::DOUBLE", "sum": "round(sum(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice ELSE 0 END), 2)",
    "avg": "round(avg(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice ELSE 0 END), 2)",
    "max": "max(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice ELSE 0 END)",
    "min": "min(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice ELSE 0 END)",
}.items():
    check(f"a9_chart_{kind}", CHART.format(sql))(chart(kind))


@check("a9_chart_text_values", """
    SELECT o_orderstatus AS label, sum(coalesce(TRY_CAST(nullif(left(o_orderpriority, 1), '3') AS DOUBLE), 0)) AS value
    FROM orders GROUP BY 1""")
def a9_text(spark, sf):
    o = table(spark, sf, "orders").withColumn("y", F.when(F.col("o_orderpriority").startswith("3"), "n/a")
                                              .otherwise(F.left("o_orderpriority", F.lit(1))))
    return ag.chart_series(o, "o_orderstatus", "y", "sum")


@check("a10_chart_rows", """
    SELECT o_orderstatus AS label, o_totalprice AS value FROM orders ORDER BY o_orderkey LIMIT 50""")
def a10(spark, sf):
    return ag.chart_series(table(spark, sf, "orders"), "o_orderstatus", "o_totalprice", "none", [F.col("o_orderkey")])


@check("a11_distinct_values", "SELECT DISTINCT p_type FROM part")
def a11(spark, sf):
    return ag.distinct_values(table(spark, sf, "part"), "p_type")


@check("a12_conditional_counts", """
    SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS closed, count_if(o_totalprice > 200000) AS big,
           sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END)::DECIMAL(18,2)::DOUBLE AS open_value
    FROM orders GROUP BY 1""")
def a12(spark, sf):
    return rounded(table(spark, sf, "orders").groupBy("o_custkey").agg(
        count_where(F.col("o_orderstatus") == "F").alias("closed"), count_where(F.col("o_totalprice") > 200000).alias("big"),
        F.sum(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice")).otherwise(0)).alias("open_value")), 2)


@check("a13_latest_value", """
    SELECT user_id, arg_max(v, ts) AS latest FROM (
      SELECT user_id, ts, CASE WHEN event_type <> 'error' THEN event_type END AS v FROM events) GROUP BY 1""")
def a13(spark, sf):
    e = table(spark, sf, "events").withColumn("v", F.when(F.col("event_type") != "error", F.col("event_type")))
    return e.groupBy("user_id").agg(latest_value(F.col("v"), F.col("ts")).alias("latest"))


@check("a14_any_flag_and_ordered_list", """
    SELECT l_orderkey, count(*) > 0 AS seen, bool_or(l_returnflag = 'R') AS returned,
           array_to_string(list(l_suppkey ORDER BY l_shipdate, l_suppkey), ' ') AS suppliers
    FROM lineitem GROUP BY 1""")
def a14(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.any_value("l_orderkey").isNotNull().alias("seen"), F.bool_or(F.col("l_returnflag") == "R").alias("returned"),
        F.array_join(ordered_list(F.col("l_suppkey").cast("string"), F.struct("l_shipdate", "l_suppkey")), " ").alias("suppliers"))
