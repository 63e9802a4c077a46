"""Queries of the pivot."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablecraft.checks.registry import check, rounded, table
from tablecraft.operators import pivots as pv
from tablecraft.session import scratch_path

# nation > segment by order status, value o_totalprice; one segment is NULL, one status has no number.
CELLS_SQL = """
    cells AS (
      SELECT coalesce(n_name, 'N/A') AS n_name, coalesce(nullif(c_mktsegment, 'MACHINERY'), 'N/A') AS seg, o_orderstatus AS col_key,
             CASE WHEN o_orderpriority = '5-LOW' THEN 0 ELSE o_totalprice END AS price, o_orderkey
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey{where})"""
LONG_SQL = """
    long AS (
      SELECT (2 - GROUPING(n_name) - GROUPING(seg))::INTEGER AS level, n_name, seg,
             CASE WHEN GROUPING(col_key) = 1 THEN 'TOTAL' ELSE col_key END AS col_key,
             round(sum(price), 2) AS sum, count(*) AS count, max(price) AS max
      FROM cells GROUP BY GROUPING SETS ((n_name, seg, col_key), (n_name, seg), (n_name, col_key), (n_name), (col_key), ()))"""
WITH = "WITH " + CELLS_SQL.format(where="") + ", " + LONG_SQL
ROWS = ["n_name", "seg"]


def facts(spark, sf):
    o, c, n = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    joined = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    return joined.select(
        "n_name", F.nullif("c_mktsegment", F.lit("MACHINERY")).alias("seg"), "o_orderstatus", "o_orderkey",
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice")).alias("price"))


def long(spark, sf):
    return rounded(pv.pivot_long(facts(spark, sf), ROWS, ["o_orderstatus"], ["price"]), 2)


@check("p1_pivot_long", f"{WITH} SELECT *, 'price' AS field FROM long")
def p1(spark, sf):
    return long(spark, sf)


@check("p1_pivot_two_columns_two_fields", """
    WITH c AS (SELECT l_returnflag AS f, l_linestatus || ' | ' || (l_linenumber % 3) AS k, l_quantity AS q, l_discount AS d FROM lineitem),
         g AS (SELECT (1 - GROUPING(f))::INTEGER AS level, f AS l_returnflag, CASE WHEN GROUPING(k) = 1 THEN 'TOTAL' ELSE k END AS col_key,
                      sum(q) AS sq, max(q) AS mq, sum(d) AS sd, max(d) AS md, count(*) AS n
               FROM c GROUP BY GROUPING SETS ((f, k), (f), (k), ()))
    SELECT level, l_returnflag, col_key, 'l_quantity' AS field, round(sq, 2) AS sum, n AS count, mq AS max FROM g
    UNION ALL SELECT level, l_returnflag, col_key, 'l_discount', round(sd, 2), n, md FROM g""")
def p1_two(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("third", F.col("l_linenumber") % 3)
    return rounded(pv.pivot_long(li, ["l_returnflag"], ["l_linestatus", "third"], ["l_quantity", "l_discount"]), 2)


@check("p1_pivot_without_columns", """
    SELECT (1 - GROUPING(p_brand))::INTEGER AS level, p_brand, CASE WHEN GROUPING(k) = 1 THEN 'TOTAL' ELSE k END AS col_key,
           'p_size' AS field, sum(p_size)::DOUBLE AS sum, count(*) AS count, max(p_size)::DOUBLE AS max
    FROM (SELECT *, 'Value' AS k FROM part) GROUP BY GROUPING SETS ((p_brand, k), (p_brand), (k), ())""")
def p1_flat(spark, sf):
    return pv.pivot_long(table(spark, sf, "part"), ["p_brand"], [], ["p_size"])


@check("p2_pivot_measures", f"""{WITH}
    SELECT level, n_name, seg, col_key, sum AS m_sum, round(sum / count, 4) AS m_avg, count::DOUBLE AS m_count, max AS m_max FROM long""")
def p2(spark, sf):
    modes = {f"m_{m}": pv.pivot_measure(m) for m in ("sum", "avg", "count", "max")}
    return rounded(long(spark, sf).select("level", *ROWS, "col_key", *[c.alias(n) for n, c in modes.items()]))


@check("p3_pivot_wide", f"""{WITH}
    SELECT level, n_name, seg, coalesce(max(sum) FILTER (col_key = 'F'), 0) AS F, coalesce(max(sum) FILTER (col_key = 'O'), 0) AS O,
           coalesce(max(sum) FILTER (col_key = 'P'), 0) AS P, max(sum) FILTER (col_key = 'TOTAL') AS TOTAL
    FROM long GROUP BY 1, 2, 3""")
def p3(spark, sf):
    return pv.pivot_wide(long(spark, sf), ROWS, "sum")


@check("p4_pivot_row_detail", """
    SELECT (2 - GROUPING(o_orderstatus) - GROUPING(o_orderkey))::INTEGER AS level, o_orderstatus, o_orderkey::VARCHAR AS o_orderkey,
           CASE WHEN GROUPING(o_orderpriority) = 1 THEN 'TOTAL' ELSE o_orderpriority END AS col_key, 'o_totalprice' AS field,
           round(sum(o_totalprice), 2) AS sum, count(*) AS count, max(o_totalprice) AS max
    FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderkey, o_orderpriority), (o_orderstatus, o_orderkey),
         (o_orderstatus, o_orderpriority), (o_orderstatus), (o_orderpriority), ())""")
def p4(spark, sf):
    return rounded(pv.pivot_long(table(spark, sf, "orders"), ["o_orderstatus", "o_orderkey"], ["o_orderpriority"], ["o_totalprice"]), 2)


@check("p5_global_filter", f"""
    WITH {CELLS_SQL.format(where=" WHERE o_orderstatus IN ('F', 'P')")}, {LONG_SQL} SELECT *, 'price' AS field FROM long""")
def p5(spark, sf):
    kept = pv.filter_in(facts(spark, sf), {"o_orderstatus": ["F", "P"], "seg": [], "absent": ["x"]})
    return rounded(pv.pivot_long(kept, ROWS, ["o_orderstatus"], ["price"]), 2)


@check("p6_field_filter_by_values", """
    SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AND o_orderstatus = 'O'""")
def p6(spark, sf):
    wanted = table(spark, sf, "customer").filter("c_acctbal < 0").select("c_custkey")
    return pv.filter_in(table(spark, sf, "orders"), {"o_custkey": wanted, "o_orderstatus": ["O"]}).select("o_orderkey", "o_custkey")


@check("p7_pivot_search", f"""
    WITH {CELLS_SQL.format(where=" WHERE contains(lower(n_name), 'auto') OR contains(lower(coalesce(nullif(c_mktsegment, 'MACHINERY'), '')), 'auto')")},
         {LONG_SQL} SELECT *, 'price' AS field FROM long""")
def p7(spark, sf):
    return rounded(pv.pivot_long(pv.pivot_search(facts(spark, sf), "AUTO", ROWS), ROWS, ["o_orderstatus"], ["price"]), 2)


@check("p8_calculated_field", """
    SELECT o_orderkey, round(CASE WHEN o_orderpriority = '5-LOW' THEN 0 ELSE o_totalprice END * 0.1 + o_custkey, 4) AS fee,
           coalesce(o_totalprice / nullif(o_custkey, 0), 0) AS per_key, 0.0::DOUBLE AS from_text
    FROM orders""")
def p8(spark, sf):
    o = table(spark, sf, "orders").withColumn("price", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice")))
    o = pv.calc_field(o, "fee", "price * 0.1D + o_custkey")
    o = pv.calc_field(o, "per_key", "try_divide(o_totalprice, o_custkey)")
    o = pv.calc_field(o, "from_text", "o_orderstatus * 2")
    return rounded(o.select("o_orderkey", "fee", "per_key", "from_text"), per_key=-1)


@check("p9_pivot_heat", f"""{WITH},
    stats AS (SELECT col_key, least(min(sum), CASE WHEN count(*) < (SELECT count(*) FROM long WHERE col_key = 'TOTAL') THEN 0 END) AS lo,
                     greatest(max(sum), CASE WHEN count(*) < (SELECT count(*) FROM long WHERE col_key = 'TOTAL') THEN 0 END) AS hi
              FROM long WHERE col_key <> 'TOTAL' GROUP BY 1)
    SELECT level, n_name, seg, long.col_key, sum AS value, round((sum - lo) / nullif(hi - lo, 0), 4) AS heat
    FROM long LEFT JOIN stats ON long.col_key = stats.col_key""")
def p9(spark, sf):
    return rounded(pv.pivot_heat(long(spark, sf), "sum").select("level", *ROWS, "col_key", "value", "heat"))


@check("p10_pivot_export", f"""{WITH}
    SELECT CASE level WHEN 0 THEN 'Grand Total' WHEN 1 THEN n_name ELSE seg END AS Dimensions,
           floor(coalesce(max(sum) FILTER (col_key = 'F'), 0) + 0.5)::BIGINT AS F, floor(coalesce(max(sum) FILTER (col_key = 'O'), 0) + 0.5)::BIGINT AS O,
           floor(coalesce(max(sum) FILTER (col_key = 'P'), 0) + 0.5)::BIGINT AS P,
           floor(max(sum) FILTER (col_key = 'TOTAL') + 0.5)::BIGINT AS "Grand Total"
    FROM long GROUP BY level, n_name, seg""")
def p10(spark, sf):
    path = scratch_path(spark, "pivot-export")
    pv.pivot_export(long(spark, sf), ROWS, path, "sum", ["F", "O", "P"], ["price"])
    return spark.read.option("header", True).schema("Dimensions string, F bigint, O bigint, P bigint, `Grand Total` bigint").csv(path)
