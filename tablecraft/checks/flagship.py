"""The flagship query: read, transform, join back, pivot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablecraft.checks.registry import check, rounded
from tablecraft.functions.aggs import Agg
from tablecraft.operators.pivots import pivot_long, pivot_wide
from tablecraft.plans.recipe import Aggregate, Calculate, Filter, apply_recipe
from tablecraft.sources.files import read_files

STATUSES = ["F", "O", "P"]


@check("flagship_revenue_pivot", """
    WITH mean_price AS (SELECT l_returnflag AS f, avg(l_extendedprice) AS mean FROM lineitem GROUP BY 1),
         kept AS (SELECT l_orderkey, l_returnflag, CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(1 - l_discount AS DECIMAL(4,2)) AS net
                  FROM lineitem JOIN mean_price ON l_returnflag = f WHERE l_extendedprice > mean),
         cells AS (SELECT l_returnflag, o_orderpriority, o_orderstatus, net FROM kept JOIN orders ON l_orderkey = o_orderkey)
    SELECT (2 - GROUPING(l_returnflag) - GROUPING(o_orderpriority))::INTEGER AS level, l_returnflag, o_orderpriority,
           round(coalesce(sum(net) FILTER (o_orderstatus = 'F'), 0)::DOUBLE, 4) AS F,
           round(coalesce(sum(net) FILTER (o_orderstatus = 'O'), 0)::DOUBLE, 4) AS O,
           round(coalesce(sum(net) FILTER (o_orderstatus = 'P'), 0)::DOUBLE, 4) AS P,
           round(sum(net)::DOUBLE, 4) AS TOTAL
    FROM cells GROUP BY ROLLUP (l_returnflag, o_orderpriority)""")
def revenue_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """Revenue of lines above their flag's mean price: flag > priority by order status."""
    lines = read_files(spark, sf, "lineitem.parquet", "parquet")
    orders = read_files(spark, sf, "orders.parquet", "parquet").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    kept = apply_recipe(lines, [
        Aggregate("l_returnflag", Agg("mean", "l_extendedprice", "mean_price")),
        Calculate("net", "l_extendedprice * (1 - l_discount)"),
        Filter("l_extendedprice > mean_price"),
    ])
    joined = kept.join(orders, kept["l_orderkey"] == orders["o_orderkey"])
    rows = ["l_returnflag", "o_orderpriority"]
    long = pivot_long(joined, rows, ["o_orderstatus"], ["net"])
    return rounded(pivot_wide(long, rows, "sum", STATUSES, ["net"]))
