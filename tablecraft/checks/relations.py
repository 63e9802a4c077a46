"""Queries of the relation graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablecraft.checks.fixtures import ROW_EDGES_SQL, row_edges
from tablecraft.checks.registry import check, table
from tablecraft.functions.fixed_values import MODULE_EXCLUDES
from tablecraft.operators import relations as rl


@check("g1_table_hierarchy", f"""
    WITH RECURSIVE {ROW_EDGES_SQL},
    tree AS (
      SELECT 1 AS level, CAST(NULL AS VARCHAR) AS parent_table, 'orders_' || o_orderkey AS table_name, 'ORDERS' AS path FROM orders
      UNION ALL
      SELECT level + 1, tree.table_name, target_table, path || ' -> ' || target_table FROM tree JOIN edges ON source_table = tree.table_name
      WHERE level < 5)
    SELECT level, min(parent_table) AS parent_table, table_name, path FROM tree WHERE level > 1 GROUP BY 1, 3, 4""")
def g1(spark, sf):
    tables = table(spark, sf, "orders").select(F.concat(F.lit("orders_"), "o_orderkey").alias("table_name"))
    return rl.table_hierarchy(row_edges(spark, sf), tables, "orders")


@check("g2_module_list", f"""
    SELECT DISTINCT 1 AS level, CAST(NULL AS VARCHAR) AS parent_table, m AS table_name, m AS path
    FROM (SELECT upper(split_part(replace(p_name, ' ', '.') || p_partkey, '.', 1)) || (p_partkey % 50) AS m FROM part WHERE p_partkey % 4 <> 0
          UNION ALL SELECT 'MAIL' FROM part UNION ALL SELECT '9X' || s_suppkey FROM supplier)
    WHERE NOT regexp_matches(m, '^({"|".join(MODULE_EXCLUDES)})') AND regexp_matches(m, '^[A-Z]') AND length(m) > 2""")
def g2(spark, sf):
    k = F.col("p_partkey")
    word = F.split_part("p_name", F.lit(" "), F.lit(1))
    models = table(spark, sf, "part").select(
        F.concat(word, k % 50, F.lit("."), "p_name").alias("model"), (k % 4 == 0).alias("transient"), F.lit("base").alias("state"))
    more = table(spark, sf, "part").select(F.lit("mail.thread").alias("model"), F.lit(False).alias("transient"), F.lit("base").alias("state"))
    digits = table(spark, sf, "supplier").select(
        F.concat(F.lit("9x"), "s_suppkey", F.lit(".line")).alias("model"), F.lit(False).alias("transient"), F.lit("base").alias("state"))
    return rl.module_list(models.unionByName(more).unionByName(digits))


@check("g3_business_edges", f"""
    WITH {ROW_EDGES_SQL}
    SELECT source_table, target_table FROM edges WHERE NOT starts_with(source_table, 'customer_1') AND NOT starts_with(target_table, 'customer_1')""")
def g3(spark, sf):
    edges = row_edges(spark, sf)
    technical = edges.withColumn("source_table", F.concat(F.lit("mail_"), "source_table"))
    kept = rl.business_edges(edges.unionByName(technical))
    return rl.business_edges(kept, ["customer_1"]).select("source_table", "target_table")
