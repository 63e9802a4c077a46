"""Frames derived from the given tables, each in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecraft.checks.registry import table
from tablecraft.operators.joins import ForeignKey

TPCH_KEYS = [
    ForeignKey("orders", ("o_custkey",), "customer", ("c_custkey",)),
    ForeignKey("lineitem", ("l_orderkey",), "orders", ("o_orderkey",)),
    ForeignKey("lineitem", ("l_partkey",), "part", ("p_partkey",)),
    ForeignKey("lineitem", ("l_suppkey",), "supplier", ("s_suppkey",)),
    ForeignKey("customer", ("c_nationkey",), "nation", ("n_nationkey",)),
    ForeignKey("supplier", ("s_nationkey",), "nation", ("n_nationkey",)),
    ForeignKey("nation", ("n_regionkey",), "region", ("r_regionkey",)),
]


def run_logs(spark: SparkSession, sf: str) -> DataFrame:
    """A run log: every event is a log row, every user and day one run."""
    user, kind = F.col("user_id"), F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("timestamp"),
        F.when(user % 10 == 9, "other.space").otherwise("ns").alias("namespace"),
        F.when(user % 10 == 8, "system").otherwise(
            F.concat(F.lit("Load"), F.when(user % 3 == 0, " ").otherwise("__"), user % 10)).alias("pipeline_id"),
        F.concat(F.lit("e"), user, F.lit("-"), F.dayofmonth("ts")).alias("execution_id"),
        F.when(kind == "error", "ERROR").when(kind == "view", "WARNING").otherwise("INFO").alias("log_level"),
        F.when(kind == "purchase", F.concat(F.lit("orders: "), k, F.lit(" |")))
        .when((kind == "signup") & (k % 2 == 0), "step finished").otherwise(kind).alias("message"),
        kind.alias("module"), (F.col("event_id") % 500).cast("int").alias("line_number"),
        F.concat(F.lit("{"), F.when(kind != "click", F.concat(F.lit('"rows": '), k, F.lit(', "duration_sec": '),
                                    F.col("value").cast("decimal(12,2)"), F.lit(", "))).otherwise(""),
                 F.when(kind == "purchase", '"stage": "pipeline_completion", ')
                 .when(kind == "signup", '"stage": "initialization", ').otherwise(""),
                 F.lit('"k": '), k, F.lit("}")).alias("extra_data"))
    return e.withColumn("logger_name", F.concat_ws(".", F.lit("pipeline"), "namespace", "pipeline_id", "execution_id"))


RUN_LOGS_SQL = """
    logs AS (
      SELECT event_id AS id, ts AS timestamp, CASE WHEN user_id % 10 = 9 THEN 'other.space' ELSE 'ns' END AS namespace,
             CASE WHEN user_id % 10 = 8 THEN 'system'
                  ELSE 'Load' || CASE WHEN user_id % 3 = 0 THEN ' ' ELSE '__' END || (user_id % 10) END AS pipeline_id,
             'e' || user_id || '-' || day(ts) AS execution_id,
             CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'WARNING' ELSE 'INFO' END AS log_level,
             CASE WHEN event_type = 'purchase' THEN 'orders: ' || k || ' |'
                  WHEN event_type = 'signup' AND k % 2 = 0 THEN 'step finished' ELSE event_type END AS message,
             event_type AS module, (event_id % 500)::INTEGER AS line_number,
             '{' || CASE WHEN event_type <> 'click' THEN '"rows": ' || k || ', "duration_sec": ' || value::DECIMAL(12,2) || ', ' ELSE '' END
                 || CASE event_type WHEN 'purchase' THEN '"stage": "pipeline_completion", '
                                    WHEN 'signup' THEN '"stage": "initialization", ' ELSE '' END
                 || '"k": ' || k || '}' AS extra_data
      FROM (SELECT *, (props->>'$.k')::INTEGER AS k FROM events))"""


def row_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Relations between single rows: lineitem's order -> customer -> nation -> region."""
    def edges(child, source, key, parent, target):
        c = table(spark, sf, child)
        return c.select(
            F.lit(f"fk_{child}_{parent}").alias("constraint_name"), F.lit(key).alias("source_column"),
            F.concat(F.lit(f"{child}_"), F.col(source)).alias("source_table"), F.lit(target).alias("target_column"),
            F.concat(F.lit(f"{parent}_"), F.col(key)).alias("target_table"))

    return (edges("orders", "o_orderkey", "o_custkey", "customer", "c_custkey")
            .unionByName(edges("customer", "c_custkey", "c_nationkey", "nation", "n_nationkey"))
            .unionByName(edges("nation", "n_nationkey", "n_regionkey", "region", "r_regionkey")))


ROW_EDGES_SQL = """
    edges AS (
      SELECT 'fk_orders_customer' AS constraint_name, 'o_custkey' AS source_column, 'orders_' || o_orderkey AS source_table,
             'c_custkey' AS target_column, 'customer_' || o_custkey AS target_table FROM orders
      UNION ALL SELECT 'fk_customer_nation', 'c_nationkey', 'customer_' || c_custkey, 'n_nationkey', 'nation_' || c_nationkey FROM customer
      UNION ALL SELECT 'fk_nation_region', 'n_regionkey', 'nation_' || n_nationkey, 'r_regionkey', 'region_' || n_regionkey FROM nation)"""


def column_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """A column catalog: every part is a column, 20 parts make a table; some have a second version."""
    suffixes = F.array(*[F.lit(s) for s in SUFFIXES])
    n = F.col("p_partkey")
    base = table(spark, sf, "part").select(
        F.concat(F.lit("tbl_"), F.floor(n / 20)).alias("table_name"),
        F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), n, F.element_at(suffixes, (n % 12 + 1).cast("int")))
        .alias("original_column_name"),
        F.when(n % 3 == 0, "bigint").when(n % 3 == 1, "text").otherwise("double").alias("data_type"),
        F.concat(F.lit("ns_at_"), F.lower("p_type")).alias("pipeline"), F.lit("store").alias("source_store"),
        F.lit("ns").alias("namespace"), n.alias("n"), F.col("p_size").alias("size"))
    second = base.filter("size > 30").withColumns(
        {"column_version": F.lit(2), "is_deleted": F.expr("int(size > 40)"), "ingested_at": F.lit("2024-02-01")})
    first = base.withColumns({"column_version": F.lit(1), "is_deleted": F.lit(0), "ingested_at": F.lit("2024-01-01")})
    both = first.unionByName(second)
    return both.withColumns({
        "column_name": F.col("original_column_name"),
        "semantic_concept": F.when(F.col("n") % 4 == 0, "").otherwise("known"),
        "confidence_score": (F.col("n") % 10) / 10.0, "description": F.lit(""), "source": F.lit("rule"),
        "validated": F.lit(0), "validated_by": F.lit(""), "validated_at": F.lit("")})


SUFFIXES = ["_id", "_at", "_email", "_phone", "_customer", "_name", "_amount", "_city", "_status", "_qty", "", "_x"]

COLUMN_CATALOG_SQL = f"""
    base AS (
      SELECT 'tbl_' || (p_partkey // 20) AS table_name,
             replace(p_name, ' ', '_') || '_' || p_partkey || ({SUFFIXES!r})[(p_partkey % 12 + 1)::INTEGER] AS original_column_name,
             CASE p_partkey % 3 WHEN 0 THEN 'bigint' WHEN 1 THEN 'text' ELSE 'double' END AS data_type,
             'ns_at_' || lower(p_type) AS pipeline, 'store' AS source_store, 'ns' AS namespace, p_partkey AS n, p_size AS size FROM part),
    versions AS (
      SELECT *, 1 AS column_version, 0 AS is_deleted, '2024-01-01' AS ingested_at FROM base
      UNION ALL SELECT *, 2, (size > 40)::INTEGER, '2024-02-01' FROM base WHERE size > 30),
    catalog AS (
      SELECT *, original_column_name AS column_name, CASE WHEN n % 4 = 0 THEN '' ELSE 'known' END AS semantic_concept,
             (n % 10) / 10.0 AS confidence_score, '' AS description, 'rule' AS source, 0 AS validated,
             '' AS validated_by, '' AS validated_at FROM versions)"""
