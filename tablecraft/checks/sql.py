"""Queries of user SQL and user sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablecraft.checks.registry import check, table
from tablecraft.session import scratch_path
from tablecraft.sources import sql as us
from tablecraft.sources.files import parquet_ranges, read_range

# The same text runs in both engines.
PLAIN = {
    "q1_sql_semi_join": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)",
    "q1_sql_anti_join": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice < 60000)",
    "q1_sql_intersect": "SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'",
    "q1_sql_except": "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'",
    "q1_sql_rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "q1_sql_cube": "SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY CUBE (p_brand, p_type)",
    "q1_sql_rank": """SELECT o_custkey, o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) * 1 AS r FROM orders""",
    "q1_sql_framed_count": """SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS n FROM events""",
    "q1_sql_joined_report": """SELECT n_name, count(*) AS orders, max(o_totalprice) AS top FROM orders JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus <> 'P' GROUP BY n_name HAVING count(*) > 10""",
}


def user_sql(text):
    def query(spark, sf):
        names = ("customer", "orders", "part", "nation", "events")
        out = us.run_sql(spark, text, {n: table(spark, sf, n) for n in names})
        return out.withColumn("r", F.col("r").cast("bigint")) if "r" in out.columns else out
    return query


for name, text in PLAIN.items():
    check(name, text.replace("* 1 AS r", "AS r"))(user_sql(text))


@check("q2_sql_over_files", "SELECT c_mktsegment, count(*) AS n, max(o_totalprice) AS top FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def q2(spark, sf):
    return us.sql_over_files(
        spark, "SELECT c_mktsegment, count(*) AS n, max(o_totalprice) AS top FROM o JOIN c ON o_custkey = c_custkey GROUP BY c_mktsegment",
        {"o": ("parquet", f"{sf}/orders.parquet"), "c": ("parquet", f"{sf}/customer.parquet")})


@check("q2_sql_over_file_path", "SELECT o_orderkey FROM orders WHERE o_totalprice > 300000")
def q2_path(spark, sf):
    return us.run_sql(spark, f"SELECT o_orderkey FROM parquet.`{sf}/orders.parquet` WHERE o_totalprice > 300000")


@check("u1_user_source", "SELECT event_id, user_id, (props->>'$.k')::BIGINT AS k, 'u1' AS _load_id FROM events")
def u1(spark, sf):
    def source(session):
        import json

        def parse(frames):
            for pdf in frames:
                yield pdf.assign(k=[json.loads(p)["k"] for p in pdf["props"]])[["event_id", "user_id", "k"]]

        return table(session, sf, "events").select("event_id", "user_id", "props").mapInPandas(parse, "event_id bigint, user_id bigint, k bigint")

    return us.from_source(spark, source, scratch_path(spark, "user-source"), ["event_id"], "u1")


@check("u1_user_source_in_parts", "SELECT o_orderkey, o_custkey, upper(o_orderpriority) AS priority, 'u2' AS _load_id FROM orders")
def u1_parts(spark, sf):
    """Each part is a range of rows of a file; the user function reads it in a task."""
    def read(part):
        for batch in read_range(part, ["o_orderkey", "o_custkey", "o_orderpriority"]):
            for row in batch.to_pylist():
                yield {"o_orderkey": row["o_orderkey"], "o_custkey": row["o_custkey"], "priority": row["o_orderpriority"].upper()}

    parts = parquet_ranges(f"{sf}/orders.parquet")
    return us.from_parts(spark, read, parts, "o_orderkey bigint, o_custkey bigint, priority string", scratch_path(spark, "user-parts"), ["o_orderkey"], "u2")
