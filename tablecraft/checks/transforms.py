"""Queries of the column and row transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablecraft.checks.registry import check, rounded, table, ts_text
from tablecraft.functions import scalars
from tablecraft.functions.aggs import Agg
from tablecraft.operators import transforms as tf
from tablecraft.plans import recipe as rc


@check("t1_casing", """
    SELECT c_custkey, lower(c_mktsegment) AS c_mktsegment, upper(c_name) AS c_name FROM customer""")
def t1(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", scalars.casing("c_mktsegment", "LOWER"), scalars.casing("c_name", "UPPER"))


@check("t1_casing_other_mode", "SELECT c_custkey, c_mktsegment FROM customer")
def t1_other(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", scalars.casing("c_mktsegment", "TITLE"))


@check("t2_calculate", """
    SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net,
           round(l_extendedprice / nullif(l_quantity, 0), 8) AS unit_price, l_linenumber % 3 AS slot
    FROM lineitem""")
def t2(spark, sf):
    out = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", scalars.calculate("net", "l_extendedprice * (1 - l_discount)"),
        scalars.calculate("unit_price", "l_extendedprice / nullif(l_quantity, 0)"),
        scalars.calculate("slot", "l_linenumber % 3"))
    return rounded(out, unit_price=8)


@check("t2_scalar_functions", """
    SELECT p_partkey, trim('  ' || p_name || ' ') AS stripped, replace(p_name, 'i', 'I') AS replaced,
           regexp_replace(p_name, '[aeiou]', '*', 'g') AS starred, string_split(p_name, ' ')[2] AS second_word,
           contains(p_name, 'ring') AS has_ring, starts_with(p_name, 'red') AS is_red, suffix(p_name, 'bolt') AS is_bolt,
           CAST(length(p_name) AS INTEGER) AS name_length, p_brand || '/' || p_type AS label,
           nullif(p_type, 'SMALL') IS NULL AS no_type, nullif(p_type, 'SMALL') IS NOT NULL AS some_type
    FROM part""")
def t2_scalars(spark, sf):
    exprs = {
        "stripped": "trim('  ' || p_name || ' ')", "replaced": "replace(p_name, 'i', 'I')",
        "starred": "regexp_replace(p_name, '[aeiou]', '*')", "second_word": "get(split(p_name, ' '), 1)",
        "has_ring": "contains(p_name, 'ring')", "is_red": "startswith(p_name, 'red')",
        "is_bolt": "endswith(p_name, 'bolt')", "name_length": "length(p_name)", "label": "concat(p_brand, '/', p_type)",
        "no_type": "nullif(p_type, 'SMALL') is null", "some_type": "nullif(p_type, 'SMALL') is not null"}
    return table(spark, sf, "part").select("p_partkey", *[scalars.calculate(k, e) for k, e in exprs.items()])


@check("t3_case_set", """
    SELECT o_orderkey,
           CASE WHEN o_totalprice > 300000 AND o_orderstatus = 'O' THEN 'VIP' ELSE o_orderpriority END AS o_orderpriority
    FROM orders""")
def t3(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", scalars.case_set("o_orderpriority", "o_totalprice > 300000 and o_orderstatus = 'O'", "'VIP'"))


@check("t4_split", """
    SELECT o_orderkey, p[1] AS prio_no, p[2] AS prio_text, p[3] AS prio_extra
    FROM (SELECT o_orderkey, string_split(coalesce(nullif(o_orderpriority, '5-LOW'), 'UNKNOWN'), '-') AS p FROM orders)""")
def t4(spark, sf):
    o = table(spark, sf, "orders").withColumn("prio", F.nullif("o_orderpriority", F.lit("5-LOW")))
    return o.select("o_orderkey", *scalars.split_to("prio", "-", ["prio_no", "prio_text", "prio_extra"]))


@check("t5_filter", """
    SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders
    WHERE (o_totalprice > 200000 AND o_orderstatus = 'O') OR contains(o_orderpriority, 'URGENT')""")
def t5(spark, sf):
    o = tf.filter_rows(table(spark, sf, "orders"),
                       "(o_totalprice > 200000 and o_orderstatus = 'O') or contains(o_orderpriority, 'URGENT')")
    return o.select("o_orderkey", "o_orderstatus", "o_totalprice")


@check("t6_dedup", """
    SELECT c_nationkey, c_mktsegment, c_custkey FROM customer
    QUALIFY row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_acctbal DESC, c_custkey) = 1""")
def t6(spark, sf):
    best = tf.dedup(table(spark, sf, "customer"), ["c_nationkey", "c_mktsegment"], [F.col("c_acctbal").desc(), F.col("c_custkey")])
    return best.select("c_nationkey", "c_mktsegment", "c_custkey")


@check("t6_dedup_any_row", "SELECT DISTINCT o_custkey FROM orders")
def t6_any(spark, sf):
    return tf.dedup(table(spark, sf, "orders"), ["o_custkey"]).select("o_custkey")


@check("t7_drop_columns", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def t7(spark, sf):
    return tf.drop_columns(table(spark, sf, "orders"), ["o_orderdate", "o_orderpriority"])


@check("t8_convert", """
    SELECT o_orderkey, o_custkey::VARCHAR AS as_str, TRY_CAST(left(o_orderpriority, 1) AS BIGINT) AS as_int,
           TRY_CAST(substr(o_orderpriority, 3) AS BIGINT) AS no_int,
           TRY_CAST(o_totalprice::DECIMAL(18,2)::VARCHAR AS DOUBLE) AS as_float,
           TRY_CAST(CASE o_orderstatus WHEN 'O' THEN 'true' WHEN 'F' THEN 'false' ELSE '?' END AS BOOLEAN) AS as_bool,
           strftime(TRY_CAST(strftime(o_orderdate, '%Y-%m-%d') AS TIMESTAMP), '%Y-%m-%d %H:%M:%S.%f') AS as_date
    FROM orders""")
def t8(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("as_str"), F.left("o_orderpriority", F.lit(1)).alias("as_int"),
        F.substr("o_orderpriority", F.lit(3)).alias("no_int"),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("as_float"),
        F.when(F.col("o_orderstatus") == "O", "true").when(F.col("o_orderstatus") == "F", "false").otherwise("?").alias("as_bool"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("as_date"))
    kinds = {"as_str": "str", "as_int": "int", "no_int": "int", "as_float": "float", "as_bool": "bool", "as_date": "date"}
    return o.select("o_orderkey", *[scalars.convert(c, k) for c, k in kinds.items()]).withColumn("as_date", ts_text("as_date"))


@check("t9_new_or_existing_field", """
    SELECT o_orderkey, CASE WHEN o_totalprice > 250000 THEN 'big' END AS size_class,
           CASE WHEN o_totalprice > 250000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus
    FROM orders""")
def t9(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", scalars.case_set("size_class", "o_totalprice > 250000", "'big'", is_new=True),
        scalars.case_set("o_orderstatus", "o_totalprice > 250000", "'X'"))


RECIPE = [
    rc.Filter("net > 20000"),
    rc.Aggregate("l_returnflag", Agg("mean", "l_quantity", "flag_quantity")),
    rc.Calculate("net", "l_extendedprice * (1 - l_discount)"),
    rc.CaseSet("l_linestatus", "l_quantity > 30", "'bulk'"),
    rc.Aggregate("l_returnflag", Agg("len", "l_quantity", "flag_rows")),
    rc.Aggregate("l_linestatus", Agg("max", "l_extendedprice", "status_price")),
    rc.Casing("l_returnflag", "LOWER"),
    rc.Drop(("l_tax", "l_shipdate")),
]


@check("t10_recipe", """
    WITH flags AS (SELECT l_returnflag AS k, avg(l_quantity) AS q, count(*) AS n FROM lineitem GROUP BY 1),
         states AS (SELECT l_linestatus AS k, max(l_extendedprice) AS p FROM lineitem GROUP BY 1)
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount,
           lower(l_returnflag) AS l_returnflag, CASE WHEN l_quantity > 30 THEN 'bulk' ELSE l_linestatus END AS l_linestatus,
           round(flags.q, 4) AS flag_quantity, flags.n AS flag_rows, states.p AS status_price,
           round(l_extendedprice * (1 - l_discount), 4) AS net
    FROM lineitem LEFT JOIN flags ON l_returnflag = flags.k LEFT JOIN states ON l_linestatus = states.k
    WHERE l_extendedprice * (1 - l_discount) > 20000""")
def t10(spark, sf):
    return rounded(rc.apply_recipe(table(spark, sf, "lineitem"), RECIPE))


@check("t10_recipes_by_table", """
    SELECT 'customer' AS name, count(*) AS n FROM customer WHERE c_acctbal > 0
    UNION ALL SELECT 'orders', count(DISTINCT o_custkey) FROM orders UNION ALL SELECT 'nation', count(*) FROM nation""")
def t10_tables(spark, sf):
    made = rc.apply_recipes(
        {n: table(spark, sf, n) for n in ("customer", "orders", "nation")},
        {"customer": [rc.Filter("c_acctbal > 0")], "orders": [rc.Dedup(("o_custkey",))]})
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in made.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


PREVIEW = [
    rc.Aggregate("o_custkey", Agg("count", "o_orderkey", "n_orders")),
    rc.Aggregate("o_custkey", Agg("max", "o_totalprice", "top_price")),
    rc.CaseSet("o_orderstatus", "o_totalprice > 400000", "'TOP'"),
    rc.Split("o_orderpriority", "-", ("prio_no", "prio_text")),
    rc.Calculate("half", "o_totalprice / 2"),
    rc.Dedup(("o_custkey",), ("o_orderkey",)),
    rc.Filter("o_totalprice < 100000"),
    rc.Drop(("o_orderdate",)),
]


@check("t11_preview_aggregate", """
    SELECT o_custkey, count(o_orderkey) AS n_orders, max(o_totalprice) AS top_price
    FROM orders GROUP BY 1 ORDER BY 1 LIMIT 20""")
def t11_aggregate(spark, sf):
    return rc.preview_recipe(table(spark, sf, "orders"), PREVIEW, 0, ["o_orderkey"])


@check("t11_preview_case", """
    SELECT o_orderkey, 'TOP' AS o_orderstatus FROM orders WHERE o_totalprice > 400000 ORDER BY 1 LIMIT 5""")
def t11_case(spark, sf):
    return rc.preview_recipe(table(spark, sf, "orders"), PREVIEW, 2, ["o_orderkey"]).select("o_orderkey", "o_orderstatus")


@check("t11_preview_calculate", """
    SELECT o_orderkey, round(o_totalprice / 2, 4) AS half FROM orders ORDER BY 1 LIMIT 5""")
def t11_calculate(spark, sf):
    return rounded(rc.preview_recipe(table(spark, sf, "orders"), PREVIEW, 4, ["o_orderkey"]).select("o_orderkey", "half"))


@check("t11_preview_dedup", """
    SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1 ORDER BY 2 LIMIT 20""")
def t11_dedup(spark, sf):
    return rc.preview_recipe(table(spark, sf, "orders"), PREVIEW, 5, ["o_orderkey"]).select("o_custkey", "o_orderkey")


@check("t11_preview_drop", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY 1 LIMIT 2")
def t11_drop(spark, sf):
    shown = rc.preview_recipe(table(spark, sf, "orders"), PREVIEW, 7, ["o_orderkey"])
    return shown.drop("half", "prio_no", "prio_text", "o_orderstatus", "o_orderpriority")


@check("t12_add_column", """
    SELECT n_nationkey, '-' AS note, n_name, n_regionkey, 'new' AS last FROM nation""")
def t12(spark, sf):
    return tf.add_column(tf.add_column(table(spark, sf, "nation"), "note", at=1), "last", "new")


@check("t13_remove_sheet_column", "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def t13(spark, sf):
    return tf.drop_columns(table(spark, sf, "customer"), ["c_acctbal"])


@check("t14_prefix_columns", """
    SELECT s_suppkey AS supplier_s_suppkey, s_name AS supplier_s_name, s_nationkey AS supplier_s_nationkey,
           s_acctbal AS supplier_s_acctbal FROM supplier""")
def t14(spark, sf):
    return tf.prefix_columns(table(spark, sf, "supplier"), "supplier")


@check("t15_select_matching", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def t15(spark, sf):
    return tf.select_matching(tf.drop_columns(table(spark, sf, "orders"), ["o_orderdate"]), "^o_order")


@check("t16_stringify_key", "SELECT CAST(c_acctbal AS VARCHAR) AS c_acctbal, c_custkey FROM customer")
def t16(spark, sf):
    c = tf.stringify_key(table(spark, sf, "customer"), "c_acctbal")
    return tf.stringify_key(c, "c_custkey").select("c_acctbal", "c_custkey")


@check("t17_search_all_columns", """
    SELECT p_name, p_brand, p_type, p_partkey FROM part
    WHERE contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring') OR contains(lower(coalesce(p_type, '')), 'ring')
       OR contains(p_partkey::VARCHAR, 'ring')""")
def t17(spark, sf):
    return tf.search_rows(table(spark, sf, "part").select("p_name", "p_brand", "p_type", "p_partkey"), "RING")


@check("t17_search_one_column", "SELECT doc_id, lang, n_chars FROM documents WHERE contains(lower(text), 'the ')")
def t17_one(spark, sf):
    return tf.search_rows(table(spark, sf, "documents"), "The ", "text").select("doc_id", "lang", "n_chars")


@check("t18_encode_binary", "SELECT c_custkey, base64(encode(c_name)) AS c_name FROM customer")
def t18(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.encode("c_name", "UTF-8").alias("c_name"))
    return tf.encode_binary(c)
