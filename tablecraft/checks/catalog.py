"""Queries of the column catalog and of similarity search."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablecraft.checks.fixtures import COLUMN_CATALOG_SQL, column_catalog
from tablecraft.checks.registry import check, rounded, table
from tablecraft.functions.fixed_values import TAG_RULES
from tablecraft.operators import aggregation as ag
from tablecraft.operators import catalog as ct
from tablecraft.operators import similarity

WITH = f"WITH {COLUMN_CATALOG_SQL}"
CURRENT_SQL = """
    current AS (
      SELECT table_name, original_column_name, CASE WHEN size < 5 THEN 'json' ELSE data_type END AS data_type FROM base
      WHERE pipeline <> 'ns_at_promo' AND table_name <> 'tbl_3'
      UNION ALL SELECT 'tbl_' || (s_suppkey // 5), 'extra_' || s_suppkey, 'text' FROM supplier)"""


def current_columns(spark, sf):
    base = column_catalog(spark, sf).filter("column_version = 1")
    kept = base.filter("pipeline <> 'ns_at_promo' and table_name <> 'tbl_3'").select(
        "table_name", "original_column_name", F.when(F.col("size") < 5, "json").otherwise(F.col("data_type")).alias("data_type"))
    extra = table(spark, sf, "supplier").select(
        F.concat(F.lit("tbl_"), F.floor(F.col("s_suppkey") / 5)).alias("table_name"),
        F.concat(F.lit("extra_"), "s_suppkey").alias("original_column_name"), F.lit("text").alias("data_type"))
    return kept.unionByName(extra)


@check("c1_catalog_diff", f"""{WITH}, {CURRENT_SQL},
    latest AS (SELECT * FROM catalog QUALIFY row_number() OVER (PARTITION BY table_name, original_column_name ORDER BY column_version DESC) = 1)
    SELECT c.table_name, c.original_column_name, c.data_type, coalesce(l.column_version + 1, 1)::INTEGER AS column_version, 0 AS is_deleted
    FROM current c LEFT JOIN latest l USING (table_name, original_column_name)
    WHERE l.n IS NULL OR l.is_deleted = 1 OR l.data_type <> c.data_type
    UNION ALL
    SELECT l.table_name, l.original_column_name, l.data_type, l.column_version + 1, 1 FROM latest l
    WHERE l.is_deleted = 0 AND l.table_name IN (SELECT table_name FROM current)
      AND NOT EXISTS (SELECT 1 FROM current c WHERE c.table_name = l.table_name AND c.original_column_name = l.original_column_name)""")
def c1(spark, sf):
    return ct.catalog_diff(column_catalog(spark, sf), current_columns(spark, sf))


@check("c2_drop_system", """
    SELECT 'tbl_' || (p_partkey // 20) AS table_name, CASE WHEN p_partkey % 4 = 0 THEN '_dlt_' ELSE '' END || p_partkey AS original_column_name
    FROM part WHERE p_partkey % 4 <> 0 AND p_partkey % 9 <> 0""")
def c2(spark, sf):
    n = F.col("p_partkey")
    cols = table(spark, sf, "part").select(
        F.concat(F.when(n % 9 == 0, "_dlt_").otherwise("tbl_"), F.floor(n / 20)).alias("table_name"),
        F.concat(F.when(n % 4 == 0, "_dlt_").otherwise(""), n).alias("original_column_name"))
    return ct.drop_system(cols)


RULE_CASE = "CASE " + " ".join(f"WHEN regexp_matches(lower(original_column_name), '{p}') THEN {{{i}}}" for i, (p, _, _) in enumerate(TAG_RULES)) + " END"
CONCEPT_SQL = RULE_CASE.format(*[f"'{c}'" for _, c, _ in TAG_RULES])
SCORE_SQL = RULE_CASE.format(*[f"{s}::DOUBLE" for _, _, s in TAG_RULES])


@check("c3_tag_columns", f"""{WITH}
    SELECT table_name, original_column_name, {CONCEPT_SQL} AS semantic_concept, {SCORE_SQL} AS confidence_score,
           CASE WHEN {CONCEPT_SQL} IS NOT NULL THEN 'rule' END AS source, CASE WHEN {CONCEPT_SQL} IS NOT NULL THEN '' END AS description
    FROM base""")
def c3(spark, sf):
    cols = column_catalog(spark, sf).filter("column_version = 1").select("table_name", "original_column_name")
    return ct.tag_columns(cols)


@check("c4_attach_labels", f"""{WITH}
    SELECT table_name, original_column_name, CASE WHEN size > 25 THEN 'concept ' || n ELSE '' END AS semantic_concept,
           CASE WHEN size > 25 THEN 0.75::DOUBLE ELSE 0.0::DOUBLE END AS confidence_score,
           CASE WHEN size > 25 THEN 'about ' || n ELSE '' END AS description, CASE WHEN size > 25 THEN 'model' ELSE '' END AS source,
           0 AS validated, '' AS validated_by, '' AS validated_at FROM base""")
def c4(spark, sf):
    base = column_catalog(spark, sf).filter("column_version = 1").select("table_name", "original_column_name", "n", "size")
    labels = base.filter("size > 25").select(
        "table_name", "original_column_name", F.concat(F.lit("concept "), "n").alias("semantic_concept"),
        F.lit(0.75).alias("confidence_score"), F.concat(F.lit("about "), "n").alias("description"), F.lit("model").alias("source"))
    return ct.attach_labels(base.drop("n", "size"), labels)


@check("c5_update_semantics", f"""{WITH},
    hit AS (SELECT table_name, original_column_name FROM base WHERE size BETWEEN 10 AND 35)
    SELECT table_name, original_column_name, column_version, semantic_concept, description, validated, validated_at FROM catalog
    WHERE (table_name, original_column_name) NOT IN (SELECT (table_name, original_column_name) FROM hit)
    UNION ALL
    SELECT table_name, original_column_name, column_version, 'edited', 'text ' || n, 1, '2024-03-01' FROM catalog
    WHERE (table_name, original_column_name) IN (SELECT (table_name, original_column_name) FROM hit)
    QUALIFY row_number() OVER (PARTITION BY table_name, original_column_name ORDER BY column_version DESC) = 1""")
def c5(spark, sf):
    catalog = column_catalog(spark, sf)
    same = ~F.col("size").between(10, 35)
    edits = catalog.filter("column_version = 1").select(
        "pipeline", "table_name", F.col("original_column_name").alias("name"),
        F.when(same, F.col("semantic_concept")).otherwise("edited").alias("semantic"), F.lit(1.0).alias("confidence"),
        F.lit("user").alias("sem_source"), F.lit(1).alias("validated"),
        F.when(same, "").otherwise(F.concat(F.lit("text "), "n")).alias("description"))
    out = ct.update_semantics(catalog, edits, "2024-03-01")
    return out.select("table_name", "original_column_name", "column_version", "semantic_concept", "description", "validated", "validated_at")


@check("c6_catalog_of", f"""{WITH}
    SELECT column_name AS name, table_name, source_store, data_type, is_deleted, column_version, semantic_concept,
           confidence_score::DOUBLE AS confidence_score, validated, source, description
    FROM catalog WHERE pipeline = 'ns_at_promo'
    QUALIFY row_number() OVER (PARTITION BY table_name, original_column_name ORDER BY column_version DESC) = 1""")
def c6(spark, sf):
    return ct.catalog_of(column_catalog(spark, sf), "ns-at-promo", details=True)


@check("c6_catalog_of_all_versions", f"""{WITH}
    SELECT column_name AS name, table_name, source_store FROM catalog WHERE pipeline = 'ns_at_small'""")
def c6_all(spark, sf):
    return ct.catalog_of(column_catalog(spark, sf), "ns_at_small", latest=False)


for status, sql in {"active": "is_deleted = 0", "deleted": "is_deleted = 1", "evolved": "column_version > 1",
                    "pending": "semantic_concept = '' AND is_deleted = 0"}.items():
    def c7(spark, sf, status=status):
        return ct.filter_catalog(column_catalog(spark, sf), "Ring", status).select("table_name", "column_name", "column_version")

    check(f"c7_filter_{status}", f"""{WITH}
        SELECT table_name, column_name, column_version FROM catalog WHERE contains(lower(column_name), 'ring') AND {sql}""")(c7)


@check("c7_column_totals", f"""{WITH}
    SELECT table_name, count_if(is_deleted = 0) AS active, count_if(is_deleted = 1) AS deleted FROM catalog GROUP BY 1""")
def c7_totals(spark, sf):
    return ct.column_totals(column_catalog(spark, sf))


def first_vector(spark, sf):
    return table(spark, sf, "embeddings").filter("vec_id = 0").select("embedding").first()[0]


QUERY_SQL = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"


@check("c8_similar", f"""
    SELECT * FROM (
      SELECT vec_id, label, round(power(list_distance(embedding::DOUBLE[], {QUERY_SQL}::DOUBLE[]), 2), 4) AS _distance
      FROM embeddings ORDER BY list_distance(embedding::DOUBLE[], {QUERY_SQL}::DOUBLE[]), vec_id LIMIT 50)
    WHERE _distance < 100""")
def c8(spark, sf):
    near = similarity.similar(table(spark, sf, "embeddings"), first_vector(spark, sf), 50, 100.0, ties=("vec_id",))
    return rounded(near.drop("embedding"))


@check("c8_similar_cosine", f"""
    SELECT * FROM (
      SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], {QUERY_SQL}::DOUBLE[]), 4) AS _distance
      FROM embeddings ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], {QUERY_SQL}::DOUBLE[]), vec_id LIMIT 50)
    WHERE _distance < 0.5""")
def c8_cosine(spark, sf):
    near = similarity.similar(table(spark, sf, "embeddings"), first_vector(spark, sf), 50, 0.5, "cosine", ties=("vec_id",))
    return rounded(near.select("vec_id", "_distance"))


@check("c8_similar_dot", f"""
    SELECT vec_id, round(-list_inner_product(embedding::DOUBLE[], {QUERY_SQL}::DOUBLE[]), 4) AS _distance
    FROM embeddings ORDER BY -list_inner_product(embedding::DOUBLE[], {QUERY_SQL}::DOUBLE[]), vec_id LIMIT 50""")
def c8_dot(spark, sf):
    near = similarity.similar(table(spark, sf, "embeddings"), first_vector(spark, sf), 50, None, "dot", ties=("vec_id",))
    return rounded(near.select("vec_id", "_distance"))


@check("c9_describe_columns", f"""{WITH}
    SELECT table_name, column_name, 'Pipeline: ' || pipeline || ' | Table: ' || table_name || ' | Column ' || column_name
           || ' | Concept: ' || semantic_concept || ' | Description ' || description AS text FROM catalog""")
def c9(spark, sf):
    return ct.describe_columns(column_catalog(spark, sf))


def run_metadata(spark, sf):
    """Metadata rows, one per customer, with two further columns added as NULL."""
    k = F.col("c_custkey")
    meta = table(spark, sf, "customer").select(
        F.concat(F.lit("p"), F.floor(k / 2)).alias("pipeline"), F.when(F.col("c_acctbal") > 4000, "ns").otherwise("other").alias("namespace"),
        F.col("c_mktsegment").alias("source_type"), F.lit("duckdb").alias("dest_type"), F.col("c_name").alias("dest_secret_name"),
        F.concat(F.lit("db"), "c_nationkey").alias("dataset_name"), F.when(k % 2 == 0, "true").otherwise("false").alias("domain_pipeline"))
    return ct.add_missing(meta, {"source_config": "string", "namespace": "string", "short_query": "string"})


META_SQL = """
    meta AS (SELECT 'p' || (c_custkey // 2) AS pipeline, CASE WHEN c_acctbal > 4000 THEN 'ns' ELSE 'other' END AS namespace,
             c_mktsegment AS source_type, 'duckdb' AS dest_type, c_name AS dest_secret_name, 'db' || c_nationkey AS dataset_name,
             (c_custkey % 2 = 0)::VARCHAR AS domain_pipeline FROM customer)"""


@check("c10_domain_rows", f"""WITH {META_SQL}
    SELECT pipeline, dataset_name, namespace FROM meta WHERE domain_pipeline = 'true' AND namespace = 'ns'""")
def c10(spark, sf):
    return ct.domain_rows(run_metadata(spark, sf), "ns")


@check("c10_endpoints", f"""WITH {META_SQL}
    SELECT pipeline, '[' || string_agg('{{"source_type":"' || source_type || '","dest_type":"duckdb","connection_name":"' || dest_secret_name
           || '","dbname":"' || dataset_name || '"}}', ',' ORDER BY source_type, dest_secret_name) || ']' AS endpoints_json
    FROM meta WHERE namespace = 'other' GROUP BY 1""")
def c10_endpoints(spark, sf):
    return ct.endpoints(run_metadata(spark, sf), "other")


@check("c10_endpoint_types", f"""WITH {META_SQL}
    SELECT pipeline, json_object('sourceType', source_type, 'destType', dest_type, 'pipeline', pipeline, 'sourceSecretName', NULL,
           'destSecretName', dest_secret_name, 'destinationConfig', NULL, 'referencedSecrets', NULL, 'datasetName', dataset_name)::VARCHAR AS types_json
    FROM meta WHERE namespace = 'ns'""")
def c10_types(spark, sf):
    return ct.endpoint_types(run_metadata(spark, sf), "ns")


@check("a15_by_namespace", f"""{WITH},
    tables AS (SELECT pipeline, table_name, '[' || string_agg('{{"name":"' || column_name || '","type":"' || data_type || '"}}', ',' ORDER BY column_name) || ']' AS cols
               FROM catalog WHERE size > 25 GROUP BY 1, 2)
    SELECT pipeline, '{{' || string_agg('"' || table_name || '":' || cols, ',' ORDER BY table_name) || '}}' AS tables_json FROM tables GROUP BY 1""")
def a15_namespace(spark, sf):
    catalog = column_catalog(spark, sf).withColumn("namespace", F.when(F.col("size") > 25, "big_ns").otherwise("ns"))
    return ag.tables_by_source(catalog, namespace="big-ns")


@check("c11_add_missing", f"""WITH {META_SQL}
    SELECT *, CAST(NULL AS VARCHAR) AS source_config, CAST(NULL AS VARCHAR) AS short_query FROM meta""")
def c11(spark, sf):
    return run_metadata(spark, sf)


@check("c12_mask_secrets", """
    SELECT c_custkey, CASE WHEN c_custkey % 2 = 0
      THEN '{"host":"h' || c_custkey || '","password":"************","token":"************","url":"db://' || c_name || ':*****@h/x"}'
      ELSE 'jdbc://' || c_name || ':*****@host' END AS dest FROM customer""")
def c12(spark, sf):
    name, k = F.col("c_name"), F.col("c_custkey")
    config = F.concat(F.lit('{"host":"h'), k, F.lit('","password":"'), name, F.lit('","token":"t'), k,
                      F.lit('","url":"db://'), name, F.lit(":pw"), k, F.lit('@h/x"}'))
    text = F.when(k % 2 == 0, config).otherwise(F.concat(F.lit("jdbc://"), name, F.lit(":secret@host")))
    return ct.mask_secrets(table(spark, sf, "customer").select("c_custkey", text.alias("dest")), "dest")


@check("a15_columns_by_table", f"""{WITH}
    SELECT table_name, '[' || string_agg('{{"column_name":"' || column_name || '","original_column_name":"' || column_name
           || '","data_type":"' || data_type || '","semantic_concept":"' || semantic_concept || '","description":""}}', ',' ORDER BY column_name) || ']' AS columns_json
    FROM catalog WHERE column_version = 1 GROUP BY 1""")
def a15(spark, sf):
    return ag.columns_by_table(column_catalog(spark, sf).filter("column_version = 1").drop("confidence_score"))


@check("a15_tables_by_source", f"""{WITH},
    tables AS (SELECT 'src_' || (n // 100) AS pipeline, table_name, '[' || string_agg('{{"name":"' || column_name || '","type":"' || data_type || '"}}', ',' ORDER BY column_name) || ']' AS cols
               FROM catalog WHERE column_version = 1 GROUP BY 1, 2)
    SELECT pipeline, '{{' || string_agg('"' || table_name || '":' || cols, ',' ORDER BY table_name) || '}}' AS tables_json FROM tables GROUP BY 1""")
def a15_nested(spark, sf):
    catalog = column_catalog(spark, sf).filter("column_version = 1").withColumn(
        "pipeline", F.concat(F.lit("src_"), F.floor(F.col("n") / 100)))
    return ag.tables_by_source(catalog)
