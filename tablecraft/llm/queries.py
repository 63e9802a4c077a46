"""Registered queries of this package: thin uses of the operators on the whole tables, and their SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecraft.llm import (chat_format, decontamination, embedding_dedup, fingerprints, hard_negatives, language_id, line_dedup, lm_scoring, mixing, near_dup,
                            substring_dedup, url_rules, vector_codes)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op1_mix_sources")
def op1_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    return mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, list_slice(w, i, i + least(len(w), 10) - 1) AS win
    FROM b, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS u(i) WHERE len(w) > 0),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS win FROM d, ns, unnest(range(1, len(w) - n + 2)) AS u(i)),
h AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
p AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM h, unnest(range(i, i + n)) AS v(x) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(p.n_hit, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(t.items, '')) AS items_sha256,
    coalesce(p.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p ON d.doc_id = p.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""


@query("op3_decontamination", OP3_SQL)
def op3_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = decontamination.find_contamination(docs, table(spark, sf, "benchmark").select("item_id", "text"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP6_SQL = r"""
WITH d AS (SELECT doc_id, source, string_split(text, chr(10)) AS lines FROM documents),
s AS (SELECT source, count(*) AS pages FROM d GROUP BY source),
l AS (SELECT source, line, count(*) AS n FROM (SELECT DISTINCT doc_id, source, unnest(lines) AS line FROM d) WHERE line <> '' GROUP BY ALL),
x AS (SELECT l.source, list(line) AS gone FROM l JOIN s ON l.source IS NOT DISTINCT FROM s.source
    WHERE n >= 4 AND n / pages > 0.1 GROUP BY l.source),
k AS (SELECT doc_id, lines, list_filter(lines, lambda y: NOT list_contains(coalesce(gone, []), y)) AS kept
    FROM d LEFT JOIN x ON d.source IS NOT DISTINCT FROM x.source)
SELECT doc_id, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(lines) - len(kept), 0) AS BIGINT) AS n_dropped,
    sha256(coalesce(array_to_string(kept, chr(10)), '')) AS kept_sha256 FROM k
"""


@query("op6_line_dedup", OP6_SQL)
def op6_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    cut = line_dedup.drop_boilerplate_lines(docs)
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op5_near_duplicates")
def op5_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    found = near_dup.assign_components(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select(F.col("_id").alias("doc_id"), "n_shingles", "component_id", "kept")


def _fold(parts: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % parts == 2


@query("op9_language_id")
def op9_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs.filter(~F.coalesce(_fold(4), F.lit(False))))
    judged = language_id.identify(docs.select("doc_id", "text"), model)
    return judged.select("doc_id", F.coalesce(_fold(4), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


@query("op2_url_rules")
def op2_url_rules(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", "url")
    judged = url_rules.judge_urls(pages, table(spark, sf, "labels").select("doc_id", "toxic"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op8_chat_format")
def op8_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    says = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", says), (-7, 1, "assistant", says)], "conv_id long, turn long, role string, text string")
    talks = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat_format.read_back(chat_format.format_turns(talks))


@query("op10_substring_dedup")
def op10_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    cut = substring_dedup.remove_repeated_windows(table(spark, sf, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op4_fingerprints")
def op4_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints.compare_with_edited(table(spark, sf, "documents").select("doc_id", "text"))


@query("op7_lm_scoring")
def op7_lm_scoring(spark: SparkSession, sf: str) -> DataFrame:
    return lm_scoring.score_texts(table(spark, sf, "documents").select("doc_id", "text"), F.coalesce(_fold(7), F.lit(False)))


WHOLE_SQL = """SELECT vec_id, {label} AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""

OP11_SQL = f"""
WITH k AS ({WHOLE_SQL.format(label="CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")} AND label IS NOT NULL),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id AS other_id, a.label = r.label AS same,
    CAST(list_inner_product(CAST(a.v AS DOUBLE[]), CAST(r.v AS DOUBLE[])) AS BIGINT) AS score
    FROM k a JOIN k r ON a.vec_id % 100 = 0 AND r.vec_id <> a.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
n AS (SELECT s.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY s.anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
    other_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s ON s.anchor_id = p.anchor_id WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT * FROM n WHERE rank <= 10
"""


@query("op11_hard_negatives", OP11_SQL)
def op11_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0, label)


OP12_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS u, vec_id AS w FROM v UNION SELECT r.u, l.w FROM r JOIN l ON r.w = l.u),
c AS (SELECT u, min(w) AS component FROM r GROUP BY u),
n AS (SELECT u, count(*) AS n FROM l GROUP BY u)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component, vec_id) AS component_id, vec_id = coalesce(component, vec_id) AS kept
FROM embeddings LEFT JOIN c ON vec_id = c.u LEFT JOIN n ON vec_id = n.u
"""


@query("op12_embedding_dedup", OP12_SQL)
def op12_embedding_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf, "embeddings"))


def _assigned_sql(books: str) -> str:
    far = " + ".join(f"(q[{i}] - b[{i}]) * (q[{i}] - b[{i}])" for i in range(1, 5))
    return f"SELECT vec_id, label, part, any_value(q) AS q, min(({far}) * 64 + entry) AS m FROM p JOIN {books} USING (part) GROUP BY vec_id, label, part"


def _moved_sql(assigned: str, books: str) -> str:
    means = ", ".join(f"CAST(floor(sum(q[{i}]) / count(*)) AS BIGINT)" for i in range(1, 5))
    return f"""SELECT part, entry, coalesce(n.b, o.b) AS b FROM {books} o
    LEFT JOIN (SELECT part, m % 64 AS entry, [{means}] AS b FROM {assigned} GROUP BY ALL) n USING (part, entry)"""


OP13_SQL = f"""
WITH k AS ({WHOLE_SQL.format(label="label")}),
p AS (SELECT vec_id, label, part, list_slice(v, part * 4 + 1, part * 4 + 4) AS q FROM k, range(16) AS t(part)),
b0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, q AS b FROM p QUALIFY entry < 64),
a1 AS MATERIALIZED ({_assigned_sql("b0")}), b1 AS MATERIALIZED ({_moved_sql("a1", "b0")}),
a2 AS MATERIALIZED ({_assigned_sql("b1")}), b2 AS MATERIALIZED ({_moved_sql("a2", "b1")}),
a3 AS ({_assigned_sql("b2")}),
c AS (SELECT vec_id, label, string_agg(format('{{:02x}}', m % 64), '' ORDER BY part) AS code, CAST(sum(m // 64) AS BIGINT) AS error FROM a3 GROUP BY ALL),
s AS (SELECT sha256(string_agg(array_to_string(b, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c, s
"""


@query("op13_vector_codes", OP13_SQL)
def op13_vector_codes(spark: SparkSession, sf: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, sf, "embeddings"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return coded.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
