"""Versioned column catalog: changes, tags, labels and reads.

A catalog row describes one version of one column of one table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecraft.functions import fixed_values as fixed
from tablecraft.operators.windows import latest_by

COLUMN_KEY = ["table_name", "original_column_name"]


def drop_system(cols: DataFrame, prefix: str = fixed.SYSTEM_PREFIX) -> DataFrame:
    """Leave out system tables and system columns."""
    return cols.filter(~F.col("table_name").startswith(prefix) & ~F.col("original_column_name").startswith(prefix))


def catalog_diff(catalog: DataFrame, current: DataFrame, whole_rows: bool = False) -> DataFrame:
    """New catalog rows that bring ``catalog`` up to the ``current`` columns.

    Where both sides name a pipeline, tables are compared within it, and ``pipeline`` is the first
    column. ``whole_rows`` gives all columns of ``catalog``, ready to append: those ``current`` does not
    give, such as the labels, are carried over from the last version.

    A new column gets version 1; a changed type or a column that came back gets the next
    version; a column that vanished from a table still present gets the next version as
    deleted; an unchanged column gives no row.
    """
    owner = ["pipeline"] if "pipeline" in catalog.columns and "pipeline" in current.columns else []
    key = [*owner, *COLUMN_KEY]
    old = latest_by(catalog, key, "column_version").select(
        *key, F.col("data_type").alias("_type"), F.col("column_version").alias("_version"),
        (F.col("is_deleted") == 1).alias("_gone"), F.struct(*catalog.columns).alias("_old"))
    new = current.select(*key, F.col("data_type").alias("_now"), F.lit(True).alias("_here"), F.struct(*current.columns).alias("_new"))
    known = old.join(current, [*owner, "table_name"], "left_semi")
    both = known.join(new, key, "full")
    is_new = F.col("_version").isNull()
    changed = F.col("_here") & ((F.col("_type") != F.col("_now")) | F.col("_gone"))
    vanished = F.col("_here").isNull() & ~F.col("_gone")
    made = {"data_type": F.coalesce("_now", "_type"),
            "column_version": F.when(is_new, F.lit(1)).otherwise(F.col("_version") + 1).cast("int"),
            "is_deleted": F.when(vanished, 1).otherwise(0)}
    rows = both.filter(is_new | changed | vanished)
    if not whole_rows:
        return rows.select(*key, *[c.alias(n) for n, c in made.items()])

    def carried(name: str) -> Column:
        sides = [F.col(f"_new.`{name}`")] * (name in current.columns) + [F.col(f"_old.`{name}`")]
        return made.get(name, F.col(name) if name in key else F.coalesce(*sides)).cast(catalog.schema[name].dataType)

    return rows.select(*[carried(c).alias(c) for c in catalog.columns])


def tag_columns(cols: DataFrame, rules: list[tuple[str, str, float]] | None = None) -> DataFrame:
    """Concept and confidence by the first name rule that matches; NULL when none does."""
    name = F.lower("original_column_name")
    concept, confidence = F.lit(None).cast("string"), F.lit(None).cast("double")
    for pattern, tag, score in reversed(fixed.TAG_RULES if rules is None else rules):
        hit = name.rlike(f"(?i){pattern}")
        concept, confidence = F.when(hit, tag).otherwise(concept), F.when(hit, score).otherwise(confidence)
    tagged = cols.withColumns({"semantic_concept": concept, "confidence_score": confidence})
    matched = F.col("semantic_concept").isNotNull()
    return tagged.withColumns({"source": F.when(matched, "rule"), "description": F.when(matched, "")})


def attach_labels(cols: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels per (table, column); without a label '' and 0.0; nothing is validated yet."""
    texts = ["semantic_concept", "description", "source"]
    given = labels.select(*COLUMN_KEY, *[F.col(c).alias(f"_{c}") for c in [*texts, "confidence_score"]])
    rest = [c for c in cols.columns if c not in [*texts, "confidence_score", "validated", "validated_by", "validated_at"]]
    return cols.select(*rest).join(given, COLUMN_KEY, "left").select(
        *rest, *[F.coalesce(f"_{c}", F.lit("")).alias(c) for c in texts],
        F.coalesce("_confidence_score", F.lit(0.0)).alias("confidence_score"),
        F.lit(0).alias("validated"), F.lit("").alias("validated_by"), F.lit("").alias("validated_at"))


def update_semantics(catalog: DataFrame, edits: DataFrame, at: str) -> DataFrame:
    """The catalog after user edits of concept and description.

    Edits have pipeline, table_name, name, semantic, confidence, sem_source, validated and
    description. Only changed columns are touched: their latest row, edited, replaces all
    their rows.
    """
    key = ["pipeline", *COLUMN_KEY]
    latest = latest_by(catalog, key, "ingested_at", "column_version")
    wanted = edits.select("pipeline", "table_name", F.col("name").alias("original_column_name"), *[
        F.col(c).alias(f"_{c}") for c in ("semantic", "confidence", "sem_source", "validated", "description")])
    hit = latest.join(wanted, key)
    changed = hit.filter(~(F.col("_semantic").eqNullSafe(F.coalesce("semantic_concept", F.lit(""))))
                         | ~(F.col("_description").eqNullSafe(F.coalesce("description", F.lit("")))))
    edited = changed.withColumns({
        "semantic_concept": F.col("_semantic"), "confidence_score": F.col("_confidence"),
        "source": F.col("_sem_source"), "validated": F.col("_validated"), "description": F.col("_description"),
        "validated_by": F.lit(""), "validated_at": F.when(F.col("_validated") == 1, at).otherwise(""),
        "ingested_at": F.lit(at)}).select(*catalog.columns)
    untouched = catalog.join(changed.select(*key), key, "left_anti").select(*catalog.columns)
    return untouched.unionByName(edited)


def catalog_of(catalog: DataFrame, pipeline: str, details: bool = False, latest: bool = True) -> DataFrame:
    """Columns of one pipeline: the latest version of each, or all versions."""
    rows = catalog.filter(F.col("pipeline") == pipeline.replace("-", "_"))
    rows = latest_by(rows, COLUMN_KEY, "column_version") if latest else rows
    shown = [F.col("column_name").alias("name"), "table_name", "source_store"]
    more = ["data_type", "is_deleted", "column_version", "semantic_concept", "confidence_score", "validated", "source",
            "description"]
    return rows.select(*shown, *(more if details else []))


def filter_catalog(catalog: DataFrame, text: str = "", status: str = "all") -> DataFrame:
    """Columns whose name contains the text and that are active, deleted, evolved or pending."""
    live = F.col("is_deleted") == 0
    untagged = F.coalesce("semantic_concept", F.lit("")) == ""
    tests = {"active": live, "deleted": ~live, "evolved": F.col("column_version") > 1, "pending": untagged & live}
    out = catalog.filter(F.contains(F.lower("column_name"), F.lit(text.lower()))) if text else catalog
    return out.filter(tests[status]) if status in tests else out


def column_totals(catalog: DataFrame) -> DataFrame:
    """Active and deleted columns per table."""
    return catalog.groupBy("table_name").agg(
        F.count_if(F.col("is_deleted") == 0).alias("active"), F.count_if(F.col("is_deleted") == 1).alias("deleted"))


def describe_columns(catalog: DataFrame, pipeline: str | None = None) -> DataFrame:
    """One line of text per column, the input of an embedder."""
    owner = F.lit(pipeline) if pipeline else F.col("pipeline")
    line = F.concat(F.lit("Pipeline: "), owner, F.lit(" | Table: "), "table_name", F.lit(" | Column "), "column_name",
                    F.lit(" | Concept: "), F.coalesce("semantic_concept", F.lit("")),
                    F.lit(" | Description "), F.coalesce("description", F.lit("")))
    return catalog.select("table_name", "column_name", line.alias("text"))


def domain_rows(meta: DataFrame, ns: str) -> DataFrame:
    """Domain pipelines of a namespace."""
    return (meta.filter((F.col("namespace") == ns) & (F.col("domain_pipeline") == "true"))
            .select("pipeline", "dataset_name", "namespace"))


def endpoints(meta: DataFrame, ns: str) -> DataFrame:
    """Source and destination of each pipeline as a JSON list."""
    entry = F.struct("source_type", "dest_type", F.col("dest_secret_name").alias("connection_name"),
                     F.col("dataset_name").alias("dbname"))
    return (meta.filter(F.col("namespace") == ns).groupBy("pipeline")
            .agg(F.to_json(F.sort_array(F.collect_list(entry))).alias("endpoints_json")))


def endpoint_types(meta: DataFrame, ns: str) -> DataFrame:
    """Source and destination types of a namespace: a JSON object per metadata row, absent columns as null.

    One row each instead of one list, which would put a whole namespace into a cell.
    """
    whole = add_missing(meta.filter(F.col("namespace") == ns), dict.fromkeys(fixed.ENDPOINT_KEYS.values(), "string"))
    entry = F.struct(*[F.col(c).alias(k) for k, c in fixed.ENDPOINT_KEYS.items()])
    return whole.select("pipeline", F.to_json(entry, {"ignoreNullFields": "false"}).alias("types_json"))


def add_missing(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Columns that are not there yet are added as NULL of the given type."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def mask_secrets(df: DataFrame, col: str, keys: list[str] | None = None) -> DataFrame:
    """Mask the values of secret keys in JSON text, and passwords inside URLs in any text."""
    secret = F.lit(fixed.SECRET_MASK)
    names = fixed.SECRET_KEYS if keys is None else keys
    entries = F.from_json(F.col(col), "map<string,string>")
    masked = F.to_json(F.transform_values(entries, lambda k, v: F.when(k.isin(names), secret).otherwise(v)))
    text = F.coalesce(masked, F.col(col))
    hidden = F.regexp_replace(text, fixed.URL_PASSWORD_PATTERN, f"$1{fixed.URL_PASSWORD_MASK}$2")
    return df.withColumn(col, hidden)
