"""JSON payloads: messages, saved API pages, record envelopes, document ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def records(text: Column, schema: T.StructType | str, selector: str | None = None) -> Column:
    """The records of a JSON text: an array, or one object, optionally under a key.

    Text that is no JSON gives NULL.
    """
    source = F.get_json_object(text, f"$.{selector}") if selector else text
    return F.from_json(source, T.ArrayType(_struct(schema)))


def _struct(schema: T.StructType | str) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def decode_messages(df: DataFrame, record_schema: T.StructType | str, selector: str | None = None) -> DataFrame:
    """Message values to records plus ``_kafka_*`` origin columns; non-JSON is dropped.

    Works on a batch and on a stream with value, topic, partition, offset and timestamp.
    """
    value = F.col("value").cast("string")
    return df.select(
        F.inline(records(value, record_schema, selector)),
        F.col("offset").alias("_kafka_offset"), F.col("partition").alias("_kafka_partition"),
        F.col("timestamp").alias("_kafka_timestamp"), F.col("topic").alias("_kafka_topic"))


def reject_reason(text: Column, schema: T.StructType | str, selector: str | None = None) -> Column:
    """Why a text gives no records, not even an empty list; NULL if it does."""
    found = records(text, schema, selector)
    reason = F.when(text.isNull(), "no text").when(F.try_parse_json(text).isNull(), "no JSON")
    if selector:
        reason = reason.when(F.get_json_object(text, f"$.{selector}").isNull(), f"nothing under {selector}")
    return F.when(found.isNull(), reason.otherwise("no records"))


def rejected_messages(df: DataFrame, record_schema: T.StructType | str, selector: str | None = None) -> DataFrame:
    """The messages that ``decode_messages`` drops, as text with the reason and their origin. Works on a stream as well."""
    value = F.col("value").cast("string")
    return df.select(
        value.alias("value"), reject_reason(value, record_schema, selector).alias("reason"), F.col("offset").alias("_kafka_offset"),
        F.col("partition").alias("_kafka_partition"), F.col("timestamp").alias("_kafka_timestamp"),
        F.col("topic").alias("_kafka_topic")).filter(F.col("reason").isNotNull())


def read_messages(spark, servers: str, topic: str, **options) -> DataFrame:
    """Stream of a Kafka topic from its beginning (needs the Kafka connector package)."""
    return (spark.readStream.format("kafka").options(**{
        "kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest", **options}).load())


def explode_payloads(df: DataFrame, schema: T.StructType | str, selector: str | None = None,
                     payload: str = "payload", keep: tuple[str, ...] = ()) -> DataFrame:
    """Saved API pages to rows; an empty page gives none."""
    return df.select(*keep, F.inline(records(F.col(payload), schema, selector)))


def rejected_payloads(df: DataFrame, schema: T.StructType | str, selector: str | None = None, payload: str = "payload",
                      keep: tuple[str, ...] = ()) -> DataFrame:
    """The pages that ``explode_payloads`` cannot read, as text with the reason."""
    text = F.col(payload)
    return df.select(*keep, text, reject_reason(text, schema, selector).alias("reason")).filter(F.col("reason").isNotNull())


def page_report(df: DataFrame, schema: T.StructType | str, selector: str | None = None, payload: str = "payload",
                by: tuple[str, ...] = ()) -> DataFrame:
    """Pages fetched, read, empty and rejected, and the records in them, in one pass."""
    size = F.size(records(F.col(payload), schema, selector))
    return df.select(*by, size.alias("_size")).groupBy(*by).agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(F.col("_size") > 0).alias("read"), F.count_if(F.col("_size") == 0).alias("empty"),
        F.count_if(F.coalesce(F.col("_size"), F.lit(-1)) < 0).alias("rejected"),
        F.sum(F.greatest(F.col("_size"), F.lit(0)).cast("bigint")).alias("records"))


def project_fields(df: DataFrame, schema: T.StructType | str, payload: str = "payload",
                   selector: str | None = "records") -> DataFrame:
    """Pages of record envelopes ``{"id": .., "fields": {..}}`` to the columns of ``fields``."""
    envelope = T.StructType([T.StructField("fields", _struct(schema))])
    return explode_payloads(df, envelope, selector, payload).select("fields.*")


def normalise_id(df: DataFrame, key: str = "_id") -> DataFrame:
    """Document id as text."""
    return df.withColumn(key, F.col(key).cast("string")) if key in df.columns else df
