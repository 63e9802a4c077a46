"""Removal of lines that most pages of a site repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecraft.llm.common import BROADCAST_BYTES, measured

MAX_RATIO = 0.1
MIN_PAGES = 4


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate(docs: DataFrame, text: str, host: str, max_ratio: float, min_pages: int) -> DataFrame:
    """One row per host with ``_drop``: hashes of the lines on more than ``max_ratio`` of its pages.

    A page counts once for a line it repeats. Counts are combined before the shuffle, so a hot
    host or line sends one row per task. A host has fewer than (its mean lines per page) /
    ``max_ratio`` such lines, whatever its size, so the list in a cell stays short.
    """
    pages = docs.select(F.col(f"`{host}`").alias("_host"), F.col(f"`{text}`").alias("_text"))
    totals = pages.groupBy("_host").agg(F.count(F.lit(1)).alias("_pages"))
    distinct = F.array_distinct(F.transform(F.filter(lines_of(F.col("_text")), lambda x: x != ""), lambda x: F.xxhash64(x)))
    counts = (pages.select("_host", F.explode(distinct).alias("_line"))
              .groupBy("_host", "_line").agg(F.count(F.lit(1)).alias("_with")).filter(F.col("_with") >= min_pages))
    totals = totals.withColumnRenamed("_host", "_site")
    common = counts.join(totals, F.col("_host").eqNullSafe(F.col("_site")))
    common = common.filter(F.col("_with") / F.col("_pages") > max_ratio)
    return common.groupBy("_site").agg(F.sort_array(F.collect_list("_line")).alias("_drop"))


def drop_boilerplate_lines(docs: DataFrame, text: str = "text", host: str = "source",
                           max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """All rows of ``docs`` with the boilerplate lines of their host cut out of ``text``.

    Lines end at a line feed. A line goes if it stands on at least ``min_pages`` pages of the host
    and on more than the share ``max_ratio`` of all its pages; rows without text count as pages.
    Adds ``n_lines`` and ``n_dropped``, which replace columns of these names. Every row stays:
    a null text stays null with 0 lines, an empty text has one empty line, empty lines are never
    dropped, repeated rows count as pages of their own, rows with a null host form one host.
    """
    lists = boilerplate(docs, text, host, max_ratio, min_pages)
    flat, size = measured(lists.select("_site", F.explode("_drop").alias("_line")))
    lists = flat.groupBy("_site").agg(F.sort_array(F.collect_list("_line")).alias("_drop"))
    lists = F.broadcast(lists) if size <= BROADCAST_BYTES else lists
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept]).join(lists, F.col(f"`{host}`").eqNullSafe(F.col("_site")), "left")
    rows = rows.withColumn("_lines", lines_of(F.col(f"`{text}`")))
    hashes = F.transform("_lines", lambda x: F.xxhash64(x))
    rows = rows.withColumn("_here", F.when(F.col("_drop").isNotNull(), F.array_intersect(hashes, "_drop")))
    rows = rows.withColumn("_kept", F.when(F.size("_here") > 0, F.filter(
        "_lines", lambda x: (x == "") | ~F.array_contains("_here", F.xxhash64(x)))).otherwise(F.col("_lines")))
    count = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("long")
    cut = F.when(F.size("_here") > 0, F.array_join("_kept", "\n")).otherwise(F.col(f"`{text}`"))
    return rows.select(*[cut.alias(text) if c == text else F.col(f"`{c}`") for c in kept], count("_lines").alias("n_lines"),
                       (count("_lines") - count("_kept")).alias("n_dropped"))
