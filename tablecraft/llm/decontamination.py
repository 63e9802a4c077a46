"""Benchmark passages in training texts: find, verify, remove."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablecraft.llm.common import ascii_lower, row_key, small_or_shuffled
from tablecraft.session import materialise

WIDTH = 10
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased words: runs of a-z, 0-9 and everything beyond ASCII."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD, -1), "")


def _stride(width: int) -> int:
    """Of the runs that start at multiples of the stride, each window of ``width`` words holds one of ``_run(width)`` words."""
    return max(1, width // 2)


def _run(width: int) -> int:
    return width - _stride(width) + 1


def _run_hashes(width: int, step: int) -> Column:
    """Hashes of the runs of ``width`` words in ``_words`` that start at multiples of ``step``."""
    last = F.size("_words") - width
    starts = F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(step))
    return F.when(last >= 0, F.transform(starts, lambda i: F.xxhash64(*[F.get(F.col("_words"), i + j) for j in range(width)])))


def _window_texts(first: Column, last: Column, width: Column) -> Column:
    """(start, words) of the windows that start from ``first`` to ``last``."""
    return F.when(last >= first, F.transform(F.sequence(first, F.greatest(first, last)), lambda i: F.struct(
        i.alias("at"), F.array_join(F.slice(F.col("_words"), i + 1, width), " ").alias("words"))))


def item_windows(benchmark: DataFrame, text: str, item_id: str, width: int) -> DataFrame:
    """Windows of the test items: ``_item``, ``_width`` and the words ``_window``."""
    rows = benchmark.select(F.col(f"`{item_id}`").alias("_item"), words(F.col(f"`{text}`")).alias("_words"))
    rows = rows.withColumn("_width", F.least(F.size("_words"), F.lit(width)))
    every = _window_texts(F.lit(0), F.size("_words") - F.col("_width"), F.col("_width"))
    rows = rows.select("_item", "_width", F.explode_outer(every).alias("_w")).filter(F.col("_width") > 0)
    return rows.select("_item", "_width", F.col("_w.words").alias("_window")).distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id",
                  item_text: str = "text", item_id: str = "item_id", width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """Two frames by row key: hit word ranges (``_from``, ``_to``), and (``_item``) of occurring items.

    Texts are scanned in windows against a hash table of test n-grams. A window of 10 words holds exactly one
    run of 6 that starts at a multiple of 5, so only these runs of a text are looked up, in the table of all such runs
    of the test windows; where one is found, the windows around it are compared word by word with the test windows.
    Either table is broadcast if measured small and met by key otherwise.
    """
    saved = materialise(item_windows(benchmark, item_text, item_id, width))
    table = small_or_shuffled(saved.select("_width", "_window").distinct())
    widths = sorted(r[0] for r in saved.select("_width").distinct().collect()) or [width]  # at most ``width`` values
    own = saved.select(F.split("_window", " ").alias("_words"), "_width")
    runs = [own.filter(F.col("_width") == n).select(F.lit(n).alias("_length"), F.explode_outer(_run_hashes(_run(n), 1)).alias("_hash"))
            for n in widths]
    runs = small_or_shuffled(reduce(DataFrame.unionByName, runs).distinct())
    rows = docs.select(*row_key(doc_id, text), words(F.col(f"`{text}`")).alias("_words"))
    # explode_outer: for the inner form the optimiser would copy the run hashes into a filter
    several = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(_stride(n)).alias("k"), _run_hashes(_run(n), _stride(n)).alias("h")) for n in widths])
    rows = rows.select("_key1", "_key2", "_words", several.alias("_several"))
    rows = rows.select("_key1", "_key2", "_words", F.explode_outer("_several").alias("_w"))
    rows = rows.select("_key1", "_key2", "_words", F.col("_w.n").alias("_n"), F.col("_w.k").alias("_k"), F.posexplode_outer("_w.h").alias("_at", "_h"))
    near = rows.join(runs, (F.col("_h") == F.col("_hash")) & (F.col("_n") == F.col("_length")))
    at = F.col("_at") * F.col("_k")
    around = _window_texts(F.greatest(at - F.col("_k") + 1, F.lit(0)), F.least(at, F.size("_words") - F.col("_n")), F.col("_n"))
    near = near.select("_key1", "_key2", "_n", F.explode_outer(around).alias("_w"))
    near = near.select("_key1", "_key2", "_n", F.col("_w.at").alias("_from"), F.col("_w.words").alias("_text"))
    hits = near.join(table, (F.col("_text") == F.col("_window")) & (F.col("_n") == F.col("_width")))
    hits = hits.select("_key1", "_key2", "_from", "_n", "_window").distinct()  # repeated rows have the same key
    spans = hits.select("_key1", "_key2", "_from", (F.col("_from") + F.col("_n")).alias("_to"))
    owners = saved.select("_window", "_item")
    items = hits.select("_key1", "_key2", "_window").distinct().join(owners, "_window").select("_key1", "_key2", "_item").distinct()
    return spans, items


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id",
                       item_text: str = "text", item_id: str = "item_id", width: int = WIDTH) -> DataFrame:
    """Every row of ``docs`` with ``n_words``, ``n_hit``, ``n_items``, ``items``, ``contaminated``.

    ``items`` lists the occurring item ids, sorted as strings. The new columns replace those of
    the same names. A null or empty text, and an item without words, matches nothing; a null item id is
    not listed. Repeated rows get equal results.
    """
    spans, items = contamination(docs, benchmark, text, doc_id, item_text, item_id, width)
    order = Window.partitionBy("_key1", "_key2").orderBy("_from", "_to")
    earlier = F.coalesce(F.max("_to").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hit = spans.withColumn("_new", F.greatest(F.lit(0), F.col("_to") - F.greatest(F.col("_from"), earlier)))
    hit = hit.groupBy("_key1", "_key2").agg(F.sum("_new").alias("_hit"))
    lists = items.groupBy("_key1", "_key2").agg(F.sort_array(F.collect_set(F.col("_item").cast("string"))).alias("_items"))
    found = hit.join(lists, ["_key1", "_key2"], "left")
    new = ["n_words", "n_hit", "n_items", "items", "contaminated"]
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in new]
    rows = docs.select(*kept, F.size(words(F.col(f"`{text}`"))).cast("long").alias("n_words"), *row_key(doc_id, text))
    rows = rows.join(found, ["_key1", "_key2"], "left")
    listed = F.coalesce("_items", F.array().cast("array<string>"))
    return rows.select(*kept, "n_words", F.coalesce("_hit", F.lit(0)).cast("long").alias("n_hit"),
                       F.size(listed).cast("long").alias("n_items"), listed.alias("items"),
                       (F.coalesce("_hit", F.lit(0)) > 0).alias("contaminated"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id",
                        item_text: str = "text", item_id: str = "item_id", width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` without any test window; all columns as they were."""
    spans, _ = contamination(docs, benchmark, text, doc_id, item_text, item_id, width)
    bad = spans.select("_key1", "_key2").distinct()
    return docs.select("*", *row_key(doc_id, text)).join(bad, ["_key1", "_key2"], "left_anti").drop("_key1", "_key2")


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id",
                 item_text: str = "text", item_id: str = "item_id", width: int = WIDTH) -> DataFrame:
    """Every row of ``docs``; texts with hits become their other words, joined by one space.

    The words are those of ``words``; texts without hits and nulls stay as they are.
    """
    spans, _ = contamination(docs, benchmark, text, doc_id, item_text, item_id, width)
    ranges = spans.groupBy("_key1", "_key2").agg(F.collect_list(F.struct("_from", "_to")).alias("_spans"))
    rows = docs.select("*", *row_key(doc_id, text)).join(ranges, ["_key1", "_key2"], "left")
    rest = F.filter(words(F.col(f"`{text}`")), lambda w, i: ~F.exists("_spans", lambda s: (s["_from"] <= i) & (i < s["_to"])))
    cut = F.when(F.col("_spans").isNull(), F.col(f"`{text}`")).otherwise(F.array_join(rest, " "))
    return rows.select(*[cut.alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns])
