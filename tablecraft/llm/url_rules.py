"""URL filters: fixed host and path rules, and rules mined by FP-growth from labelled pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecraft.llm.common import ascii_lower, small_or_shuffled
from tablecraft.session import materialise

MIN_PAGES = 10
MIN_LIFT = 2.0
BLOCK = "=block"
#: (host, path, verdict); a rule fits the host and its subdomains.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct of the longest fitting rule (``rule``, ``verdict``), null if none fits."""
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p),
                   F.struct(F.lit(len(h + p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in rules]
    return F.array_max(F.array(*fits))


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """What a URL is made of: labels of the host, its ends, segments of the path with digits as #, keys of the query."""
    labels = F.split(host, r"\.", -1)
    ends = F.transform(labels, lambda x, i: F.concat(F.lit("end:"), F.array_join(F.slice(labels, i + 1, F.size(labels)), ".")))
    plain = lambda x: F.regexp_replace(F.lower(x), r"\d+", "#")
    parts = F.transform(F.split(path, "/", -1), lambda x: F.concat(F.lit("path:"), plain(x)))
    query = F.split(F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1), "&", -1)
    keys = F.transform(query, lambda x: F.concat(F.lit("key:"), F.split(x, "=", -1)[0]))
    words = F.transform(labels, lambda x: F.concat(F.lit("label:"), x))
    every = F.array_distinct(F.concat(words, ends, parts, keys))
    return F.array_sort(F.filter(every, lambda x: ~x.isin("label:", "end:", "path:", "path:#", "key:")))


def mine_rules(pages: DataFrame, min_pages: int = MIN_PAGES, min_lift: float = MIN_LIFT) -> DataFrame:
    """(``_tokens``, ``_confidence``): token combinations of labelled ``pages`` (``_tokens``, ``_bad``) that call for a block.

    FP-growth over all labelled pages; a rule stands on at least ``min_pages`` bad pages, whatever the size of the table, its share of bad pages is at
    least ``min_lift`` times that of all labelled pages (or all of its pages are bad, if that is less), and it is dropped when fewer of
    its tokens do as well. Without labelled or without bad pages there is no rule.
    """
    pages = materialise(pages.select(F.when(F.col("_bad"), F.array_append("_tokens", F.lit(BLOCK))).otherwise(F.col("_tokens")).alias("items")))
    total, bad = pages.agg(F.count(F.lit(1)), F.count_if(F.array_contains("items", BLOCK))).first()
    if bad < min_pages:
        return pages.sparkSession.createDataFrame([], "_tokens array<string>, _confidence double")
    # half a page less, so that rounding does not ask for one more
    sets = materialise(FPGrowth(itemsCol="items", minSupport=(min_pages - 0.5) / total).fit(pages).freqItemsets)
    blocked = F.array_contains("items", BLOCK)
    bad_sets = sets.filter(blocked & (F.size("items") > 1)).select(F.array_sort(F.array_remove("items", BLOCK)).alias("_tokens"), F.col("freq").alias("_bad"))
    all_sets = sets.filter(~blocked).select(F.array_sort("items").alias("_tokens"), F.col("freq").alias("_pages"))
    rules = bad_sets.join(all_sets, "_tokens").select("_tokens", (F.col("_bad") / F.col("_pages")).alias("_confidence"))
    rules = materialise(rules.filter(F.col("_confidence") >= min(1.0, min_lift * bad / total)))
    shorter = rules.select(F.col("_tokens").alias("_part"), F.col("_confidence").alias("_part_confidence"))
    parts = rules.withColumn("_left_out", F.explode("_tokens")).withColumn("_part", F.array_sort(F.array_remove("_tokens", F.col("_left_out"))))
    # of two rules that do equally well, both stay if neither is part of the other
    weaker = parts.join(shorter, "_part").filter(F.col("_part_confidence") >= F.col("_confidence")).select("_tokens").distinct()
    return rules.join(weaker, "_tokens", "left_anti")


def match_rules(patterns: DataFrame, rules: DataFrame) -> DataFrame:
    """(``_pattern``, ``_confidence``) of the best rule of each pattern (``_pattern``, ``_tokens``) that one fits.

    The inverted index lists each rule under its rarest token; a pattern meets only the rules listed under its own tokens.
    """
    owned = patterns.select("_pattern", "_tokens", F.explode("_tokens").alias("_token"))
    frequency = owned.groupBy("_token").agg(F.count(F.lit(1)).alias("_times"))
    rules = rules.withColumn("_rule", F.array_join("_tokens", "\n"))
    listed = rules.select("_rule", "_confidence", F.explode("_tokens").alias("_token")).join(frequency, "_token", "left")
    index = listed.groupBy("_rule", "_confidence").agg(F.min(F.struct(F.coalesce("_times", F.lit(0)).alias("n"), "_token"))["_token"].alias("_rarest"))
    index = small_or_shuffled(index)
    met = owned.join(index, F.col("_token") == F.col("_rarest"))
    met = met.filter(F.size(F.array_except(F.split("_rule", "\n", -1), "_tokens")) == 0)
    return met.groupBy("_pattern").agg(F.max("_confidence").alias("_confidence"))


def judge_urls(pages: DataFrame, labels: DataFrame, url: str = "url", page_id: str = "page_id",
               rules: Sequence[tuple[str, str, str]] = tuple(RULES)) -> DataFrame:
    """Every row of ``pages`` with ``host``, ``path``, ``rule``, ``verdict``, ``confidence``, which replace columns of these names.

    ``labels`` (``doc_id``, ``toxic``) names bad pages. The longest fitting fixed rule decides; otherwise a mined rule
    blocks (``confidence`` is the highest of those that fit), and all else is allowed; URLs of any length are read whole, and an empty table gives no rows. A null URL and one without ``://`` have empty host and path and no tokens. Pages are judged once per
    set of tokens, so a host with most of the pages costs no more than its distinct shapes. Repeated rows and repeated labels
    count each; a null label is no label.
    """
    new = ["host", "path", "rule", "verdict", "confidence"]
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in new]
    address = F.col(f"`{url}`")
    rows = pages.select(*kept, host_of(address).alias("_host"), path_of(address).alias("_path"))
    tokens = url_tokens(address, F.col("_host"), F.col("_path"))
    rows = rows.withColumn("_tokens", F.when(F.col("_host") == "", F.array().cast("array<string>")).otherwise(tokens))
    rows = rows.withColumn("_pattern", F.xxhash64("_tokens"))
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_labelled"), (F.col("toxic") == 1).alias("_bad"))
    labelled = rows.join(known, F.col(f"`{page_id}`") == F.col("_labelled")).filter(F.size("_tokens") > 0).select("_tokens", "_bad")
    patterns = materialise(rows.groupBy("_pattern").agg(F.first("_tokens").alias("_tokens")))
    best = match_rules(patterns, mine_rules(labelled)).withColumnRenamed("_pattern", "_judged")
    rows = rows.join(small_or_shuffled(best), F.col("_pattern") == F.col("_judged"), "left")
    fixed = fixed_rule(F.col("_host"), F.col("_path"), rules)
    rows = rows.withColumn("_fixed", fixed)
    verdict = F.coalesce(F.col("_fixed.verdict"), F.when(F.col("_confidence").isNotNull(), "block").otherwise("allow"))
    return rows.select(*kept, F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_fixed.rule").alias("rule"), verdict.alias("verdict"),
                       F.col("_confidence").alias("confidence"))
