"""Mixing sources to target weights by Sainte-Laguë apportionment of equal blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablecraft.llm.common import running_before
from tablecraft.session import materialise

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS = 16
SHARD_WORDS = 1 << 18
BUCKETS = 1 << 16
MAX_REPEAT = 3
SEED = 20240117


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """Never null; sorts by code point with null last."""
    return F.when(source.isNull(), "1").otherwise(F.concat(F.lit("0"), source.cast("string")))


def cycled_weights(sources: DataFrame, cycle: int = 3) -> DataFrame:
    """(``_source``, ``_weight``): the sources in order of ``_source`` weigh 1, 2, .. ``cycle``, repeating."""
    ranked = running_before(sources.select("_source").distinct(), [], ["_source"], F.lit(1), "_rank")
    return ranked.select("_source", (F.col("_rank") % cycle + 1).cast("double").alias("_weight"))


def target_sizes(sizes: DataFrame, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``_target`` for each (``_source``, ``_size``, ``_weight``): shares of the total by weight, none above
    ``max_repeat`` times the source's size; what is above is shared out again by weight.

    The result is min(level * weight, cap) for one level, found over the sources ordered by cap / weight.
    """
    cap, at = F.col("_size") * float(max_repeat), ["_full_at", "_source"]
    rows = sizes.withColumn("_full_at", cap / F.col("_weight"))
    rows = running_before(rows, [], at, cap, "_caps_before")
    rows = running_before(rows, [], at, F.col("_weight"), "_weights_before")
    rows = rows.withColumn("_one", F.lit(1))
    sums = rows.groupBy("_one").agg(F.sum(F.col("_size").cast("double")).alias("_all"), F.sum("_weight").alias("_weights"))
    rows = rows.join(F.broadcast(sums), "_one")  # one row
    level = (F.col("_all") - F.col("_caps_before")) / (F.col("_weights") - F.col("_weights_before"))
    fits = F.when(level <= F.col("_full_at"), F.struct("_full_at", "_source", level.alias("level")))
    found = rows.groupBy("_one").agg(F.min(fits)["level"].alias("_level"))
    rows = rows.join(F.broadcast(found), "_one")  # one row
    return rows.withColumn("_target", F.least(F.col("_level") * F.col("_weight"), cap)).drop(
        "_one", "_all", "_weights", "_level", "_full_at", "_caps_before", "_weights_before")


def apportion(rows: DataFrame, group: list[str], key: list[str], votes: str, seats: str) -> DataFrame:
    """Sainte-Laguë: deal the ``seats`` of each group to its rows by the highest quotients votes / (2k - 1).

    Adds ``_won``. The divisor bounds every row's seats from both sides up to a few, so only about
    four quotients a row are ranked, whatever the number of seats. Ties go by ``key``.
    """
    if group:
        sums = rows.groupBy(*group).agg(F.sum(votes).alias("_votes"), F.count(F.lit(1)).alias("_n"))
        rows = rows.join(sums, group)
    else:
        sums = rows.agg(F.sum(votes).alias("_votes"), F.count(F.lit(1)).alias("_n"))
        rows = rows.withColumn("_one", F.lit(1)).join(F.broadcast(sums.withColumn("_one", F.lit(1))), "_one").drop("_one")
    share = F.when(F.col("_votes") > 0, F.col(votes) / F.col("_votes")).otherwise(0.0)
    low = F.floor(share * F.greatest(F.col(seats) - F.col("_n") / 2, F.lit(0.0)) + 0.5) - 1
    rows = rows.withColumn("_low", F.greatest(low, F.lit(0)))
    rows = rows.withColumn("_high", F.when(share > 0, F.floor(share * (F.col(seats) + F.col("_n") / 2 + 1) + 0.5) + 1).otherwise(0))
    rows = materialise(rows)
    dealt = rows.filter(F.col("_high") > F.col("_low"))
    dealt = dealt.select(*group, *key, votes, F.explode(F.sequence(F.col("_low") + 1, "_high")).alias("_k"))
    dealt = dealt.withColumn("_quotient", F.col(votes) / (2 * F.col("_k") - 1))
    dealt = running_before(dealt, group, [F.col("_quotient").desc(), *key], F.lit(1), "_rank")
    if group:
        left = rows.groupBy(*group).agg((F.first(seats) - F.sum("_low")).alias("_left"))
        dealt = dealt.join(left, group)
    else:
        left = rows.agg((F.first(seats) - F.sum("_low")).alias("_left"))
        dealt = dealt.withColumn("_one", F.lit(1)).join(F.broadcast(left.withColumn("_one", F.lit(1))), "_one")
    won = dealt.filter(F.col("_rank") < F.col("_left")).groupBy(*group, *key).agg(F.count(F.lit(1)).alias("_more"))
    rows = rows.join(won, [*group, *key], "left")
    return rows.withColumn("_won", (F.col("_low") + F.coalesce("_more", F.lit(0))).cast("long")).drop(
        "_votes", "_n", "_low", "_high", "_more")


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, text: str = "text", doc_id: str = "doc_id",
                source: str = "source", max_repeat: int = MAX_REPEAT, block_words: int = BLOCK_WORDS,
                shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """Every row of ``docs`` with ``size``, ``source_size``, ``target``, ``taken``.

    ``taken`` is the number of the row's words in the mix, repeats counted, at most ``max_repeat`` times
    ``size``. ``weights`` has a ``_source`` as ``source_key`` makes it and a positive ``_weight``; without it
    the sources weigh 1, 2, 3, repeating. The total is shared in blocks of ``block_words`` words: by highest quotients to the
    sources, then to the shards of a source (about ``shard_words`` words each, dealt by a hash of the id).
    A shard lays its rows out in seeded order as one line of words and takes its quota of blocks from the
    start, beginning again at the end, so any two runs agree. New columns replace those of the same names.
    A shard takes whole blocks, at most ``max_repeat`` times its words: a source whose words times ``max_repeat`` are below one block takes
    nothing, and one at its cap may fall short by up to about one block a shard; these blocks are not dealt to others.
    A null text has size 0 and takes nothing; null is a source; repeated rows count each; an empty table gives no rows.
    """
    new = ["size", "source_size", "target", "taken"]
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in new]
    order = F.xxhash64(F.lit(seed), F.col(f"`{doc_id}`"), F.col(f"`{doc_id}`").isNull())
    bucket = F.pmod(F.xxhash64(F.lit(seed + 1), F.col(f"`{doc_id}`")), F.lit(BUCKETS))
    sized = docs.select(*kept, word_count(F.col(f"`{text}`")).alias("size"), source_key(F.col(f"`{source}`")).alias("_source"),
                        bucket.alias("_bucket"), order.alias("_order"))
    parts = materialise(sized.groupBy("_source", "_bucket").agg(F.sum("size").alias("_words")))
    sizes = parts.groupBy("_source").agg(F.sum("_words").alias("_size"))
    weights = cycled_weights(parts) if weights is None else weights
    plan = materialise(target_sizes(sizes.join(weights, "_source"), max_repeat))
    total = plan.agg(F.floor(F.sum("_target") / block_words + 1e-9)).first()[0] or 0
    plan = apportion(plan.withColumn("_blocks", F.lit(int(total)).cast("long")), [], ["_source"], "_target", "_blocks")
    plan = materialise(plan.select("_source", "_size", "_target", F.col("_won").alias("_quota"),
                                   (F.floor(F.col("_size") / shard_words) + 1).alias("_shards")))
    shard = F.floor(F.col("_bucket") * F.col("_shards") / BUCKETS)
    shards = parts.join(plan, "_source").withColumn("_shard", shard)
    shards = shards.groupBy("_source", "_shard").agg(F.sum("_words").cast("double").alias("_line"), F.first("_quota").alias("_quota"))
    shards = apportion(shards, ["_source"], ["_shard"], "_line", "_quota")
    most = F.floor(F.col("_line") * max_repeat / block_words)
    shards = materialise(shards.select("_source", "_shard", F.col("_line").cast("long").alias("_line"),
                                       (F.least(F.col("_won"), most) * block_words).cast("long").alias("_take")))
    rows = sized.join(plan.select("_source", "_size", "_target", "_shards"), "_source").withColumn("_shard", shard)
    rows = rows.join(shards, ["_source", "_shard"])
    seeded = Window.partitionBy("_source", "_shard").orderBy("_order", f"`{doc_id}`", "size")
    start = F.coalesce(F.sum("size").over(seeded.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_start", start)
    rounds = F.when(F.col("_line") > 0, F.floor(F.col("_take") / F.col("_line"))).otherwise(0).cast("long")
    rest = F.col("_take") - rounds * F.col("_line")
    taken = rounds * F.col("size") + F.greatest(F.lit(0), F.least(F.col("_start") + F.col("size"), rest) - F.col("_start"))
    return rows.select(*kept, "size", F.col("_size").alias("source_size"), F.col("_target").alias("target"),
                       taken.cast("long").alias("taken"))
