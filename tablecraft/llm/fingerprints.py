"""Document fingerprints by consistent weighted sampling."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablecraft.llm.common import BLANK, row_key, running_before
from tablecraft.session import materialise

SAMPLES = 128
# Terms of a key that a sample compares, on average.
EXPECTED = 24.0
# Cells of the table of r up to which a term is judged by c alone, before either is read.
STEPS = (110, 160, 200, 230)
SCALE = float(1 << 24)
CELLS = 256
FIRST_CELLS = 16


def _gamma_quantiles() -> np.ndarray:
    """Values x at which the Gamma(2, 1) distribution 1 - (1 + x) exp(-x) reaches (i / CELLS) squared; the last stands for the open end."""
    share = (np.append(np.arange(CELLS), CELLS - 0.25) / CELLS) ** 2
    low, high = np.zeros(CELLS + 1), np.full(CELLS + 1, 60.0)
    for _ in range(80):
        mid = (low + high) / 2
        below = -np.expm1(-mid) - mid * np.exp(-mid) < share
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


def _between(table: np.ndarray, cell: Column, rest: Column) -> Column:
    """Linear interpolation of a table, ``rest`` after a cell."""
    return F.get(F.lit(table[:-1]), cell) + rest * F.get(F.lit(np.diff(table)), cell)


def _held(value: Column) -> Column:
    """The value, in a projection that the optimizer neither merges nor moves a filter below, which would compute its inputs twice."""
    return F.when(F.spark_partition_id() >= 0, value)


def _sampled(rows: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and ``_s``, the sampled (term, level) of one term in sample ``_at`` as a number that sorts by the sample's key, for the log weight
    ``_w``; only those with a key below ``_limit``, and all of sample 0.

    r and c are Gamma(2, 1), beta is uniform, all fixed by term and number of the sample: t = floor(ln w / r + beta) and
    ln a = ln c - r * (t - beta + 1). The term of the smallest a is the sample, and two weighted sets have the same sample with
    probability sum(min) / sum(max) of their weights. r and ln c are read from tables of quantiles at the square root of a uniform number, which
    saves the logarithms; below ``FIRST_CELLS`` ln c follows the series of the quantile. That is off by less than 0.001 of the value but for
    the largest one in a hundred, far below what 128 samples can tell. Each step is a projection, so that nothing is computed twice.
    As ln a is at least ln c - ln w - r, many terms are out by the bits of their hash (``_bars``) and most before beta is drawn.
    """
    quantiles = _gamma_quantiles()
    low = lambda c: c.bitwiseAND(F.lit(0xFFFFFFFF)).cast("double") + 0.5
    high = lambda c: F.shiftrightunsigned(c, 32).cast("double") + 0.5
    scale = CELLS / 65536
    own = [*keep, "_at", "_w", "_limit"]
    bars = [f"_bar{k}" for k in range(len(STEPS))]
    rows = rows.select(*own, *bars, _held(F.xxhash64("_term", "_at")).alias("_h"))
    out = [(F.col("_h").bitwiseAND(F.lit(0xFFFFFFFF)) < int((step / CELLS) ** 2 * 2 ** 32)) & (F.shiftrightunsigned("_h", 32) > F.col(bar)) for step, bar in zip(STEPS, bars, strict=True)]
    rows = rows.filter(~reduce(lambda x, y: x | y, out) | (F.col("_at") == 0))
    rows = rows.select(*own, "_h", (F.sqrt(low(F.col("_h"))) * scale).alias("_r"), (F.sqrt(high(F.col("_h"))) * scale).alias("_c"))
    rows = rows.select(*own, "_h", "_r", "_c", F.col("_r").cast("int").alias("_ri"), F.col("_c").cast("int").alias("_ci"))
    logs = np.log(np.maximum(quantiles, 1e-9))
    s = F.col("_c") * (2 ** 0.5 / CELLS)
    series = F.log(s * (1 + s * (F.lit(1 / 3) + s * (F.lit(11 / 72) + s * F.lit(43 / 540)))))
    between = lambda table, x: _between(table, F.col(f"_{x}i"), F.col(f"_{x}") - F.col(f"_{x}i"))
    rows = rows.select(*own, "_h", _held(between(quantiles, "r")).alias("_r"), F.when(F.col("_ci") < FIRST_CELLS, series).otherwise(between(logs, "c")).alias("_c"))
    rows = rows.filter((F.col("_c") - F.col("_r") < F.col("_w") + F.col("_limit") + 1e-6) | (F.col("_at") == 0))
    rows = rows.select(*own, "_r", "_c", F.xxhash64("_h").alias("_g"))
    rows = rows.select(*own, "_r", "_c", (low(F.col("_g")) * 2.0 ** -32).alias("_b"), F.shiftrightunsigned("_g", 32).alias("_g"))
    rows = rows.select(*own, "_r", "_c", "_b", "_g", F.floor(F.col("_w") / F.col("_r") + F.col("_b")).alias("_t"))
    rows = rows.select(*own, "_g", "_t", _held(F.col("_c") - F.col("_r") * (F.col("_t") - F.col("_b") + 1)).alias("_a"))
    rows = rows.filter((F.col("_a") < F.col("_limit")) | (F.col("_at") == 0))
    code = (F.col("_g") + F.col("_t")).bitwiseAND(F.lit(0xFFFFFF))
    return rows.select(*keep, "_at", F.shiftleft((F.col("_a") * SCALE).cast("long"), 24).bitwiseOR(code).alias("_s"))


def _bars(limit: Column) -> list[Column]:
    """For each of ``STEPS`` the high half of a hash above which ln c - r is not below ``limit``, if its low half is below the step."""
    def bar(most: float) -> Column:
        c = F.exp(limit + (most + 0.02))
        share = 1 - (1 + c) * F.exp(-c)
        return F.when(share < 0.98, F.ceil(share * 2.0 ** 32)).otherwise(1 << 32)
    quantiles = _gamma_quantiles()
    return [bar(float(quantiles[step])).alias(f"_bar{k}") for k, step in enumerate(STEPS)]


def _prints(terms: DataFrame, keys: list[str], weights: list[str], samples: int, expected: float) -> DataFrame:
    """``fingerprints`` from the terms with an a so small that a sample has ``expected`` of them on average; ``_whole`` tells whether each sample had
    one. ``_sum0`` .. of ``terms`` are the sums of the weights of a key, or less."""
    entries = []
    for i, w in enumerate(weights):
        here = sum([F.when(F.col(v) == F.col(w), 1 << j).otherwise(0) for j, v in enumerate(weights) if j >= i], F.lit(0))
        total = F.array_min(F.array(*[F.when(F.col(v) == F.col(w), F.col(f"_sum{j}")) for j, v in enumerate(weights) if j >= i]))
        new = F.col(w) > 0
        for v in weights[:i]:
            new = new & (F.col(v) != F.col(w))
        entries.append(F.when(new, F.struct(F.log(F.col(w).cast("double")).alias("_w"), here.alias("_of"), (F.lit(math.log(expected)) - F.log(total)).alias("_limit"))))
    rows = terms.select(*keys, "_term", F.explode(F.array_compact(F.array(*entries))).alias("_e")).select(*keys, "_term", "_e._w", "_e._of", "_e._limit")
    rows = rows.select("*", *_bars(F.col("_w") + F.col("_limit")))
    rows = rows.withColumn("_at", F.explode(F.array(*[F.lit(i) for i in range(samples)])))
    sampled = _sampled(rows, [*keys, "_of"]).select(*keys, "_of", F.shiftright("_at", 2).alias("_part"), F.col("_at").bitwiseAND(F.lit(3)).alias("_at"), "_s")
    least = sampled.groupBy(*keys, "_part", "_of").agg(*[F.min(F.when(F.col("_at") == j, F.col("_s"))).alias(f"_s{j}") for j in range(4)])
    own = lambda i, j: F.min(F.when(F.col("_of").bitwiseAND(F.lit(1 << i)) != 0, F.col(f"_s{j}")))
    best = least.groupBy(*keys, "_part").agg(*[own(i, j).alias(f"{w}{j}") for i, w in enumerate(weights) for j in range(4)])
    lane = lambda w, j: F.shiftleft(F.coalesce(F.col(f"{w}{j}"), F.lit(0)).bitwiseAND(F.lit(0xFFFF)), 48 - 16 * j)
    lanes = lambda w: reduce(lambda x, y: x.bitwiseOR(y), [lane(w, j) for j in range(4)]).alias(w)
    found = lambda w: sum([F.col(f"{w}{j}").isNotNull().cast("int") for j in range(4)], F.lit(0))
    parts = best.select(*keys, "_part", *[lanes(w) for w in weights], *[found(w).alias(f"_found{i}") for i, w in enumerate(weights)])
    joined = lambda w: F.transform(F.array_sort(F.collect_list(F.struct("_part", w))), lambda x: x[w]).alias(w)
    whole = reduce(lambda x, y: x & y, [F.sum(f"_found{i}").isin(0, samples) for i in range(len(weights))])
    return parts.groupBy(*keys).agg(*[joined(w) for w in weights], whole.alias("_whole"))


def _completed(found: DataFrame, terms: DataFrame, keys: list[str], weights: list[str], samples: int) -> DataFrame:
    """``found``, computed and with columns of ``_prints``, where keys that are not whole have fingerprints from all their terms."""
    few = found.filter(~F.col("_whole"))
    if few.isEmpty():
        return found.drop("_whole")
    again = materialise(_prints(terms.join(few.select(*keys), keys, "left_semi"), keys, weights, samples, math.inf))
    return found.filter(F.coalesce("_whole", F.lit(True))).unionByName(few.drop(*weights, "_whole").join(again, keys), allowMissingColumns=False).drop("_whole")


def fingerprints(terms: DataFrame, keys: list[str], weights: list[str], samples: int = SAMPLES) -> DataFrame:
    """A fingerprint per key and weight column from (keys, ``_term`` long, weights): a list of numbers that hold four samples of 16 bits each.

    A term is sampled once for equal weights. The smallest a of a key is distributed as an exponential variate over its sum of weights, so only
    terms with an a below ``EXPECTED`` / sum are compared. A key that has none there in some sample (e ** -EXPECTED) is taken again with all its terms.
    ``samples`` is a multiple of four; a key without terms has no row.
    """
    sums = [F.sum(F.when(F.col(w) > 0, F.col(w).cast("double"))).over(Window.partitionBy(*keys)).alias(f"_sum{i}") for i, w in enumerate(weights)]
    terms = terms.select(*keys, "_term", *weights, *sums)
    return _completed(materialise(_prints(terms, keys, weights, samples, EXPECTED)), terms, keys, weights, samples)


def digits(prints: Column) -> Column:
    """A fingerprint as text, four hex digits a sample."""
    return F.lower(F.array_join(F.transform(prints, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of equal samples of two fingerprints."""
    equal = lambda x, at: F.when(F.shiftrightunsigned(x, at).bitwiseAND(F.lit(0xFFFF)) == 0, 1).otherwise(0)
    fours = F.transform(F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)), lambda x: equal(x, 0) + equal(x, 16) + equal(x, 32) + equal(x, 48))
    return F.aggregate(fours, F.lit(0), lambda x, y: x + y) / float(samples)


def next_rows(docs: DataFrame, order: list[str], keys: list[str]) -> DataFrame:
    """For each of the distinct keys, those of the next row in ``order`` (``_next_`` and the name), the first after the last."""
    ranked = materialise(running_before(docs, [], [*order, *keys], F.lit(1), "_rank"))
    total = ranked.count()
    later = ranked.select(F.pmod(F.col("_rank") - 1, F.lit(max(total, 1))).alias("_rank"), *[F.col(k).alias(f"_next_{k}") for k in keys])
    return ranked.join(later, "_rank").drop("_rank")


def compare_with_edited(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", samples: int = SAMPLES) -> DataFrame:
    """One row for each distinct (id, text) of ``docs``: ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited``, ``near_next``.

    Terms are the words of a text, weighted by their number. The edited text has its last quarter (code points) replaced by the first as
    many, or all, of the next text in order of id. A null text is empty; a text without words has a fingerprint of zeros, like any other such.
    Rows that repeat id and text are one row; a null id comes first; a single row is its own next; an empty table gives no rows. Texts of any
    length are taken whole; columns other than the two are not read, whatever their names.
    """
    keys = ["_key1", "_key2"]
    whole = docs.select(*row_key(doc_id, text), F.col(f"`{doc_id}`").alias("_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    slim = whole.select(*keys, "_id", F.char_length("_text").cast("long").alias("_n")).distinct()
    slim = materialise(next_rows(slim, ["_id"], keys))
    wanted = slim.select(F.col("_key1").alias("_for1"), F.col("_key2").alias("_for2"), F.col("_next__key1").alias("_key1"), F.col("_next__key2").alias("_key2"),
                         F.floor(F.col("_n") / 4).cast("int").alias("_k"))
    heads = whole.select(*keys, "_text").join(wanted, keys).select("_for1", "_for2", F.col("_text").substr(F.lit(1), F.col("_k")).alias("_head"))
    heads = heads.groupBy("_for1", "_for2").agg(F.min("_head").alias("_head"))
    rows = whole.select(*keys, "_text").join(heads.select(F.col("_for1").alias("_key1"), F.col("_for2").alias("_key2"), "_head"), keys)
    n = F.char_length("_text")
    edited = F.concat(F.col("_text").substr(F.lit(1), n - F.floor(n / 4).cast("int")), "_head")
    rows = rows.select(*keys, "_text", edited.alias("_edited"))
    split = rows.select(*keys, F.split("_text", BLANK, -1).alias("_words0"), F.split("_edited", BLANK, -1).alias("_words1"))
    sides = F.array(*[F.struct(F.lit(i).alias("side"), F.col(f"_words{i}").alias("words")) for i in (0, 1)])
    # the first and the last piece may be empty
    sums = [F.greatest(F.size(f"_words{i}") - 2, F.lit(1)).alias(f"_sum{i}") for i in (0, 1)]
    words = split.select(*keys, *sums, F.explode(sides).alias("_s")).select(*keys, "_sum0", "_sum1", F.col("_s.side").alias("_side"), F.explode("_s.words").alias("_word"))
    words = words.filter(F.col("_word") != "")
    terms = words.groupBy(*keys, F.xxhash64("_word").alias("_term")).agg(
        F.sum(1 - F.col("_side")).alias("fingerprint"), F.sum("_side").alias("edited_fingerprint"), F.min("_sum0").alias("_sum0"), F.min("_sum1").alias("_sum1"))
    weights = ["fingerprint", "edited_fingerprint"]
    prints = _prints(terms, keys, weights, samples, EXPECTED)
    shas = rows.groupBy(*keys).agg(F.min(F.sha2("_edited", 256)).alias("edited_sha256"))
    none = F.array_repeat(F.lit(0).cast("long"), samples // 4)
    found = _completed(materialise(slim.join(shas, keys).join(prints, keys, "left")), terms, keys, weights, samples)
    found = found.withColumn("fingerprint", F.coalesce("fingerprint", none)).withColumn("edited_fingerprint", F.coalesce("edited_fingerprint", none))
    following = found.select(F.col("_key1").alias("_next__key1"), F.col("_key2").alias("_next__key2"), F.col("fingerprint").alias("_next_print"))
    found = found.join(following, ["_next__key1", "_next__key2"])
    return found.select(F.col("_id").alias(doc_id), F.col("_n").alias("n_chars"), "edited_sha256", digits(F.col("fingerprint")).alias("fingerprint"),
                        digits(F.col("edited_fingerprint")).alias("edited_fingerprint"),
                        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), samples).alias("near_edited"),
                        likeness(F.col("fingerprint"), F.col("_next_print"), samples).alias("near_next"))
