"""Language identification with interpolated Kneser-Ney character models, one per language."""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecraft.llm.common import share, shared, small_or_shuffled, written
from tablecraft.llm.words import mix

ORDER = 5
TRAIN_DOCS = 600
FALSE_SHARE = 0.01
MARGIN = 1.1
SALTS = 64
SYMBOLS = 5_000
CACHE_WORDS = 200_000
SLICE_CHARS = 1 << 20
LETTERS = re.compile(r"[^\W\d_]+")
START, END = "\x02", "\x03"
UND = "und"
_BASE = np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Orders:
    """N-grams of one length over all languages: sorted hashes, log probabilities, and as contexts their log back-off weights."""

    grams: np.ndarray
    logp: np.ndarray
    contexts: np.ndarray
    backoff: np.ndarray


@dataclass
class Model:
    languages: list[str]
    orders: list[Orders]
    floor: float
    mean: np.ndarray
    spread: np.ndarray
    deviation: np.ndarray
    limit: float = math.inf


def letter_words(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


def gram_hashes(words: list[str], order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each length n the hash of the n symbols that end at each position of the padded words (0: reaches
    beyond the word), the positions' word numbers, and whether a position is a predicted symbol."""
    text = "".join(START + w + END for w in words)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), lengths)
    first = np.repeat(np.cumsum(lengths) - lengths, lengths)
    depth = np.arange(len(codes)) - first
    scrambled, hashes, total, power = mix(codes + np.uint64(1)), [], np.zeros(len(codes), np.uint64), np.ones(1, np.uint64)
    for n in range(1, order + 1):
        shifted = np.zeros(len(codes), np.uint64)
        shifted[n - 1:] = scrambled[:max(0, len(codes) - n + 1)]
        total = total + shifted * power
        power = power * _BASE
        hashes.append(np.where(depth >= n - 1, mix(total) | np.uint64(1), np.uint64(0)))
    return hashes, owner, depth > 0


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def word_scores(model: Model, words: list[str]) -> np.ndarray:
    """Natural log probability of each word (its letters and its end) in each language."""
    hashes, owner, counted = gram_hashes(words, len(model.orders))
    value = np.full((len(owner), len(model.languages)), model.floor)
    for n, table in enumerate(model.orders):
        at, found = _find(table.grams, hashes[n])
        value[found] = table.logp[at[found]]
        if n:
            before = np.concatenate([[np.uint64(0)], hashes[n - 1][:-1]])
            at, known = _find(table.contexts, before)
            known &= ~found & (before != 0) & (hashes[n] != 0)
            value[known] += table.backoff[at[known]]
    value[~counted] = 0
    scores = np.zeros((len(words), len(model.languages)))
    np.add.at(scores, owner, value)
    return scores


def fit(counts: dict[str, dict[str, int]], order: int = ORDER) -> Model:
    """Models from word counts by language; lower orders use continuation counts, except after the word's start."""
    languages = sorted(counts)
    longest: dict[str, dict[str, int]] = {language: defaultdict(int) for language in languages}
    for language in languages:
        for word, times in counts[language].items():
            padded = START + word + END
            for end in range(2, len(padded) + 1):
                longest[language][padded[max(0, end - order):end]] += times
    return fit_grams(longest, order)


def fit_grams(longest: dict[str, dict[str, int]], order: int) -> Model:
    """Models from counts of each symbol with the up to ``order - 1`` symbols before it in its word."""
    languages = sorted(longest)
    raw = [[defaultdict(int) for _ in range(order)] for _ in languages]
    for per, language in zip(raw, languages, strict=True):
        for gram, times in longest[language].items():
            for n in range(1, len(gram) + 1):
                per[n - 1][gram[-n:]] += times
    prob: list[dict[str, list[float]]] = []
    orders: list[Orders] = []
    for n in range(1, order + 1):
        union = sorted(set().union(*[per[n - 1] for per in raw])) if raw else []
        logp, gamma = np.zeros((len(union), len(languages))), {}
        for k, per in enumerate(raw):
            adjusted = dict(per[n - 1])
            if n < order:
                left = defaultdict(int)
                for gram in per[n]:
                    left[gram[1:]] += 1
                adjusted = {g: c if g[0] == START or not left[g] else left[g] for g, c in adjusted.items()}
            once = sum(c == 1 for c in adjusted.values())
            twice = sum(c == 2 for c in adjusted.values())
            discount = min(max(once / (once + 2 * twice) if once else 0.5, 0.1), 0.9)
            total, kinds = defaultdict(int), defaultdict(int)
            for g, c in adjusted.items():
                total[g[:-1]] += c
                kinds[g[:-1]] += 1
            for context, t in total.items():
                gamma.setdefault(context, [1.0] * len(languages))[k] = discount * kinds[context] / t
            for i, g in enumerate(union):
                t = total.get(g[:-1], 0)
                lower = 1.0 / SYMBOLS if n == 1 else prob[-1][g[1:]][k]
                logp[i, k] = lower if not t else max(adjusted.get(g, 0) - discount, 0.0) / t + gamma[g[:-1]][k] * lower
        prob.append({g: row for g, row in zip(union, logp.tolist(), strict=True)})
        grams, rows = _sorted(union, np.log(logp))
        contexts, weights = _sorted(list(gamma), np.log(np.array(list(gamma.values())).reshape(len(gamma), len(languages))))
        orders.append(Orders(grams, rows, contexts, weights))
    return Model(languages, orders, math.log(1e-3 / SYMBOLS), np.zeros(len(languages)), np.ones(len(languages)), np.zeros(len(languages)))


def _hash(gram: str) -> np.uint64:
    codes = mix(np.array([ord(c) + 1 for c in reversed(gram)], np.uint64))
    with np.errstate(over="ignore"):
        return mix(np.array([(codes * np.multiply.accumulate(np.array([1] + [int(_BASE)] * (len(gram) - 1), np.uint64))).sum()]))[0] | np.uint64(1)


def _sorted(grams: list[str], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hashes = np.array([_hash(g) if g else np.uint64(0) for g in grams], np.uint64)
    order = np.argsort(hashes, kind="stable")
    return hashes[order], rows[order]


class Scorer:
    """Scores texts; keeps the scores of words met before, up to a fixed number."""

    def __init__(self, model: Model):
        self.model, self.ids = model, {}
        self.scores, self.symbols = np.zeros((0, len(model.languages))), np.zeros(0)

    def _learn(self, texts: list[list[str]]) -> None:
        new = sorted(set().union(*texts).difference(self.ids))
        if len(self.ids) + len(new) > CACHE_WORDS:
            self.ids, new = {}, sorted(set().union(*texts))
            self.scores, self.symbols = np.zeros((0, len(self.model.languages))), np.zeros(0)
        if new:
            self.ids.update(zip(new, range(len(self.ids), len(self.ids) + len(new)), strict=True))
            parts = [word_scores(self.model, new[i:i + 20_000]) for i in range(0, len(new), 20_000)]
            self.scores = np.concatenate([self.scores, *parts])
            self.symbols = np.concatenate([self.symbols, [len(w) + 1 for w in new]])

    def entropies(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray | None, float]]:
        """Nats per symbol in each language and the number of symbols; None for texts without letters."""
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to] or "") <= SLICE_CHARS):
                size += len(texts[to] or "")
                to += 1
            words = [letter_words(t) for t in texts[at:to]]
            words = [w if any(c.isalpha() for x in w for c in x) else [] for w in words]
            self._learn(words)
            for own in words:
                if not own or not self.model.languages:
                    yield None, 0.0
                    continue
                ids = np.fromiter(map(self.ids.__getitem__, own), np.int64, len(own))
                n = float(self.symbols[ids].sum())
                yield -self.scores[ids].sum(0) / n, n
            at = to

    def judge(self, texts: list[str | None]) -> Iterator[tuple[str, float, bool]]:
        """Language, score and rejection of each text."""
        for entropy, n in self.entropies(texts):
            if entropy is None:
                yield UND, 0.0, bool(self.model.languages)
                continue
            best = int(np.argmin(entropy))
            score = 1.0 / float(np.exp(-(entropy - entropy[best]) * math.sqrt(n)).sum())
            limit = self.model.mean[best] * MARGIN + self.model.limit * max(self.model.spread[best] / math.sqrt(n), self.model.deviation[best])
            yield self.model.languages[best], score, bool(entropy[best] > limit)


def training_texts(docs: DataFrame, text: str, lang: str, doc_id: str, train_docs: int) -> DataFrame:
    """At most ``train_docs`` whole texts a language, those of the smallest hashes of id and text: ``_lang``, ``_text``, ``_apart``.

    Only hashes are ranked, first within salts of a language and then among what these leave, so no task meets the texts of a
    language, or the candidates of all tasks; the texts chosen are then fetched by key. Repeated rows are one text.
    """
    rows = docs.select(F.col(f"`{lang}`").cast("string").alias("_lang"), F.col(f"`{text}`").alias("_text"),
                       F.xxhash64(F.lit(5), F.col(f"`{doc_id}`")).alias("_order"), F.xxhash64(F.col(f"`{text}`")).alias("_tie"))
    rows = rows.filter(F.col("_lang").isNotNull() & F.col("_text").isNotNull())
    keys, order = ["_lang", "_order", "_tie"], ["_order", "_tie"]
    ranked = rows.select(*keys, F.pmod("_order", F.lit(SALTS)).alias("_salt"))
    for group in (["_lang", "_salt"], ["_lang"]):
        ranked = ranked.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("_n") <= train_docs)
    chosen = small_or_shuffled(ranked.groupBy(*keys).agg(F.min("_n").alias("_n")))
    found = rows.join(chosen, keys).groupBy(*keys).agg(F.first("_text").alias("_text"), F.first("_n").alias("_n"))
    return written(found.select("_lang", "_text", (F.col("_n") % 4 == 0).alias("_apart")), "training-texts")


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", train_docs: int = TRAIN_DOCS,
          false_share: float = FALSE_SHARE, order: int = ORDER) -> Model:
    """A model of all languages in ``docs``; with no labelled text, a model without languages.

    The fit is bounded by ``train_docs`` whole texts a language, chosen by a hash of the id; all their words are learned. A quarter of
    the texts is kept apart to calibrate the rejection: the mean cross-entropy of right-language texts, its spread for texts of one symbol (short texts
    spread with the root of their length) and its deviation between texts (long texts differ in more than their length); the larger one counts. By the
    one-sided inequality of Chebyshev, about the mean and whatever the distribution, at most a share 1 / (1 + z * z) lies z spreads or more above; z is
    chosen for ``false_share``. The mean counts ``MARGIN`` times, because in a language of few words the kept-apart texts hardly differ, and a passage of
    other words would not pass.
    """
    rows = training_texts(docs, text, lang, doc_id, train_docs)
    words = rows.mapInArrow(_count_words, "_lang string, _word string, _times long")
    words = words.groupBy("_lang", "_word").agg(F.sum("_times").alias("_times"))
    counts: dict[str, dict[str, int]] = defaultdict(dict)
    for language, word, times in words.collect():  # words of at most train_docs texts a language
        counts[language][word] = times
    model = fit(counts, order)
    model.limit = math.sqrt(1 / false_share - 1)
    if not model.languages:
        return model
    sent = share(docs, model)

    def calibrate(batches):
        known = shared(sent)
        scorer = Scorer(known)
        for batch in batches:
            out = []
            apart = [(a, b) for a, b, c in zip(*[batch.column(c).to_pylist() for c in ("_lang", "_text", "_apart")], strict=True) if c]
            for (language, _), (entropy, n) in zip(apart, scorer.entropies([b for _, b in apart]), strict=True):
                if entropy is not None and language in known.languages:
                    out.append((language, float(entropy[known.languages.index(language)]), n))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.float64(), pa.float64()))],
                                             ["_lang", "_entropy", "_n"])

    scored = rows.mapInArrow(calibrate, "_lang string, _entropy double, _n double")
    for language, n, mean, square in scored.groupBy("_lang").agg(
            F.sum("_n"), F.sum(F.col("_entropy") * F.col("_n")) / F.sum("_n"),
            F.collect_list(F.struct("_entropy", "_n"))).collect():  # at most train_docs / 4 pairs a language
        at = model.languages.index(language)
        model.mean[at] = mean
        model.spread[at] = math.sqrt(sum(w * (e - mean) ** 2 for e, w in square) / len(square))
        model.deviation[at] = math.sqrt(sum((e - mean) ** 2 for e, _ in square) / len(square))
    return model


def _count_words(batches):
    for batch in batches:
        times: dict[tuple[str, str], int] = defaultdict(int)
        for language, text, apart in zip(*[batch.column(c).to_pylist() for c in ("_lang", "_text", "_apart")], strict=True):
            if not apart:
                for word in letter_words(text):
                    times[language, word] += 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in times], pa.string()), pa.array([k[1] for k in times], pa.string()),
                                          pa.array(list(times.values()), pa.int64())], ["_lang", "_word", "_times"])


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``lang_pred``, ``score`` (0 to 1) and ``rejected``, which replace columns of these names.

    The language is that of the lowest cross-entropy per symbol; ties go to the first by name. ``und`` is given only to null
    texts and texts without a letter; they are rejected, as are texts far above the cross-entropy
    calibrated for their language. Without any learned language all is ``und`` and nothing is rejected.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept])
    sent = share(docs, model)
    at = kept.index(text)

    def judge(batches):
        scorer = Scorer(shared(sent))
        for batch in batches:
            found = list(scorer.judge(batch.column(at).to_pylist()))
            new = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "lang_pred", "score", "rejected"])

    schema = T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                           T.StructField("rejected", T.BooleanType())])
    return rows.mapInArrow(judge, schema)
