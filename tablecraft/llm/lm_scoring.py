"""Scores of texts under a weighted backoff automaton learned from the whole collection.

States are the last word read (or the text's begin); a traversal from left to right carries the state along. An arc of a state holds
the discounted probability of the word after it, for every pair that the training texts have at least ``MIN_PAIRS`` times; the failure arc,
at the state's back-off weight, leads to the root. The root has an arc for each learned word and a failure arc into character states: contexts
of up to four signs of the word, with interpolated Kneser-Ney weights over all words. P(word) at the root is
max(c - D, 0) / N + D * V / N * P(signs of the word). The text's end is read like a word.

Arcs of words and of signs are tables that grow with the input; a block of texts or words gets those that it asks for, and no more.
"""

from __future__ import annotations

import math
import struct
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecraft.llm.common import row_key, written
from tablecraft.llm.language_id import END, START, SYMBOLS
from tablecraft.llm.words import mix
from tablecraft.session import delete_folder

ORDER = 5
MIN_PAIRS = 2
PAIR_DISCOUNT = 0.5
BLOCK_BYTES = 12 << 20
BLOCK_WORDS = 100_000
SLICE_BYTES = 4 << 20
PACK_ROWS = 500_000
FLUSH_GRAMS = 500_000
PART_TIMES = 200_000
NO_WORD = -1
FLOOR = math.log(1e-3 / SYMBOLS)


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of UTF-8 texts one after another, A-Z in lower case and bytes split at exactly x20 and x09-x0D; each text's number of words."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.string())))
    words, ends = lists.flatten().view(pa.binary()), lists.offsets.to_numpy().astype(np.int64)
    real = pc.greater(pc.binary_length(words), 0)
    before = np.append(0, np.cumsum(real.to_numpy(zero_copy_only=False)))
    return words.filter(real), np.diff(before[ends - ends[0]])


def _planes(values: np.ndarray) -> bytes:
    """The first bytes of all values, then the second and so on, which compresses better than one value after another."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _values(data: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def _sealed(*columns: np.ndarray) -> bytes:
    """Columns of floats, or of whole numbers from 0 in as few bytes each as the largest needs, compressed as one."""
    heads, parts = [], []
    for x in columns:
        x = x if x.dtype.kind == "f" else x.astype(np.min_scalar_type(int(x.max(initial=0))))
        heads.append(struct.pack("<cBq", x.dtype.kind.encode(), x.itemsize, len(x)))
        parts.append(_planes(x))
    plain = b"".join([*heads, *parts])
    return struct.pack("<Bq", len(columns), len(plain)) + pa.compress(plain, codec="zstd", asbytes=True)


def _opened(data: bytes) -> list[np.ndarray]:
    """The columns of ``_sealed``; whole numbers as int64."""
    n, size = struct.unpack_from("<Bq", data)
    plain = pa.decompress(memoryview(data)[struct.calcsize("<Bq"):], size, codec="zstd", asbytes=True)
    width, out = struct.calcsize("<cBq"), []
    at = n * width
    for i in range(n):
        kind, itemsize, length = struct.unpack_from("<cBq", plain, i * width)
        values = _values(plain[at:at + itemsize * length], f"{kind.decode()}{itemsize}")
        out.append(values if kind == b"f" else values.astype(np.int64))
        at += itemsize * length
    return out


def _table(df: DataFrame, name: str, paths: list[str] | None = None) -> DataFrame:
    """``written``, closely compressed; Spark deletes the shuffle files of the write at its end, as nothing reads them again."""
    conf = df.sparkSession.conf
    settings = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.parquet.compression.codec": "zstd"}
    before = {key: conf.get(key, None) for key in settings}
    for key, value in settings.items():
        conf.set(key, value)
    try:
        return written(df, name, paths)
    finally:
        for key, value in before.items():
            conf.unset(key) if value is None else conf.set(key, value)


def _encoder(kind: pa.DataType):
    """Texts as places of their words in the word list of their block, then these lists with the counts in training texts."""
    names = ["_block", "_id", "_train", "_codes", "_place", "_word", "_times"]

    def rows(batches):
        held: dict[int, list[tuple[pa.RecordBatch, pa.Array, np.ndarray]]] = defaultdict(list)
        for batch in batches:
            of, sizes = batch.column("_block").to_numpy(), pc.fill_null(pc.binary_length(batch.column("_text")), 0).to_numpy().astype(np.int64)
            order = np.argsort(of, kind="stable")
            slices = np.cumsum(sizes[order]) // SLICE_BYTES
            cuts = np.flatnonzero((np.diff(of[order]) != 0) | (np.diff(slices) != 0)) + 1
            for here in np.split(order, cuts) if len(order) else ():
                some = batch.take(pa.array(here))
                held[int(of[here[0]])].append((some.select(["_block", "_id", "_train"]), *tokens(some.column("_text"))))
        for block in list(held):
            texts, words, lengths = zip(*held.pop(block), strict=True)
            words = pa.chunked_array(words).dictionary_encode()
            places = words.chunk(0).dictionary
            times = np.zeros(len(places), np.int64)
            for some, chunk, n_words in zip(texts, words.chunks, lengths, strict=True):
                codes = chunk.indices.to_numpy()
                times += np.bincount(codes[np.repeat(np.array(some.column("_train").to_pylist(), bool), n_words)], minlength=len(places))
                out = [_planes(x) for x in np.split(codes, np.cumsum(n_words)[:-1])]
                n = some.num_rows
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(out, pa.binary()),
                                                  pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64())], names)
            for at in range(0, len(places), 50_000):
                n = len(places[at:at + 50_000])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, block, np.int64)), pa.nulls(n, kind), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.binary()),
                     pa.array(np.arange(at, at + n, dtype=np.int32)), places[at:at + n], pa.array(times[at:at + n])], names)
    return rows


def padded(word: bytes) -> str:
    return START + word.decode("utf-8", "replace") + END


def longest_grams(signs: str, order: int = ORDER) -> list[str]:
    """For each sign after the first, the sign with the up to ``order - 1`` before it."""
    n = len(signs)
    return [signs[:end] for end in range(2, min(order, n) + 1)] + [signs[at:at + order] for at in range(1, n - order + 1)]


def _fixed(signs: np.ndarray) -> pa.Array:
    """Rows of ``ORDER`` code points, each plus 1, as binaries of equal length; 0 stands before shorter grams."""
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * ORDER), len(signs), [None, pa.py_buffer(np.ascontiguousarray(signs, "<u4"))])


def _code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points plus 1 of all texts one after another, the place of each in its text, the texts' lengths."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    signs = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4") + np.uint32(1)
    return signs, np.arange(len(signs)) - np.repeat(np.cumsum(lengths) - lengths, lengths), lengths


def _fixed_grams(words: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The ``longest_grams`` of all padded words one after another, as ``_fixed`` binaries, and each word's number of them."""
    signs, at, lengths = _code_points([padded(w) for w in words])
    grams = np.zeros((len(signs), ORDER), "<u4")
    for back in range(ORDER):
        grams[back:, ORDER - 1 - back] = np.where(at[back:] >= back, signs[:len(signs) - back], 0)
    return _fixed(grams[at > 0]), lengths - 1


def _fixed_texts(texts: list[str]) -> pa.Array:
    """Grams of up to ``ORDER`` signs as ``_fixed`` binaries."""
    signs, at, lengths = _code_points(texts)
    grams = np.zeros((len(texts), ORDER), "<u4")
    grams[np.repeat(np.arange(len(texts)), lengths), at + ORDER - np.repeat(lengths, lengths)] = signs
    return _fixed(grams)


def _gram_texts(grams: pa.Array) -> list[str]:
    """``_fixed`` binaries as texts."""
    signs = np.frombuffer(grams.buffers()[1], "<u4")[grams.offset * ORDER:(grams.offset + len(grams)) * ORDER].reshape(-1, ORDER)
    every = (signs[signs > 0] - np.uint32(1)).tobytes().decode("utf-32-le")
    ends = np.cumsum((signs > 0).sum(axis=1))
    return [every[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)] if len(ends) else []


def _grams(batches):
    held: list[bytes] = []

    def counted():
        found = _fixed_grams(held)[0].value_counts()
        return pa.RecordBatch.from_arrays([pa.array(_gram_texts(found.field("values")), pa.string()), found.field("counts")], ["_gram", "_times"])

    for batch in batches:
        held += batch.column(0).to_pylist()
        if len(held) >= BLOCK_WORDS:
            yield counted()
            held.clear()
    if held:
        yield counted()


def sign_arcs(words: DataFrame, order: int = ORDER, done: list[str] | None = None) -> DataFrame:
    """Arcs and back-off weights of all character states learned from all words (``_word``), each once: ``_gram``, ``_back``, ``_value``.

    ``_value`` is the natural log of the probability of the gram's last sign after the others or, where ``_back``, of the back-off weight
    of the gram as a context. Lower orders use continuation counts, except after the word's start, as ``language_id.fit`` does.
    Paths of the tables it leaves are added to ``done``.
    """
    grams = words.select("_word").mapInArrow(_grams, "_gram string, _times long")
    grams = _table(grams.groupBy("_gram").agg(F.sum("_times").alias("_times")), "grams", done)
    of = lambda n: grams.filter(F.char_length("_gram") == n).select("_gram", F.col("_times").alias("_count"))
    levels = {order: _table(of(order), "grams-level", done)}
    for n in range(order - 1, 0, -1):
        left = levels[n + 1].select(F.substring("_gram", 2, n).alias("_gram"), F.lit(1).alias("_one"), F.lit(None).cast("long").alias("_own"))
        own = of(n).select("_gram", F.lit(0).alias("_one"), F.col("_count").alias("_own"))
        both = left.unionByName(own).groupBy("_gram").agg(F.coalesce(F.max("_own"), F.sum("_one")).alias("_count"))
        levels[n] = _table(both, "grams-level", done)
    lower, arcs = None, []
    for n in range(1, order + 1):
        level = levels[n].withColumn("_context", F.substring("_gram", 1, n - 1))
        once, twice = level.agg(F.sum((F.col("_count") == 1).cast("long")), F.sum((F.col("_count") == 2).cast("long"))).first()
        discount = min(max(once / (once + 2 * twice) if once else 0.5, 0.1), 0.9)
        contexts = level.groupBy("_context").agg(F.sum("_count").alias("_total"), (F.lit(discount) * F.count(F.lit(1)) / F.sum("_count")).alias("_gamma"))
        share = F.greatest(F.col("_count") - discount, F.lit(0.0)) / F.col("_total")
        found = level.join(contexts, "_context")
        if lower is None:
            found = found.select("_gram", (share + F.col("_gamma") / SYMBOLS).alias("_p"))
        else:
            below = lower.select(F.col("_gram").alias("_suffix"), F.col("_p").alias("_below"))
            found = found.withColumn("_suffix", F.substring("_gram", 2, n - 1)).join(below, "_suffix").select(
                "_gram", (share + F.col("_gamma") * F.col("_below")).alias("_p"))
            arcs.append(contexts.select(F.col("_context").alias("_gram"), F.lit(True).alias("_back"), F.log("_gamma").alias("_value")))
        lower = _table(found, "sign-arcs", done)
        arcs.append(lower.select("_gram", F.lit(False).alias("_back"), F.log("_p").alias("_value")))
    every = arcs[0]
    for more in arcs[1:]:
        every = every.unionByName(more)
    return every


def _asked_grams(batches):
    """(word block, gram, whether as a context) of the words that pass by, block after block; learned words have all their longest grams."""
    learned: list[bytes] = []
    arcs: set[str] = set()
    backs: set[str] = set()

    def flush(block):
        arcs.update(_gram_texts(_fixed_grams(learned)[0].unique()))
        for back, own in enumerate((arcs, backs)):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), block, np.int64)), pa.array(list(own), pa.string()),
                                              pa.array(np.full(len(own), bool(back)))], ["_part", "_gram", "_back"])
            own.clear()
        learned.clear()

    last = None
    for batch in batches:
        for block, word, times in zip(*[batch.column(c).to_pylist() for c in ("_part", "_word", "_times")], strict=True):
            if block != last or len(learned) >= 2 * BLOCK_WORDS or len(arcs) + len(backs) > FLUSH_GRAMS:
                if last is not None:
                    yield from flush(last)
                last = block
            if times:
                learned.append(word)
                continue
            grams = longest_grams(padded(word))
            arcs.update(grams)
            for g in grams:
                arcs.update([g[-n:] for n in range(1, len(g))])
                backs.update([g[-n:-1] for n in range(2, len(g) + 1)])
    if last is not None:
        yield from flush(last)


def sign_weight(signs: str, arcs: dict[str, float], backs: dict[str, float]) -> float:
    """Natural log of the probability of the signs after the first."""
    total = 0.0
    for gram in longest_grams(signs):
        value = arcs.get(gram[-1], FLOOR)
        for n in range(2, len(gram) + 1):
            value = arcs[gram[-n:]] if gram[-n:] in arcs else value + backs.get(gram[-n:-1], 0.0)
        total += value
    return total


def spelled(words: DataFrame, known: int, total: int, done: list[str] | None = None) -> DataFrame:
    """``words`` with ``_signs``, the natural log of the probability of their signs; ``known`` of the ``total`` words are learned."""
    if not known:
        length = F.char_length(F.decode("_word", "UTF-8"))
        return words.withColumn("_signs", (length + 1) * math.log(1e-6))
    parts = max(1, math.ceil(total / BLOCK_WORDS))
    # a part is whole in its task, so it asks for a gram once (or once more after a flush)
    rows = words.withColumn("_part", F.pmod(F.xxhash64("_word"), F.lit(parts))).repartition("_part")
    asked = rows.sortWithinPartitions("_part").mapInArrow(_asked_grams, "_part long, _gram string, _back boolean")
    told = asked.join(sign_arcs(words.filter(F.col("_times") > 0), done=done).hint("shuffle_hash"), ["_gram", "_back"])

    def weigh(own: pa.Table, grams: pa.Table) -> pa.Table:
        words, learned = own.column("_word").to_pylist(), own.column("_times").to_numpy() > 0
        texts, values = grams.column("_gram").to_pylist(), grams.column("_value").to_numpy()
        back = grams.column("_back").to_numpy()
        signs = np.zeros(len(words))
        if learned.any():
            arcs = np.flatnonzero(~back)
            found, lengths = _fixed_grams([w for w, known in zip(words, learned, strict=True) if known])
            at = pc.index_in(found, value_set=_fixed_texts([texts[i] for i in arcs.tolist()])).to_numpy(zero_copy_only=False)
            signs[learned] = np.add.reduceat(values[arcs][at], np.cumsum(lengths) - lengths)
        if not learned.all():
            own_arcs, own_backs = {}, {}
            for gram, is_back, value in zip(texts, back.tolist(), values.tolist(), strict=True):
                (own_backs if is_back else own_arcs)[gram] = value
            signs[~learned] = [sign_weight(padded(w), own_arcs, own_backs) for w, known in zip(words, learned, strict=True) if not known]
        return own.select(["_number", "_word", "_times"]).append_column("_signs", pa.array(signs, pa.float64()))

    return rows.groupBy("_part").cogroup(told.groupBy("_part")).applyInArrow(weigh, "_number long, _word binary, _times long, _signs double")


def _joined(texts: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """States and words read in all texts one after another, as places (``size`` is the begin, one more the end), each text's number of tokens, ``size``."""
    codes = [_values(data, "i4") for data in texts.column("_codes").to_pylist()]
    lengths = np.array([len(c) + 1 for c in codes], np.int64)
    every = np.concatenate([np.zeros(0, np.int32), *codes]).astype(np.int64)
    del codes
    size = int(every.max(initial=-1)) + 1
    ends = np.cumsum(lengths)
    inside = np.ones(int(lengths.sum()) + 1, bool)
    inside[0] = inside[ends] = False
    words = np.full(len(inside), size + 1)
    words[inside] = every
    states, read = words[:-1].copy(), words[1:]
    states[ends - lengths] = size
    return states, read, lengths, size


class _Block:
    """What is told of the words of a block, by place: counts, natural logs of sign weights, numbers of the whole (0 is the begin or the end,
    ``NO_WORD`` a word in no pair that comes twice). ``states`` and ``read`` are the tokens of its texts."""

    def __init__(self, texts: pa.Table, told: list[bytes], ends: int):
        self.states, self.read, self.lengths, self.size = _joined(texts)
        self.times, self.signs, self.number = np.zeros(self.size + 2, np.int64), np.zeros(self.size), np.zeros(self.size + 2, np.int64)
        self.times[self.size:] = ends
        for data in told:
            steps, number, times, signs = _opened(data)
            places = np.cumsum(steps)
            self.number[places], self.times[places], self.signs[places] = number + 1, times, signs
        self.number[self.times < MIN_PAIRS] = NO_WORD
        self.train = np.repeat(np.array(texts.column("_train").to_pylist(), bool), self.lengths)

    def pairs(self, parts: int, part_times: int):
        """Places in the tokens that have a pair of numbered words, the pair of each, of the pairs state and word as places, and for each part
        the pairs there. After the pairs come the numbered states without any, each with ``NO_WORD``, as their sums are asked for too."""
        fit = np.flatnonzero((self.number[self.states] >= 0) & (self.number[self.read] >= 0))
        keys, of = np.unique(self.states[fit] * (self.size + 2) + self.read[fit], return_inverse=True)
        first, second = keys // (self.size + 2), keys % (self.size + 2)
        alone = self.number[:self.size] >= 0
        alone[first[first < self.size]] = False
        alone = np.flatnonzero(alone)
        first, second = np.append(first, alone), np.append(second, np.full(len(alone), NO_WORD))
        # a state with very many occurrences is dealt to several parts by the word after it
        salts = 1 + self.times[first] // part_times
        dealt = self.number[first] * 1_000_003 + np.where(second < 0, 0, self.number[second] % salts)
        part = (mix(dealt.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        found, starts = np.unique(part[order], return_index=True)
        return fit, of, first, second, dict(zip(found.tolist(), np.split(order, starts[1:]), strict=True)) if len(found) else {}


def _merger(hot: int):
    """For each block that sent pairs to a part their counts over all blocks, in its order, and the sums of its states over their arcs there;
    then these sums for the begin and the ``hot`` most frequent words, whose arcs lie in several parts."""
    def merge(sent: pa.Table) -> pa.Table:
        blocks, part = sent.column("_block").to_pylist(), sent.column("_part")[0].as_py()
        heads, runs, nexts, times, weight = zip(*map(_opened, sent.column("_pairs").to_pylist()), strict=True)
        own, state = np.unique(np.concatenate(heads), return_inverse=True)
        state, following = np.repeat(state, np.concatenate(runs)), np.concatenate(nexts)
        width = int(following.max(initial=0)) + 1
        keys, of = np.unique(state * width + following, return_inverse=True)
        del state, following
        every, weights = np.zeros(len(keys), np.int64), np.zeros(len(keys))
        ends = np.cumsum([len(x) for x in times])
        places = [of[end - len(x):end] for end, x in zip(ends, times, strict=True)]
        for here, t, w in zip(places, times, weight, strict=True):
            every[here] += t  # a block sends a pair once
            weights[here] = w
        arcs = every >= MIN_PAIRS
        at = keys[arcs] // width
        taken = np.bincount(at, every[arcs], len(own)).astype(np.int64)
        many = np.bincount(at, minlength=len(own))
        root = np.bincount(at, weights[arcs], len(own))
        replies = []
        for here, x in zip(places, heads, strict=True):
            at = np.searchsorted(own, x)
            replies.append(_sealed(every[here], taken[at], many[at], root[at]))
        has = np.flatnonzero((many > 0) & (own <= hot))
        n, m = len(blocks), len(has)
        return pa.table({
            "_block": pa.array([*blocks, *[None] * m], pa.int64()), "_part": pa.array([part] * (n + m), pa.int64()),
            "_every": pa.array([*replies, *[None] * m], pa.binary()), "_state": pa.array([*[None] * n, *own[has].tolist()], pa.int64()),
            "_used": pa.array([*[None] * n, *(taken - PAIR_DISCOUNT * many)[has].tolist()], pa.float64()),
            "_root": pa.array([*[None] * n, *root[has].tolist()], pa.float64())})
    return merge


def learn_pairs(texts: DataFrame, told: DataFrame, parts: int, ends: int, end_weight: float, n: int, v: int, discount: float, hot: int,
                part_times: int) -> DataFrame:
    """All pairs of texts, counted over all training texts, as rows of two kinds: for a block and a part ``_every``, the counts of the
    pairs that the block sent there with the sums of their states, and for a part and a ``_state`` with arcs in several parts (the begin and
    the ``hot`` words that come ``part_times`` times or more) what its arcs take there (``_used``, not yet divided by the state's count)
    and what the root gives to the same words (``_root``).

    A block sends each of its distinct pairs once, packed with the others of the same part, so there are never more rows than pairs. Both
    words of a pair that comes twice come twice, so only these words have pairs. Root weights travel in single precision.
    """
    def send(own_texts: pa.Table, own: pa.Table) -> pa.Table:
        block = _Block(own_texts, own.column("_told").to_pylist(), ends)
        fit, of, first, second, dealt = block.pairs(parts, part_times)
        times = np.bincount(of, block.train[fit], len(first)).astype(np.int64)
        weight = np.append(10 ** word_weight(block.times[:-2].astype(np.float64), block.signs, n, v, discount), [0.0, end_weight]).astype(np.float32)
        del fit, of
        rows = []
        for here in dealt.values():
            states, real = first[here], here[second[here] >= 0]
            heads = np.flatnonzero(np.diff(states, prepend=-1))
            runs = np.diff(heads, append=len(here)) - (second[here][heads] < 0)
            rows.append(_sealed(block.number[states[heads]], runs, block.number[second[real]], times[real], weight[second[real]]))
        name = own_texts.column("_block")[0].as_py() if own_texts.num_rows else 0
        return pa.table({"_block": pa.array([name] * len(rows), pa.int64()), "_part": pa.array(list(dealt), pa.int64()), "_pairs": pa.array(rows, pa.binary())})

    sent = texts.groupBy("_block").cogroup(told.groupBy("_block")).applyInArrow(send, "_block long, _part long, _pairs binary")
    return _table(sent.groupBy("_part").applyInArrow(_merger(hot), "_block long, _part long, _every binary, _state long, _used double, _root double"), "pairs")


def _packer(hot: int):
    """What is told of words (``_block``, ``_place``, ``_number``, ``_times``, ``_signs``) packed by block as ``_told``; a row more for each of the ``hot`` words."""
    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        block, place, number, times, signs = (rows.column(c).to_numpy() for c in ("_block", "_place", "_number", "_times", "_signs"))
        order = np.lexsort((place, block))
        found, starts = np.unique(block[order], return_index=True)
        told = [_sealed(np.diff(place[here], prepend=0), number[here], times[here], signs[here]) for here in np.split(order, starts[1:])]
        n, own = len(found), np.flatnonzero(number < hot)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.append(found, block[own])), pa.array([*told, *[None] * len(own)], pa.binary()),
            pa.array([*[None] * n, *place[own].tolist()], pa.int32()), pa.array([*[None] * n, *number[own].tolist()], pa.int64())],
            ["_block", "_told", "_place", "_number"])

    def rows(batches):
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= PACK_ROWS:
                yield from flush(held)
                held, n = [], 0
        if held:
            yield from flush(held)
    return rows


def _numbered(words: DataFrame, done: list[str]) -> DataFrame:
    """``words`` with ``_number`` from 0 without gaps; frequent words get small numbers, which take less room in packed pairs."""
    rough = _table(words.orderBy(F.col("_times").desc(), "_word").withColumn("_rough", F.monotonically_increasing_id()), "rough", done)
    of = F.shiftright("_rough", 33)
    counts = {r["_of"]: r["_n"] for r in rough.groupBy(of.alias("_of")).agg(F.count(F.lit(1)).alias("_n")).collect()}  # one row a partition
    starts, at = [], 0
    for i in range(max(counts, default=0) + 1):
        starts.append(at)
        at += counts.get(i, 0)
    first = F.get(F.lit(np.array(starts, np.int64)), of.cast("int"))
    return rough.select("_word", "_times", (first + F.col("_rough").bitwiseAND(F.lit((1 << 33) - 1))).alias("_number"))


def _drop(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch tables whose readers are done and written themselves."""
    for path in paths:
        delete_folder(spark, path)


def score_texts(docs: DataFrame, held_out: Column, text: str = "text", doc_id: str = "doc_id", block_bytes: int = BLOCK_BYTES,
                part_times: int = PART_TIMES) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    The model learns from all rows where ``held_out`` is not true. Tokens are words and one end; a null text is empty and has the
    end alone. With nothing to learn from, base and score follow the formulas with all counts 0. Repeated rows count each.

    Texts are dealt into blocks of about ``block_bytes`` by a hash; a block sends its distinct words and pairs once, and gets back the counts
    and weights of just these, so neither a task nor the driver ever holds the model of the whole. Arcs of a word that comes ``part_times``
    times or more are dealt to several tasks. Scratch tables go once they are read.
    """
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`"))), F.sum(F.when(held_out, 0).otherwise(1))).first()
    blocks = max(1, math.ceil((size[0] or 0) / block_bytes))
    rows = docs.select(F.pmod(row_key(doc_id, text)[1], F.lit(blocks)).alias("_block"), (~F.coalesce(held_out, F.lit(False))).alias("_train"),
                       F.col(f"`{text}`").cast("binary").alias("_text"), F.col(f"`{doc_id}`").alias("_id"))
    kind = rows.schema["_id"].dataType.simpleString()
    id_type = rows.select("_id").limit(0).toArrow().schema.field(0).type
    coded = rows.repartition(blocks, "_block").mapInArrow(
        _encoder(id_type), f"_block long, _id {kind}, _train boolean, _codes binary, _place int, _word binary, _times long")
    spent: list[str] = []
    coded = _table(coded, "coded", spent)
    asked = coded.filter(F.col("_word").isNotNull()).select("_block", "_place", "_word", "_times")
    spark, done = docs.sparkSession, []
    words = _table(asked.groupBy("_word").agg(F.sum("_times").alias("_times")), "words", done)
    n, v, once, twice, total, hot = words.agg(F.sum("_times"), F.sum((F.col("_times") > 0).cast("long")), F.sum((F.col("_times") == 1).cast("long")),
                                              F.sum((F.col("_times") == 2).cast("long")), F.count(F.lit(1)),
                                              F.sum((F.col("_times") >= part_times).cast("long"))).first()
    known, ends, hot = int(v or 0), int(size[1] or 0), int(hot or 0)
    n, v = int(n or 0) + ends, known + (ends > 0)
    discount = (once or 0) / ((once or 0) + 2 * (twice or 0)) if once else 0.5
    discount = min(max(discount, 0.1), 0.9)
    end_base = math.log10((ends + 1) / (n + v + 1))
    end = float(word_weight(np.array([float(ends)]), np.array([-math.inf]), n, v, discount)[0]) if ends else end_base
    last: list[str] = []
    weighted = _table(spelled(_numbered(words, done), known, total, done).select("_number", "_word", "_times", "_signs"), "weighted", last)
    _drop(spark, done)
    told = asked.select("_block", "_place", "_word").join(weighted.hint("shuffle_hash"), "_word").select("_block", "_place", "_number", "_times", "_signs")
    told = _table(told.mapInArrow(_packer(hot), "_block long, _told binary, _place int, _number long"), "told")
    _drop(spark, last)
    texts = _table(coded.filter(F.col("_codes").isNotNull()).select("_block", "_id", "_train", "_codes"), "texts")
    _drop(spark, spent)
    packed = told.filter(F.col("_told").isNotNull()).select("_block", "_told")
    pairs = learn_pairs(texts.drop("_id"), packed, blocks, ends, 10 ** end, n, v, discount, hot, part_times)
    sums = pairs.filter(F.col("_state").isNotNull()).groupBy("_state").agg(F.sum("_used").alias("_used"), F.sum("_root").alias("_root"))
    sums = _table(sums, "states")
    start = sums.filter(F.col("_state") == 0).first()  # one row
    start_sums = (float(start["_used"]), float(start["_root"])) if start else (0.0, 0.0)
    nothing = lambda kind: F.lit(None).cast(kind)
    of_hot = told.filter(F.col("_place").isNotNull()).join(sums.select((F.col("_state") - 1).alias("_number"), "_used", "_root"), "_number")
    model = packed.select("_block", "_told", nothing("long").alias("_part"), nothing("binary").alias("_every"), nothing("int").alias("_place"),
                          nothing("double").alias("_used"), nothing("double").alias("_root"))
    model = model.unionByName(pairs.filter(F.col("_every").isNotNull()).select("_block", "_part", "_every"), allowMissingColumns=True)
    model = model.unionByName(of_hot.select("_block", "_place", "_used", "_root"), allowMissingColumns=True)

    def score(texts: pa.Table, own: pa.Table) -> pa.Table:
        rows = lambda mark: own.filter(pc.is_valid(own.column(mark)))
        block = _Block(texts, rows("_told").column("_told").to_pylist(), ends)
        times, states, read, lengths = block.times.astype(np.float64), block.states, block.read, block.lengths
        weight = np.append(word_weight(times[:-2], block.signs, n, v, discount), [0.0, end])
        base = np.append(np.log10((times[:-2] + 1) / (n + v + 1)), [0.0, end_base])
        fit, of, first, second, dealt = block.pairs(blocks, part_times)
        every, used, root = np.zeros(len(first), np.int64), np.zeros(block.size + 2), np.zeros(block.size + 2)
        linked = rows("_every")
        for p, data in zip(linked.column("_part").to_pylist(), linked.column("_every").to_pylist(), strict=True):
            here = dealt[p]
            heads = first[here][np.flatnonzero(np.diff(first[here], prepend=-1))]
            every[here[second[here] >= 0]], taken, many, root[heads] = _opened(data)
            used[heads] = taken - PAIR_DISCOUNT * many
        whole = rows("_place")  # states with arcs in several parts, of which a block may have asked only some
        places = whole.column("_place").to_numpy()
        used[places], root[places] = whole.column("_used").to_numpy(), whole.column("_root").to_numpy()
        used[-2:], root[-2:] = (start_sums[0], 0.0), (start_sums[1], 0.0)
        backoff = np.log10(np.maximum(1 - used / np.maximum(times, 1), 1e-9) / np.maximum(1 - root, 1e-9))
        value = backoff[states] + weight[read]
        share = np.log10(np.maximum(every - PAIR_DISCOUNT, PAIR_DISCOUNT) / np.maximum(times[first], 1))
        value[fit] = np.where(every[of] >= MIN_PAIRS, share[of], value[fit])
        starts = np.cumsum(lengths) - lengths
        total = lambda x: np.add.reduceat(x, starts) if len(starts) else np.zeros(0, x.dtype)
        learned = np.append(times[:-2] > 0, [False, ends > 0]).astype(np.int64)
        return pa.table({"_id": texts.column("_id"), "_train": texts.column("_train"), "n_tokens": lengths, "n_known": total(learned[read]),
                         "base_score": total(base[read]), "score": total(value)})

    scored = texts.groupBy("_block").cogroup(model.groupBy("_block")).applyInArrow(
        score, f"_id {kind}, _train boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select(F.col("_id").alias(doc_id), (~F.col("_train")).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
                         "base_score", "score")


def word_weight(times: np.ndarray, signs: np.ndarray, n: int, v: int, discount: float) -> np.ndarray:
    """log10 of the word arc plus the failure path; ``signs`` are natural logs."""
    if n == 0:
        return signs / math.log(10)
    arc, failure = np.maximum(times - discount, 0) / n, discount * v / n
    with np.errstate(divide="ignore"):
        direct = np.log(arc)
    return np.logaddexp(direct, math.log(failure) + signs) / math.log(10)
