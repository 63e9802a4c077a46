"""Removal of word windows that an earlier document has: count-min prefilter, then exact grouping."""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecraft.llm.common import row_key, written
from tablecraft.llm.words import SECOND_BASE, U64, mix, powers, window_hashes, words_of

WIDTH = 50
GRAM = 8
DEPTH = 2
CELLS_PER_ENTRY = 8
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def anchors(hashes: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The anchors of one text: hash, hash of the whole stretch, first and last window start.

    The anchor of a window is the smallest hash of its ``gram``-word runs, the first of equal ones. Equal windows have equal
    anchors at equal places, so a window is repeated only if its anchor is. Windows in a row with the same anchor are one entry.
    """
    grams = window_hashes(hashes, gram)
    inside = width - gram + 1
    starts = len(hashes) - width + 1
    spot = np.empty(starts, np.int64)
    for at in range(0, starts, 1 << 16):
        part = grams[at:min(at + (1 << 16), starts) + inside - 1]
        spot[at:at + (1 << 16)] = np.lib.stride_tricks.sliding_window_view(part, inside).argmin(1) + np.arange(at, min(at + (1 << 16), starts))
    first = np.flatnonzero(np.concatenate([[True], spot[1:] != spot[:-1]]))
    last = np.concatenate([first[1:] - 1, [starts - 1]])
    up, down = powers(SECOND_BASE, len(hashes))
    total = np.zeros(len(hashes) + 1, U64)
    np.cumsum(hashes * up, out=total[1:])
    stretch = mix(mix((total[last + width] - total[first]) * down[first]) ^ (last - first).astype(U64))
    return grams[spot[first]], stretch, first, last


def _anchor_rows(width: int, gram: int):
    def rows(batches):
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for words in words_of(batch.column(2), lower=False):
                parts = []
                for i in range(words.texts):
                    own = words.hashes[words.first[i]:words.first[i + 1]]
                    if len(own) >= width:
                        found = anchors(own, width, gram)
                        at = words.rows.start + i
                        parts.append((np.full(len(found[0]), ids[at]), np.full(len(found[0]), keys[at]), found[0].astype(np.int64),
                                      found[1].astype(np.int64), found[2].astype(np.int32), found[3].astype(np.int32)))
                if parts:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)],
                                                     ["_id", "_key", "_anchor", "_stretch", "_from", "_to"])
    return rows


def _window_rows(width: int):
    def rows(batches):
        for batch in batches:
            ids, keys, ranges = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3).to_pylist()
            for words in words_of(batch.column(2), lower=False):
                for i in range(words.texts):
                    own, at = words.hashes[words.first[i]:words.first[i + 1]], words.rows.start + i
                    spots = np.unique(np.concatenate([np.arange(r["_from"], r["_to"] + 1) for r in ranges[at]]))
                    one, two = window_hashes(own, width)[spots], window_hashes(own, width, SECOND_BASE)[spots]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(spots), ids[at])), pa.array(np.full(len(spots), keys[at])),
                                                      pa.array(one.astype(np.int64)), pa.array(two.astype(np.int64)), pa.array(spots.astype(np.int32))],
                                                     ["_id", "_key", "_one", "_two", "_from"])
    return rows


def estimated_repeats(entries: DataFrame) -> DataFrame:
    """The entries whose ``_anchor`` a count-min sketch puts at two or more.

    Each task sketches its own entries (the cells it touches, with counts); the sketches are merged by cell. The sketch has ``CELLS_PER_ENTRY``
    cells an entry in each of ``DEPTH`` rows, so it grows with the input and is never in one place. It never underestimates.
    """
    width = 1 << max(10, math.ceil(math.log2(CELLS_PER_ENTRY * max(1, entries.count()))))
    cells = [F.pmod(F.xxhash64(F.lit(d), "_anchor"), F.lit(width)) + d * width for d in range(DEPTH)]
    merged = entries.select(F.explode(F.array(*cells)).alias("_cell")).groupBy("_cell").agg(F.count(F.lit(1)).alias("_times"))
    repeated = merged.filter(F.col("_times") >= 2).select("_cell")
    for cell in cells:
        entries = entries.withColumn("_cell", cell).join(repeated, "_cell", "left_semi").drop("_cell")
    return entries


def repeated_ranges(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """Ranges of window starts (``_from``, ``_to``) of the rows (``_id``, ``_key``, ``_text``) that a smaller id has too."""
    known = docs.filter(F.col("_id").isNotNull())
    entries = known.mapInArrow(_anchor_rows(width, gram), "_id long, _key long, _anchor long, _stretch long, _from int, _to int")
    entries = written(estimated_repeats(written(entries, "anchors")), "repeats")
    stretches = entries.groupBy("_anchor", "_stretch").agg(F.min("_id").alias("_low"))
    kinds = stretches.groupBy("_anchor").agg(F.count(F.lit(1)).alias("_kinds"))
    told = entries.join(stretches, ["_anchor", "_stretch"]).join(kinds, "_anchor")
    told = written(told.select("_id", "_key", "_from", "_to", "_low", "_kinds").filter((F.col("_id") > F.col("_low")) | (F.col("_kinds") > 1)), "told")
    # A stretch that a smaller id has as a whole is settled. Of the others, those whose anchor stands in different stretches
    # may share single windows; these are grouped exactly, by 128 bits.
    whole = told.filter(F.col("_id") > F.col("_low")).select("_id", "_key", "_from", "_to")
    open_ = told.filter(F.col("_id") == F.col("_low")).groupBy("_id", "_key").agg(F.collect_list(F.struct("_from", "_to")).alias("_ranges"))
    windows = known.join(open_, ["_id", "_key"]).select("_id", "_key", "_text", "_ranges")
    windows = written(windows.mapInArrow(_window_rows(width), "_id long, _key long, _one long, _two long, _from int"), "windows")
    lows = windows.groupBy("_one", "_two").agg(F.min("_id").alias("_low"), F.max("_id").alias("_high")).filter(F.col("_low") < F.col("_high"))
    single = windows.join(lows, ["_one", "_two"]).filter(F.col("_id") > F.col("_low"))
    return whole.unionByName(single.select("_id", "_key", "_from", F.col("_from").alias("_to")))


def _cut(width: int, at: int):
    def rows(batches):
        for batch in batches:
            total, removed, texts = [], [], []
            for text, ranges in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                words = WORD.findall(text) if text else []
                gone = np.zeros(len(words), bool)
                for r in ranges or ():
                    gone[r["_from"]:r["_to"] + width] = True
                total.append(len(words))
                removed.append(int(gone.sum()))
                texts.append(" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g))
            new = [pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string()),
                   pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], [*batch.schema.names[:-1], "n_words", "n_removed", "kept_text", "kept_sha256"])
    return rows


def remove_repeated_windows(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """Every row of ``docs`` with ``n_words``, ``n_removed``, ``kept_text`` and ``kept_sha256``, which replace columns of these names.

    A window is ``width`` words in a row. Each word covered by a window that also stands in a row of a smaller id is removed; windows are judged on the
    input. Kept words are joined by one space. Null, empty and blank texts have no words; rows that repeat an id do not remove each other;
    a row without id neither removes nor loses words. Ids are whole numbers.
    """
    new = ["n_words", "n_removed", "kept_text", "kept_sha256"]
    kept = [c for c in docs.columns if c not in new]
    ids = [F.col(f"`{doc_id}`").cast("long").alias("_id"), row_key(doc_id, text)[0].alias("_key")]
    ranges = repeated_ranges(docs.select(*ids, F.col(f"`{text}`").alias("_text")), width)
    ranges = ranges.distinct().groupBy(F.col("_id").alias("_own"), F.col("_key").alias("_own_key")).agg(F.collect_list(F.struct("_from", "_to")).alias("_ranges"))
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], *ids)
    rows = rows.join(ranges, (F.col("_id") == F.col("_own")) & (F.col("_key") == F.col("_own_key")), "left")
    rows = rows.select(*[F.col(f"`{c}`") for c in kept], "_ranges")
    fields = [f for f in rows.schema.fields if f.name != "_ranges"]
    schema = T.StructType([*fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
                           T.StructField("kept_text", T.StringType()), T.StructField("kept_sha256", T.StringType())])
    return rows.mapInArrow(_cut(width, kept.index(text)), schema)
