"""Vector code compression: codebooks per part of the dimensions, learned and applied over tries of distinct parts."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecraft.llm.common import small_or_shuffled
from tablecraft.llm.vectors import matrix, usable, whole_numbers
from tablecraft.session import materialise

PARTS = 16
ENTRIES = 64
ROUNDS = 2
RUN = 4096


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry (lowest index among ties) and its squared distance for each of the sorted distinct ``parts``.

    The parts are the leaves of a trie whose levels are their dimensions. It is walked depth first with the distances of all entries
    summed up so far, so the parts below a node share the work of their common prefix. A subtree of at most ``RUN`` leaves is finished
    level by level, a row a node.
    """
    width, code, distance = parts.shape[1], np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)

    def descend(first: int, last: int, depth: int, so_far: np.ndarray) -> None:
        if last - first <= RUN or depth == width:
            sums, node = so_far[None, :], np.zeros(last - first, np.int64)
            for d in range(depth, width):
                value = parts[first:last, d]
                opens = np.append(True, (value[1:] != value[:-1]) | (node[1:] != node[:-1]))
                heads = np.flatnonzero(opens)
                sums = sums[node[heads]] + (value[heads, None] - entries[None, :, d]) ** 2
                node = np.cumsum(opens) - 1
            code[first:last], distance[first:last] = sums.argmin(1)[node], sums.min(1)[node]
            return
        value = parts[first:last, depth]
        cuts = np.concatenate([[0], np.flatnonzero(value[1:] != value[:-1]) + 1, [last - first]])
        for a, b in zip(cuts[:-1], cuts[1:]):
            descend(first + int(a), first + int(b), depth + 1, so_far + (value[a] - entries[:, depth]) ** 2)

    if len(parts):
        descend(0, len(parts), 0, np.zeros(len(entries), np.int64))
    return code, distance


def _summed(books: np.ndarray):
    """Weighted sums of the parts nearest to each entry, one set of rows a task."""
    parts, entries, width = books.shape

    def rows(batches):
        sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            at, times = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            values = matrix(batch.column(1), width, np.int64)
            for part in np.unique(at):
                own = at == part
                code, _ = nearest(values[own], books[part])
                np.add.at(sums[part], code, values[own] * times[own, None])
                np.add.at(counts[part], code, times[own])
        part, entry = np.nonzero(counts)
        flat = lambda x: pa.array(np.repeat(x, width))
        yield pa.RecordBatch.from_arrays([flat(part), flat(entry), pa.array(np.tile(np.arange(width), len(part))), pa.array(sums[part, entry].ravel()),
                                          flat(counts[part, entry])], ["_at", "_entry", "_place", "_sum", "_count"])
    return rows


def whole_vectors(vectors: DataFrame, parts: int, vector: str, vec_id: str, label: str) -> tuple[DataFrame, int]:
    """Usable rows as ``_id``, ``_label``, ``_whole`` (whole components), and their common size, a multiple of ``parts``."""
    rows = vectors.filter(usable(F.col(f"`{vector}`")))
    size = parts * max(1, math.ceil((rows.agg(F.max(F.size(F.col(f"`{vector}`")))).first()[0] or 0) / parts))
    return rows.select(F.col(f"`{vec_id}`").alias("_id"), F.col(f"`{label}`").alias("_label"), whole_numbers(F.col(f"`{vector}`"), size).alias("_whole")), size


def learn(rows: DataFrame, size: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, place) of whole vectors (``_id``, ``_whole``).

    They start as the parts of the ``entries`` smallest ids (null ids last, ties by vector). Distinct parts are counted once, dealt in
    lexicographic order and written; each round walks a trie a task over them and brings back one sum a component and entry, which is as
    much as the codebooks themselves.
    """
    width = size // parts
    first = rows.orderBy(F.col("_id").asc_nulls_last(), "_whole").select("_whole").limit(entries).collect()
    books = np.array([r[0] for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2)
    if not len(first):
        return books
    cut = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.slice("_whole", i * width + 1, width))
    distinct = rows.select(F.posexplode(cut).alias("_at", "_part")).groupBy("_at", "_part").agg(F.count(F.lit(1)).alias("_times"))
    distinct = materialise(distinct.repartitionByRange("_at", "_part").sortWithinPartitions("_at", "_part"))
    for _ in range(rounds):
        found = distinct.mapInArrow(_summed(books), "_at long, _entry long, _place long, _sum long, _count long")
        found = found.groupBy("_at", "_entry", "_place").agg(F.sum("_sum").alias("_sum"), F.sum("_count").alias("_count")).collect()
        books = books.copy()
        for r in found:
            books[r["_at"], r["_entry"], r["_place"]] = r["_sum"] // r["_count"]
    return books


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """Whole vectors (``_id``, ``_label``, ``_whole``) as ``_id``, ``_label``, ``code``, ``error``; nothing is shuffled.

    ``code`` has two hex digits a part, ``error`` is the sum of the squared distances.
    """
    parts, entries, width = books.shape
    if entries > 256:
        raise ValueError("two hex digits name at most 256 entries")

    def batches_of(batches):
        for batch in batches:
            values = matrix(batch.column(2), parts * width, np.int64)
            codes, error = np.zeros((len(values), parts), np.uint8), np.zeros(len(values), np.int64)
            for part in range(parts if len(values) else 0):
                leaves, of = np.unique(values[:, part * width:(part + 1) * width], axis=0, return_inverse=True)
                code, distance = nearest(leaves, books[part])
                codes[:, part], error = code[of.ravel()], error + distance[of.ravel()]
            digits = codes.tobytes().hex()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([digits[i:i + 2 * parts] for i in range(0, len(digits), 2 * parts)], pa.string()),
                                              pa.array(error)], ["_id", "_label", "code", "error"])

    kinds = dict(rows.dtypes)
    return rows.select("_id", "_label", "_whole").mapInArrow(batches_of, f"_id {kinds['_id']}, _label {kinds['_label']}, code string, error long")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, vector: str = "embedding", vec_id: str = "vec_id",
             label: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(``vec_id``, ``label``, ``code``, ``error``, ``label_error``) of each usable row, and the codebooks.

    A component x counts as floor(256 * x), held at plus or minus 2**23. Rows whose vector is null or has a null or non-finite component are left
    out; shorter vectors are padded with zeros. Repeated rows count and are returned each; a null id comes last in the start of the codebooks.
    ``label_error`` is the error summed over rows of equal label, null labels together. An empty table gives no rows and empty codebooks.
    Other columns are not read, whatever their names.
    """
    rows, size = whole_vectors(vectors, parts, vector, vec_id, label)
    books = learn(rows, size, parts, entries, rounds)
    coded = materialise(encode(rows, books))
    totals = coded.groupBy(F.col("_label").alias("_of")).agg(F.sum("error").alias("label_error"))
    coded = coded.join(small_or_shuffled(totals), F.col("_label").eqNullSafe(F.col("_of")))
    return coded.select(F.col("_id").alias(vec_id), F.col("_label").alias(label), "code", "error", "label_error"), books
