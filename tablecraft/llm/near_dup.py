"""Near-duplicate texts: MinHash signatures, a multi-index Hamming join, exact confirmation, components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablecraft.llm.common import row_key
from tablecraft.llm.graph import components
from tablecraft.llm.words import U64, mix, window_hashes, words_of
from tablecraft.session import materialise

WIDTH = 5
PERCENT = 75
CHUNKS = 12
CHUNK = 5
BLOCK = 256
BUCKET = 256
DISTANCE = 35
_SEEDS = mix(np.arange(1, CHUNKS * CHUNK + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))


def shingle_sets(texts: pa.Array):
    """The sorted distinct shingle hashes of each text in turn."""
    for words in words_of(texts, lower=True):
        shingles = window_hashes(words.hashes, WIDTH)
        for i in range(words.texts):
            a, b = words.first[i], words.first[i + 1]
            if b - a >= WIDTH:
                yield np.unique(shingles[a:b - WIDTH + 1])
            elif b > a:
                yield window_hashes(words.hashes[a:b], int(b - a))
            else:
                yield np.zeros(0, U64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The low 16 bits of the smallest of each of the scrambled orders of a set."""
    out = np.empty(len(_SEEDS), np.uint16)
    for at in range(0, len(_SEEDS), 20):
        low = None
        for part in range(0, len(shingles), 4096):
            values = mix(shingles[part:part + 4096, None] ^ _SEEDS[None, at:at + 20]).min(0)
            low = values if low is None else np.minimum(low, values)
        out[at:at + 20] = (low & U64(0xFFFF)).astype(np.uint16)
    return out


def index_keys(signatures: np.ndarray) -> np.ndarray:
    """Keys of each signature: for each chunk of five positions, each way to leave one of them out.

    Two signatures that differ in at most ``2 * CHUNKS - 1`` of the positions have a chunk with at most one
    difference, so they share a key for certain.
    """
    n, keys = len(signatures), []
    wide = signatures.astype(U64)
    for c in range(CHUNKS):
        for left_out in range(CHUNK):
            picked = [c * CHUNK + j for j in range(CHUNK) if j != left_out]
            packed = np.zeros(n, U64)
            for j in picked:
                packed = (packed << U64(16)) | wide[:, j]
            keys.append(mix(packed ^ _SEEDS[c * CHUNK + left_out]))
    return np.stack(keys, 1).astype(np.int64) if n else np.zeros((0, CHUNKS * CHUNK), np.int64)


def _sign(batches):
    for batch in batches:
        sizes, marks, signs = [], [], []
        for s in shingle_sets(batch.column(2)):
            sizes.append(len(s))
            marks.append([int(mix(mix(s ^ salt).sum(keepdims=True) ^ U64(len(s))).astype(np.int64)[0]) if len(s) else 0 for salt in (U64(0), _SEEDS[0])])
            signs.append(signature(s).tobytes() if len(s) else b"")
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array([m for m, _ in marks], pa.int64()),
                                          pa.array([m for _, m in marks], pa.int64()), pa.array(signs, pa.binary())], ["_id", "_key", "_size", "_mark1", "_mark2", "_sign"])


def _index(batches):
    for batch in batches:
        ids = batch.column(0).to_numpy()
        for at in range(0, len(ids), 4096):
            part = batch.column(1).slice(at, 4096)
            signs = np.frombuffer(b"".join(part.to_pylist()), np.uint16).reshape(len(part), -1)
            keys = index_keys(signs)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(ids[at:at + 4096], keys.shape[1]))], ["_shared_key", "_id"])


def close_ties(keys: np.ndarray, ids: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ties of ids with the smallest id that they reach by steps between signatures of one key that differ in at most ``DISTANCE`` values.

    Rows come by key and id.
    """
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lag in range(1, len(keys)):
        same = np.flatnonzero(keys[lag:] == keys[:-lag])
        if not len(same):
            break
        close = same[(signs[same] != signs[same + lag]).sum(1) <= DISTANCE]
        left.append(close)
        right.append(close + lag)
    u, v, least = np.concatenate(left), np.concatenate(right), np.arange(len(keys))
    while True:
        before = least.copy()
        np.minimum.at(least, u, before[v])
        np.minimum.at(least, v, before[u])
        least = least[least]
        if np.array_equal(least, before):
            break
    tied = np.flatnonzero(least != np.arange(len(keys)))
    return ids[tied], ids[least[tied]]


def _close(batches):
    """``close_ties`` of whole keys; a key that ends a batch may go on in the next."""
    def told(table: pa.Table) -> pa.RecordBatch:
        signs = np.frombuffer(b"".join(table.column("_sign").to_pylist()), np.uint16).reshape(table.num_rows, -1)
        ties = close_ties(table.column("_shared_key").to_numpy(), table.column("_id").to_numpy(), signs)
        return pa.RecordBatch.from_arrays([pa.array(t) for t in ties], ["_u", "_v"])

    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        keys = table.column("_shared_key").to_numpy()
        whole = int(np.searchsorted(keys, keys[-1]))
        rest = table.slice(whole)
        if whole:
            yield told(table.slice(0, whole))
    if rest is not None:
        yield told(rest)


def _pack_sets(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), batch.column(4), pa.array(
            [s.tobytes() for s in shingle_sets(batch.column(2))], pa.binary())], ["_id", "_group", "_count", "_pivot", "_set"])


def links_between(left: list[np.ndarray], right: list[np.ndarray] | None) -> list[tuple[int, int]]:
    """Forest of the links among ``left`` (and between left and right, when given) whose similarity is high enough.

    Right positions count on after left ones. At most one link fewer than there are sets is returned.
    """
    sets = left + (right or [])
    n, sizes = len(sets), np.array([len(s) for s in sets])
    if n < 2:
        return []
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(code, kind="stable")
    owners = owner[order]
    begin = np.searchsorted(code[order], np.arange(code.max() + 2 if len(code) else 1))
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    forest, start = [], np.concatenate([[0], np.cumsum(sizes)])
    for i in range(n if right is None else len(left)):
        own = code[start[i]:start[i + 1]]
        lengths = begin[own + 1] - begin[own]
        own, lengths = own[lengths > 1], lengths[lengths > 1]
        if not len(own):
            continue
        at = np.repeat(begin[own] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        shared = np.bincount(owners[at], minlength=n)
        linked = 100 * shared >= PERCENT * (sizes[i] + sizes - shared)
        linked &= shared > 0
        for j in np.flatnonzero(linked):
            if j > i or right is not None:
                a, b = root(i), root(int(j))
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    forest.append((i, int(j)))
    return forest


def _confirm(table: pa.Table) -> pa.Table:
    """Links within one group of sets: all of them, or those of its part 0 with its part 1."""
    part = table.column("_part").to_numpy()
    ids = table.column("_id").to_numpy()
    sets = [np.frombuffer(b, U64) for b in table.column("_set").to_pylist()]
    left, right = np.flatnonzero(part == 0), np.flatnonzero(part == 1)
    if not len(left):
        right = left
    at = np.concatenate([left, right])
    forest = links_between([sets[i] for i in left], [sets[i] for i in right] if len(right) else None)
    return pa.table({"_u": pa.array([int(ids[at[a]]) for a, _ in forest], pa.int64()), "_v": pa.array([int(ids[at[b]]) for _, b in forest], pa.int64())})


def _closeness(batches):
    """Whether each row's set is linked with the set of its group's pivot."""
    for batch in batches:
        near = []
        for own, pivot in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            a, b = np.frombuffer(own, U64), np.frombuffer(pivot, U64)
            shared = len(np.intersect1d(a, b, assume_unique=True))
            near.append((shared, len(a) + len(b) - shared))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[0] for x in near], pa.int64()), pa.array([x[1] for x in near], pa.int64())],
                                         ["_id", "_group", "_shared", "_union"])


def _links(sets: DataFrame) -> DataFrame:
    """Confirmed links (a forest of each group, or of its blocks) among ``sets`` (``_id``, ``_group``, ``_set``, ``_count``, ``_pivot``).

    A group of up to ``BLOCK`` sets is compared whole in one task. In a larger one all sets are first compared with one pivot.
    The sets linked to it are connected already, so only the others are compared with each other and with those linked sets whose distance
    to the pivot allows a link (the Jaccard distance obeys the triangle inequality), in pairs of blocks.
    """
    about = sets.groupBy("_group").agg(F.max("_count").alias("_count"), F.max("_pivot").alias("_pivot"))
    small = sets.filter(F.col("_count") <= BLOCK).withColumn("_part", F.lit(0))
    links = small.select("_group", "_id", "_part", "_set").groupBy("_group").applyInArrow(_confirm, "_u long, _v long")
    if about.filter(F.col("_count") > BLOCK).isEmpty():
        return links

    large = sets.filter(F.col("_count") > BLOCK)
    pivots = large.filter(F.col("_id") == F.col("_pivot")).select("_group", F.col("_set").alias("_pivot_set"))
    close = large.join(pivots, "_group").select("_id", "_group", "_set", "_pivot_set")
    close = materialise(close.mapInArrow(_closeness, "_id long, _group long, _shared long, _union long"))
    linked = 100 * F.col("_shared") >= PERCENT * F.col("_union")
    distance = 1 - F.col("_shared") / F.col("_union")
    close = close.withColumn("_far", ~linked).withColumn("_distance", distance)
    nearest = close.filter("_far").groupBy("_group").agg(F.min("_distance").alias("_nearest"), F.count(F.lit(1)).alias("_outside"))
    rim = close.join(nearest, "_group").filter(F.col("_far") | (F.col("_distance") >= F.col("_nearest") - (1 - PERCENT / 100) - 1e-9))
    rim = rim.withColumn("_blocks", F.ceil(F.col("_outside") / BLOCK))
    # blocks of outside sets are numbered from 0; blocks of linked sets have negative numbers
    spot = F.pmod(F.xxhash64("_id"), F.col("_blocks"))
    inner = close.join(nearest, "_group").filter(~F.col("_far")).groupBy("_group").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_inner"))
    rim = rim.join(inner, "_group", "left").withColumn("_inner", F.coalesce("_inner", F.lit(1)))
    rim = rim.withColumn("_block", F.when(F.col("_far"), spot).otherwise(-1 - F.pmod(F.xxhash64("_id"), F.col("_inner"))))
    every = F.sequence(F.when(F.col("_far"), -F.col("_inner")).otherwise(0).cast("long"), F.col("_blocks") - 1)
    own = F.transform(every, lambda b: F.struct(F.greatest(b, F.col("_block")).alias("a"), F.least(b, F.col("_block")).alias("b"),
                                               F.when(b > F.col("_block"), 1).otherwise(0).alias("part")))
    dealt = rim.select("_id", "_group", F.explode(own).alias("_pair"))
    dealt = dealt.select("_id", "_group", "_pair.a", "_pair.b", F.col("_pair.part").alias("_part"))
    dealt = dealt.join(large.select("_id", "_set"), "_id").select("_group", "a", "b", "_id", "_part", "_set")
    across = dealt.groupBy("_group", "a", "b").applyInArrow(_confirm, "_u long, _v long")
    direct = close.filter(~F.col("_far")).join(about, "_group").select(F.col("_id").alias("_u"), F.col("_pivot").alias("_v"))
    return links.unionByName(across).unionByName(direct)


def _classes_of_groups(classes: DataFrame) -> DataFrame:
    """Classes with candidates, by connected group: ``_class``, ``_group``, ``_count``, ``_pivot``.

    The signatures of a key with up to ``BUCKET`` classes are compared there, and only those that differ in at most ``DISTANCE`` values
    are tied, each with the smallest one that it reaches. In a larger key each class is tied to the smallest one.
    """
    keys = materialise(classes.select("_class", "_sign").mapInArrow(_index, "_shared_key long, _id long"))
    heads = keys.groupBy("_shared_key").agg(F.min("_id").alias("_head"), F.count(F.lit(1)).alias("_members")).filter(F.col("_members") > 1)
    members = keys.join(heads, "_shared_key")
    few = members.filter(F.col("_members") <= BUCKET).select("_shared_key", "_id")
    few = few.join(classes.select(F.col("_class").alias("_id"), "_sign"), "_id")
    few = few.repartition("_shared_key").sortWithinPartitions("_shared_key", "_id").mapInArrow(_close, "_u long, _v long")
    many = members.filter((F.col("_members") > BUCKET) & (F.col("_id") > F.col("_head"))).select(F.col("_id").alias("_u"), F.col("_head").alias("_v"))
    ties = materialise(few.unionByName(many).distinct())
    groups = materialise(components(ties))
    counts = groups.groupBy("_root").agg(F.count(F.lit(1)).alias("_count"))
    pull = ties.groupBy(F.col("_v").alias("_n")).agg(F.count(F.lit(1)).alias("_pull")).join(groups, "_n")
    pivots = pull.groupBy("_root").agg(F.max(F.struct("_pull", "_n"))["_n"].alias("_pivot"))
    about = counts.join(pivots, "_root")
    return groups.join(about, "_root").select(F.col("_n").alias("_class"), F.col("_root").alias("_group"), "_count", "_pivot")


def assign_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: ``_id``, ``_key`` (a hash of id and text), ``n_shingles``, ``component_id``, ``kept``.

    Texts are linked when their sets of distinct five-word shingles have a similarity of 0.75 or more; a text of fewer words is one
    shingle. ``component_id`` is the smallest id that can be reached, ``kept`` marks the rows with that id. A null, empty or
    blank text has no shingle and is linked with nothing. Ids are whole numbers; a row without id has the component of its text,
    or null if nothing in it has an id. Repeated rows get equal results; rows that repeat an id with other texts are rows of their own.

    Equal sets (by 128 bits of all their shingles) become one class; only classes go on. Their signatures (60 values of 16 bits) are indexed so
    that any two that differ in at most 23 values share a key; at a similarity of 0.75 the chance to share none is about 6e-6,
    and it vanishes above. Two that share one are candidates if they differ in at most 35 values; at 0.75 the chance of more is below 1e-7.
    Each member of a key is tied to the smallest it reaches, never to all others; the connected groups of
    these ties hold all links and are compared exactly on full sets.
    """
    whole = docs.select(F.col(f"`{doc_id}`").cast("long").alias("_id"), row_key(doc_id, text)[0].alias("_key"), F.col(f"`{text}`").alias("_text"))
    signed = materialise(whole.mapInArrow(_sign, "_id long, _key long, _size long, _mark1 long, _mark2 long, _sign binary"))
    classes = signed.filter(F.col("_size") > 0).groupBy("_mark1", "_mark2").agg(
        F.min(F.struct("_id", "_key")).alias("_of"), F.min("_id").alias("_first"), F.min("_sign").alias("_sign"))
    classes = materialise(classes.withColumn("_class", F.monotonically_increasing_id()))
    members = _classes_of_groups(classes).join(classes.select("_class", "_of"), "_class")
    members = materialise(members.select("_class", "_group", "_count", "_pivot", F.col("_of._id").alias("_first"), F.col("_of._key").alias("_mark")))
    texts = whole.join(members, F.col("_id").eqNullSafe(F.col("_first")) & (F.col("_key") == F.col("_mark")))
    sets = texts.select("_class", "_group", "_text", "_count", "_pivot").mapInArrow(
        _pack_sets, "_id long, _group long, _count long, _pivot long, _set binary")
    links = _links(materialise(sets))
    roots = components(links).withColumnRenamed("_n", "_class")
    roots = classes.select("_class", "_first", "_mark1", "_mark2").join(roots, "_class", "left").withColumn("_root", F.coalesce("_root", "_class"))
    roots = materialise(roots)
    firsts = roots.groupBy("_root").agg(F.min("_first").alias("component_id"))
    found = roots.join(firsts, "_root").select("_mark1", "_mark2", "component_id")
    whole = signed.select("_id", "_key", "_size", "_mark1", "_mark2").join(found, ["_mark1", "_mark2"], "left")
    component = F.when(F.col("_size") > 0, F.col("component_id")).otherwise(F.col("_id"))
    return whole.select("_id", "_key", F.col("_size").alias("n_shingles"), component.alias("component_id"),
                        F.col("_id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that are kept: one of each component, that of the smallest id; all columns as they were.

    Rows without shingles stay. Of rows that repeat id and text one stays.
    """
    kept = assign_components(docs, text, doc_id).filter("kept")
    kept = materialise(kept.groupBy("_id", "_key").agg(F.count(F.lit(1)).alias("_times")))
    names = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(*names, F.col(f"`{doc_id}`").cast("long").alias("_own"), row_key(doc_id, text)[0].alias("_own_key"))
    rows = rows.join(kept, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_own_key") == F.col("_key")))
    if kept.filter(F.col("_times") > 1).isEmpty():
        return rows.select(*names)
    first = Window.partitionBy("_own", "_own_key").orderBy(F.lit(1))
    rows = rows.withColumn("_nth", F.when(F.col("_times") > 1, F.row_number().over(first)).otherwise(1))
    return rows.filter(F.col("_nth") == 1).select(*names)
