"""Near-duplicate vectors: an epsilon grid order join of sequence intervals, exact confirmation, components."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecraft.llm.common import running_before
from tablecraft.llm.graph import components
from tablecraft.llm.vectors import matrix, usable
from tablecraft.session import materialise

COSINE = 0.9
LEADING = 32
SORTED = 8
CELLS = 4
BLOCK = 8192
LEAF = 512
FAN = 16
MARGIN = 1e-4
DENSE = 0.02


def scaled(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors times a power of two that keeps their squares finite, which changes no digit, and their lengths."""
    most = np.abs(vectors).max(1, initial=0.0)
    vectors = vectors * np.exp2(-np.frexp(most)[1].astype(np.float64))[:, None]
    return vectors, np.sqrt((vectors ** 2).sum(1))


def directions(vectors: np.ndarray) -> np.ndarray:
    vectors, lengths = scaled(vectors)
    return vectors / np.maximum(lengths, 1e-300)[:, None]


def _moments(size: int):
    """Count, sums and products of sums of the directions, one set of rows a task."""
    def rows(batches):
        total = np.zeros((size + 1, size + 1))
        for batch in batches:
            units = directions(matrix(batch.column(0), size))
            units = np.column_stack([np.ones(len(units)), units])
            total += units.T @ units
        i, j = np.triu_indices(size + 1)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], ["_i", "_j", "_sum"])
    return rows


def principal_axes(classes: DataFrame, size: int, leading: int) -> tuple[np.ndarray, np.ndarray]:
    """The mean direction and the axes of the largest variance; what reaches the driver is as large as the square of the dimension."""
    sums = classes.select("_vector").mapInArrow(_moments(size), "_i long, _j long, _sum double").groupBy("_i", "_j").agg(F.sum("_sum").alias("_sum"))
    total = np.zeros((size + 1, size + 1))
    for r in sums.collect():
        total[r["_i"], r["_j"]] = total[r["_j"], r["_i"]] = r["_sum"]
    count = max(total[0, 0], 1.0)
    mean = total[0, 1:] / count
    _, axes = np.linalg.eigh(total[1:, 1:] / count - np.outer(mean, mean))
    return mean, np.ascontiguousarray(axes[:, ::-1][:, :leading])


def spots(units: np.ndarray, mean: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Coordinates on the leading axes, then the length of the rest: no two spots are further apart than their vectors."""
    moved = units - mean
    along = moved @ axes
    rest = np.sqrt(np.maximum((moved ** 2).sum(1) - (along ** 2).sum(1), 0.0))
    return np.column_stack([along, rest])


def _cells(size: int, mean: np.ndarray, axes: np.ndarray, width: float):
    def rows(batches):
        for batch in batches:
            found = spots(directions(matrix(batch.column(3), size)), mean, axes)[:, :SORTED]
            cells = np.floor(found / width).astype(np.int32)
            listed = pa.ListArray.from_arrays(np.arange(0, cells.size + 1, max(cells.shape[1], 1), dtype=np.int32)[:len(cells) + 1], cells.ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns, listed], [*batch.schema.names, "_cells"])
    return rows


def _box(size: int, mean: np.ndarray, axes: np.ndarray):
    def one(table: pa.Table) -> pa.Table:
        found = spots(directions(matrix(table.column("_vector"), size)), mean, axes)
        return pa.table({"_node": table.column("_block")[:1], "_low": pa.array([found.min(0).tolist()]), "_high": pa.array([found.max(0).tolist()])})
    return one


def close_intervals(boxes: DataFrame, blocks: int, places: int, eps: float) -> DataFrame:
    """(``_a``, ``_b``), ``_a`` <= ``_b``: blocks of the sequence whose boxes (``_node``, ``_low``, ``_high``) are at most ``eps`` apart.

    Intervals of ``FAN`` blocks, of ``FAN`` such intervals and so on have boxes of their own. From the widest on, only pairs that are not
    provably distant are split into the pairs of their parts, so distant stretches of the sequence never meet.
    """
    levels = [boxes.withColumn("_parent", F.floor(F.col("_node") / FAN))]
    while blocks > FAN:
        blocks = math.ceil(blocks / FAN)
        wider = levels[-1].groupBy(F.col("_parent").alias("_node")).agg(F.array(*[F.min(F.col("_low")[i]) for i in range(places)]).alias("_low"),
                                                                       F.array(*[F.max(F.col("_high")[i]) for i in range(places)]).alias("_high"))
        levels.append(materialise(wider.withColumn("_parent", F.floor(F.col("_node") / FAN))))
    pairs = None
    for level in reversed(levels):
        a, b = (level.select(*[F.col(c).alias(f"{c}{s}") for c in level.columns]) for s in "ab")
        found = a.join(b, F.col("_parenta") == F.col("_parentb")) if pairs is None else pairs.join(a, F.col("_a") == F.col("_parenta")).join(b, F.col("_b") == F.col("_parentb"))
        gap = F.zip_with(F.zip_with("_lowa", "_highb", lambda x, y: x - y), F.zip_with("_lowb", "_higha", lambda x, y: x - y),
                         lambda x, y: F.pow(F.greatest(x, y, F.lit(0.0)), 2))
        apart = F.aggregate(gap, F.lit(0.0), lambda x, y: x + y)
        pairs = materialise(found.filter((F.col("_nodea") <= F.col("_nodeb")) & (apart <= eps * eps + MARGIN)).select(F.col("_nodea").alias("_a"), F.col("_nodeb").alias("_b")))
    return pairs


class _Sequence:
    """One block of the sequence with boxes and balls of its dyadic intervals."""

    def __init__(self, table: pa.Table, size: int, mean: np.ndarray, axes: np.ndarray):
        order = np.argsort(table.column("_rank").to_numpy())
        self.rank, self.times = (table.column(c).to_numpy()[order] for c in ("_rank", "_times"))
        self.vectors, self.lengths = scaled(matrix(table.column("_vector"), size)[order])
        self.units = self.vectors / self.lengths[:, None]
        self.spots = spots(self.units, mean, axes)
        self.narrow, self.half = self.spots.astype(np.float32), ((self.spots ** 2).sum(1) / 2).astype(np.float32)
        self.links = np.zeros(len(self.rank), np.int64)
        self._about: dict = {}

    def about(self, a: int, b: int):
        if (a, b) not in self._about:
            own, units = self.spots[a:b], self.units[a:b]
            center = units.mean(0)
            self._about[a, b] = own.min(0), own.max(0), center, math.sqrt(((units - center) ** 2).sum(1).max())
        return self._about[a, b]


class _Forest:
    """Which rows of a task are linked so far, and the links that made it so."""

    def __init__(self, size: int):
        self.label, self.edges = np.arange(size), []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        """Takes in links, of which only some that join two trees are kept: in each turn one for each tree that has any."""
        while True:
            a, b = self.label[i], self.label[j]
            new = a != b
            if not new.any():
                return
            i, j, a, b = i[new], j[new], a[new], b[new]
            high, low = np.maximum(a, b), np.minimum(a, b)
            trees, at = np.unique(high, return_index=True)
            self.edges.append(np.stack([i[at], j[at]], 1))
            hung = np.arange(len(self.label))
            hung[trees] = low[at]
            while (hung[hung] != hung).any():
                hung = hung[hung]
            self.label = hung[self.label]


def interval_join(left: _Sequence, right: _Sequence | None, cosine: float) -> list[np.ndarray]:
    """Adds the links between two blocks (within one, if ``right`` is not given) to the counts of both; returns a forest of the links.

    Right rows are numbered on after left ones. A pair of intervals is skipped when their boxes are provably too far apart, taken in whole when all of it is
    provably near, else halved down to ``LEAF`` rows. There, bounds from the spots choose the pairs, whose cosines are taken exactly.
    """
    same, right = right is None, left if right is None else right
    eps = math.sqrt(2 - 2 * cosine)
    shift = 0 if same else len(left.rank)
    forest = _Forest(len(left.rank) + (0 if same else len(right.rank)))
    stack = [(0, len(left.rank), 0, len(right.rank))]
    while stack:
        a, b, c, d = stack.pop()
        (low1, high1, mid1, reach1), (low2, high2, mid2, reach2) = left.about(a, b), right.about(c, d)
        if (np.maximum(0, np.maximum(low1 - high2, low2 - high1)) ** 2).sum() > eps * eps + MARGIN:
            continue
        own = same and a == c
        if math.sqrt(((mid1 - mid2) ** 2).sum()) + reach1 + reach2 <= eps - MARGIN:
            left.links[a:b] += right.times[c:d].sum() - (left.times[a:b] if own else 0)
            if not own:
                right.links[c:d] += left.times[a:b].sum()
            forest.add(np.full(d - c, a), np.arange(c, d) + shift)
            forest.add(np.arange(a, b), np.full(b - a, c + shift))
            continue
        if max(b - a, d - c) > LEAF:
            if own:
                m = (a + b) // 2
                stack += [(a, m, a, m), (a, m, m, b), (m, b, m, b)]
            elif b - a >= d - c:
                stack += [(a, (a + b) // 2, c, d), ((a + b) // 2, b, c, d)]
            else:
                stack += [(a, b, c, (c + d) // 2), (a, b, (c + d) // 2, d)]
            continue
        near = left.narrow[a:b] @ right.narrow[c:d].T
        near = near >= (left.half[a:b, None] + right.half[None, c:d]) - np.float32(1 - cosine + MARGIN)
        if own:
            near = np.triu(near, 1)
        if np.count_nonzero(near) > DENSE * near.size:
            near &= left.vectors[a:b] @ right.vectors[c:d].T >= cosine * (left.lengths[a:b, None] * right.lengths[None, c:d])
            i, j = np.nonzero(near)
        else:
            i, j = np.nonzero(near)
            exact = np.einsum("ij,ij->i", left.vectors[a + i], right.vectors[c + j]) >= cosine * (left.lengths[a + i] * right.lengths[c + j])
            i, j = i[exact], j[exact]
        if len(i):
            np.add.at(left.links, a + i, right.times[c + j])
            np.add.at(right.links, c + j, left.times[a + i])
            forest.add(a + i, c + j + shift)
    return forest.edges


def _join(size: int, mean: np.ndarray, axes: np.ndarray, cosine: float):
    """Counts of links of the classes of two blocks (``_u``, ``_n``) and the links of a forest (``_u``, ``_v``)."""
    def one(table: pa.Table) -> pa.Table:
        at = table.column("_block").to_numpy()
        first = table.column("_a")[0].as_py()
        left = _Sequence(table.filter(pa.array(at == first)), size, mean, axes)
        right = None if (at == first).all() else _Sequence(table.filter(pa.array(at != first)), size, mean, axes)
        edges = interval_join(left, right, cosine)
        sides = [left] if right is None else [left, right]
        rank, links = np.concatenate([s.rank for s in sides]), np.concatenate([s.links for s in sides])
        edges = rank[np.concatenate(edges)] if edges else np.zeros((0, 2), np.int64)
        has = links > 0
        return pa.table({"_u": np.concatenate([rank[has], edges[:, 0]]), "_v": pa.array([None] * int(has.sum()) + edges[:, 1].tolist(), pa.int64()),
                         "_n": np.concatenate([links[has], np.zeros(len(edges), np.int64)])})
    return one


def near_vectors(vectors: DataFrame, cosine: float = COSINE, vector: str = "embedding", vec_id: str = "vec_id", leading: int = LEADING, block: int = BLOCK) -> DataFrame:
    """One row for each row of ``vectors``: ``vec_id``, ``n_links``, ``component_id``, ``kept``.

    Vectors are linked when their cosine in double precision is at least ``cosine``. Those that are null or zero, or hold null or non-finite
    components, are linked with nothing; shorter ones are padded with zeros. ``n_links`` counts the other rows linked directly, repeated rows each;
    ``component_id`` is the smallest id that links lead to (null if none there has an id), ``kept`` marks the rows with that id. An empty table gives no
    rows; columns of other names are not read.

    Equal vectors are one class with a count, so copies make no pairs. Classes are sorted by the cells of a grid, ``CELLS`` to an epsilon (the distance of
    two directions at that cosine), on the ``SORTED`` leading principal axes, and cut into blocks of ``block``; cells of any size span several. Blocks
    whose boxes are further apart than epsilon never meet. Each pair of the others is one task, which yields counts and at most one link
    a row fewer than it has rows. Vectors without structure leave few pairs of blocks to skip: the work then grows with their square.
    """
    own, value = F.col(f"`{vec_id}`").cast("long"), F.col(f"`{vector}`")
    linkable = usable(value) & F.coalesce(F.exists(value, lambda x: x != 0), F.lit(False))
    rows = materialise(vectors.select(own.alias("_id"), linkable.alias("_in"), F.xxhash64(value).alias("_key1"), F.xxhash64(F.lit(77), value).alias("_key2"),
                                      F.when(linkable, value).alias("_vector")))
    classes = rows.filter("_in").groupBy("_key1", "_key2").agg(F.count(F.lit(1)).alias("_times"), F.first("_vector").alias("_vector"), F.min("_id").alias("_least"))
    classes = materialise(classes.select("_key1", "_key2", "_times", "_vector", "_least"))
    count, size = classes.agg(F.count(F.lit(1)), F.max(F.size("_vector"))).first()
    if not count:
        return rows.select(F.col("_id").alias(vec_id), F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"), F.lit(True).alias("kept"))
    eps, blocks = math.sqrt(2 - 2 * cosine), math.ceil(count / block)
    mean, axes = principal_axes(classes, size, min(leading, size))
    kind = dict(classes.dtypes)["_vector"]
    placed = classes.mapInArrow(_cells(size, mean, axes, eps / CELLS), f"_key1 long, _key2 long, _times long, _vector {kind}, _least long, _cells array<int>")
    placed = running_before(placed, [], ["_cells", "_key1", "_key2"], F.lit(1), "_rank").drop("_cells")
    placed = materialise(placed.withColumn("_block", F.floor(F.col("_rank") / block)))
    boxes = materialise(placed.select("_block", "_vector").groupBy("_block").applyInArrow(_box(size, mean, axes), "_node long, _low array<double>, _high array<double>"))
    pairs = close_intervals(boxes, blocks, axes.shape[1] + 1, eps)
    ends = F.array_distinct(F.array("_a", "_b"))
    dealt = placed.select("_block", "_rank", "_times", "_vector").join(pairs.select("_a", "_b", F.explode(ends).alias("_block")), "_block")
    found = materialise(dealt.groupBy("_a", "_b").applyInArrow(_join(size, mean, axes, cosine), "_u long, _v long, _n long"))
    roots = components(found.filter(F.col("_v").isNotNull()).select("_u", "_v"))
    links = found.filter(F.col("_v").isNull()).groupBy(F.col("_u").alias("_rank")).agg(F.sum("_n").alias("_links"))
    named = placed.select("_key1", "_key2", "_times", "_least", "_rank").join(links, "_rank", "left").join(roots.withColumnRenamed("_n", "_rank"), "_rank", "left")
    named = materialise(named.withColumn("_root", F.coalesce("_root", "_rank")))
    least = named.groupBy("_root").agg(F.min("_least").alias("_component"))
    named = named.join(least, "_root").select("_key1", "_key2", "_component", (F.coalesce("_links", F.lit(0)) + F.col("_times") - 1).alias("_links"))
    named = rows.filter("_in").select("_id", "_key1", "_key2").join(named, ["_key1", "_key2"]).select("_id", "_links", "_component")
    alone = rows.filter(~F.col("_in")).select("_id", F.lit(0).cast("long").alias("_links"), F.col("_id").alias("_component"))
    return named.unionByName(alone).select(F.col("_id").alias(vec_id), F.col("_links").alias("n_links"), F.col("_component").alias("component_id"),
                                           F.col("_id").eqNullSafe(F.col("_component")).alias("kept"))
