"""Hard-negative mining: largest inner products within windows, found in cover trees over norm-augmented vectors."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablecraft.llm.vectors import matrix, usable, whole_numbers
from tablecraft.session import materialise

POSITIVES = 5
NEGATIVES = 10
LOW_PERCENT, HIGH_PERCENT = 30, 90
SHARD = 4096
ANCHORS = 1024
LEAF = 64
SHRINK = 0.8
POOR = 8
SLACK = 1e-6


@dataclass
class Tree:
    """A cover tree: rows in the order of its leaves, and per node its centre (a row), covering angle, rows from ``first`` to ``last``, parent
    and level. Parents come before their children."""

    rows: np.ndarray
    center: np.ndarray
    angle: np.ndarray
    first: np.ndarray
    last: np.ndarray
    parent: np.ndarray
    level: np.ndarray
    leaf: np.ndarray


def augmented(vectors: np.ndarray) -> tuple[np.ndarray, float]:
    """Vectors with one more component that gives all the same norm, as directions, and that norm.

    An inner product with a query, to which 0 is added, stays as it was and now depends on the angle alone.
    """
    squares = (vectors ** 2).sum(1)
    norm = math.sqrt(squares.max(initial=0.0)) or 1.0
    more = np.sqrt(np.maximum(norm * norm - squares, 0.0))
    return np.column_stack([vectors, more]) / norm, norm


def cover_tree(points: np.ndarray) -> Tree:
    """The cover tree of directions.

    A node's rows are covered by balls of ``SHRINK`` times its covering radius whose centres are further apart than that; the first centre is its own.
    A node of at most ``LEAF`` rows is a leaf, and so is one whose rows lie so far apart that over one in ``POOR`` would be a centre.
    """
    rows, nodes = [], []
    stack = [(np.arange(len(points)), -1, 0)] if len(points) else []
    place = 0
    while stack:
        own, parent, level = stack.pop()
        cosine = np.clip(points[own] @ points[own[0]], -1.0, 1.0)
        reach = math.sqrt(max(0.0, 2 - 2 * cosine.min()))
        children, left = [], own
        if len(own) > LEAF and reach > SLACK:
            nearness = 1 - (SHRINK * reach) ** 2 / 2
            while len(left) and len(children) <= len(own) // POOR:
                near = points[left] @ points[left[0]] >= nearness
                near[0] = True
                children.append(left[near])
                left = left[~near]
        split = bool(children) and not len(left)
        nodes.append((own[0], math.acos(cosine.min()), place, place + len(own), parent, level, not split))
        if split:
            stack += [(c, len(nodes) - 1, level + 1) for c in reversed(children)]
        else:
            rows.append(own)
            place += len(own)
    columns = list(zip(*nodes)) if nodes else [()] * 7
    kinds = (np.int64, np.float64, np.int64, np.int64, np.int64, np.int64, bool)
    return Tree(np.concatenate(rows) if rows else np.zeros(0, np.int64), *[np.array(c, k) for c, k in zip(columns, kinds)])


def bounds(tree: Tree, points: np.ndarray, norm: float, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bound (node, query) of the inner products of each query with the rows of each node."""
    lengths = np.sqrt((queries ** 2).sum(1))
    cosine = points[tree.center][:, :queries.shape[1]] @ (queries / np.maximum(lengths, 1e-300)[:, None]).T
    angle, scale = np.arccos(np.clip(cosine, -1.0, 1.0)), norm * lengths[None, :]
    reach = tree.angle[:, None] + SLACK
    return scale * (np.cos(np.minimum(angle + reach, np.pi)) - SLACK), scale * (np.cos(np.maximum(angle - reach, 0.0)) + SLACK)


def descend(tree: Tree, low: np.ndarray, high: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether (node, query) may hold an inner product between ``least`` and ``most`` of the query, level by level: below a node outside all are outside."""
    meets = (high >= least[None, :]) & (low <= most[None, :])
    for level in range(1, int(tree.level.max(initial=0)) + 1):
        own = np.flatnonzero(tree.level == level)
        meets[own] &= meets[tree.parent[own]]
    return meets


def best_first(tree: Tree, open_leaves: np.ndarray, high: np.ndarray, vectors: np.ndarray, ids: np.ndarray, fits: np.ndarray, query: np.ndarray,
               windows: list[tuple[float, float]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, scores) of the first ``k`` fitting rows of each window, by exact scores.

    Leaves are read from the largest bound on, and no more once no window can gain. ``vectors``, ``ids`` and ``fits`` are in the order of the leaves.
    """
    order = open_leaves[np.argsort(-high[open_leaves], kind="stable")]
    found, scores = np.zeros(0, np.int64), np.zeros(0)
    at, step, enough = 0, 8, -np.inf
    least, most = min(w[0] for w in windows), max(w[1] for w in windows)
    picked = [found] * len(windows)
    while at < len(order) and high[order[at]] >= enough:
        rows = np.concatenate([np.arange(tree.first[n], tree.last[n]) for n in order[at:at + step]])
        at, step = at + step, step * 2
        rows = rows[fits[rows]]
        value = vectors[rows] @ query
        inside = (value >= least) & (value <= most)
        found, scores = np.concatenate([found, rows[inside]]), np.concatenate([scores, value[inside]])
        sort = np.lexsort((ids[found], -scores))
        found, scores = found[sort], scores[sort]
        picked = [np.flatnonzero((scores >= a) & (scores <= b))[:k] for a, b in windows]
        enough = min(scores[p[-1]] if len(p) == k else -np.inf for p in picked)
        keep = np.unique(np.concatenate(picked))
        picked = [np.searchsorted(keep, p) for p in picked]
        found, scores = found[keep], scores[keep]
    return [(ids[found[p]], scores[p].astype(np.int64)) for p in picked]


def _grow(size: int):
    """The tree of one shard as one row."""
    def one(table: pa.Table) -> pa.Table:
        vectors = matrix(table.column("_whole"), size, np.int32)
        order = np.lexsort((*vectors.T[::-1], table.column("_id").to_numpy()))  # the same tree, however the rows arrive
        ids, labels, vectors = table.column("_id").to_numpy()[order], table.column("_label").to_numpy()[order], vectors[order]
        tree = cover_tree(augmented(vectors.astype(np.float64))[0])
        flat = lambda x, kind: pa.array([np.ascontiguousarray(x, kind).tobytes()], pa.binary())
        whole = np.column_stack([tree.center, tree.first, tree.last, tree.parent, tree.level, tree.leaf])
        return pa.table({"_shard": table.column("_shard")[:1], "_ids": flat(ids, np.int64), "_labels": flat(labels, np.int64), "_vectors": flat(vectors, np.int32),
                         "_rows": flat(tree.rows, np.int64), "_nodes": flat(whole, np.int64), "_angles": flat(tree.angle, np.float64)})
    return one


_TREE = "_shard long, _ids binary, _labels binary, _vectors binary, _rows binary, _nodes binary, _angles binary"


def _search(size: int, same: bool, k: int):
    """For each asked window the first ``k`` rows of one shard, of the anchor's label (``same``) or of others."""
    def one(trees: pa.Table, asked: pa.Table) -> pa.Table:
        out = {c: [] for c in ("_anchor", "_nth", "_other", "_score")}
        if trees.num_rows and asked.num_rows:
            read = lambda name, kind: np.frombuffer(trees.column(name)[0].as_py(), kind)
            nodes = read("_nodes", np.int64).reshape(-1, 6)
            vectors = read("_vectors", np.int32).reshape(-1, size).astype(np.float64)
            points, norm = augmented(vectors)
            tree = Tree(read("_rows", np.int64), nodes[:, 0], read("_angles", np.float64), nodes[:, 1], nodes[:, 2], nodes[:, 3], nodes[:, 4], nodes[:, 5] > 0)
            ids, labels, vectors = (x[tree.rows] for x in (read("_ids", np.int64), read("_labels", np.int64), vectors))
            anchors, first, of = np.unique(asked.column("_anchor").to_numpy(), return_index=True, return_inverse=True)
            queries, own = matrix(asked.column("_whole"), size)[first], asked.column("_label").to_numpy()[first]
            least, most = (asked.column(c).to_numpy().astype(np.float64) for c in ("_least", "_most"))
            nth = asked.column("_nth").to_pylist()
            begin, by_anchor = np.searchsorted(np.sort(of), np.arange(len(anchors) + 1)), np.argsort(of, kind="stable")
            low, high = bounds(tree, points, norm, queries)
            span = [by_anchor[begin[i]:begin[i + 1]] for i in range(len(anchors))]
            meets = descend(tree, low, high, np.array([least[s].min() for s in span]), np.array([most[s].max() for s in span])) & tree.leaf[:, None]
            for i, anchor in enumerate(anchors):
                fits = ((labels == own[i]) == same) & (ids != anchor)
                found = best_first(tree, np.flatnonzero(meets[:, i]), high[:, i], vectors, ids, fits, queries[i], [(least[j], most[j]) for j in span[i]], k)
                for j, (others, scores) in zip(span[i], found, strict=True):
                    out["_anchor"] += [int(anchor)] * len(others)
                    out["_nth"] += [nth[j]] * len(others)
                    out["_other"] += others.tolist()
                    out["_score"] += scores.tolist()
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})
    return one


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("_score").desc(), "_other")
    return found.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= k)


def mine(vectors: DataFrame, anchors: Column, label: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW_PERCENT,
         high: int = HIGH_PERCENT, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    A score is the inner product of whole vectors (floor(256 * x), held at plus or minus 2**23; shorter ones are padded with zeros). Each row that ``anchors`` marks
    has as positives the first ``positives`` rows of its ``label`` (a whole number), and for each of them the first ``negatives`` rows of other labels whose
    score lies between ``low`` and ``high`` percent of the positive's; higher scores come first, ties by smaller id. Rows without id or label, and
    those whose vector is null or has null or non-finite components, take no part. Rows of the anchor's own id never serve it; other repeated rows
    count each; an id that several rows have is one anchor, that of the least label and vector. An empty table gives no rows. Columns
    of other names are not read.

    Rows are dealt by a hash into shards of about ``SHARD``, each with a cover tree that is written once; anchors meet every shard in blocks of about
    ``ANCHORS``. A shard sends back no more than the wanted rows of each window.
    """
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("_id"), label.cast("long").alias("_label"), F.col(f"`{vector}`").alias("_vector"), anchors.alias("_asks"))
    rows = rows.filter(F.col("_id").isNotNull() & F.col("_label").isNotNull() & usable(F.col("_vector")))
    count, size, asking = rows.agg(F.count(F.lit(1)), F.max(F.size("_vector")), F.count_if("_asks")).first()
    size, shards, blocks = max(1, size or 0), max(1, math.ceil(count / SHARD)), max(1, math.ceil(asking / ANCHORS))
    rows = rows.select("_id", "_label", "_asks", whole_numbers(F.col("_vector"), size).alias("_whole"))
    shard = F.pmod(F.xxhash64("_id", "_whole"), F.lit(shards)).alias("_shard")
    trees = materialise(rows.select(shard, "_id", "_label", "_whole").groupBy("_shard").applyInArrow(_grow(size), _TREE))
    dealt = trees.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    asks = rows.filter("_asks").groupBy(F.col("_id").alias("_anchor")).agg(F.min(F.struct("_label", "_whole")).alias("_own"))
    asks = materialise(asks.select("_anchor", "_own.*", F.pmod(F.xxhash64("_anchor"), F.lit(blocks)).alias("_block")))

    def search(windows: DataFrame, same: bool, k: int) -> DataFrame:
        everywhere = windows.withColumn("_shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
        return dealt.groupBy("_shard", "_block").cogroup(everywhere.groupBy("_shard", "_block")).applyInArrow(
            _search(size, same, k), "_anchor long, _nth long, _other long, _score long")

    everything = asks.withColumns({"_least": F.lit(-2.0 ** 62), "_most": F.lit(2.0 ** 62), "_nth": F.lit(0).cast("long")})
    best = materialise(_first(search(everything, True, positives), ["_anchor"], positives).select(
        "_anchor", F.col("_rank").cast("long").alias("_nth"), F.col("_other").alias("positive_id"), F.col("_score").alias("positive_score")))
    lowest, highest = F.ceil(F.col("positive_score") * low / F.lit(100)), F.floor(F.col("positive_score") * high / F.lit(100))
    windows = best.withColumns({"_least": lowest.cast("double"), "_most": highest.cast("double")}).filter("_least <= _most").join(asks, "_anchor")
    found = _first(search(windows, False, negatives), ["_anchor", "_nth"], negatives).join(best, ["_anchor", "_nth"])
    return found.select(F.col("_anchor").alias("anchor_id"), "positive_id", F.col("_rank").alias("rank"), F.col("_other").alias("negative_id"),
                        "positive_score", F.col("_score").alias("negative_score"))
