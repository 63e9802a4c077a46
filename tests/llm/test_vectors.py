"""Vector operators against brute force: planted near copies, ties, repeated rows, nulls, ragged and empty tables, clashing columns."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablecraft.llm import embedding_dedup, hard_negatives, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, rank string, n_links string, _id long, _vector string"
ODD = [None, [], [0.0] * 8, [float("nan")] * 8, [1.0, None] + [0.5] * 6, [float("inf")] + [0.0] * 7, [-0.25, 0.5]]


def frame(spark, rows):
    plain = [(i, None if v is None else [None if x is None else float(x) for x in v], y, "c", "r", "l", 5, "v") for i, v, y in rows]
    return spark.createDataFrame(plain, SCHEMA)


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def whole(v, size):
    return [math.floor(256 * float(np.float32(x))) for x in v] + [0] * (size - len(v))


@pytest.fixture(scope="module")
def mixed():
    """Clusters of near copies around the cosine of 0.9, exact copies, a hot vector, structureless and odd vectors."""
    rng = np.random.default_rng(11)
    rows = []
    for c in range(30):
        center = rng.normal(size=8)
        for _ in range(20):
            rows.append((center / np.linalg.norm(center) + rng.normal(size=8) * rng.choice([0.02, 0.12, 0.2])).astype(np.float32).tolist())
    rows += rng.normal(size=(300, 8)).astype(np.float32).tolist() + [rows[3]] * 250 + [rows[7]] * 2
    order = rng.permutation(len(rows))
    made = [(int(i) * 3 + 5, rows[j], int(rng.integers(0, 4))) for i, j in enumerate(order)]
    made += [(9000 + i, v, i % 3) for i, v in enumerate(ODD)] + [(None, rows[3], 1), (9100, rows[0], None), made[0], made[0]]
    return made


def linked(rows, cosine=0.9):
    """(row, number of links, component) by brute force."""
    fit = [i for i, (_, v, _) in enumerate(rows) if usable(v) and any(v)]
    x = np.zeros((len(rows), 8))
    for i in fit:
        x[i, :len(rows[i][1])] = np.array(rows[i][1], np.float32)
    lengths = np.linalg.norm(x, axis=1)
    near = np.zeros((len(rows), len(rows)), bool)
    near[np.ix_(fit, fit)] = (x[fit] @ x[fit].T) / np.outer(lengths[fit], lengths[fit]) >= cosine
    np.fill_diagonal(near, False)
    root = np.arange(len(rows))
    while True:
        new = np.array([min(root[i], root[near[i]].min(initial=len(rows))) for i in range(len(rows))])
        if (new == root).all():
            break
        root = new
    least = {}
    for i, r in enumerate(root):
        if rows[i][0] is not None:
            least[r] = min(least.get(r, 1 << 60), rows[i][0])
    return sorted(((rows[i][0], int(near[i].sum()), least.get(root[i])) for i in range(len(rows))), key=str)


@pytest.mark.parametrize("block", [40, 8192])
def test_near_vectors(spark, mixed, block):
    got = embedding_dedup.near_vectors(frame(spark, mixed), block=block).collect()
    want = linked(mixed)
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=str) == want
    assert max(n for _, n, _ in want) > 250 and len({c for _, _, c in want}) < 700
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_near_vectors_of_few_axes(spark, mixed):
    got = embedding_dedup.near_vectors(frame(spark, mixed), 0.97, leading=2, block=64).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=str) == linked(mixed, 0.97)


def test_distant_blocks_do_not_meet(spark):
    rng = np.random.default_rng(2)
    angles = np.sort(rng.random(4000) * 2 * np.pi)
    boxes = [(i, np.array([np.cos(a), np.sin(a)]).min(1).tolist(), np.array([np.cos(a), np.sin(a)]).max(1).tolist()) for i, a in enumerate(angles.reshape(400, 10))]
    table = spark.createDataFrame(boxes, "_node long, _low array<double>, _high array<double>")
    got = {tuple(r) for r in embedding_dedup.close_intervals(table, 400, 2, 0.05).collect()}
    gap = lambda a, b: sum(max(0, la - hb, lb - ha) ** 2 for la, ha, lb, hb in zip(a[1], a[2], b[1], b[2]))
    limit = 0.05 ** 2 + embedding_dedup.MARGIN
    assert got == {(a[0], b[0]) for a in boxes for b in boxes if a[0] <= b[0] and gap(a, b) <= limit} and len(got) < 8000


def test_intervals_that_are_all_near_are_taken_whole(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (np.ones(8) + rng.normal(size=8) * 0.01).tolist(), 0) for i in range(1500)] + [(2000 + i, v, 0) for i, v in enumerate(rng.normal(size=(700, 8)).tolist())]
    got = embedding_dedup.near_vectors(frame(spark, rows)).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=str) == linked(rows)


def mined(rows, anchor_every=5, size=8):
    rows = [(i, y, whole(v, size)) for i, v, y in rows if i is not None and y is not None and usable(v)]
    out = []
    for anchor in sorted({i for i, _, _ in rows if i % anchor_every == 0}):
        label, own = min((y, w) for i, y, w in rows if i == anchor)
        scored = sorted((-sum(a * b for a, b in zip(w, own)), i, y) for i, y, w in rows if i != anchor)
        for s, p, _ in [x for x in scored if x[2] == label][:5]:
            fit = [(i, -t) for t, i, y in scored if y != label and 30 * -s <= 100 * -t <= 90 * -s]
            out += [(anchor, p, n + 1, i, -s, t) for n, (i, t) in enumerate(fit[:10])]
    return sorted(out)


def test_hard_negatives(spark, mixed):
    got = hard_negatives.mine(frame(spark, mixed), F.col("vec_id") % 5 == 0, F.col("label"))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = mined(mixed)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 1000


def test_hard_negatives_over_many_shards_and_blocks(spark, mixed, monkeypatch):
    monkeypatch.setattr(hard_negatives, "SHARD", 100)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 30)
    got = hard_negatives.mine(frame(spark, mixed), F.col("vec_id") % 5 == 0, F.col("label"))
    assert sorted(map(tuple, got.collect())) == mined(mixed)


def test_cover_tree():
    rng = np.random.default_rng(6)
    vectors = np.concatenate([rng.normal(size=6) * 3 + rng.normal(size=(120, 6)) * 0.2 for _ in range(25)])
    points, norm = hard_negatives.augmented(vectors)
    tree = hard_negatives.cover_tree(points)
    assert sorted(tree.rows) == list(range(len(vectors))) and tree.level.max() >= 2 and np.allclose(np.linalg.norm(points, axis=1), 1)
    queries = rng.normal(size=(20, 6)) * 5
    low, high = hard_negatives.bounds(tree, points, norm, queries)
    true = queries @ vectors.T
    for n in range(len(tree.center)):
        own = true[:, tree.rows[tree.first[n]:tree.last[n]]]
        assert (low[n] <= own.min(1)).all() and (high[n] >= own.max(1)).all()
    read = []

    class Counted(np.ndarray):
        def __getitem__(self, at):
            read.append(np.size(at))
            return np.asarray(self)[at]
    own, everyone = vectors[tree.rows].view(Counted), np.ones(len(vectors), bool)
    leaves = np.flatnonzero(tree.leaf)
    for q in range(20):
        found, = hard_negatives.best_first(tree, leaves, high[:, q], own, tree.rows, everyone, queries[q], [(-np.inf, np.inf)], 3)
        assert set(found[0]) == set(np.argsort(-true[q])[:3])
    assert sum(read) < 20 * len(vectors) / 2  # most leaves are never read


def coded(rows, size=16, parts=16, entries=64):
    rows = [(i, y, np.array(whole(v, size))) for i, v, y in rows if usable(v)]
    width = size // parts
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2].tolist()))
    books = np.array([r[2].reshape(parts, width) for r in ordered[:entries]]).transpose(1, 0, 2)
    cut = np.array([r[2].reshape(parts, width) for r in rows])
    for turn in range(3):
        far = ((cut[:, :, None, :] - books[None]) ** 2).sum(3)
        code = far.argmin(2)
        if turn < 2:
            for p in range(parts):
                for e in set(code[:, p].tolist()):
                    own = cut[code[:, p] == e, p]
                    books[p, e] = own.sum(0) // len(own)
    error = far.min(2).sum(1)
    by = {}
    for r, x in zip(rows, error):
        by[r[1]] = by.get(r[1], 0) + int(x)
    return sorted(((r[0], r[1], "".join(f"{c:02x}" for c in k), int(x), by[r[1]]) for r, k, x in zip(rows, code, error)), key=str), books


def test_vector_codes(spark, mixed):
    got, books = vector_codes.compress(frame(spark, mixed))
    want, want_books = coded(mixed)
    assert got.columns == ["vec_id", "label", "code", "error", "label_error"] and (books == want_books).all()
    assert sorted(map(tuple, got.collect()), key=str) == want and len(want) == len(mixed) - 4


def test_vector_codes_of_few_rows(spark):
    rows = [(3, [0.5] * 40, None), (1, [-0.5] * 40, None), (2, [0.1] * 3, 1)]
    got, books = vector_codes.compress(frame(spark, rows))
    assert books.shape == (16, 3, 3) and sorted(map(tuple, got.collect()), key=str) == coded(rows, 48)[0]


def test_trie_walk(monkeypatch):
    rng = np.random.default_rng(8)
    parts = np.unique(rng.integers(-9, 9, (5000, 4)), axis=0)
    entries = rng.integers(-9, 9, (64, 4))
    far = ((parts[:, None] - entries[None]) ** 2).sum(2)
    for run in (1, 50, 10_000):
        monkeypatch.setattr(vector_codes, "RUN", run)
        code, distance = vector_codes.nearest(parts, entries)
        assert (code == far.argmin(1)).all() and (distance == far.min(1)).all()


def test_no_vectors(spark):
    for rows in ([], [(1, None, 1), (2, [float("nan")], None)]):
        table = frame(spark, rows)
        assert [r["component_id"] for r in embedding_dedup.near_vectors(table).orderBy("vec_id").collect()] == [r[0] for r in rows]
        assert hard_negatives.mine(table, F.lit(True), F.col("label")).count() == 0
        got, books = vector_codes.compress(table)
        assert got.count() == 0 and books.size == 0
    one = frame(spark, [(4, [0.5], 1)])
    assert [tuple(r) for r in embedding_dedup.near_vectors(one).collect()] == [(4, 0, 4, True)]
    assert hard_negatives.mine(one, F.lit(True), F.col("label")).count() == 0 and vector_codes.compress(one)[0].count() == 1
