"""Each stage of the pipeline on planted rows against plain Python."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rejected string, kept string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEST_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOOTER = "read more of these pages here and subscribe"
ITEM = " ".join(f"{a}{b}ing" for a, b in zip("the qui bro jum ove laz dog ani fri her the bro ove dog".split(), "stone water light mount river".split() * 3))


def planted():
    rng = np.random.default_rng(11)
    words = {"en": [f"{a}{b}ing" for a in "the qui bro jum ove laz dog ani fri her".split() for b in "stone water light mount river".split()],
             "de": [f"{a}{b}ung" for a in "der sch bra fuc spr fau hun ein tie bei".split() for b in "stein wasser licht berg fluss".split()]}
    rows = []
    for i in range(160):
        lang = "de" if i % 3 == 0 else "en"
        text = "\n".join(" ".join(rng.choice(words[lang], 20)) for _ in range(4))
        rows.append([i, text, lang, "ab"[i % 2] if i % 10 else None])
    for i in range(0, 40, 2):
        rows[i][1] += "\n" + FOOTER  # on a quarter of the pages of one source
    rows[7][1] += "\n" + ITEM
    rows[13][1] += "\n" + ITEM.upper()
    rows += [[200 + i, rows[i][1] + " one more", "en", "a"] for i in range(1, 12, 2) if i not in (7, 9)]
    rows += [[220, rows[21][1], "de", "b"], [20, rows[20][1], rows[20][2], rows[20][3]]]
    rows += [[300, None, "en", "a"], [301, "", None, None], [302, "12 + 30 = 42", "de", "b"], [None, rows[33][1], None, None]]
    rows += [[310 + i, " ".join("".join(rng.choice(list("bcdfghjklmnpqrstvwxz"), 8)) for _ in range(60)), None, "a"] for i in range(3)]  # no label: labelled noise is learned
    return [(*r, None if r[1] is None else len(r[1]), "r", "k") for r in rows]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(planted(), SCHEMA).write.parquet(f"{path}/documents.parquet")
    items = [(1, ITEM), (2, None), (3, ""), (4, "a question that no text holds anywhere")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def stage(spark, sf, name, docs):
    got = dict(corpus_pipeline.STAGES)[name](spark, docs, sf)
    assert name == "mixing" or got.columns == docs.columns
    return sorted(got.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or ""))


def plain(rows):
    return Counter(tuple(r) for r in rows)


def test_language_stage_drops_noise_and_keeps_clean_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    gone = {300, 301, 302, 310, 311, 312}
    assert plain(stage(spark, sf, "language_id", docs)) == plain(r for r in docs.collect() if r["doc_id"] not in gone)


def test_line_stage(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    pages, found = Counter(), defaultdict(Counter)
    for r in docs.collect():
        pages[r["source"]] += 1
        found[r["source"]].update({x for x in (r["text"] or "").split("\n") if x})
    drop = {(s, x) for s in found for x, n in found[s].items() if n >= 4 and n / pages[s] > 0.1}
    assert {x for _, x in drop} == {FOOTER}
    want = []
    for r in docs.collect():
        text = None if r["text"] is None else "\n".join(x for x in r["text"].split("\n") if (r["source"], x) not in drop)
        want.append((r["doc_id"], text, r["lang"], r["source"], None if text is None else len(text), "r", "k"))
    assert plain(stage(spark, sf, "line_dedup", docs)) == plain(want)


def test_near_duplicate_stage(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted({tuple(r) for r in docs.collect()}, key=lambda r: (r[0] is None, r[0] or 0))
    sets = []
    for r in rows:
        words = WORD.findall((r[1] or "").lower())
        sets.append({tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set())
    root = list(range(len(rows)))

    def find(x):
        return x if root[x] == x else find(root[x])
    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    want = [r for i, r in enumerate(rows) if find(i) == i]
    assert len(want) < len(rows) - 4 and plain(stage(spark, sf, "near_dedup", docs)) == plain(want)


def test_decontamination_stage(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")

    def windows(text):
        words = TEST_WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
        return {tuple(words[i:i + 10]) for i in range(len(words) - 9)}
    bad = windows(ITEM)
    assert plain(stage(spark, sf, "decontamination", docs)) == plain(r for r in docs.collect() if not windows(r["text"]) & bad)


def test_mixing_stage(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = stage(spark, sf, "mixing", docs)
    own = Counter(tuple(r) for r in docs.collect())
    sizes, taken, targets = Counter(), Counter(), {}
    for r in docs.collect():
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    for r in got:
        assert own[tuple(r[c] for c in docs.columns)] and 0 < r["taken"] <= 3 * r["size"] and r["size"] == len(WORD.findall(r["text"]))
        taken[r["source"]] += r["taken"]
        targets[r["source"]] = r["target"]
    total, weight = sum(sizes.values()), {"a": 1, "b": 2, None: 3}
    want, open_ = {}, set(weight)
    while open_:
        share = {s: (total - sum(want.values())) * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        want |= {s: 3 * sizes[s] for s in over} if over else share
        open_ = open_ - over if over else set()
    assert all(abs(targets[s] - want[s]) < 1e-6 * want[s] and abs(taken[s] - want[s]) <= 32 for s in weight)


def test_stages_of_an_empty_table_and_the_whole_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, _ in corpus_pipeline.STAGES:
        assert stage(spark, sf, name, docs.filter(F.lit(False))) == []
    ids = [r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()]
    assert ids and len(ids) == len(set(ids)) and not {7, 13, 201, 220, 300, 301, 302, 310, 311, 312} & set(ids)
