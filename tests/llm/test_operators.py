"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing columns; brute-force versions."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablecraft.llm import (chat_format, decontamination, fingerprints, language_id, line_dedup, lm_scoring, mixing,
                            near_dup, substring_dedup, url_rules)
from tablecraft.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977}x{i}" for i in range(6000))
RUN = " ".join(f"p{i}" for i in range(60))
SCHEMA = "doc_id long, text string, source string, lang string, size string, kept string, n_words int"
ROWS = [(1, RUN, "a", "en"), (2, "intro " + RUN + " outro", "a", "en"), (2, "intro " + RUN + " outro", "a", "en"), (3, None, None, None),
        (4, "", "b", None), (5, LONG, "b", "en"), (6, LONG + " tail", "b", "en"), (7, "  \t\n ", "b", "de"), (None, RUN, None, "de"), (8, "one two", "c", "de"),
        (9, "one two", "c", "de")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "s", "k", 7) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_mixing(docs, none):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(ROWS) and mixing.mix_sources(none).count() == 0
    total = sum(len(WORD.findall(r[1] or "")) for r in ROWS)
    assert sum(r["size"] for r in got) == total and all(r["taken"] <= 3 * r["size"] for r in got)
    assert {r["source"]: r["target"] for r in got if r["size"]}.keys() == {"a", "b", "c", None}
    assert abs(sum(r["taken"] for r in got) - total) <= 16 * 8
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(docs).collect()))


def test_apportionment_is_that_of_highest_quotients(spark):
    votes = {f"s{i}": float(v) for i, v in enumerate([53, 24, 23, 1, 1, 999, 0, 53])}
    for seats in (0, 1, 5, 37, 400):
        want = dict.fromkeys(votes, 0)
        for _ in range(seats):
            best = max(votes, key=lambda k: (votes[k] / (2 * want[k] + 1), -int(k[1:])))
            want[best] += 1
        rows = spark.createDataFrame([(k, v, seats) for k, v in votes.items()], "_source string, _target double, _blocks long")
        got = {r["_source"]: r["_won"] for r in mixing.apportion(rows, [], ["_source"], "_target", "_blocks").collect()}
        assert got == want


def test_targets_stop_at_three_times_the_size(spark):
    rows = spark.createDataFrame([("a", 10, 1.0), ("b", 1000, 2.0), ("c", 5, 3.0)], "_source string, _size long, _weight double")
    got = {r["_source"]: r["_target"] for r in mixing.target_sizes(rows).collect()}
    assert got == {"a": 30.0, "b": 970.0, "c": 15.0}


def test_url_rules(spark):
    urls = [(1, "http://A.Example.NET/en/x?q=1"), (2, "https://example.net/fr"), (3, "x://net"), (4, None), (5, "no scheme"), (6, "http://m.example.com/de/1#f"),
            (7, "http://notexample.com/de/1"), (8, "http://a.org/fr/"), (8, "http://a.org/fr/"), (9, "http://bad.test/spam/1"), (10, "http://bad.test/spam/2?://x")]
    pages = spark.createDataFrame([(*u, "host") for u in urls], "page_id long, url string, verdict string")
    labels = spark.createDataFrame([(9, 1), (10, 1), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    got = {r["page_id"]: tuple(r)[2:6] for r in url_rules.judge_urls(pages, labels).select("page_id", "url", "host", "path", "rule", "verdict").collect()}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[2] == ("example.net", "/fr", "net/", "block")
    assert got[3] == ("net", "", None, "allow") and got[4] == ("", "", None, "allow") == got[5]
    assert got[6][2:] == ("example.com/de/", "block") and got[7][2:] == (None, "allow") and got[8][2:] == ("org/fr/", "allow")
    assert url_rules.judge_urls(pages.limit(0), labels).count() == 0
    many = spark.createDataFrame([(["a", "b"], True)] * 12 + [(["a"], False)] * 12 + [(["b"], True)] * 3, "_tokens array<string>, _bad boolean")
    mined = url_rules.mine_rules(many)
    assert [(r["_tokens"], r["_confidence"]) for r in mined.collect()] == [(["b"], 1.0)]
    patterns = spark.createDataFrame([(1, ["a"]), (2, ["b", "c"])], "_pattern long, _tokens array<string>")
    assert [tuple(r) for r in url_rules.match_rules(patterns, mined).collect()] == [(2, 1.0)]


def test_mined_url_rules_against_brute_force(spark):
    rng = np.random.default_rng(9)
    rows, bad = [], {}
    for i in range(600):
        host, path = f"h{rng.integers(0, 4)}.site{rng.integers(0, 3)}.test", f"/{'abc'[rng.integers(0, 3)]}/{'xyz'[rng.integers(0, 3)]}?k{rng.integers(0, 2)}=1"
        rows.append((i, f"http://{host}{path}"))
        if i % 2:
            hit = host.startswith("h1.site2") and path.startswith("/b/y?k1") or host.startswith("h0.") and path.startswith("/c")
            bad[i] = int(hit or rng.random() < 0.03)
    five = [(700 + i, f"http://q{i % 2}.r{i // 2 % 2}.s.test/m{'ab'[i // 4 % 2]}/n{'ab'[i // 8 % 2]}?o{i // 16 % 2}") for i in range(640)]
    rows += five
    bad |= {i: int(u == "http://q0.r0.s.test/ma/na?o0") for i, u in five}
    pages = spark.createDataFrame([*rows, (9999, "http://q0.r0.s.test/ma/na?o0" + "z" * 30_000)], "page_id long, url string")
    labels = spark.createDataFrame(list(bad.items()), "doc_id long, toxic int")

    def tokens(url):
        host, _, rest = url.split("://")[1].partition("/")
        path, _, query = rest.partition("?")
        parts = host.split(".")
        found = {f"label:{p}" for p in parts} | {"end:" + ".".join(parts[i:]) for i in range(len(parts))}
        return found | {"path:" + re.sub(r"\d+", "#", p) for p in path.split("/") if p} | {f"key:{q.split('=')[0]}" for q in query.split("&")}
    labelled = [(frozenset(tokens(u)), bad[i]) for i, u in rows if i in bad]
    base = sum(b for _, b in labelled) / len(labelled)

    def share(part):
        own = [b for t, b in labelled if part <= t]
        return (sum(own) >= 10) and sum(own) / len(own)
    got = {frozenset(r["_tokens"]): r["_confidence"] for r in url_rules.mine_rules(spark.createDataFrame(
        [(sorted(t), bool(b)) for t, b in labelled], "_tokens array<string>, _bad boolean")).collect()}
    assert got and max(map(len, got)) >= 5
    for part, confidence in got.items():
        assert share(part) == confidence >= min(1, 2 * base)
        assert all(share(part - {x}) < confidence for x in part if len(part) > 1)
    verdicts = {r["page_id"]: (r["verdict"], r["confidence"]) for r in url_rules.judge_urls(pages, labels).collect()}
    for i, u in rows:
        best = max((c for part, c in got.items() if part <= tokens(u)), default=None)
        assert verdicts[i] == ("block" if best else "allow", best)
        # whatever no rule covers has no combination of its tokens that would be one: no rule was cut
        if best is None and i < 60:
            assert not any(share(frozenset([a, b])) >= 2 * base for a in tokens(u) for b in tokens(u))
    assert verdicts[9999][0] in ("allow", "block") and {v for v, _ in verdicts.values()} == {"allow", "block"}


def test_decontamination(docs, none, spark):
    bench = spark.createDataFrame([(10, RUN.upper()), (11, "one two"), (12, None), (13, "..."), (None, "one")], "item_id long, text string")
    got = decontamination.find_contamination(docs, bench).collect()
    by = {(r["doc_id"], r["text"]): r for r in got}
    assert len(got) == len(ROWS) and by[1, RUN]["n_hit"] == 60 and by[1, RUN]["items"] == ["10"]
    assert by[8, "one two"]["items"] == ["11"] and by[8, "one two"]["n_hit"] == 2 and not by[3, None]["contaminated"] and by[3, None]["n_words"] == 0
    assert by[5, LONG]["n_hit"] == 0 and by[None, RUN]["contaminated"]
    assert decontamination.find_contamination(none, bench).count() == 0
    assert decontamination.find_contamination(docs, bench.limit(0)).filter("contaminated").count() == 0
    clean = decontamination.remove_contaminated(docs, bench)
    assert clean.columns == docs.columns and sorted(str(r["doc_id"]) for r in clean.collect()) == ["3", "4", "5", "6", "7"]
    assert {r["doc_id"]: r["text"] for r in decontamination.remove_spans(docs, bench).collect()}[2] == "intro outro"


def test_fingerprints(docs, none):
    got = fingerprints.compare_with_edited(docs).collect()
    assert len(got) == len(ROWS) - 1 and fingerprints.compare_with_edited(none).count() == 0
    by = {r["doc_id"]: r for r in got}
    assert by[8]["fingerprint"] == by[9]["fingerprint"] and by[8]["near_next"] == 1.0 and by[5]["near_next"] > 0.9
    assert by[3]["fingerprint"] == by[4]["fingerprint"] == by[7]["fingerprint"] and 0.4 < by[5]["near_edited"] < 0.9
    k = len(LONG) // 4
    edited = LONG[:-k] + (LONG + " tail")[:k]
    assert by[5]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and by[5]["n_chars"] == len(LONG)


def test_fingerprints_collide_as_generalised_jaccard(spark):
    one, two = {i: 1 + i % 7 for i in range(200)}, {i: 1 + (i * 3) % 7 for i in range(100, 300)}
    rows = [(0, t, one.get(t, 0), two.get(t, 0)) for t in range(300)]
    terms = spark.createDataFrame(rows, "id int, t int, a int, b int").select("id", F.xxhash64("t").alias("_term"), "a", "b")
    true = sum(min(r[2:]) for r in rows) / sum(max(r[2:]) for r in rows)
    got = fingerprints.fingerprints(terms, ["id"], ["a", "b"], 512).select(fingerprints.likeness(F.col("a"), F.col("b"), 512)).first()[0]
    assert abs(got - true) < 0.08


def test_fingerprints_of_few_terms_are_those_of_all(spark, docs, monkeypatch):
    rng = np.random.default_rng(11)
    rows = [(i, " ".join(f"w{j}" for j in rng.zipf(1.3, 20 + 15 * i) % 900)) for i in range(24)] + [(30, "one"), (31, ""), (32, None)]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    found = {}
    for expected in (float("inf"), fingerprints.EXPECTED, 2.0):  # the last one leaves most documents to be taken again
        monkeypatch.setattr(fingerprints, "EXPECTED", expected)
        found[expected] = [sorted(map(str, fingerprints.compare_with_edited(d).collect())) for d in (texts, docs)]
    every, *others = found.values()
    assert len(every[0]) == len(rows) and others == [every, every]
    terms = spark.createDataFrame([(i % 3, i, 1 + i % 4) for i in range(900)], "id int, t int, w int").select("id", F.xxhash64("t").alias("_term"), "w")
    sampled = fingerprints._sampled
    seen = []
    monkeypatch.setattr(fingerprints, "_sampled", lambda rows, keep: seen.append(sampled(rows, keep)) or seen[-1])
    monkeypatch.setattr(fingerprints, "EXPECTED", 24.0)
    fingerprints.fingerprints(terms, ["id"], ["w"])
    assert 10 < seen[0].count() / (3 * fingerprints.SAMPLES) < 30  # of 300 terms


def test_likeness_of_the_query_is_near_the_exact_one(spark):
    rows = [(p, t, 1 + t % 5 if t < 200 else 0, 1 + (t * 3) % 5 if t >= p * 3 else 0) for p in range(60) for t in range(300)]
    terms = spark.createDataFrame(rows, "id int, t int, a int, b int").select("id", F.xxhash64("id", "t").alias("_term"), "a", "b")
    true = {p: sum(min(r[2:]) for r in rows if r[0] == p) / sum(max(r[2:]) for r in rows if r[0] == p) for p in range(60)}
    got = fingerprints.fingerprints(terms, ["id"], ["a", "b"]).select("id", fingerprints.likeness(F.col("a"), F.col("b")).alias("near")).collect()
    errors = np.array([r["near"] - true[r["id"]] for r in got])
    assert len(got) == 60 and np.sqrt((errors ** 2).mean()) < 0.05 and np.abs(errors).max() < 0.15


def test_near_duplicates(docs, none):
    got = near_dup.assign_components(docs).collect()
    assert len(got) == len(ROWS) and near_dup.assign_components(none).count() == 0
    by = {r["_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got}
    assert by[1] == (56, 1, True) and by[2] == (58, 1, False) and by[None] == (56, 1, False) and by[3] == (0, 3, True) and by[7] == (0, 7, True)
    assert by[6][1:] == (5, False) and by[8] == (1, 8, True) and by[9] == (1, 8, False)
    kept = near_dup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4, 5, 7, 8]


def test_near_duplicates_in_a_large_group(spark):
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(700):
        words = list(base)
        for j in rng.choice(150, int(rng.integers(0, 7)), replace=False):
            words[j] = f"e{i}"
        rows.append((i, " ".join(words)))
    sets = [frozenset(tuple(t.split()[i:i + 5]) for i in range(146)) for _, t in rows]
    root = list(range(700))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(700):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if 100 * shared >= 75 * (len(sets[i]) + len(sets[j]) - shared):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = near_dup.assign_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["_id"]: r["component_id"] for r in got} == {i: find(i) for i in range(700)}


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99), (5, 5), (99, 101)], "_u long, _v long")
    got = {r["_n"]: r["_root"] for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 99: 99, 100: 99, 101: 99}


def test_line_dedup(spark, none):
    rows = [(i, f"head\nbody {i}\nbody {i}\n", "h") for i in range(6)] + [(7, None, "h"), (8, "", None), (9, "head", "other"), (9, "head", "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_lines", F.lit("x"))
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in line_dedup.drop_boilerplate_lines(docs).collect()}
    assert got[0] == ("body 0\nbody 0\n", 4, 1) and got[7] == (None, 0, 0) and got[8] == ("", 1, 0) and got[9] == ("head", 1, 0)
    assert line_dedup.drop_boilerplate_lines(none).count() == 0


def test_lm_scoring(docs, none, spark):
    held = F.col("doc_id") == 8
    got = lm_scoring.score_texts(docs, F.coalesce(held, F.lit(False))).collect()
    train = [r for r in ROWS if r[0] != 8]
    counts: dict = {}
    for r in train:
        for w in [*WORD.findall((r[1] or "").lower()), None]:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(ROWS) and {r["train_tokens"] for r in got} == {n}
    for r in got:
        text = next(x[1] for x in ROWS if x[0] == r["doc_id"])
        words = [*WORD.findall((text or "").lower()), None]
        base = sum(np.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in words)
        assert r["n_tokens"] == len(words) and r["n_known"] == sum(w in counts for w in words) and abs(r["base_score"] - base) < 1e-6
        assert np.isfinite(r["score"]) and r["score"] < 0
    assert lm_scoring.score_texts(none, F.lit(False)).count() == 0
    assert lm_scoring.score_texts(docs, F.lit(True)).count() == len(ROWS)


def test_lm_is_better_on_held_out_texts(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"{'ab'[i % 2]}{j}" for j in rng.integers(0, 20, 200))) for i in range(60)]
    got = lm_scoring.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") % 5 == 2).filter("held_out")
    assert got.agg(F.sum("score") - F.sum("base_score")).first()[0] > 0


def test_lm_scoring_reads_all_arcs(spark):
    vocabulary = [f"v{i}" for i in range(6000)]
    rows = [(i, " ".join(vocabulary[j % 6000] for j in range(i * 300, i * 300 + 400))) for i in range(40)]
    rows += [(100, "V5990 v5991 unseené v5991 ퟿"), (101, ""), (102, None), (103, "v1 v1 new v2 v3"), (103, "v1 v1 new v2 v3")]
    held = {3, 39, 100, 101, 103}
    got = lm_scoring.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id").isin(*held), block_bytes=20_000).collect()
    words = {i: [w.lower() for w in WORD.findall(t or "")] for i, t in rows}
    train = [words[i] for i, _ in rows if i not in held]
    counts = Counter(w for t in train for w in t)
    pairs = Counter(p for t in train for p in zip(["", *t], [*t, None]))
    totals = counts | {"": len(train)}
    n, v = sum(counts.values()) + len(train), len(counts) + 1
    once, twice = (sum(c == k for c in counts.values()) for k in (1, 2))
    discount = min(max(once / (once + 2 * twice) if once else 0.5, 0.1), 0.9)
    model = language_id.fit({"x": dict.fromkeys(counts, 1)})
    spelled = {w: np.exp(language_id.word_scores(model, [w])[0, 0]) for w in {w for t in words.values() for w in t}}
    root = {w: max(counts[w] - discount, 0) / n + discount * v / n * p for w, p in spelled.items()} | {None: (len(train) - discount) / n}
    arcs: dict = {}
    for (a, b), c in pairs.items():
        if c >= 2:
            arcs.setdefault(a, {})[b] = (c - 0.5) / totals[a]
    assert len(arcs) > 4096
    want = {}
    for i, text in words.items():
        want[i] = 0.0
        for a, b in zip(["", *text], [*text, None]):
            own = arcs.get(a, {})
            back = (1 - sum(own.values())) / (1 - sum(root[x] for x in own))
            want[i] += np.log10(own[b] if b in own else back * root[b])
    assert len(got) == len(rows)
    for r in got:
        assert abs(r["score"] - want[r["doc_id"]]) < 1e-6 * max(1, abs(want[r["doc_id"]]))


def test_lm_scoring_packs_what_blocks_are_told(spark, monkeypatch):
    rng = np.random.default_rng(11)
    rows = [(i, " ".join(f"w{j}" for j in np.append(rng.zipf(1.3, 150) % 3000, i + 5000))) for i in range(80)] + [(90, "w1 \x00 w1 x\x00\x00 w1 only"), (91, None), (92, " \t")]
    docs, held = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), F.col("doc_id") % 6 == 0
    seen: dict = {}
    table = lm_scoring._table

    def watched(df, name, *more):
        out = table(df, name, *more)
        seen.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(lm_scoring, "_table", watched)
    scores = lambda **more: {r["doc_id"]: r["score"] for r in lm_scoring.score_texts(docs, held, block_bytes=15_000, **more).collect()}
    whole, alone = scores(), lm_scoring.score_texts(docs, held, block_bytes=1 << 20)
    words = seen["words"][0]
    assert seen["told"][0] < words / 4  # not a row for each word and block
    # words whose arcs are dealt to several parts, and texts in one block, score the same
    for other in (scores(part_times=20), {r["doc_id"]: r["score"] for r in alone.collect()}):
        assert other.keys() == whole.keys() and all(abs(other[k] - whole[k]) < 1e-6 * abs(whole[k]) for k in whole)


def test_lm_grams_of_words_at_once():
    words = [b"a", b"hello", b"\x00", b"a\x00\x00b\x00", "\u00e9\U0001f600zzzzzz".encode(), b"\xff\xc3", b"abcdefghij"]
    grams, n = lm_scoring._fixed_grams(words)
    padded = [lm_scoring.padded(w) for w in words]
    want = [[p[max(0, end - 5):end] for end in range(2, len(p) + 1)] for p in padded]
    assert lm_scoring._gram_texts(grams) == [g for w in want for g in w] and n.tolist() == [len(w) for w in want]
    assert [lm_scoring.longest_grams(p) for p in padded] == want and lm_scoring._fixed_texts([g for w in want for g in w]).equals(grams)
    columns = np.zeros(0, np.int64), np.array([0, 70_000]), np.array([0.5, -np.inf]), np.array([1.5], np.float32)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(lm_scoring._opened(lm_scoring._sealed(*columns)), columns, strict=True))
    texts = [bytes(range(256)), None, b"", b"  A\x0bb\x1cc ", b"A b"]
    found, lengths = lm_scoring.tokens(pa.array(texts, pa.binary()))
    assert found.to_pylist() == [w for t in texts for w in (t or b"").lower().split()] and lengths.tolist() == [len((t or b"").split()) for t in texts]


@pytest.mark.parametrize("text", ["</s>[INST] ok [/INST]", "<\\/s> <\\\\/s> [\\INST]", "<|turn|><|end|><|text|>", "", "\u00e9 \U0001f600 \\"])
def test_escape(text):
    safe = chat_format.escape(text)
    assert chat_format.unescape(safe) == text and not any(c in safe for c in chat_format.CONTROL)


def test_chat_format(spark):
    rows = [(1, 0, "user", "hi </s>"), (1, 1, "assistant", "yes [INST] <|end|>"), (1, 1, "assistant", None), (2, None, None, "x" * 50_000), (None, 0, "assistant", "a"), (3, 2, "assistant", "b"), (3, 1, "user", "c")]
    talks = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, ids string")
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_turns(talks)).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 18 and got[1]["loss_sha256"] == hashlib.sha256(b"yes [INST] <|end|>").hexdigest()
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\nhi </s>\nassistant\n\nassistant\nyes [INST] <|end|>\n").hexdigest()
    assert got[2]["turns_sha256"] == hashlib.sha256(b"\n" + b"x" * 50_000 + b"\n").hexdigest() and got[None]["loss_chars"] == 1
    assert got[3]["turns_sha256"] == hashlib.sha256(b"user\nc\nassistant\nb\n").hexdigest()
    assert chat_format.read_back(chat_format.format_turns(talks.limit(0))).count() == 0


def test_language_id(docs, none, spark):
    rows = [(i, t, lang) for i in range(60) for t, lang in [(f"the {i} thing with these others there", "en"), (f"der {i} und die mit einer nicht zu", "de")]]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(train)
    asked = [(1, "these things with others", "x"), (2, "und nicht die einer", "x"), (3, None, "x"), (4, "12 + 3!", "x"), (5, "", "x"), (1, "these things with others", "x")]
    frame = spark.createDataFrame(asked, "doc_id long, text string, score string")
    got = [(r["doc_id"], r["lang_pred"]) for r in language_id.identify(frame, model).orderBy("doc_id").collect()]
    assert got == [(1, "en"), (1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und")]
    assert all(0 <= r["score"] <= 1 for r in language_id.identify(docs, model).collect()) and language_id.identify(none, model).count() == 0
    empty = language_id.train(train.limit(0))
    assert {(r["lang_pred"], r["rejected"]) for r in language_id.identify(frame, empty).collect()} == {("und", False)}


def test_kneser_ney_sums_to_one():
    model = language_id.fit({"x": {"abab": 3, "abc": 1, "b": 2}}, 3)
    signs = "abc" + language_id.END
    seen = sum(np.exp(language_id.word_scores(model, ["ab" + s])[0, 0] - language_id.word_scores(model, ["ab"])[0, 0]) for s in "abc")
    assert np.isfinite(seen) and len(signs) == 4 and all(np.exp(o.logp).max() <= 1 for o in model.orders)


def test_substring_dedup(docs, none):
    got = substring_dedup.remove_repeated_windows(docs).collect()
    seen, want = {}, {}
    for d, t in sorted((r[0], r[1]) for r in ROWS if r[0] is not None and r[1]):
        words = WORD.findall(t)
        gone = [False] * len(words)
        for i in range(len(words) - 49):
            if seen.setdefault(tuple(words[i:i + 50]), d) < d:
                gone[i:i + 50] = [True] * 50
        want[d] = (len(words), sum(gone), hashlib.sha256(" ".join(w for w, g in zip(words, gone) if not g).encode()).hexdigest())
    assert len(got) == len(ROWS) and substring_dedup.remove_repeated_windows(none).count() == 0
    for r in got:
        if r["doc_id"] in want:
            assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == want[r["doc_id"]]
    assert want[2][1] == 60 and want[6][1] == 6000 and next(r for r in got if r["doc_id"] is None)["n_removed"] == 0
