"""Candidate ties of near duplicates, texts and rejection of language identification, against brute force."""

import numpy as np
from pyspark.sql import functions as F

from tablecraft.llm import chat_format, language_id, near_dup


def test_close_ties_against_brute_force():
    rng = np.random.default_rng(5)
    heads = rng.integers(0, 1 << 16, (6, 60)).astype(np.uint16)
    keys, signs = np.sort(rng.integers(0, 7, 90)), heads[rng.integers(0, 6, 90)].copy()
    for i in range(90):
        at = rng.choice(60, int(rng.integers(0, 40)), replace=False)
        signs[i, at] = rng.integers(0, 1 << 16, len(at))
    ids = np.arange(90) * 3 + 1
    root = list(range(90))

    def find(x):
        return x if root[x] == x else find(root[x])
    for i in range(90):
        for j in range(i):
            if keys[i] == keys[j] and (signs[i] != signs[j]).sum() <= near_dup.DISTANCE:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    want = {(int(ids[i]), int(ids[find(i)])) for i in range(90) if find(i) != i}
    u, v = near_dup.close_ties(keys, ids, signs)
    assert want and {(int(a), int(b)) for a, b in zip(u, v, strict=True)} == want


def test_texts_with_a_shared_passage_are_no_candidates(spark):
    shared = " ".join(f"s{i}" for i in range(90))
    rows = [(i, shared + " " + " ".join(f"o{i}x{j}" for j in range(210))) for i in range(1200)]
    rows += [(2000 + i, rows[i][1] + " more") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = docs.select("doc_id", F.lit(0).cast("long").alias("k"), "text")
    signed = whole.mapInArrow(near_dup._sign, "_id long, _key long, _size long, _mark1 long, _mark2 long, _sign binary")
    classes = near_dup.materialise(signed.select(F.col("_id").alias("_class"), "_sign"))
    groups = near_dup._classes_of_groups(classes).collect()
    assert {r["_count"] for r in groups} == {2} and {r["_class"] for r in groups} == {*range(5), *range(2000, 2005)}
    got = near_dup.assign_components(docs)
    assert {r["_id"]: r["component_id"] for r in got.collect()} == {i: i - 2000 if i >= 2000 else i for i, _ in rows}


def test_training_texts_are_a_fixed_number_a_language(spark):
    rows = [(i, f"text {i}", "a") for i in range(300)] + [(500 + i, f"word {i}", "b") for i in range(3)] + [(900, "same", "c")] * 50
    rows += [(901, None, "a"), (902, "no language", None), (None, "no id", "b")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    pick = lambda: sorted((r["_lang"], r["_text"], r["_apart"]) for r in language_id.training_texts(frame, "text", "lang", "doc_id", 20).collect())
    got = pick()
    keyed = frame.filter("lang = 'a' and text is not null").select("text", F.xxhash64(F.lit(5), "doc_id").alias("h")).collect()
    least = sorted(keyed, key=lambda r: r["h"])[:20]
    assert sorted(t for lang, t, _ in got if lang == "a") == sorted(r["text"] for r in least) and sum(x for lang, _, x in got if lang == "a") == 5
    assert [t for lang, t, _ in got if lang == "b"] == ["no id", "word 0", "word 1", "word 2"]
    assert [t for lang, t, _ in got if lang == "c"] == ["same"] and pick() == got


def test_rejection_keeps_texts_of_a_language_and_drops_noise(spark):
    rng = np.random.default_rng(8)
    words = {"en": "the quick brown fox jumps over lazy dog and some other animals here with their friends".split(),
             "de": "der schnelle braune fuchs springt und faulen hund mit einigen anderen tieren hier bei seinen freunden".split()}
    say = lambda lang, n: " ".join(rng.choice(words[lang], n))
    rows = [(i, say(lang, int(rng.integers(20, 200))), lang) for i, lang in enumerate(["en", "de"] * 200)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    clean = [(i, say(lang, n), lang) for i, (lang, n) in enumerate([("en", 30), ("de", 30), ("en", 3000), ("de", 3000)] * 25)]
    noise = [(1000 + i, " ".join("".join(rng.choice(list("bcdfghjklmnpqrstvwxz"), 7)) for _ in range(60)), "en") for i in range(10)]
    got = {r["doc_id"]: r for r in language_id.identify(spark.createDataFrame(clean + noise, "doc_id long, text string, lang string"), model).collect()}
    assert all(not got[i]["rejected"] and got[i]["lang_pred"] == lang for i, _, lang in clean)
    assert all(got[i]["rejected"] for i, _, _ in noise)


def test_chat_turns_are_read_from_ids_and_mask():
    template = chat_format.Template(chat_format.TOKENIZER)
    roles, texts = ["user", "assistant", "", "assistant"], ["</s> hi", "[INST] é <\\|end|>", "", ""]
    turns = template.turns(roles, texts)
    whole = [template.decode(ids) for ids, _ in turns]
    assert template.read(turns) == [(r, t, t if r == "assistant" else "", len(w)) for r, t, w in zip(roles, texts, whole, strict=True)]
    ids, mask = turns[1]
    part = mask.copy()
    part[np.flatnonzero(mask)[-1]] = 0
    assert template.read([(ids, part)])[0][2] == template.plain(ids[part == 1])
