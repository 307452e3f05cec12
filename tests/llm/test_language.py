from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from corpus_pipeline import keep_known_languages
from dugout.llm import language
from dugout.llm.language import GRAM, Grams, LanguageFilter, fit, identify, too_short
from fixtures import LONG, empty_docs

SOUNDS = {"aa": "ka lo mi nu", "bb": "stra plen grif dorn", "cc": "жа ло ми ну"}


def text(rng, lang, n):
    sounds = SOUNDS[lang].split()
    return " ".join("".join(rng.choice(sounds) for _ in range(rng.randrange(2, 5))) for _ in range(n))


def labelled(spark, n=60):
    rng = random.Random(1)
    rows = [(i, text(rng, lang, rng.randrange(5, 60)), lang, "x") for i, lang in enumerate(list(SOUNDS) * n)]
    rows += [(9001, "nothing to learn", None, "x"), (9002, None, "aa", "x"), (9003, "", "bb", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def test_held_out_accuracy(spark):
    docs = labelled(spark)
    model = fit(docs.filter("doc_id % 4 <> 2"))
    found = docs.filter("doc_id % 4 = 2 and doc_id < 9000").withColumn("found", identify(docs, model)).collect()
    assert all(r["found"]["lang"] == r["lang"] for r in found)
    assert all(0.5 < r["found"]["score"] <= 1 for r in found)


def test_defined_results(spark):
    model = fit(labelled(spark))
    rows = [(None,), ("",), ("123 !?",), ("ŋŋŋŋŋŋ",), ("kalomi nuka " * 3,), (LONG,)]
    out = [r["f"] for r in spark.createDataFrame(rows, "text string").coalesce(1).withColumn("f", identify(labelled(spark), model)).collect()]
    assert [r["lang"] for r in out[:3]] == ["und"] * 3 and [r["score"] for r in out[:3]] == [0, 0, 0]
    assert out[3]["lang"] == "aa" and out[3]["score"] == 0  # letters, but no known gram: the first by name
    assert out[4]["lang"] == "aa" and out[5]["lang"] in SOUNDS


def test_texts_too_short_for_a_gram_stay_in_the_pipeline(spark, sf_dir):
    short = [(9101, "A.", "aa", "x"), (9102, "1 É\n", "aa", "x"), (9103, "1.\n", "aa", "x"), (9104, "ŋŋŋŋŋŋ", None, "x"), (9105, "", None, "x")]
    docs = labelled(spark).unionByName(spark.createDataFrame(short, "doc_id long, text string, lang string, score string"))
    kept = {r["doc_id"] for r in keep_known_languages(spark, docs, sf_dir).collect()}
    assert kept & set(range(9100, 9200)) == {9101, 9102}
    grams = Grams()
    for t in ("A.", "1 É\n", "a b", "ab"):
        row = spark.createDataFrame([(t,)], "text string").select(too_short(F.col("text")).alias("s")).first()
        assert row["s"] == (sum(len(h) for h, _ in grams.pieces([t])) == 0)


def test_a_language_with_one_document(spark):
    one = spark.createDataFrame([(9200, "zuvex qorim " * 9, "dd", "x")], "doc_id long, text string, lang string, score string")
    docs = labelled(spark).unionByName(one)
    found = one.select(identify(docs, fit(docs)).alias("f")).first()["f"]
    assert found["lang"] == "dd" and found["score"] > 0.9


def test_nothing_learned(spark):
    docs = empty_docs(spark)
    model = fit(docs)
    assert model.languages == []
    rows = spark.createDataFrame([("some words",)], "text string")
    assert rows.select(identify(rows, model)["lang"]).first()[0] == "und"
    assert docs.select(identify(docs, model)).count() == 0


def plain_grams(text):
    """By the definition: letters in lower case, one blank for anything between them and at both ends."""
    out, last = [" "], " "
    for c in text.lower() + " ":
        c = c if c.isalpha() else " "
        if c != " " or last != " ":
            out.append(c)
        last = c
    joined = "".join(out)
    return [joined[i : i + GRAM] for i in range(len(joined) - GRAM + 1)]


def test_grams_and_filters_match_sets(monkeypatch):
    rng = random.Random(5)
    texts = [text(rng, rng.choice(list(SOUNDS)), 40) + rng.choice(["", " 1!", "É"]) for _ in range(30)] + ["", None, "a", LONG[:5000]]
    grams = Grams()
    for piece in (1 << 18, 37):
        monkeypatch.setattr(language, "PIECE", piece)
        names: dict[int, set] = {}
        count = np.zeros(len(texts), int)
        for hashes, of in grams.pieces(texts):
            for h, i in zip(hashes.tolist(), of.tolist()):
                names.setdefault(h, set())
                count[i] += 1
        wanted = [plain_grams(t or "") for t in texts]
        assert count.tolist() == [len(w) for w in wanted]
        assert len(names) == len({g for w in wanted for g in w})
    own = {}
    for lang in SOUNDS:
        part = [t for t in texts if t][:10]
        own[lang] = np.unique(np.concatenate([h for h, _ in grams.pieces(part)]))
    model = LanguageFilter(sorted(own), own)
    total, hits = model.counts(texts, grams)
    for i, t in enumerate(texts):
        for k, lang in enumerate(model.languages):
            true = sum(int(h in set(own[lang].tolist())) for hs, _ in grams.pieces([t]) for h in hs.tolist()) if i < 4 else None
            assert true is None or true <= hits[i, k] <= true + 1


def test_many_languages_use_several_planes():
    grams = Grams()
    names = [f"l{i:03d}" for i in range(130)]
    own = {n: np.concatenate([h for h, _ in grams.pieces([chr(0x4E00 + i) * 30])]) for i, n in enumerate(names)}
    model = LanguageFilter(names, own)
    guesses, _ = model.predict([chr(0x4E00 + i) * 8 for i in range(130)], grams)
    assert guesses == names
