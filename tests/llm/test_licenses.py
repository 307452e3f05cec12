from __future__ import annotations

import re

from dugout.llm.licenses import MIN_SHARE, TEMPLATES, Template, scan
from fixtures import awkward_docs, empty_docs

BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def plain(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    starts, labels = [], set()
    for phrase, label in BASE.items():
        own = phrase.split()
        for i in range(len(words) - len(own) + 1):
            if words[i : i + len(own)] == own:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def rows_of(frame):
    return [(r["key"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in frame.collect()]


def found(spark, *texts, **kw):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["key"]: r for r in scan(spark, frame, **kw).collect()}


def test_base_phrases_against_a_plain_scan(spark):
    docs = awkward_docs(spark).select("doc_id", "text", "size", "row")
    more = ["CC BY cc by-CC/by", "all rights reserved. All  Rights\nReserved!", "GENERAL public license general public", "xcc by", "cc byé cc by"]
    more += ["word " * 3000 + "cc by " * 50, "all all rights reserved reserved", "reserved"]
    docs = docs.union(spark.createDataFrame([(1000 + i, t, 0, "") for i, t in enumerate(more)] * 2, docs.schema))
    got = sorted(rows_of(scan(spark, docs)), key=str)
    wanted = sorted(((r["doc_id"], *plain(r["text"])) for r in docs.collect()), key=str)
    assert got == wanted


def test_notices_with_small_changes(spark):
    mit = next(t.text for t in TEMPLATES if t.label == "mit" and len(t.text) > 60)
    words = mit.split()
    changed = " ".join(words[:6] + ["hereby", "also"] + words[6:12] + words[13:])
    r = found(spark, f"Before. {mit.upper()}, after.", changed, " ".join(words[:6]), " ".join(words[::-1]), "Released under the MIT License.")
    assert [r[i]["labels"] for i in range(5)] == ["mit", "mit", "", "", "mit"]
    assert r[0]["score"] == 1 and MIN_SHARE <= r[1]["score"] < 1 and r[2]["score"] == 0
    assert all(r[i]["n_base"] == 0 and r[i]["first_word"] is None for i in range(5))


def test_parts_far_apart_are_no_notice(spark):
    words = next(t.text for t in TEMPLATES if t.label == "bsd").split()
    spread = " filler filler filler filler filler ".join(" ".join(words[i : i + 3]) for i in range(0, len(words), 3))
    assert found(spark, spread)[0]["labels"] == ""


def test_two_templates_of_one_label_and_repeats(spark):
    two = (Template("x", "one two three four"), Template("x", "five six seven"), Template("b", "two three", base=True))
    r = found(spark, "one two three four five six seven one two three four", templates=two)[0]
    assert (r["labels"], r["base_labels"], r["n_base"], r["first_word"], r["last_word"]) == ("b,x", "b", 2, 1, 8)


def test_no_rows(spark):
    assert scan(spark, empty_docs(spark)).count() == 0
