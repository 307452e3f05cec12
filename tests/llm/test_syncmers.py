from __future__ import annotations

import hashlib
import random

import xxhash
from fixtures import LONG, awkward_docs, empty_docs

import __spark_entry__ as contract
from dugout.llm import syncmers
from dugout.llm.syncmers import ANCHORS, K, S, fingerprints


def plain_anchors(text: str) -> dict[int, int]:
    """hash -> first place, of the smallest hashes."""
    found = {}
    signature = lambda x: xxhash.xxh64(x.encode(), seed=42).intdigest() & 0xFFFFFFFF
    if 0 < len(text) < K:
        return {signature(text): 0}
    for i in range(len(text) - K + 1):
        kmer = text[i : i + K]
        inner = [kmer[j : j + S] for j in range(K - S + 1)]
        if min(inner) in (inner[0], inner[-1]):
            found.setdefault(signature(kmer), i)
    return dict(sorted(found.items())[:ANCHORS])


def plain_likeness(a: dict[int, int], b: dict[int, int]) -> float:
    if not a and not b:
        return 1.0
    near = sorted(a.keys() | b.keys())[:ANCHORS]
    shifts = [b[h] - a[h] for h in near if h in a and h in b]
    return max((shifts.count(s) for s in shifts), default=0) / len(near)


def printed(anchors: dict[int, int]) -> str:
    return "".join(f"{h << 31 | p:016x}" for h, p in anchors.items())


def plain(rows: list[tuple]) -> list[tuple]:
    """What the query returns for (key, text) rows with unlike keys."""
    rows = sorted(((k, t or "") for k, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for (k, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        third = len(t) // 3
        edited = t[: len(t) - third] + after[:third]
        own, cut, other = plain_anchors(t), plain_anchors(edited), plain_anchors(after)
        digest = hashlib.sha256(edited.encode()).hexdigest()
        out.append((k, len(t), digest, printed(own), printed(cut), plain_likeness(own, cut), plain_likeness(own, other)))
    return out


def result(df) -> list[tuple]:
    found = df.select(
        "key",
        syncmers.F.char_length("text"),
        syncmers.F.sha2("edited", 256),
        syncmers.printed(syncmers.F.col("anchors")),
        syncmers.printed(syncmers.F.col("edited_anchors")),
        "near_edited",
        "near_next",
    )
    return [tuple(r) for r in found.collect()]


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2]))


def test_against_plain_loops(spark):
    docs = awkward_docs(spark).filter("doc_id is null or doc_id <> 106")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rng = random.Random(3)
    rows += [(200 + i, "".join(rng.choice("abcé 😀\n") for _ in range(i))) for i in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert ordered(result(fingerprints(frame))) == ordered(plain(rows))


def test_pieces_do_not_show(spark, monkeypatch):
    monkeypatch.setattr(syncmers, "PIECE", 37)
    rows = [(1, LONG[:2000]), (2, LONG[500:1500]), (3, "short"), (4, "x" * 400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert ordered(result(fingerprints(frame))) == ordered(plain(rows))


def test_repeated_rows_follow_each_other(spark):
    rows = [(7, "the same row again and again")] * 5 + [(3, "another text that stands behind"), (None, "no key"), (None, "no key")]
    got = result(fingerprints(spark.createDataFrame(rows, "doc_id long, text string")))
    assert len(got) == 8
    assert sorted(r[6] for r in got if r[0] == 7) == [0.0, 1.0, 1.0, 1.0, 1.0]
    assert sorted(r[6] for r in got if r[0] is None) == [0.0, 1.0]


def test_small_tables(spark):
    assert result(fingerprints(empty_docs(spark))) == []
    one = result(fingerprints(spark.createDataFrame([(1, "only one document here")], "doc_id long, text string")))
    assert len(one) == 1 and one[0][6] == 1.0
    none = result(fingerprints(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")))
    assert [r[1:] for r in none] == [(0, hashlib.sha256(b"").hexdigest(), "", "", 1.0, 1.0)] * 2


def test_query_on_given_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = [tuple(r) for r in contract.queries()["op12_closed_syncmers"](spark, sf_dir).collect()]
    assert sorted(got) == sorted(plain(rows))
    edited, following = (sum(r[i] for r in got) / len(got) for i in (5, 6))
    assert edited > 0.45 > 0.1 > following


def test_shift_of_a_passage_is_seen(spark):
    """A shared passage at another place still counts: its anchors stand on one diagonal."""
    words = [f"word{i} " for i in range(400)]
    rows = [(2, "".join(words[:200])), (1, "zz yy xx ww " + "".join(words[:200]))]
    near = {r[0]: r[6] for r in result(fingerprints(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert near[2] > 0.9
