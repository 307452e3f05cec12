from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import xxhash
from dugout.llm import simhash
from dugout.llm.components import components
from dugout.llm.simhash import close_pairs, drop_near_duplicates, fingerprint, simhash_components
from fixtures import awkward_docs, empty_docs


def plain_print(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64(g, seed=42).intdigest()
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if grams and 2 * ones[b] > len(grams))


def plain_components(nodes, edges):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_prints(rng, groups=25, n=30, flips=2):
    out = set()
    for _ in range(groups):
        base = int(rng.integers(0, 1 << 63)) * 2 + 1
        for _ in range(n):
            x = base
            for b in rng.integers(0, 64, flips):
                x ^= 1 << int(b)
            out.add(x)
    return np.array(sorted(out), dtype=np.uint64)


def check_links(spark, prints):
    signed = prints.view(np.int64).tolist()
    found = {(r["a"], r["b"]) for r in close_pairs(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3
    true = {(signed[i], signed[j]) for i, j in zip(*np.nonzero(near)) if i != j}
    assert found <= true
    assert plain_components(signed, found) == plain_components(signed, true)
    return len(found)


def test_links_join_what_is_near(spark):
    check_links(spark, near_prints(np.random.default_rng(1)))


def test_large_buckets_are_cut_and_linked_by_forests(spark, monkeypatch):
    monkeypatch.setattr(simhash, "JOIN_UP_TO", 3)
    monkeypatch.setattr(simhash, "LINK_UP_TO", 12)
    rng = np.random.default_rng(2)
    dense = near_prints(rng, groups=1, n=40, flips=2)
    check_links(spark, dense)


def test_forests_hold_a_bucket_together():
    """One link fewer than the members of each linked part, whatever the number of pairs."""
    rng = np.random.default_rng(6)
    prints = near_prints(rng, groups=3, n=300, flips=1)
    out = simhash.forest(3)(pd.DataFrame({"fp": prints.view(np.int64)}))
    nodes = prints.view(np.int64).tolist()
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3
    true = [(nodes[i], nodes[j]) for i, j in zip(*np.nonzero(near)) if i < j]
    found = list(zip(out["a"].tolist(), out["b"].tolist()))
    assert plain_components(nodes, found) == plain_components(nodes, true)
    assert len(found) == len(nodes) - len(set(plain_components(nodes, true).values())) < len(true) / 10


def test_components_match_union_find(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (330, 2))] + [(i, i + 1) for i in range(500, 560)]
    rows = components(spark.createDataFrame(edges, "a long, b long")).collect()
    edges = [(a, b) for a, b in edges if a != b] + [(7, 7)]
    nodes = {n for a, b in edges[:-1] for n in (a, b)}
    assert {r["node"]: r["root"] for r in rows} == plain_components(nodes, edges[:-1]) and len(rows) == len(nodes)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprints(spark):
    for text in (None, "", " \t", "one", "One two", "A b C d", "x " * 500, "Ünï cödé wörds hère"):
        assert fingerprint(text, 3) % (1 << 64) == plain_print(text)


def test_whole_operator(spark):
    docs = awkward_docs(spark)
    rows = simhash_components(docs).collect()
    assert len(rows) == docs.count()
    texts = Counter((r["doc_id"], plain_print(r["text"])) for r in docs.collect())
    assert Counter((r["key"], r["fingerprint"] % (1 << 64)) for r in rows) == texts
    prints = sorted({p for _, p in texts})
    near = [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 3]
    roots = plain_components(prints, near)
    least = {}
    for (key, p), _ in texts.items():
        if key is not None:
            least[roots[p]] = min(key, least.get(roots[p], key))
    for r in rows:
        assert r["component"] == least.get(roots[r["fingerprint"] % (1 << 64)])
    zero = {r["component"] for r in rows if r["key"] in (100, 101, 102)}
    assert len(zero) == 1


def test_one_row_of_each_component_stays(spark):
    docs = awkward_docs(spark)
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    wanted = {r["component"] for r in simhash_components(docs).collect()}
    assert Counter(ids) == Counter(wanted)
    assert drop_near_duplicates(empty_docs(spark)).count() == 0


def test_signed_zero_and_negative_prints(spark):
    check_links(spark, np.array([0, 1, 3, 7, 15, (1 << 64) - 1, (1 << 64) - 2, 1 << 63, (1 << 63) | 7], dtype=np.uint64))
