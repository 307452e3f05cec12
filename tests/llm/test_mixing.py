from __future__ import annotations

import hashlib
import math
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from dugout.llm.common import word_count
from dugout.llm.mixing import systematic_mix
from fixtures import awkward_docs, empty_docs


def water(sizes: dict, share=1.5, ceiling=2.0, weights=(3, 1, 2)):
    """Deal by weight, stop the full ones, deal their excess again, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, total = set(), share * sum(sizes.values())
    while True:
        rest = total - sum(ceiling * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        level = rest / sum(weight[s] for s in open_) if open_ else 0
        more = {s for s in open_ if level * weight[s] >= ceiling * sizes[s]}
        if not more:
            return {s: ceiling * sizes[s] if s in full else level * weight[s] for s in names}
        full |= more


def test_targets_and_copies(spark):
    docs = awkward_docs(spark)
    rows = systematic_mix(docs, word_count(F.col("text"))).select("row.doc_id", "row.source", "row.text", "size", "source_size", "target", "copies").collect()
    assert len(rows) == docs.count()
    sizes = defaultdict(int)
    for r in rows:
        assert r["size"] == len((r["text"] or "").encode().split())
        sizes[r["source"]] += r["size"]
    wanted = water(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert math.isclose(r["target"], wanted[r["source"]], rel_tol=1e-12)
        rate = r["target"] / r["source_size"] if r["source_size"] else 0
        assert r["copies"] in (math.floor(rate), math.ceil(rate)) and r["copies"] <= 2


def test_near_target_and_same_again(spark):
    docs = spark.range(20_000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 5).cast("string")).alias("source"),
        (F.pmod(F.hash("id"), F.lit(900)) + 1).alias("words"),
    )
    run = lambda d: systematic_mix(d, F.col("words")).select("row.doc_id", "row.source", "size", "target", "copies").collect()
    rows = run(docs)
    taken, target = Counter(), {}
    for r in rows:
        taken[r["source"]] += r["copies"] * r["size"]
        target[r["source"]] = r["target"]
    for s, t in target.items():
        assert abs(taken[s] - t) <= 0.01 * t
    assert Counter(map(tuple, run(docs.repartition(7)))) == Counter(map(tuple, rows))


def test_one_offset_and_prefix_sums(spark):
    """Copies of a source in place order are those of a plain loop over its rows."""
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), (F.col("id") % 7).alias("words"))
    docs = docs.union(spark.range(300, 400).select("id", F.lit("b"), F.lit(40).cast("long")))
    rows = {r["doc_id"]: r for r in systematic_mix(docs, F.col("words")).select("row.*", "size", "target", "source_size", "copies").collect()}

    def klass(n):
        digits = len(f"{n:b}")
        return digits * 8 + (n >> max(digits - 4, 0)) % 8

    for source in ("a", "b"):
        own = sorted((r for r in rows.values() if r["source"] == source), key=lambda r: (klass(r["size"]), hashlib.md5(f"mix:{r['doc_id']}".encode()).hexdigest()))
        rate = own[0]["target"] / own[0]["source_size"]
        offset = int(hashlib.md5(f"mix/0{source}".encode()).hexdigest()[:8], 16) / 2**32
        for i, r in enumerate(own, 1):
            assert r["copies"] == math.floor(i * rate + offset) - math.floor((i - 1) * rate + offset)


def test_nothing_to_mix(spark):
    assert systematic_mix(empty_docs(spark), word_count(F.col("text"))).count() == 0
    blank = spark.createDataFrame([(1, "", None), (2, None, "s")], "doc_id long, text string, source string")
    assert [r["copies"] for r in systematic_mix(blank, word_count(F.col("text"))).collect()] == [0, 0]
