from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from dugout.llm import registry
from dugout.llm.sharding import Matrix, hypergeometric, shuffle_into_shards
from fixtures import awkward_docs, empty_docs


def check(rows, n, shards):
    sizes = Counter(r["shard"] for r in rows)
    assert sum(sizes.values()) == n
    counts = [sizes[s] for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    for s in range(shards):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))


def test_sizes_slots_and_rows(spark):
    docs = awkward_docs(spark)
    out = shuffle_into_shards(docs, 7, rows_per_bucket=3)
    rows = out.collect()
    check(rows, docs.count(), 7)
    key = lambda r: tuple(str(x) for x in r)
    assert Counter(key(r["row"]) for r in rows) == Counter(key(r) for r in docs.collect())


def test_fewer_rows_than_shards_and_none(spark):
    check(shuffle_into_shards(spark.range(5), 40).collect(), 5, 40)
    assert shuffle_into_shards(empty_docs(spark), 40).count() == 0


def test_the_query_deals_whole_documents(spark, tmp_path, monkeypatch):
    docs = awkward_docs(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    given = []
    monkeypatch.setattr(registry, "shuffle_into_shards", lambda df, n: (given.append(df.schema), shuffle_into_shards(df, n))[1])
    found = registry.op4_hypergeometric_shards(spark, str(tmp_path))
    assert [f.names for f in given] == [docs.columns]
    dealt = found._jdf.queryExecution().sparkPlan().toString()
    assert dealt.index("crc32") < dealt.index("Window")  # the checksum is taken of what the shard holds
    rows = found.collect()
    check(rows, docs.count(), 40)
    plain = lambda t: (16, None) if t is None else (len(t.encode()) + 16, zlib.crc32(t.encode()))
    wanted = Counter((r["doc_id"], *plain(r["text"])) for r in docs.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == wanted


def test_same_seed_same_deal(spark):
    docs = spark.range(0, 1000, numPartitions=4)
    deal = lambda seed: {r["row"]["id"]: (r["shard"], r["slot"]) for r in shuffle_into_shards(docs, 10, seed=seed).collect()}
    assert deal(1) == deal(1) != deal(2)


def test_uniform(spark):
    """Every shard draws on every partition in proportion, and slots do not follow the input's order."""
    docs = spark.range(0, 40_000, numPartitions=8)
    rows = shuffle_into_shards(docs, 20, rows_per_bucket=500).select("row.id", "shard", "slot").toPandas()
    table = np.zeros((8, 20))
    np.add.at(table, (rows["id"] // 5000, rows["shard"]), 1)
    chi = ((table - 250) ** 2 / 250).sum()
    assert chi < 133 + 5 * math.sqrt(2 * 133)
    assert abs(np.corrcoef(rows["id"], rows["slot"])[0, 1]) < 0.03
    assert abs(np.corrcoef(rows["id"], rows["shard"])[0, 1]) < 0.03


def test_matrix_has_both_margins():
    rows = np.array([5, 0, 17, 3, 900, 41])
    matrix = Matrix(rows, 9, seed=3)
    table = np.array([matrix.row(p) for p in range(len(rows))])
    assert (table.sum(axis=1) == rows).all() and (table.sum(axis=0) == matrix.sizes()).all()
    assert sorted(matrix.labels(4)) == sorted(np.repeat(np.arange(9), table[4]))


def test_hypergeometric_moments(monkeypatch):
    import dugout.llm.sharding as sharding

    rng = np.random.default_rng(0)
    monkeypatch.setattr(sharding, "NUMPY_LIMIT", 0)
    draws = np.array([hypergeometric(rng, 300, 700, 400) for _ in range(20_000)])
    assert abs(draws.mean() - 120) < 0.3
    assert abs(draws.var() / (400 * 0.3 * 0.7 * 600 / 999) - 1) < 0.05
    assert draws.min() >= 0 and draws.max() <= 300
    big = hypergeometric(rng, 3 * 10**10, 7 * 10**10, 10**10)
    assert abs(big - 3 * 10**9) < 10 * math.sqrt(10**10 * 0.21)
    assert hypergeometric(rng, 5, 0, 3) == 3 and hypergeometric(rng, 0, 5, 3) == 0 and hypergeometric(rng, 2, 3, 5) == 2
