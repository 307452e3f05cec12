from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from dugout.llm import forest
from dugout.llm.common import table
from dugout.llm.forest import Strings, nearest, span

SHAPE = "vec_id long, embedding array<float>, rank int, score string"


def brute(ids, vectors, queries, k=5):
    v = np.asarray(vectors, dtype=np.float32).astype(np.float64)
    norms = np.sqrt((v * v).sum(axis=1))
    out = {}
    for q in queries:
        i = ids.index(q)
        scores = (v * v[i]).sum(axis=1) / (norms * norms[i])
        order = sorted((-s, x) for s, x in zip(scores.tolist(), ids) if x != q)[:k]
        out[q] = [(x, -s) for s, x in order]
    return out


def results(frame):
    out = {}
    for r in frame.orderBy("query", "rank").collect():
        out.setdefault(r["query"], []).append((r["id"], r["score"]))
        assert r["rank"] == len(out[r["query"]])
    return out


def test_small_tables_are_exact(spark):
    """Few rows: the ascent reaches the root, so all candidates are seen."""
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(60, 12)).tolist()
    vectors[7] = vectors[3]
    vectors[9] = [2 * x for x in vectors[3]]
    rows = [(i, v, i, "") for i, v in enumerate(vectors)]
    bad = [(100, None, 0, ""), (101, [0.0] * 12, 0, ""), (102, [float("nan")] * 12, 0, ""), (103, [None] + [1.0] * 11, 0, "")]
    bad += [(104, [float("inf")] + [1.0] * 11, 0, ""), (105, [1.0, 2.0], 0, ""), (106, [], 0, ""), (None, vectors[0], 0, "")]
    found = results(nearest(spark.createDataFrame(rows + bad, SHAPE), wanted=F.col("vec_id") % 3 == 0))
    wanted = brute(list(range(60)), vectors, range(0, 60, 3))
    assert found.keys() == wanted.keys()
    for q, near in wanted.items():
        assert [round(s, 12) for _, s in found[q]] == [round(s, 12) for _, s in near]
        if q != 3:
            assert [x for x, _ in found[q]] == [x for x, _ in near]
    assert {x for x, _ in found[3][:2]} == {7, 9}


def test_fewer_rows_than_k_and_none(spark):
    rows = [(i, [1.0, float(i)], 0, "") for i in range(3)]
    found = results(nearest(spark.createDataFrame(rows, SHAPE), wanted=F.lit(True)))
    assert {q: [x for x, _ in near] for q, near in found.items()} == {0: [1, 2], 1: [2, 0], 2: [1, 0]}
    assert nearest(spark.createDataFrame(rows[:1], SHAPE), wanted=F.lit(True)).count() == 0
    assert nearest(spark.createDataFrame([], SHAPE), wanted=F.lit(True)).count() == 0


def test_many_copies_of_one_vector(spark):
    """Equal vectors are one entry; ties go to the smaller id, whether it is one of the copies or not."""
    rng = np.random.default_rng(1)
    one = rng.normal(size=8).tolist()
    rows = [(i, one if i % 2 else rng.normal(size=8).tolist(), 0, "") for i in range(400)]
    found = results(nearest(spark.createDataFrame(rows, SHAPE), wanted=F.col("vec_id").isin(1, 3, 399, 10)))
    assert [x for x, _ in found[1]] == [3, 5, 7, 9, 11] and [x for x, _ in found[399]] == [1, 3, 5, 7, 9]
    assert len(found[10]) == 5


def recall(found, wanted):
    return np.mean([len({x for x, _ in found.get(q, [])} & {x for x, _ in near}) / len(near) for q, near in wanted.items()])


def test_recall_on_the_given_vectors(spark):
    frame = table(spark, "/root/testdata/sf0.1", "embeddings")
    rows = frame.orderBy("vec_id").collect()
    found = results(nearest(frame, wanted=F.col("vec_id") % 50 == 0))
    wanted = brute([r["vec_id"] for r in rows], [r["embedding"] for r in rows], [r["vec_id"] for r in rows if r["vec_id"] % 50 == 0])
    assert recall(found, wanted) >= 0.9


def test_trees_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(forest, "BLOCK_ROWS", 300)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    vectors = (centres[rng.integers(0, 40, 1500)] + 0.3 * rng.normal(size=(1500, 16))).tolist()
    rows = [(i, v, 0, "") for i, v in enumerate(vectors)]
    found = results(nearest(spark.createDataFrame(rows, SHAPE), wanted=F.col("vec_id") % 50 == 0))
    assert recall(found, brute(list(range(1500)), vectors, range(0, 1500, 50))) >= 0.9


@pytest.mark.parametrize("size", (1, 2, 64, 100))
def test_strings(size):
    strings = Strings(size, trees=2)
    vectors = np.random.default_rng(3).normal(size=(50, size))
    labels = strings.labels(vectors)
    assert labels.shape == (50, 2) and (labels >= 0).all() and (labels < 1 << 62).all()
    assert (strings.labels(vectors * 3.0) >> forest.TIE_BITS == labels >> forest.TIE_BITS).all()
    low, high = span(labels[:, 0], np.full(50, strings.depth), strings.depth)
    assert ((low <= labels[:, 0]) & (labels[:, 0] <= high)).all()
    low, high = span(labels[:, 0], np.zeros(50, int), strings.depth)
    assert (low == 0).all() and (high >= labels.max()).all()


def test_extreme_magnitudes(spark):
    """Doubles whose squares would over- or underflow keep their cosine, which a power of ten does not change."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 10))
    scale = np.array([1e-200, 1e200, 1.0, 1e-310, 1e300])[np.arange(60) % 5]
    rows = [(i, (v * s).tolist(), 0, "") for i, (v, s) in enumerate(zip(base, scale))]
    found = results(nearest(spark.createDataFrame(rows, SHAPE.replace("float", "double")), wanted=F.col("vec_id") < 20))
    norms = np.sqrt((base * base).sum(axis=1))
    for q in range(20):
        cosines = base @ base[q] / (norms * norms[q])
        wanted = [i for i in np.argsort(-cosines) if i != q][:5]
        assert [x for x, _ in found[q]] == wanted
        # parts near 1e-310 have few digits left
        assert np.allclose([s for _, s in found[q]], cosines[wanted], rtol=0, atol=1e-9)


def test_multiples_of_one_vector_over_many_blocks(spark, monkeypatch):
    """Multiples share their hash strings; blocks cut them apart, and none is lost."""
    monkeypatch.setattr(forest, "BLOCK_ROWS", 50)
    rng = np.random.default_rng(5)
    one = rng.normal(size=12)
    vectors = [(one * (1 + i / 7)).tolist() if i % 3 == 0 else rng.normal(size=12).tolist() for i in range(600)]
    labels = Strings(12, trees=2).labels(np.array(vectors[::3]))
    assert len(set(labels[:, 0] >> forest.TIE_BITS)) == 1 and len(set(labels[:, 0])) > 150
    rows = [(i, v, 0, "") for i, v in enumerate(vectors)]
    found = results(nearest(spark.createDataFrame(rows, SHAPE), wanted=F.col("vec_id").isin(0, 300, 597, 1, 100)))
    for q in (0, 300, 597):
        assert all(x % 3 == 0 and round(s, 6) == 1 for x, s in found[q])
    wanted = brute(list(range(600)), vectors, (0, 300, 597, 1, 100))
    for q, near in wanted.items():
        assert np.allclose([s for _, s in found[q]], [s for _, s in near], atol=1e-12)


def test_two_vectors_with_one_id(spark):
    rows = [(1, [1.0, 0.0, 0.1], 0, ""), (1, [0.0, 1.0, 0.2], 0, ""), (2, [1.0, 0.1, 0.1], 0, ""), (3, [0.1, 1.0, 0.2], 0, "")]
    found = results(nearest(spark.createDataFrame(rows, SHAPE), wanted=F.col("vec_id") > 1, k=2))
    assert [x for x, _ in found[2]] == [1, 3] and [x for x, _ in found[3]] == [1, 2]
    assert round(found[3][0][1], 3) == round(1.04 / np.sqrt(1.04 * 1.05), 3)
