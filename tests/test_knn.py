"""Neighbour imputation against a plain double loop."""

from __future__ import annotations

import math
import random

import duckdb
import numpy as np
import pytest

from dugout.operators import knn
from dugout.operators.knn import impute_knn
from dugout.plans import features
from dugout.plans import queries as Q

COLUMNS = ["game_year", "a", "b", "c"]
SCHEMA = "batter_id long, player_name string, game_year int, pitch_group string, a double, b double, c double"


def _rows(n: int, seed: int):
    rng = random.Random(seed)
    maybe = lambda: None if rng.random() < 0.3 else rng.randrange(12) / 4.0
    return [
        (i, f"p{i}", 2000 + i % 2, "FB" if i % 3 else "BB", maybe(), maybe(), maybe()) for i in range(n)
    ]


def _brute_force(rows, k: int, donors=None, blocks: bool = True):
    donors = rows if donors is None else donors
    values = {r[0]: r[4:7] for r in donors}
    ranges, means = [], []
    years = [r[2] for r in donors]
    for j in range(3):
        known = [v[j] for v in values.values() if v[j] is not None]
        ranges.append(max(known) - min(known))
        means.append(sum(known) / len(known))
    out = {}
    for r in rows:
        filled = list(r[4:7])
        for j in range(3):
            if r[4 + j] is not None:
                continue
            found = []
            for d in donors:
                if d[4 + j] is None or (blocks and (d[2], d[3]) != (r[2], r[3])):
                    continue
                # Season and group are two more terms; within a block they are 0.
                other = abs(d[2] - r[2]) / ((max(years) - min(years)) or 1) + (d[3] != r[3])
                both = [(r[4 + i], d[4 + i], ranges[i]) for i in range(3) if None not in (r[4 + i], d[4 + i])]
                found.append(((other + sum(abs(x - y) / s for x, y, s in both)) / (len(both) + 2), d[4 + j]))
            found.sort(key=lambda f: f[0])
            out[(r[0], j)] = (found, means[j])
        values[r[0]] = filled
    return out


def _check(got, rows, wanted):
    for (row, col), (found, mean) in wanted.items():
        if not found:
            assert got[row][col] == pytest.approx(mean)
            continue
        # Equal distances may be settled either way: bound the mean by the two extremes.
        edge = found[min(5, len(found)) - 1][0]
        sure = [v for d, v in found[:5] if not math.isclose(d, edge)]
        tied = sorted(v for d, v in found if math.isclose(d, edge))
        n = min(5, len(found)) - len(sure)
        low, high = (sum(sure) + sum(tied[:n])), (sum(sure) + sum(tied[-n:]))
        assert low / min(5, len(found)) - 1e-9 <= got[row][col] <= high / min(5, len(found)) + 1e-9
    for r in rows:
        for j in range(3):
            if r[4 + j] is not None:
                assert got[r[0]][j] == r[4 + j]


def _by_id(df):
    return {r.batter_id: (r.a, r.b, r.c) for r in df.collect()}


@pytest.mark.parametrize("tiles", [(2048, 16384), (7, 5)])
def test_matches_brute_force(spark, tiles):
    rows = _rows(160, 3)
    df = spark.createDataFrame(rows, SCHEMA)
    got = _by_id(impute_knn(df, COLUMNS, query_tile=tiles[0], donor_tile=tiles[1]))
    assert len(got) == len(rows)
    _check(got, rows, _brute_force(rows, 5))


@pytest.mark.parametrize("blocks", [True, False])
def test_new_rows_are_filled_from_training_rows(spark, blocks):
    train = _rows(120, 8)
    new = [(1000 + r[0], *r[1:]) for r in _rows(60, 9)]
    frames = [spark.createDataFrame(rows, SCHEMA) for rows in (new, train)]
    cut = {} if blocks else {"block": ()}
    got = _by_id(impute_knn(frames[0], COLUMNS, donors=frames[1], query_tile=11, donor_tile=13, **cut))
    assert len(got) == len(new)
    _check(got, new, _brute_force(new, 5, train, blocks))


def test_tiling_does_not_change_the_result(spark):
    df = spark.createDataFrame(_rows(200, 5), SCHEMA)
    one = impute_knn(df, COLUMNS).orderBy("batter_id").collect()
    many = impute_knn(df, COLUMNS, query_tile=3, donor_tile=4).orderBy("batter_id").collect()
    for a, b in zip(one, many):
        assert [a.a, a.b, a.c] == pytest.approx([b.a, b.b, b.c])


def test_block_without_donor_falls_back_to_the_mean(spark):
    rows = [
        (1, "x", 2000, "FB", None, 1.0, 1.0),
        (2, "y", 2001, "FB", 4.0, 1.0, 1.0),
        (3, "z", 2001, "FB", 8.0, 2.0, 1.0),
    ]
    got = impute_knn(spark.createDataFrame(rows, SCHEMA), COLUMNS).where("batter_id = 1").first()
    assert got.a == 6.0


def _sql(columns: list[str], gappy: list[str], k: int) -> str:
    """Neighbours of every row among all rows, with ties by key: distance to nine digits, then hash of the key."""
    key = "md5(concat_ws('|', batter_id, player_name, game_year, pitch_group))"
    ranges = ", ".join(f"nullif(max({c}) - min({c}), 0)::DOUBLE AS r{i}" for i, c in enumerate(columns))
    scaled = ", ".join(f"{c}::DOUBLE / coalesce(r{i}, 1) AS s{i}" for i, c in enumerate(columns))
    total = " + ".join(f"coalesce(abs(a.s{i} - b.s{i}), 0)" for i in range(len(columns)))
    shared = " + ".join(f"(a.s{i} IS NOT NULL AND b.s{i} IS NOT NULL)::INT" for i in range(len(columns)))
    fills = ", ".join(
        f"list_avg(list_transform(min({{'d': d, 'id': b_id, 'v': b{i}}}, {k}) FILTER (WHERE a{i} IS NULL AND b{i} IS NOT NULL), lambda x: x.v)) AS f{i}"
        for i, c in enumerate(columns) if c in gappy
    )
    values = ", ".join(f"a.{c}::DOUBLE AS a{i}, b.{c}::DOUBLE AS b{i}" for i, c in enumerate(columns) if c in gappy)
    return f"""WITH ranges AS (SELECT {ranges} FROM train), scaled AS (SELECT *, {key} AS id, {scaled} FROM train, ranges),
met AS (SELECT a.id AS a_id, b.id AS b_id, {values},
 round(({total} + (a.pitch_group <> b.pitch_group)::INT) / ({shared} + 1), 9) AS d FROM scaled a, scaled b),
found AS (SELECT a_id, {fills} FROM met GROUP BY a_id)
SELECT batter_id, game_year, pitch_group, {", ".join(f"coalesce({c}::DOUBLE, f{i}, avg({c}) OVER ()) AS {c}" for i, c in enumerate(columns) if c in gappy)}
FROM scaled JOIN found ON id = a_id"""


def test_the_whole_training_table_against_sql(spark, sf_dir, monkeypatch):
    """Every cell of the registered query on the smallest tables; larger ones are too many pairs for SQL."""
    rows = Q.training(spark, sf_dir)
    monkeypatch.setattr(Q, "training", lambda *_: rows)
    names = features.predictors()
    train = rows.toPandas()  # noqa: F841, read by name below
    gappy = [c for c in names if train[c].isna().any()]
    con = duckdb.connect()
    wanted = con.sql(_sql(names, gappy, 5)).df().set_index(["batter_id", "game_year", "pitch_group"]).sort_index()
    got = Q.impute_knn(spark, sf_dir).toPandas().set_index(["batter_id", "game_year", "pitch_group"]).sort_index()
    assert len(got) == len(wanted) == len(train) and train[gappy].isna().sum().sum() > 1000
    np.testing.assert_allclose(got[gappy].to_numpy(float), wanted[gappy].to_numpy(float), rtol=0, atol=1e-7)


def test_bounds_leave_out_tiles(spark):
    """Far clusters: tile pairs grow with the rows, not with their square, and the fills stay those of the double loop."""
    def clusters(n: int):
        rows = []
        for i in range(n):
            at = (i // 40) * 40.0
            gap = i % 4 == 0
            rows.append((i, f"p{i}", 2000, "FB", None if gap else at + i % 7, at + i % 5, at + i % 3))
        return rows

    pairs = {}
    for n in (400, 1600):
        df = spark.createDataFrame(clusters(n), SCHEMA)
        spread = {c: (r, m, s) for c, r, m, s in zip(*(lambda x: (x.columns, x.ranges, x.means, x.sds))(knn.learn(df, COLUMNS)))}
        how = (COLUMNS, (), knn.CELL, 5, 16, 32, spread)
        queries, donors, scheduled, _, _ = knn.tile_pairs(df, df, *how)
        tiles = [t.select(c).distinct().count() for t, c in ((queries, "query_tile"), (donors, "donor_tile"))]
        pairs[n] = scheduled.count()
        assert pairs[n] < 0.6 * tiles[0] * tiles[1]
    assert pairs[1600] < 9 * pairs[400]
    rows = clusters(400)
    got = _by_id(impute_knn(spark.createDataFrame(rows, SCHEMA), COLUMNS, block=(), query_tile=16, donor_tile=32))
    _check(got, rows, _brute_force(rows, 5, blocks=False))


def _plan(df, **how):
    spread = {c: (r, m, s) for c, r, m, s in zip(*(lambda x: (x.columns, x.ranges, x.means, x.sds))(knn.learn(df, COLUMNS)))}
    return knn.neighbours(df, df, COLUMNS, (), knn.CELL, 5, how["query_tile"], how["donor_tile"], spread)


def test_no_tile_is_shuffled_once_per_pair(spark):
    """Behind the meeting of tiles nothing is shuffled but one row of fills for each row with gaps."""
    rows = _rows(120, 4)
    found = _plan(spark.createDataFrame(rows, SCHEMA), query_tile=8, donor_tile=8)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan[: plan.index("CartesianProduct")]
    donors = plan[plan.index("CartesianProduct") :].splitlines()[1:4]
    assert not any("Exchange" in line for line in donors)
    assert found.count() == sum(None in r for r in rows)


def test_values_beyond_those_of_the_donors(spark):
    """Rough sums cut such values off at the donors' ends; what is found are still the nearest by whole distances."""
    rng = random.Random(12)
    far = lambda: None if rng.random() < 0.4 else rng.choice((-1e6, 3.0, 1e9)) + rng.random()
    train = _rows(150, 11)
    new = [(1000 + i, f"n{i}", 2000 + i % 2, "FB", far(), far(), far()) for i in range(60)]
    frames = [spark.createDataFrame(rows, SCHEMA) for rows in (new, train)]
    got = _by_id(impute_knn(frames[0], COLUMNS, donors=frames[1], block=(), query_tile=9, donor_tile=40))
    assert len(got) == len(new)
    _check(got, new, _brute_force(new, 5, train, blocks=False))


def test_rough_sums_leave_out_no_pair():
    """Every pair within a row's bound passes the test in 16 bits, for many columns and spans."""
    rng = np.random.default_rng(9)
    for spread in (1e-3, 0.3, 1.0, 40.0):
        x, y = (np.where(rng.random((n, 50)) < 0.3, np.nan, rng.normal(0, spread, (n, 50))) for n in (100, 700))
        donors = knn._Donors(y, bytes(16 * len(y)), np.ones(50))
        gaps = knn._Gaps(x, bytes(16 * len(x)), np.full(x.shape, np.inf), 5, -2)
        both = ~np.isnan(x[:, None]) & ~np.isnan(y[None])
        dist = np.where(both, np.abs(x[:, None] - y[None]), 0).sum(axis=2) / (both.sum(axis=2) - 2)
        own = np.quantile(dist, 0.02, axis=1)
        side = gaps._side(knn._grid(gaps.rows.x, donors.low, donors.high, donors.unit), slice(0, 100), own, donors)
        passed = np.zeros(dist.shape, bool)
        for piece, start in enumerate(donors.starts):
            r, c = gaps._near(knn._grid(gaps.rows.x, donors.low, donors.high, donors.unit), side, gaps.boxes[0], donors, piece)
            passed[r, start + c] = True
        assert passed[dist <= own[:, None]].all() and passed.mean() < 0.1


def test_a_row_meets_the_sample_and_all_others(spark):
    """With a tiny sample and few pairs kept at once the bounds move often; the fills are those of the double loop."""
    rows = _rows(300, 21)
    sizes = knn.SAMPLE, knn.PENDING
    knn.SAMPLE, knn.PENDING = 12, 50
    try:
        got = _by_id(impute_knn(spark.createDataFrame(rows, SCHEMA), COLUMNS, block=(), query_tile=64, donor_tile=64))
    finally:
        knn.SAMPLE, knn.PENDING = sizes
    _check(got, rows, _brute_force(rows, 5, blocks=False))


def test_no_pair_within_the_bounds_is_left_out():
    """Columns of few steps and of many, known on both sides, on one or by some rows only."""
    rng = np.random.default_rng(8)
    cells = lambda n: np.stack([rng.random(n), rng.integers(0, 3, n) / 2, rng.random(n) ** 3, rng.integers(0, 6, n) / 5, np.full(n, 0.4), rng.random(n)], axis=1)
    donors, rows = cells(900), cells(300)
    for x in (donors, rows):
        x[:, 2:4][rng.random((len(x), 2)) < 0.3] = np.nan
    rows[:, 5] = np.nan
    d = knn._Donors(donors, bytes(16 * len(donors)), np.ones(6))
    assert d.coarse.tolist() == [False, True, False, True, True, False]
    for reach in (0.05, 0.2, np.inf):
        g = knn._Gaps(rows, bytes(16 * len(rows)), np.full(rows.shape, reach), 5, -1)
        steps = knn._grid(g.rows.x, d.low, d.high, d.unit)
        for strip, box in zip(g.strips, g.boxes):
            own = g.wanted[strip].max(axis=1)
            side = g._side(steps[strip], strip, own, d)
            for piece, start in enumerate(d.starts):
                found = set(zip(*g._near(steps[strip], side, box, d, piece)))
                r, c = (x.ravel() for x in np.indices((len(own), min(knn.PIECE, len(donors) - start))))
                exact = knn.exact_distances(g.rows, r + strip.start, d.rows, c + start, -1)
                near = exact <= own[r]
                assert set(zip(r[near], c[near])) <= found and len(found) <= near.sum() + 0.02 * len(near)
