"""What must grow no faster than the tables: passes, shuffles, stored copies, rows of a task."""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from dugout.operators import correlation as corr
from dugout.operators import split
from dugout.params import Seasons
from dugout.plans import model_table, modelling
from dugout.plans import queries as Q
from dugout.sources import scratch, tables


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_correlations_read_the_rows_once(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (4.0, None)], "a double, b double")
    found = corr.redundant_pairs(corr.correlations(corr.pair_moments(df, ["a", "b"])), 2, 0.5)
    assert "MapInArrow" not in plan_of(found)
    assert [(r.i, r.j, round(r.r, 9)) for r in found.collect()] == [(0, 1, -1.0)]


def test_extremes_of_pairs_over_many_batches():
    rng = np.random.default_rng(3)
    whole = np.round(rng.normal(size=(500, 6)) * 4)
    whole[rng.random(whole.shape) < 0.4] = np.nan
    whole[:, 4] = np.nan
    whole[0, 5], whole[1, 5] = np.inf, -np.inf
    names = [f"c{i}" for i in range(6)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, from_pandas=True) for c in part.T], names=names) for part in np.split(whole, 25)]
    with np.errstate(invalid="ignore"):
        (out,) = corr._moments(np.zeros(6))(batches)
    for row in out.to_pylist():
        both = whole[~np.isnan(whole[:, row["i"]]) & ~np.isnan(whole[:, row["j"]]), row["i"]]
        ends = (both.min(), both.max()) if len(both) else (np.inf, -np.inf)
        assert (row["n"], row["lo"], row["hi"]) == (len(both), *ends)


def test_line_items_are_joined_after_orders_found_their_customers(spark, sf_dir):
    plan = plan_of(tables.pitches(spark, sf_dir))
    assert plan.index("= o_orderkey") < plan.index("= c_custkey")


def test_only_the_season_before_meets_absent_names(spark):
    seasons = Seasons(2000, 2001, 2002)
    rows = [("a", 2000), ("a", 2001), ("b", 2000), ("b", 2000), ("c", None), (None, 2000), (None, 1999)]
    df = spark.createDataFrame(rows, "player_name string, game_year int").withColumn("pred_year", F.col("game_year") + 1)
    moved = model_table.carry_over(df, seasons)
    got = sorted((str(r.player_name), r.game_year or 0, r.pred_year or 0) for r in moved.collect())
    wanted = [("None", 1999, 2000), ("None", 2000, 2002), ("a", 2000, 2001), ("a", 2001, 2002), ("b", 2000, 2002), ("b", 2000, 2002), ("c", 0, 0)]
    assert got == wanted
    assert plan_of(moved).startswith("Union")


def test_files_of_fitted_rows_are_bounded(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(scratch, "FITTED_FILE_ROWS", 100)
    rows = Q.split_rows(spark, sf_dir, [*Q.CELL, "pred_year"])
    sizes = [r["count"] for r in rows.groupBy(F.input_file_name()).count().collect()]
    assert max(sizes) <= 100 < sum(sizes)


def test_scan_tasks_of_fitted_rows_are_bounded(spark):
    rows = scratch.materialize(spark.range(0, 600_000, numPartitions=1), "rows", scratch.FITTED_FILE_ROWS)
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert max(sizes) <= 32 * scratch.FITTED_FILE_ROWS < 300_000 and sum(sizes) == 600_000


def test_moments_of_all_resamples_in_one_pass(spark):
    rows = [(float(i % 7), None if i % 4 == 0 else float(i * i % 11), i % 3, (i // 2) % 3 if i else None) for i in range(60)]
    df = spark.createDataFrame(rows, "a double, b double, fold_1 int, fold_2 int").repartition(4)
    found = {}
    for r in corr.resample_moments(df, ["a", "b"], {1: "fold_1", 2: "fold_2"}).collect():
        found[r.repeat, r.fold, r.i, r.j] = (r.n, r.lo, r.hi, r["shift"] + r.sx / r.n, r.sxx - r.sx * r.sx / r.n)
    for repeat in (1, 2):
        for fold in range(3):
            apart = corr.pair_moments(df.where(F.col(f"fold_{repeat}") != fold), ["a", "b"]).collect()
            for r in apart:
                wanted = (r.n, r.lo, r.hi, r["shift"] + r.sx / r.n, r.sxx - r.sx * r.sx / r.n)
                assert np.allclose(found[repeat, fold, r.i, r.j], wanted, rtol=1e-9, atol=1e-9)
    assert len(found) == 2 * 3 * 4


def test_tuning_stores_the_rows_once_for_all_resamples(spark, sf_dir, monkeypatch):
    train = Q.training(spark, sf_dir)
    folds = scratch.materialize(split.stratified_folds(train, folds=3, repeats=1), "folds")
    stored, store = [], modelling.materialize
    monkeypatch.setattr(modelling, "materialize", lambda df, label, *more: (stored.append(label), store(df, label, *more))[1])
    found = modelling.tune_grid(train, folds, [modelling.Point(100, 17, (1,))])
    assert stored == ["folded"] and found.count() == 3 * 3


def test_guesses_are_taken_apart_after_they_met_the_folds(spark, sf_dir):
    plan = plan_of(Q.cv_summary(spark, sf_dir))
    assert plan.index("Generate explode(") < plan.index("Join")


def shuffle_files(spark) -> set[str]:
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {name for name in blocks.mkString(" ").split() if name.startswith("shuffle_")}


def test_a_stored_table_leaves_no_shuffle_files(spark):
    setting = spark.conf.get(scratch._RELEASE, None)
    before = shuffle_files(spark)
    rows = spark.range(0, 100_000, numPartitions=4).groupBy((F.col("id") % 1000).alias("k")).count()
    stored = scratch.materialize(rows, "counts")
    end = time.monotonic() + 5
    while (left := shuffle_files(spark) - before) and time.monotonic() < end:
        time.sleep(0.1)
    assert not left and stored.count() == 1000 == rows.count()
    assert spark.conf.get(scratch._RELEASE, None) == setting


def test_each_resample_prepares_a_row_once(spark, sf_dir, monkeypatch):
    train = Q.training(spark, sf_dir)
    folds = scratch.materialize(split.stratified_folds(train, folds=3, repeats=1), "folds")
    sizes, prepared = [], modelling.prepared
    monkeypatch.setattr(modelling, "prepared", lambda df, recipe: (sizes.append(df.count()), prepared(df, recipe))[1])
    grid = [modelling.Point(100, 17, (1,)), modelling.Point(12, 17, (1,))]
    assert modelling.tune_grid(train, folds, grid).count() == 3 * 2 * 3
    assert len(sizes) == 6 and sum(sizes) == 3 * train.count()


def test_tuning_takes_the_rows_that_are_there(spark, sf_dir, tmp_path, monkeypatch):
    calls, split_rows = [], Q.split_rows
    monkeypatch.setattr(Q, "split_rows", lambda *a: (calls.append(a), split_rows(*a))[1])
    monkeypatch.setattr(Q.scratch, "shared_dir", lambda spark, label, *_: (str(tmp_path / label), True))
    row = (12, 17, 1, 1, 0, "rsq", 0.5)
    frame = spark.createDataFrame([row], "min_n int, mtry int, trees int, repeat int, fold int, metric string, estimate double")
    monkeypatch.setattr(Q.modelling, "tune_grid", lambda *_, **__: frame)
    assert Q.bind_columns_predictions(spark, sf_dir).count() > 0
    assert len(calls) == 1
