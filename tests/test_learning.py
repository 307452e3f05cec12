"""Correlation, splits, recipe and models."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from dugout.operators import correlation as corr
from dugout.operators import split
from dugout.params import CELL
from dugout.plans import evaluation, features, modelling
from dugout.plans import queries as Q


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return Q.split_rows(spark, sf_dir)


def test_correlation_of_gaps_constants_and_subset_constants(spark):
    data = [(1.0, 2.0, 0.1, None), (2.0, 4.5, 0.1, 0.3), (3.0, None, 0.1, 0.3), (4.0, 8.0, 0.1, None), (5.0, 9.0, 0.1, 0.7)]
    df = spark.createDataFrame(data, "a double, b double, c double, d double").repartition(3)
    got = {(r.col_a, r.col_b): r.r for r in corr.corr_matrix(df, ["a", "b", "c", "d"]).collect()}
    x, y = np.array([1, 2, 4, 5.0]), np.array([2, 4.5, 8, 9])
    assert got[("a", "b")] == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-12)
    assert got[("a", "c")] is None and got[("c", "d")] is None
    assert got[("b", "d")] == pytest.approx(1.0)
    assert len(got) == 6


def test_redundant_column_with_larger_mean_goes(spark):
    pairs = spark.createDataFrame([(0, 1, 0.95), (0, 2, 0.5), (1, 2, 0.1)], "i int, j int, r double")
    assert [(r.i, r.j, r.drop_j) for r in corr.redundant_pairs(pairs, 3, 0.9).collect()] == [(0, 1, False)]


def test_split_is_exact_disjoint_and_repeatable(spark, rows):
    counts = rows.groupBy("pitch_group").agg(F.count("*").alias("n"), F.sum(F.col("is_train").cast("int")).alias("t"))
    for r in counts.collect():
        assert r.t == math.floor(r.n * 0.8)
    again = split.stratified_split(rows.drop("is_train").repartition(5))
    keys = ["batter_id", "game_year", "pitch_group", "is_train"]
    assert rows.select(*keys).exceptAll(again.select(*keys)).isEmpty()


def test_folds_cover_every_row_once_per_repeat(rows):
    n = rows.count()
    folds = split.stratified_folds(rows)
    for r in folds.groupBy("repeat").agg(F.count("*").alias("n"), F.countDistinct("batter_id", "game_year", "pitch_group").alias("d")).collect():
        assert (r.n, r.d) == (n, n)
    per_fold = [r.n for r in folds.groupBy("repeat", "pitch_group", "fold").agg(F.count("*").alias("n")).collect()]
    assert len(per_fold) == 5 * 3 * 5


def test_regular_grid_has_the_full_size():
    grid = modelling.regular_grid()
    assert len(grid) == 100 and all(len(p.trees) == 10 for p in grid)
    assert grid[0].trees == (1, 12, 23, 34, 45, 56, 67, 78, 89, 100)
    assert sorted({p.mtry for p in grid}) == [1, 6, 11, 17, 22, 28, 33, 39, 44, 50]


def test_recipe_drops_one_of_the_year_columns_and_scales(rows):
    train = rows.where("is_train")
    recipe = features.fit_recipe(train)
    assert ("game_year" in recipe.inputs) + ("pred_year" in recipe.inputs) < 2
    assert not set(recipe.inputs) & set(features.ID_COLUMNS)
    assert {"pitch_group_FB", "pitch_group_OS"} <= set(recipe.inputs)
    baked = recipe.stages()[0].transform(train)
    row = baked.agg(F.avg("z_pitch_group_FB").alias("m"), F.stddev_samp("z_pitch_group_FB").alias("s")).first()
    assert row.m == pytest.approx(0, abs=1e-9) and row.s == pytest.approx(1)


def test_model_predicts_persists_and_repeats(spark, rows, tmp_path):
    train, held_out = rows.where("is_train"), rows.where("not is_train")
    model = Q.fitted(train)
    scored = modelling.predict(model, held_out)
    assert scored.where("prediction is null").isEmpty() and scored.count() == held_out.count()
    metrics = {r.metric: r.estimate for r in evaluation.regression_metrics(scored, "num_pitches", "prediction").collect()}
    assert 0 <= metrics["rsq"] <= 1 and metrics["mae"] <= metrics["rmse"]
    modelling.save(model, str(tmp_path / "m"))
    again = modelling.predict(modelling.load(str(tmp_path / "m")), held_out)
    assert scored.select("batter_id", "prediction").exceptAll(again.select("batter_id", "prediction")).isEmpty()


def test_prefix_of_a_long_fit_is_the_short_fit(rows):
    train = rows.where("is_train")
    recipe = features.fit_recipe(train)
    ready = modelling.prepared(train, recipe).select("features", features.OUTCOME)
    long = modelling.boosted_trees(modelling.Point(12, 17, (4,))).fit(ready)
    short = modelling.boosted_trees(modelling.Point(12, 17, (2,))).fit(ready)
    scored = modelling.prefix_predictions(long, ready, [2, 4])
    found = {(r.trees, r.metric): r.estimate for r in evaluation.regression_metrics(scored, features.OUTCOME, "prediction", by=["trees"]).collect()}
    want = evaluation.regression_metrics(short.transform(ready), features.OUTCOME, "prediction")
    for r in want.collect():
        assert found[2, r.metric] == pytest.approx(r.estimate, rel=1e-9)
    assert found[4, "rmse"] < found[2, "rmse"]


def test_best_point_is_the_highest_rsq(spark):
    rows = [(1, 1, n, "rsq", m) for n, m in ((1, 0.2), (12, 0.9), (23, 0.4))] + [(1, 1, 1, "rmse", 0.1)]
    summary = spark.createDataFrame(rows, "min_n int, mtry int, trees int, metric string, mean double")
    assert modelling.best_point(summary) == modelling.Point(1, 1, (12,))


def test_assembled_features_are_those_of_the_stages(spark, sf_dir):
    train = Q.training(spark, sf_dir)
    recipe = features.fit_recipe(train)
    staged = train
    for stage in recipe.stages():
        staged = stage.transform(staged)
    told = lambda df: {tuple(r[:-1]): r.x for r in df.select(*CELL, vector_to_array("features").alias("x")).collect()}
    wanted = told(staged)
    assert len(wanted) > 100 and told(recipe.assembled(train)) == wanted
    bad = train.withColumn(recipe.inputs[3], F.lit(float("nan")))
    with pytest.raises(Exception, match="NaN"):
        recipe.assembled(bad).select("features").collect()
