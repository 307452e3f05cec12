"""Trees grown within a task, against the library's, and what is tuned with them."""

from __future__ import annotations

import numpy as np
import pytest
from compare import duck
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

import __spark_entry__ as contract
from dugout.operators import split
from dugout.plans import boosting, modelling
from dugout.plans import queries as Q
from dugout.sources.scratch import materialize


def made(spark, n: int, parts: int):
    """Rows with vectors: continuous, mostly zero, of few values, of both signs, constant."""
    rng = np.random.default_rng(n)
    x = np.stack([rng.normal(size=n), np.where(rng.random(n) < 0.7, 0.0, rng.random(n)), rng.integers(0, 9, n) * 1.0, rng.normal(size=n) ** 3, np.full(n, 2.5)], axis=1)
    y = x[:, 0] * 2 + x[:, 1] ** 2 - x[:, 2] + rng.normal(size=n) / 3
    rows = [(i, float(y[i]), x[i].tolist()) for i in range(n)]
    df = spark.createDataFrame(rows, "id int, y double, x array<double>").repartitionByRange(parts, "id")
    return materialize(df.select("id", "y", array_to_vector("x").alias("features")), "made")


@pytest.mark.parametrize("n, mtry, min_n", [(700, 3, 5), (700, 9, 20), (12_500, 2, 40)])
def test_trees_are_those_of_the_library(spark, n, mtry, min_n):
    rows = made(spark, n, 3)
    train, held_out = rows.where("id % 5 > 0"), rows.where("id % 5 = 0")
    lengths = (1, 3, 7)
    fitted = GBTRegressor(
        labelCol="y", featuresCol="features", maxIter=7, maxDepth=6, stepSize=0.3, minInstancesPerNode=min_n, featureSubsetStrategy=str(mtry), seed=11
    ).fit(train)
    wanted = {(r.id, r.trees): r.prediction for r in modelling.prefix_predictions(fitted, held_out, lengths).collect()}
    cuts = boosting.learn_cuts(train, train.count(), 11)
    binned = boosting.binned(rows.withColumn("held_out", F.col("id") % 5 == 0), cuts)
    found = boosting.predictions(binned, "y", ["id"], lengths, min_n=min_n, mtry=mtry, depth=6, rate=0.3, seed=11)
    assert {(r.id, r.trees): r.prediction for r in found.collect()} == pytest.approx(wanted, rel=1e-9, abs=1e-9)
    assert len(wanted) == 3 * held_out.count()


def test_unknown_outcomes_are_refused(spark):
    rows = made(spark, 50, 1).withColumn("y", F.when(F.col("id") != 7, F.col("y"))).withColumn("held_out", F.col("id") == 3)
    binned = boosting.binned(rows, boosting.learn_cuts(rows, 50, 1))
    with pytest.raises(Exception, match="missing in some"):
        boosting.predictions(binned, "y", ["id"], [1], min_n=1, mtry=2, depth=2, rate=0.3, seed=1).collect()


def test_fits_in_tasks_and_on_many_rows_agree(spark, sf_dir, monkeypatch):
    train = Q.training(spark, sf_dir)
    folds = materialize(split.stratified_folds(train, folds=2, repeats=1), "folds")
    grid, found = [modelling.Point(100, 17, (1, 3))], []
    with monkeypatch.context() as m:
        m.setattr(modelling, "boosted_trees", lambda point: pytest.fail("the library fits, in many jobs"))
        found.append(modelling.tune_grid(train, folds, grid).collect())
    monkeypatch.setattr(modelling, "TASK_ROWS", 0)
    found.append(modelling.tune_grid(train, folds, grid).collect())
    tasks, library = ({tuple(r)[:-1]: r.estimate for r in rows} for rows in found)
    assert len(tasks) == 2 * 2 * 3 and tasks == pytest.approx(library, rel=1e-9)


def test_the_whole_grid_is_tuned(spark, sf_dir, tmp_path, monkeypatch):
    given = []
    row = (1, 1, 1, 1, 0, "rsq", 0.5)
    frame = spark.createDataFrame([row], "min_n int, mtry int, trees int, repeat int, fold int, metric string, estimate double")
    monkeypatch.setattr(Q.scratch, "shared_dir", lambda spark, label, *_: (str(tmp_path / label), True))
    monkeypatch.setattr(Q.modelling, "tune_grid", lambda train, folds, grid, **_: (given.append((folds.count() / train.count(), grid)), frame)[1])
    Q.tuned(spark, sf_dir)
    [(repeats, grid)] = given
    points = {(p.min_n, p.mtry, t) for p in grid for t in p.trees}
    assert repeats == 5 and len(points) == 1000
    assert [{p[i] for p in points} for i in range(3)] == [set(range(1, 101, 11)), {1, 6, 11, 17, 22, 28, 33, 39, 44, 50}, set(range(1, 101, 11))]
    told = duck(sf_dir).sql(contract.oracle_sql()["tune_grid"]).fetchall()
    assert {r[:3] for r in told} == points and len(told) == 3000 and {r[4] for r in told} == {25}
