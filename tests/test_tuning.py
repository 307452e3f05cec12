"""Tuning that keeps its predictions, and filling that is stored with its donors."""

from __future__ import annotations

import math
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.ml import PipelineModel

from dugout.operators import split
from dugout.operators.knn import impute_knn
from dugout.params import CELL
from dugout.plans import filling, modelling
from dugout.plans import queries as Q
from dugout.plans.tuning import ResultStore, Task
from dugout.sources.scratch import materialize

GRID = [modelling.Point(12, 17, (1, 2)), modelling.Point(100, 17, (1, 2))]
REPO = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def train(spark, sf_dir):
    return Q.training(spark, sf_dir)


@pytest.fixture(scope="module")
def tuned(spark, train, tmp_path_factory):
    store = ResultStore(spark, str(tmp_path_factory.mktemp("tuning")))
    folds = materialize(split.stratified_folds(train, folds=2, repeats=1), "folds")
    return store, folds, modelling.tune_grid(train, folds, GRID, store=store)


def test_every_row_is_predicted_once_per_setting(train, tuned):
    store, _, _ = tuned
    tasks = modelling.tasks_of(GRID, [(1, 0), (1, 1)])
    kept = store.predictions(tasks)
    n = train.count()
    sizes = kept.groupBy("repeat", "min_n", "mtry", "trees").count().collect()
    assert len(sizes) == 4 and {r["count"] for r in sizes} == {n}
    assert kept.dropDuplicates([*CELL, "min_n", "trees"]).count() == 4 * n


def test_metrics_are_those_of_the_kept_predictions(tuned):
    store, _, metrics = tuned
    kept = store.predictions(modelling.tasks_of(GRID, [(1, 0), (1, 1)])).toPandas()
    found = {(r.min_n, r.trees, r.fold, r.metric): r.estimate for r in metrics.collect()}
    assert len(found) == 2 * 2 * 2 * 3
    for (min_n, trees, fold), part in kept.groupby(["min_n", "trees", "fold"]):
        gap = part["num_pitches"] - part["prediction"]
        r = np.corrcoef(part["num_pitches"], part["prediction"])[0, 1]
        wanted = {"rmse": math.sqrt((gap**2).mean()), "rsq": r * r, "mae": gap.abs().mean()}
        assert {m: found[min_n, trees, fold, m] for m in wanted} == pytest.approx(wanted, rel=1e-9)


def test_only_missing_fits_are_run(spark, train, tuned, monkeypatch):
    store, folds, before = tuned
    before = {tuple(r) for r in before.collect()}
    path, files = store._path("predictions/repeat=1/fold=1/min_n=100/mtry=17/_SUCCESS")
    assert files.delete(path, False)
    ran = []
    add = store.add
    monkeypatch.setattr(ResultStore, "add", lambda self, task, rows: (ran.append(task), add(task, rows)))
    after = modelling.tune_grid(train, folds, GRID, store=ResultStore(spark, store.root))
    assert ran == [Task(1, 1, 100, 17)]
    assert {tuple(r) for r in after.collect()} == before


def test_published_versions(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "store"))
    with pytest.raises(ValueError, match="no metrics"):
        store.published()
    rows = lambda *of: spark.createDataFrame([(n, 1.0) for n in of], "trees int, estimate double")
    assert (store.publish(rows(1)), store.publish(rows(1, 2))) == (1, 2)
    assert store.published().count() == 2 and store.published(1).count() == 1 and store.versions() == [1, 2]


SCHEMA = "batter_id long, player_name string, game_year int, pitch_group string, a double, b double, c double"
COLUMNS = ["game_year", "a", "b", "c"]


def made(n: int, shift: int):
    pick = lambda i, j: None if (i * 7 + j * 5) % 4 == 0 else float((i * 13 + j * 29) % 17)
    return [(shift + i, f"p{i}", 2000 + i % 3, ("FB", "BB", "OS")[i % 3], pick(i, 0), pick(i, 1), pick(i, 2)) for i in range(n)]


def test_a_stored_stage_fills_the_same_in_another_session(spark, tmp_path):
    train, new = (materialize(spark.createDataFrame(made(*x), SCHEMA), "rows") for x in ((90, 0), (40, 1000)))
    stage = filling.NeighbourFill.fit(train, COLUMNS)
    wanted = {r.batter_id: tuple(r) for r in stage.transform(new).collect()}
    direct = impute_knn(new, COLUMNS, block=(), donors=train)
    assert wanted == {r.batter_id: tuple(r) for r in direct.collect()}
    assert all(None not in r for r in wanted.values())
    PipelineModel([stage]).write().overwrite().save(str(tmp_path / "model"))
    new.write.parquet(str(tmp_path / "new"))
    code = f"""
import sys; sys.path.insert(0, {str(REPO)!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
    .config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {str(tmp_path / "ck")!r}).getOrCreate())
from dugout.sources.shipping import ship; ship(spark)
from pyspark.ml import PipelineModel
model = PipelineModel.load({str(tmp_path / "model")!r})
model.transform(spark.read.parquet({str(tmp_path / "new")!r})).write.parquet({str(tmp_path / "filled")!r})
"""
    run = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=600)
    assert run.returncode == 0, run.stderr[-2000:]
    assert {r.batter_id: tuple(r) for r in spark.read.parquet(str(tmp_path / "filled")).collect()} == wanted
