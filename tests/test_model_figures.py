"""What fitted models give, against plain figures."""

from __future__ import annotations

import math

import numpy as np
import pytest

import __spark_entry__ as contract
from dugout.params import CELL, GROUPS
from dugout.plans import queries as Q

FIGURES = (
    "rf_screen_predictions variable_importance_scores gbt_fit_metrics tune_grid_metrics tune_grid_predictions show_best"
    " select_best final_fit predict_batch_shares bind_columns_predictions"
).split()


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return Q.split_rows(spark, sf_dir)


@pytest.fixture
def given(monkeypatch, rows):
    monkeypatch.setattr(Q, "split_rows", lambda *_: rows)


def plain_metrics(pairs):
    truth, guess = np.array(pairs, float).T
    r = np.corrcoef(truth, guess)[0, 1]
    return {"rmse": math.sqrt(((truth - guess) ** 2).mean()), "rsq": r * r, "mae": np.abs(truth - guess).mean()}


def test_all_are_registered():
    assert set(FIGURES) == set(Q.FIGURES) <= set(contract.queries())


def test_metrics_are_those_of_the_predictions(spark, sf_dir, given, rows):
    bound = Q.scored_holdout(rows, Q.SMALL_FIT).select("num_pitches", "prediction").collect()
    pairs = [tuple(r) for r in bound]
    assert len({guess for _, guess in pairs}) > 10
    wanted, spread = plain_metrics(pairs), np.std([truth for truth, _ in pairs], ddof=1)
    found = Q.gbt_fit_metrics(spark, sf_dir).collect()
    assert {r["metric"] for r in found} == set(wanted)
    for r in found:
        assert r["estimate"] == pytest.approx(wanted[r["metric"]], rel=1e-9) and r["spread"] == pytest.approx(spread)


def summary(spark):
    rows = [(n, 17, t, m, mean, 0.1, 2) for n, t, r in ((12, 1, 0.2), (12, 3, 0.7), (100, 1, 0.1), (100, 3, 0.6)) for m, mean in (("rsq", r), ("rmse", 9 - r), ("mae", 5 + r))]
    return spark.createDataFrame(rows, "min_n int, mtry int, trees int, metric string, mean double, std_err double, n long")


def test_the_selected_point_is_fitted(spark, sf_dir, given, rows, monkeypatch):
    monkeypatch.setattr(Q, "tune_grid_metrics", lambda *_: summary(spark))
    assert [tuple(r) for r in Q.select_best(spark, sf_dir).collect()] == [(12, 17, 3)]
    best = Q.show_best(spark, sf_dir).collect()
    order = lambda metric: [(r["min_n"], r["trees"]) for r in best if r["metric"] == metric]
    assert order("rsq") == order("rmse") == [(12, 3), (100, 3), (12, 1), (100, 1)] == order("mae")[::-1]
    fit = Q.final_fit(spark, sf_dir).collect()
    scored = Q.scored_holdout(rows, Q.modelling.Point(12, 17, (3,))).select(*CELL, "num_pitches", "prediction").collect()
    wanted = plain_metrics([(r["num_pitches"], r["prediction"]) for r in scored])
    assert {(r["min_n"], r["mtry"], r["trees"]) for r in fit} == {(12, 17, 3)}
    assert {r["metric"]: r["estimate"] for r in fit} == pytest.approx(wanted, rel=1e-9)
    # What is published comes from the model of that point.
    bound = {tuple(r)[:4]: r["prediction"] for r in Q.bind_columns_predictions(spark, sf_dir).collect()}
    assert bound == pytest.approx({tuple(r)[:4]: r["prediction"] for r in scored})
    published = Q.predict_batch_shares(spark, sf_dir).collect()
    shares = [[r[f"PITCH_TYPE_{g}"] or 0.0 for g in GROUPS] for r in published]
    assert len({tuple(s) for s in shares}) > 10 and all(sum(s) == pytest.approx(1) for s in shares)


def test_tuning_gives_its_figures(spark, sf_dir, given, monkeypatch):
    resamples = [(12, 17, 1, 1, fold, "rmse", x) for fold, x in ((0, 4.0), (1, 7.0))]
    frame = spark.createDataFrame(resamples, "min_n int, mtry int, trees int, repeat int, fold int, metric string, estimate double")
    monkeypatch.setattr(Q.modelling, "tune_grid", lambda *_, **__: frame)
    assert [tuple(r) for r in Q.tune_grid_metrics(spark, sf_dir).collect()] == [(12, 17, 1, "rmse", 5.5, pytest.approx(1.5), 2)]


def test_screening(spark, sf_dir, monkeypatch):
    """Filling is left out; tests/test_knn.py has it."""
    monkeypatch.setattr(Q.filling, "impute_knn", lambda rows, names, **_: rows.fillna(0.0, list(names)))
    forest = Q.modelling.screening_forest
    monkeypatch.setattr(Q.modelling, "screening_forest", lambda **_: forest(trees=10, depth=8))
    model = Q.screened(spark, sf_dir)
    raw = model.stages[-1].featureImportances.toArray()
    scores = {r["variable"]: r["importance"] for r in Q.variable_importance_scores(spark, sf_dir).collect()}
    names = [n.removeprefix("z_") for n in model.stages[-2].getInputCols()]
    assert scores == pytest.approx({n: 100 * x / raw.max() for n, x in zip(names, raw)})
    guesses = [r["prediction"] for r in Q.rf_screen_predictions(spark, sf_dir).collect()]
    assert len(set(guesses)) > 10 and all(g >= 0 for g in guesses)
