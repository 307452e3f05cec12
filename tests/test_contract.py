"""The registered queries against their SQL on the smallest tables."""

from __future__ import annotations

import pytest
from compare import differences, duck

import __spark_entry__ as contract

#: Queries that between them run every view; check_all.py runs the whole list.
CORE = (
    "scan_csv",
    "snapshot_read",
    "clean_names",
    "multi_grain",
    "reassign_pred_year",
    "scale_position",
    "report_long",
    "final_prediction_table",
    "similarity_table",
    "format_number_styles",
    "corr_filter",
    "repeated_stratified_folds",
    "cv_summary",
    "stratified_split",
    "avg_rank",
    "season_report",
    "player_card",
    "recipe_bake",
)
#: Twenty thousand rows against each other are too much for DuckDB; tests/test_knn.py has a plain double loop.
NOT_IN_SQL = {"impute_knn"}


def test_every_query_has_sql_unless_a_model_is_involved():
    from dugout.plans.queries import QUERIES

    assert set(QUERIES) - set(contract.oracle_sql()) == NOT_IN_SQL
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_runs(spark):
    assert contract.entry(spark).limit(5).count() == 5


@pytest.mark.parametrize("name", CORE)
def test_agrees_with_sql(spark, sf_dir, name):
    df = contract.queries()[name](spark, sf_dir)
    assert differences(df, duck(sf_dir), contract.oracle_sql()[name]) == []
