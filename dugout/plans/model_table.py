"""The table the model is trained on, and the rows it is applied to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dugout.operators.joins import mark_members, names_missing_from
from dugout.params import BATTER, Seasons
from dugout.plans.summaries import player_cells
from dugout.sources.scratch import materialize


def prediction_template(pitches: DataFrame, seasons: Seasons) -> DataFrame:
    """Key list of hitters to predict: those of the last season."""
    last = pitches.where(F.col("game_year") == seasons.last_year)
    return (
        last.select(*BATTER)
        .distinct()
        .withColumns({"pred_year": F.lit(seasons.target_year), "game_year": F.lit(seasons.last_year)})
    )


def join_template(cells: DataFrame, template: DataFrame) -> DataFrame:
    """Left join to a unique key list: adds neither rows nor columns.

    With plain equality and a distinct right side the optimizer drops the join altogether,
    and missing keys make no difference to a join that contributes nothing.
    """
    keys = [c for c in cells.columns if c in template.columns]
    return cells.join(template.select(*keys).distinct(), keys, "left").select(*cells.columns)


def absent_hitters(cells: DataFrame, seasons: Seasons) -> DataFrame:
    """Names seen in other seasons but not in the last one."""
    last = cells.where(F.col("game_year") == seasons.last_year)
    others = cells.where(F.col("game_year") != seasons.last_year)
    return names_missing_from(others, last, "player_name")


def carry_over(cells: DataFrame, seasons: Seasons) -> DataFrame:
    """Hitters absent from the last season are predicted from the season before it.

    Only cells of that season can move, so only they meet the names; the others stay where they are.
    """
    before = F.coalesce(F.col("game_year") == seasons.prev_year, F.lit(False))
    marked = mark_members(cells.where(before), absent_hitters(cells, seasons), "player_name", "is_absent")
    target = F.when(F.col("is_absent"), F.lit(seasons.target_year)).otherwise(F.col("pred_year"))
    moved = marked.withColumn("pred_year", target).drop("is_absent")
    return moved.unionByName(cells.where(~before))


def stored_cells(pitches: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The cell table on storage. Everything after it reads the table, so pitches are scanned once.

    Only the named columns are computed and written; pruning cannot reach through a written table.
    """
    cells = player_cells(pitches)
    return materialize(cells.select(*columns) if columns else cells, "cells")


def train_test_rows(table: DataFrame, seasons: Seasons) -> DataFrame:
    return table.where(F.col("pred_year") != seasons.target_year)


def predict_rows(table: DataFrame, seasons: Seasons) -> DataFrame:
    return table.where(F.col("pred_year") == seasons.target_year)
