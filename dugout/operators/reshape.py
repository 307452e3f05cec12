"""Stacking and pivoting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dugout.params import GROUPS


def stack_rows(top: DataFrame, bottom: DataFrame) -> DataFrame:
    """Stack by column name; a column one side lacks is missing there, numbers widen."""
    return top.unionByName(bottom, allowMissingColumns=True)


def pivot_groups(df: DataFrame, ids: Sequence[str], value: str, fill: float | None = None) -> DataFrame:
    """One row per id with a column per pitch group.

    The groups are known, so this is one conditional aggregate with a single exchange; the
    general pivot would first aggregate by id and group and shuffle twice.
    """
    cells = []
    for group in GROUPS:
        cell = F.max(F.when(F.col("pitch_group") == group, F.col(value)))
        cells.append((cell if fill is None else F.coalesce(cell, F.lit(fill))).alias(group))
    return df.groupBy(*ids).agg(*cells)
