"""Shares and totals within a batter or batter-year.

Inputs are already aggregated to one row per pitch group, so a window partition holds at
most a handful of rows however many pitches one batter has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dugout.functions.nullsafe import ratio
from dugout.params import BATTER, BATTER_YEAR


def share(value: str | Column, keys: Sequence[str]) -> Column:
    x = F.col(value) if isinstance(value, str) else value
    return ratio(x, F.sum(x).over(Window.partitionBy(*keys)))


def share_by_year(df: DataFrame, value: str, into: str = "prop") -> DataFrame:
    return df.withColumn(into, share(value, BATTER_YEAR))


def share_overall(df: DataFrame, value: str, into: str = "prop") -> DataFrame:
    return df.withColumn(into, share(value, BATTER))


def not_negative(x: Column) -> Column:
    """Negative becomes 0 and missing stays missing (``greatest`` would make it 0)."""
    return F.when(x < 0, F.lit(0.0)).otherwise(x)


def clamp_and_share(df: DataFrame, prediction: str, into: str, keys: Sequence[str] = BATTER) -> DataFrame:
    """Clamp predicted counts at 0, then divide by the batter's total over all rows given."""
    return df.withColumn(prediction, not_negative(F.col(prediction))).withColumn(into, share(prediction, keys))


def partition_total(df: DataFrame, value: str, keys: Sequence[str], into: str) -> DataFrame:
    return df.withColumn(into, F.sum(value).over(Window.partitionBy(*keys)))
