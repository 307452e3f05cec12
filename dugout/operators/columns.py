"""Selecting, ordering and filtering by column or parameter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def first_columns(df: DataFrame, first: Sequence[str]) -> DataFrame:
    """Named columns first, the others behind in their old order."""
    return df.select(*first, *(c for c in df.columns if c not in first))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def for_players(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows of the chosen players. Namesakes are not told apart."""
    return df.where(F.col("player_name").isin(*names))


def sorted_choices(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def sort_missing_last(df: DataFrame, *keys: str, descending: bool = False) -> DataFrame:
    """Global sort with missing values last in either direction.

    Give enough keys to make the order total: range partitioning can then also cut through
    the rows of one frequent leading value.
    """
    lead, *rest = keys
    first = F.col(lead).desc_nulls_last() if descending else F.col(lead).asc_nulls_last()
    return df.orderBy(first, *(F.col(k).asc_nulls_last() for k in rest))
