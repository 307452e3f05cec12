"""Equi-joins in which missing keys match each other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dugout.functions.nullsafe import equal_keys


def left_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join that keeps one copy of each key column."""
    a, b = left.alias("a"), right.alias("b")
    kept = [F.col(f"a.{c}") for c in left.columns] + [F.col(f"b.{c}") for c in right.columns if c not in keys]
    cond = None
    for k in keys:
        same = F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        cond = same if cond is None else cond & same
    return a.join(b, cond, "left").select(*kept)


def left_join_suffixed(
    left: DataFrame, right: DataFrame, keys: Sequence[str], suffixes: tuple[str, str]
) -> DataFrame:
    """Left join in which clashing columns outside the keys get a suffix per side."""
    clash = [c for c in left.columns if c in right.columns and c not in keys]
    return left_join(
        left.withColumnsRenamed({c: c + suffixes[0] for c in clash}),
        right.withColumnsRenamed({c: c + suffixes[1] for c in clash}),
        keys,
    )


def left_join_natural(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on all column names the two sides share."""
    return left_join(left, right, [c for c in left.columns if c in right.columns])


def names_missing_from(df: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``df`` that ``others`` does not have.

    Both sides are reduced to distinct keys before they meet, so a frequent key costs one
    row per task in the shuffle.
    """
    have, seen = df.select(key).distinct(), others.select(key).distinct()
    return have.join(seen, equal_keys(have, seen, [key]), "left_anti")


def mark_members(df: DataFrame, members: DataFrame, key: str, into: str) -> DataFrame:
    """Append true / false: is the key among ``members`` (distinct keys)?

    The member list grows with the data, so no broadcast is forced; adaptive execution
    broadcasts it when its measured size allows and splits a skewed key otherwise.
    """
    marked = members.select(F.col(key), F.lit(True).alias(into))
    return left_join(df, marked, [key]).withColumn(into, F.coalesce(F.col(into), F.lit(False)))
