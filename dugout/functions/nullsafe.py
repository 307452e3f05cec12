"""Missing-value semantics in one place.

Set membership of a missing value is *false*, an empty mean is missing, an empty sum is 0
and a division by zero is missing. Spark's own defaults differ on three of the four.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def member(col: Column, values: Iterable[str]) -> Column:
    """True / false membership that never turns NULL."""
    return F.coalesce(col.isin(*values), F.lit(False))


def as_flag(cond: Column) -> Column:
    """1 / 0, and NULL where the condition itself is unknown."""
    return cond.cast("int")


def ratio(num: Column, den: Column) -> Column:
    """``num / den`` as DOUBLE, NULL for a zero denominator."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def zero_if_empty(total: Column) -> Column:
    return F.coalesce(total, F.lit(0).cast("bigint"))


def no_nan(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in all floating point columns."""
    fixes = {
        name: F.when(~F.isnan(name), F.col(name))
        for name, kind in df.dtypes
        if kind in ("double", "float")
    }
    return df.withColumns(fixes) if fixes else df


def equal_keys(left: DataFrame, right: DataFrame, keys: Iterable[str]) -> Column:
    """Join condition in which two missing keys are the same key."""
    return _all(left[k].eqNullSafe(right[k]) for k in keys)


def _all(conds: Iterable[Column]) -> Column:
    out = None
    for cond in conds:
        out = cond if out is None else out & cond
    if out is None:
        raise ValueError("no join keys")
    return out
