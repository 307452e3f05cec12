"""Deterministic stratified splits.

The order within a stratum is that of a seeded hash of the row key, so a split depends on
the keys alone, not on partitioning or task order. Strata are few and large; the exact row
number is therefore built from hash buckets, each of which is a small window, plus the
number of rows in all earlier buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dugout.operators.joins import left_join
from dugout.params import CELL, FOLDS, REPEATS, SEED, TRAIN_SHARE
from dugout.sources.scratch import materialize

#: Leading hex digits of the hash that form a bucket: 4,096 buckets per stratum.
BUCKET_DIGITS = 3


def row_hash(seed: int | Column, keys: Sequence[str]) -> Column:
    lead = F.lit(seed) if isinstance(seed, int) else seed
    return F.md5(F.concat_ws("|", lead.cast("string"), *(F.col(k).cast("string") for k in keys)).cast("binary"))


def numbered(
    df: DataFrame, strata: Sequence[str], keys: Sequence[str], seed: int | Column
) -> DataFrame:
    """Append the row number in the stratum (``row_no``, from 1) and its size (``n_rows``)."""
    bucketed = df.withColumn("h", row_hash(seed, keys)).withColumn("bucket", F.substring("h", 1, BUCKET_DIGITS))
    # Sixteen bytes sort as their 32 digits do, and are half as many to shuffle.
    bucketed = bucketed.withColumn("h", F.unhex("h"))
    earlier = Window.partitionBy(*strata).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        bucketed.groupBy(*strata, "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .withColumn("n_rows", F.sum("n").over(Window.partitionBy(*strata)))
        .drop("n")
    )
    own = Window.partitionBy(*strata, "bucket").orderBy("h", *keys)
    rows = bucketed.withColumn("in_bucket", F.row_number().over(own))
    return (
        left_join(rows, sizes, [*strata, "bucket"])
        .withColumn("row_no", F.col("before") + F.col("in_bucket"))
        .drop("h", "bucket", "before", "in_bucket")
    )


def stratified_split(
    df: DataFrame,
    strata: Sequence[str] = ("pitch_group",),
    keys: Sequence[str] = CELL,
    seed: int = SEED,
    train_share: float = TRAIN_SHARE,
) -> DataFrame:
    """Append ``is_train``: exactly floor(share * n) rows of each stratum.

    The first rows of a stratum, by hash and key, are its training rows. Bucket counts tell in which
    bucket a stratum's cut lies; only the rows of that bucket are numbered, to find the last training
    row. That is one row per stratum, and every row decides for itself by comparing, so no row moves.
    """
    hashed = df.withColumn("h", row_hash(seed, keys)).withColumn("bucket", F.substring("h", 1, BUCKET_DIGITS))
    cut = materialize(_last_rows(hashed, strata, keys, train_share), "cuts")
    place = F.struct("h", *keys)
    return (
        left_join(hashed, cut, strata)
        .withColumn("is_train", F.coalesce(place <= F.col("last"), F.lit(False)))
        .drop("h", "bucket", "last")
    )


def _last_rows(hashed: DataFrame, strata: Sequence[str], keys: Sequence[str], share: float) -> DataFrame:
    """(strata, last): hash and key of the last training row of each stratum that has one."""
    earlier = Window.partitionBy(*strata).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    limit = F.floor(F.sum("n").over(Window.partitionBy(*strata)) * F.lit(share))
    border = (
        hashed.groupBy(*strata, "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumns({"before": F.coalesce(F.sum("n").over(earlier), F.lit(0)), "limit": limit})
        .where((F.col("before") < F.col("limit")) & (F.col("limit") <= F.col("before") + F.col("n")))
        .select(*strata, "bucket", (F.col("limit") - F.col("before")).alias("wanted"))
    )
    border = materialize(border, "border")
    own = Window.partitionBy(*strata).orderBy("h", *keys)
    columns = list(dict.fromkeys([*strata, "bucket", "h", *keys]))
    a, b = hashed.select(*columns).alias("a"), border.alias("b")
    met = F.col("a.bucket") == F.col("b.bucket")
    for s in strata:
        met = met & F.col(f"a.{s}").eqNullSafe(F.col(f"b.{s}"))
    inside = a.join(b, met).select("a.*", "b.wanted")
    return (
        inside.withColumn("place", F.row_number().over(own))
        .where(F.col("place") == F.col("wanted"))
        .select(*strata, F.struct("h", *keys).alias("last"))
    )


def stratified_folds(
    df: DataFrame,
    strata: Sequence[str] = ("pitch_group",),
    keys: Sequence[str] = CELL,
    seed: int = SEED,
    folds: int = FOLDS,
    repeats: int = REPEATS,
) -> DataFrame:
    """Long table (keys, strata, repeat, fold): every row once per repeat, fold 0 .. folds - 1.

    Only the keys are multiplied by the number of repeats, and all repeats share one shuffle.
    """
    columns = list(dict.fromkeys([*keys, *strata]))
    repeated = df.select(*columns).withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    return (
        numbered(repeated, [*strata, "repeat"], keys, F.lit(seed) + F.col("repeat"))
        .withColumn("fold", ((F.col("row_no") - 1) % folds).cast("int"))
        .drop("row_no", "n_rows")
    )
