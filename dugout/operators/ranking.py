"""Ranks and value domains within a key, whatever the number of rows a key has.

Every step first reduces rows to distinct values or to one row per key; ranks come from values
that are range-partitioned by key and value, so a key that holds a large part of the data is
spread over many tasks instead of being sorted in one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dugout.functions.nullsafe import ratio
from dugout.operators.joins import left_join
from dugout.sources.scratch import materialize


def domains(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Smallest and largest value per key, missing ones ignored."""
    return df.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))


def with_domain(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    return left_join(df, domains(df, value, keys), keys)


def position(value: Column, lo: Column, hi: Column, reverse: Column) -> Column:
    """Place of a value in its domain, 0 to 1; the middle if the domain is a single point."""
    place = F.when(lo == hi, F.lit(0.5)).otherwise(ratio(value - lo, hi - lo))
    place = F.when(value.isNotNull(), place)
    return F.when(reverse, 1 - place).otherwise(place)


def average_rank(
    df: DataFrame, value: str, keys: Sequence[str], into: str = "rank", descending: bool = False
) -> DataFrame:
    """Rank within the key, ties sharing their mean rank, missing values unranked.

    Descending ranks are mirrored: highest rank of the key, minus the rank, plus 1. Distinct values
    with their counts are range-partitioned by key and value and written with the number of their
    partition; a value's rank is the count of its key in earlier partitions plus the running count in
    its own. Partitions are cut by number of values, so neither a large key nor an outlier matters.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    parts = materialize(counts.repartitionByRange(*keys, value).withColumn("part", F.spark_partition_id()), "ranks")
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        parts.groupBy(*keys, "part")
        .agg(F.sum("n").alias("in_part"), F.max_by("n", value).alias("n_last"))
        .withColumns({
            "before": F.coalesce(F.sum("in_part").over(earlier), F.lit(0)),
            "n_all": F.sum("in_part").over(whole),
            "n_top": F.max(F.struct("part", "n_last")).over(whole)["n_last"],
        })
        .drop("in_part", "n_last")
    )
    upto = Window.partitionBy(*keys, "part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    running = left_join(parts.withColumn("upto", F.sum("n").over(upto)), offsets, [*keys, "part"])
    rank = F.col("before") + F.col("upto") - (F.col("n") - 1) / F.lit(2.0)
    highest = F.col("n_all") - (F.col("n_top") - 1) / F.lit(2.0)
    ranked = running.select(*keys, value, (highest - rank + 1 if descending else rank).alias(into))
    return left_join(df, ranked, [*keys, value])
