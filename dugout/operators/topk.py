"""First rows of an order, and nearest hitters by pitch shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dugout.params import GROUPS


def head(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """First n rows of a total order: each task keeps n, only those are merged."""
    return df.orderBy(*order).limit(n)


def share_distances(wide: DataFrame, batter_id: int, season: int, min_pitches: float) -> DataFrame:
    """Euclidean distance of every eligible hitter's shares to the target's, self excluded.

    The target side is a global aggregate, hence exactly one row; it is broadcast and met on
    the season, so candidates are scanned once and never shuffled.
    """
    in_season = wide.where(F.col("game_year") == season)
    target = (
        in_season.where(F.col("batter_id") == batter_id)
        .agg(*(F.max(g).alias(f"{g}_target") for g in GROUPS))
        .withColumn("game_year", F.lit(season))
    )
    gaps = sum((F.pow(F.col(g) - F.col(f"{g}_target"), F.lit(2.0)) for g in ("BB", "FB")), _square("OS"))
    return (
        in_season.where((F.col("num_pitches") >= min_pitches) & (F.col("batter_id") != batter_id))
        .join(F.broadcast(target), "game_year")
        .withColumn("distance", F.sqrt(gaps))
        .drop(*(f"{g}_target" for g in GROUPS))
    )


def _square(group: str) -> Column:
    return F.pow(F.col(group) - F.col(f"{group}_target"), F.lit(2.0))


def _first(distances: DataFrame, k: int, nearest: bool) -> DataFrame:
    """Exactly k hitters, ties settled by id. Each task forwards at most k rows."""
    d = F.col("distance")
    order = Window.partitionBy("game_year").orderBy(d.asc() if nearest else d.desc(), F.col("batter_id"), "player_name")
    known = distances.where(d.isNotNull())
    return known.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def with_ties(distances: DataFrame, k: int, nearest: bool = True) -> DataFrame:
    """The k nearest (or farthest) hitters and all that tie with the last of them.

    The cut-off distance is found from k rows; everyone at or inside it is then a plain
    filter, so even a large tie is never gathered in one task.
    """
    edge = F.max("distance") if nearest else F.min("distance")
    cut = _first(distances, k, nearest).groupBy("game_year").agg(edge.alias("cut"))
    inside = F.col("distance") <= F.col("cut") if nearest else F.col("distance") >= F.col("cut")
    return distances.join(F.broadcast(cut), "game_year").where(inside).drop("cut")


def similarity_table(distances: DataFrame, k: int = 3) -> DataFrame:
    """Two report rows: the k most and the k least similar hitters, one column per place."""
    rows = []
    for label, nearest in (("Most Similar", True), ("Least Similar", False)):
        names = [
            F.max(F.when(F.col("place") == i, F.col("player_name"))).alias(f"player_{i}") for i in range(1, k + 1)
        ]
        rows.append(_first(distances, k, nearest).agg(*names).select(F.lit(label).alias("value"), "*"))
    return rows[0].unionByName(rows[1])
