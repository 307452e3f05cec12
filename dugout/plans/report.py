"""Report tables: published predictions, long and wide history, player cards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dugout.functions import formats
from dugout.operators.ranking import average_rank, position, with_domain
from dugout.operators.reshape import pivot_groups, stack_rows
from dugout.operators.shares import clamp_and_share, partition_total
from dugout.params import BATTER, BATTER_YEAR, CELL, Seasons

OUTPUT_NAMES = {
    "batter_id": "BATTER_ID",
    "player_name": "PLAYER_NAME",
    "game_year": "GAME_YEAR",
    "FB": "PITCH_TYPE_FB",
    "BB": "PITCH_TYPE_BB",
    "OS": "PITCH_TYPE_OS",
}

# Metrics of the player card, in display order, and how each is scaled.
CARD_METRICS = (
    "prop",
    "swing_prop",
    "chase_prop",
    "zone_swing_prop",
    "whiff_prop",
    "putaway_prop",
    "sweetspot_prop",
    "hardhit_prop",
    "barrel_prop",
    "woba",
    "xwoba",
    "exit_velo",
    "exit_angle",
    "win_prob_added",
)
REVERSED_METRICS = ("chase_prop", "whiff_prop", "putaway_prop", "exit_velo", "exit_angle")
RANKED_METRICS = ("exit_velo", "exit_angle")


def predicted_shares(predicted: DataFrame, seasons: Seasons, prediction: str = "prediction") -> DataFrame:
    """Model output as counts and shares of the target season.

    The share runs over all rows of a batter, not over one season: a carried-over hitter's
    rows come from an older season and still make one mix.
    """
    shared = clamp_and_share(predicted, prediction, "prop")
    return shared.select(
        *BATTER,
        F.lit(seasons.target_year).alias("game_year"),
        "pitch_group",
        F.col(prediction).alias("num_pitches"),
        "prop",
    )


def final_predictions(predicted: DataFrame, seasons: Seasons, prediction: str = "prediction") -> DataFrame:
    """The published table: one row per hitter, a share per group. Sorted by the sink, by id."""
    shares = predicted_shares(predicted, seasons, prediction)
    wide = pivot_groups(shares, BATTER_YEAR, "prop")
    return wide.withColumnsRenamed(OUTPUT_NAMES).select(*OUTPUT_NAMES.values())


def tag_type(df: DataFrame, seasons: Seasons) -> DataFrame:
    known = F.col("game_year") != seasons.target_year
    return df.withColumn("type", F.when(known, "True").when(~known, "Pred"))


def actual_counts(cells: DataFrame) -> DataFrame:
    """Counts and season shares of played seasons; the cell table already has them."""
    return cells.select(*CELL, "num_pitches", "prop")


def report_long(actual: DataFrame, predicted: DataFrame, seasons: Seasons, prediction: str = "prediction"):
    """Actual and predicted counts and shares below each other."""
    return tag_type(stack_rows(actual, predicted_shares(predicted, seasons, prediction)), seasons)


def report_wide(actual: DataFrame, predicted: DataFrame, seasons: Seasons, prediction: str = "prediction"):
    """One row per hitter and season with the season total; a group not seen counts 0."""
    by_season = partition_total(actual, "num_pitches", BATTER_YEAR, "num_pitches")
    expected = partition_total(
        predicted_shares(predicted, seasons, prediction), "num_pitches", BATTER, "num_pitches"
    )
    return pivot_groups(stack_rows(by_season, expected), [*BATTER_YEAR, "num_pitches"], "prop", fill=0.0)


def season_report(wide: DataFrame) -> DataFrame:
    """One line per season of the chosen hitters: pitches as a whole number, shares as whole percent."""
    return wide.select(
        "game_year",
        formats.whole_number(F.col("num_pitches")).alias("num_pitches"),
        *(formats.whole_percent(F.col(g)).alias(g) for g in ("OS", "BB", "FB")),
    )


def player_card(overall: DataFrame, colours: DataFrame) -> DataFrame:
    """The chosen hitters' pitch groups, group and percent first, sorted by pitches seen.

    The filter on players comes before the summary, so only their pitches are read.
    """
    left_out = [*BATTER, "sz_top", "sz_bot", "singles", "doubles", "triples", "homeruns", "ks", "walks"]
    joined = overall.join(F.broadcast(colours), "pitch_group", "left").withColumn("prop", 100 * F.col("prop"))
    rest = [c for c in joined.columns if c not in ("pitch_group", "prop", *left_out)]
    return joined.orderBy(F.col("total_pitches").desc(), "pitch_group", *BATTER).select("pitch_group", "prop", *rest)


def card_metrics(overall: DataFrame) -> DataFrame:
    """Long form (batter, group, metric, value) of the player card."""
    values = overall.withColumn("prop", 100 * F.col("prop"))
    return values.unpivot([*BATTER, "pitch_group"], list(CARD_METRICS), "metric", "value")


def card_positions(overall: DataFrame) -> DataFrame:
    """Where each value of a player's card lies between that player's lowest and highest.

    Exit figures are placed by rank instead of by value.
    """
    keys = ["player_name", "metric"]
    long = card_metrics(overall)
    is_ranked = F.col("metric").isin(*RANKED_METRICS)
    by_value = long.where(~is_ranked).withColumn("placed", F.col("value"))
    by_rank = average_rank(long.where(is_ranked), "value", keys, into="placed", descending=True)
    placed = with_domain(by_value.unionByName(by_rank), "placed", keys)
    reverse = F.col("metric").isin(*REVERSED_METRICS)
    return placed.select(
        *BATTER,
        "pitch_group",
        "metric",
        "value",
        position(F.col("placed"), F.col("lo"), F.col("hi"), reverse).alias("position"),
    )
