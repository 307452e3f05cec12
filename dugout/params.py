"""Values that used to be spread over the jobs as literals, kept together."""

from __future__ import annotations

from dataclasses import dataclass

SEED = 6432
GROUPS = ("FB", "BB", "OS")
TRAIN_SHARE = 0.8
FOLDS = 5
REPEATS = 5
CORR_CUTOFF = 0.9
NEIGHBOURS = 5

BATTER = ("batter_id", "player_name")
BATTER_YEAR = (*BATTER, "game_year")
CELL = (*BATTER_YEAR, "pitch_group")


@dataclass(frozen=True)
class Seasons:
    """The three years one run works on.

    One object is passed to the carry-over, the split and the reports, so they cannot
    disagree about which season is being predicted.
    """

    prev_year: int = 2022
    last_year: int = 2023
    target_year: int = 2024


#: The years the driver's line items map to.
FIXTURE_SEASONS = Seasons(prev_year=2000, last_year=2001, target_year=2002)
