"""Per-pitch indicators. Each is 1, 0 or NULL; NULL means 'not applicable or not known'."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dugout.functions.nullsafe import as_flag, member

# Pitch names by group, pitch outcomes, event codes.
FASTBALLS = ("4-Seam Fastball", "Four-Seam", "FourSeamFastBall", "TwoSeamFastBall", "Cutter", "Sinker")
OFFSPEED = ("Changeup", "ChangeUp", "Split-Finger", "Forkball", "Screwball")
BREAKING = (
    "Slider",
    "Curveball",
    "Knuckle Curve",
    "Sweeper",
    "Slurve",
    "Slow Curve",
    "Other",
    "Knuckleball",
    "Eephus",
)
SWINGS = ("foul", "hit_into_play", "swinging_strike", "swinging_strike_blocked", "foul_tip")
CONTACTS = ("foul", "hit_into_play")
STRIKEOUTS = ("strikeout", "strikeout_double_play")
WALKS = ("walk", "hit_by_pitch")
HITS = {"is_single": "single", "is_double": "double", "is_triple": "triple", "is_home_run": "home_run"}
UNKNOWN_GROUP = "Other"
IN_ZONE = (1, 9)
OUT_OF_ZONE = (11, 14)
SWEET_ANGLES = (8, 32)
HARD_HIT_SPEED = 95


def pitch_group() -> Column:
    """FB, OS or BB by pitch name. The *name* 'Other' is BB, an unlisted one is the group 'Other'.

    A constant map reads the name once; three IN lists would each carry a copy of whatever
    expression the name comes from, down into the pushed filter as well.
    """
    groups = {"FB": FASTBALLS, "OS": OFFSPEED, "BB": BREAKING}
    entries = [F.lit(v) for group, names in groups.items() for name in names for v in (name, group)]
    return F.coalesce(F.element_at(F.create_map(*entries), F.col("pitch_name")), F.lit(UNKNOWN_GROUP))


def _first_level() -> dict[str, Column]:
    """Flags that need raw columns only."""
    events, described = F.col("events"), F.col("description")
    home_gain = F.col("delta_home_win_exp")
    half = F.col("inning_topbot")
    return {
        "is_bip": as_flag(F.col("type") == "X"),
        "is_swing": as_flag(member(described, SWINGS)),
        "is_contact": as_flag(member(described, CONTACTS)),
        **{flag: as_flag(events == event) for flag, event in HITS.items()},
        "is_walk": as_flag(member(events, WALKS)),
        "is_strikeout": as_flag(member(events, STRIKEOUTS)),
        "delta_bat_win_exp": F.when(half == "Top", -home_gain).when(half == "Bot", home_gain),
    }


def _second_level() -> dict[str, Column]:
    """Flags built on the first level."""
    zone, angle = F.col("zone"), F.col("launch_angle")
    in_play, swing = F.col("is_bip") == 1, F.col("is_swing")
    low, high = SWEET_ANGLES
    return {
        "is_whiff": F.when(swing == 1, 1 - F.col("is_contact")),
        "is_zone_swing": F.when(zone.between(*IN_ZONE), swing),
        "is_chase_swing": F.when(zone.between(*OUT_OF_ZONE), swing),
        "is_putaway": F.when(F.col("strikes") == 2, F.col("is_strikeout")),
        # Too steep counts as a miss for any pitch, too flat only for balls in play.
        "is_sweetspot": F.when(angle > high, 0).when(in_play, as_flag(angle >= low)),
        "is_hardhit": F.when(in_play, as_flag(F.col("launch_speed") >= HARD_HIT_SPEED)),
    }


def _third_level() -> dict[str, Column]:
    """SQL's three-valued AND is the barrel rule: one known miss decides, else both must be known."""
    both = (F.col("is_sweetspot") == 1) & (F.col("is_hardhit") == 1)
    return {"is_barrel": F.when(F.col("is_bip") == 1, as_flag(both))}


def with_flags(df: DataFrame) -> DataFrame:
    """Append all indicators. Narrow projections only, so the scan stage stays one codegen span."""
    for level in (_first_level, _second_level, _third_level):
        df = df.withColumns(level())
    return df
