"""The measure vector, split into mergeable buffers (sums and counts) and a finishing step.

Keeping the buffers apart lets one scan serve every grain: a coarser grain adds up the
buffers of a finer one, and a mean is only formed at the very end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from dugout.functions.nullsafe import ratio, zero_if_empty

#: measure -> (averaged column, whether only balls counted in wOBA qualify)
MEANS = {
    "swing_prop": "is_swing",
    "chase_prop": "is_chase_swing",
    "zone_swing_prop": "is_zone_swing",
    "whiff_prop": "is_whiff",
    "putaway_prop": "is_putaway",
    "woba": "woba_value",
    "xwoba": "estimated_woba_using_speedangle",
    "exit_velo": "launch_speed",
    "exit_angle": "launch_angle",
    "sweetspot_prop": "is_sweetspot",
    "hardhit_prop": "is_hardhit",
    "barrel_prop": "is_barrel",
    "sz_top": "sz_top",
    "sz_bot": "sz_bot",
}
SUMS = {
    "win_prob_added": "delta_bat_win_exp",
    "ks": "is_strikeout",
    "walks": "is_walk",
    "singles": "is_single",
    "doubles": "is_double",
    "triples": "is_triple",
    "homeruns": "is_home_run",
}
MEASURES = ("total_pitches", *MEANS, *SUMS, "total_bases")

WOBA_ONLY = ("woba", "xwoba")
IN_PLAY_ONLY = ("exit_velo", "exit_angle")
RATES = tuple(m for m in MEANS if m.endswith("_prop"))

#: How a buffer of this grain is read: a plain column, a sum, or a sum over a window.
Total = Callable[[str], Column]


def averaged(measure: str, in_play: bool = False) -> Column:
    """The values a mean measure is taken over; rows that do not qualify are NULL."""
    value = F.col(MEANS[measure])
    if measure in WOBA_ONLY:
        return F.when(F.col("woba_denom") == 1, value)
    if in_play and measure in IN_PLAY_ONLY:
        return F.when(F.col("is_bip") == 1, value)
    return value


def _buffer(measure: str, part: str, in_play: bool = False) -> str:
    tag = "_bip" if in_play and measure in IN_PLAY_ONLY else ""
    return f"{measure}{tag}__{part}"


def buffers() -> list[Column]:
    """Aggregates that collect everything any grain needs, in one pass."""
    out = [F.count(F.lit(1)).alias("total_pitches")]
    for measure in MEANS:
        for in_play in (False, True) if measure in IN_PLAY_ONLY else (False,):
            x = averaged(measure, in_play)
            out.append(F.sum(x).alias(_buffer(measure, "sum", in_play)))
            out.append(F.count(x).alias(_buffer(measure, "n", in_play)))
    out += [F.sum(F.col(src)).alias(_buffer(m, "sum")) for m, src in SUMS.items()]
    return out


def plain(name: str) -> Column:
    return F.col(name)


def summed(name: str) -> Column:
    return F.sum(name)


def from_buffers(total: Total, overall: bool = False) -> dict[str, Column]:
    """The 23 measures at whatever grain ``total`` reads the buffers."""
    out = {"total_pitches": total("total_pitches")}
    for measure in MEANS:
        mean = ratio(total(_buffer(measure, "sum", overall)), total(_buffer(measure, "n", overall)))
        out[measure] = 100 * mean if overall and measure in RATES else mean
    for measure in SUMS:
        out[measure] = _empty_as_zero(measure, total(_buffer(measure, "sum")))
    out["total_bases"] = total_bases(out)
    return out


def direct(overall: bool = False) -> list[Column]:
    """The measures straight from pitch rows, for a single grain (all but total_bases)."""
    out = [F.count(F.lit(1)).alias("total_pitches")]
    for measure in MEANS:
        mean = F.avg(averaged(measure, overall))
        out.append((100 * mean if overall and measure in RATES else mean).alias(measure))
    out += [_empty_as_zero(m, F.sum(src)).alias(m) for m, src in SUMS.items()]
    return out


def _empty_as_zero(measure: str, total: Column) -> Column:
    if measure == "win_prob_added":
        return F.coalesce(total, F.lit(0.0))
    return zero_if_empty(total)


def total_bases(have: dict[str, Column] | None = None) -> Column:
    """Bases gained; a walk counts like a single."""
    of = (have or {}).get
    worth = {"singles": 1, "walks": 1, "doubles": 2, "triples": 3, "homeruns": 4}
    out = F.lit(0).cast("bigint")
    for measure, bases in worth.items():
        out = out + bases * (of(measure) if have else F.col(measure))
    return out
