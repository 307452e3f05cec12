"""Hitter summaries at every grain.

Batter-year, batter-year-group and batter-group all come out of the same buffers. Where only
one grain is wanted it is aggregated directly; where several meet, the pitches are scanned
once at the finest grain and the coarser figures are added up from there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dugout.functions import measures as M
from dugout.operators.ingest import batting_team
from dugout.operators.shares import share, share_by_year, share_overall
from dugout.params import BATTER, BATTER_YEAR, CELL


def with_pred_year(df: DataFrame) -> DataFrame:
    return df.withColumn("pred_year", F.col("game_year") + 1)


def with_total_bases(df: DataFrame) -> DataFrame:
    return df.withColumn("total_bases", M.total_bases())


def yearly_summary(pitches: DataFrame) -> DataFrame:
    """Measures per batter and season: one partial and one final aggregate, one exchange."""
    return (
        pitches.groupBy(*BATTER_YEAR).agg(*M.direct()).transform(with_total_bases).transform(with_pred_year)
    )


def pitch_summary(pitches: DataFrame) -> DataFrame:
    """Measures per batter, season and pitch group, with the group's share of the season."""
    cells = pitches.groupBy(*CELL).agg(*M.direct()).transform(with_total_bases)
    return share_by_year(with_pred_year(cells), "total_pitches")


def pitch_summary_overall(pitches: DataFrame) -> DataFrame:
    """All seasons together, rates in percent, exit figures from balls in play only."""
    cells = pitches.groupBy(*BATTER, "pitch_group").agg(*M.direct(overall=True)).transform(with_total_bases)
    return share_overall(cells, "total_pitches")


def pitch_counts(pitches: DataFrame) -> DataFrame:
    return pitches.groupBy(*CELL).agg(F.count(F.lit(1)).alias("num_pitches"))


def player_info(pitches: DataFrame) -> DataFrame:
    return batting_team(pitches).select(*BATTER_YEAR, "batting_team").distinct()


def team_group_counts(pitches: DataFrame) -> DataFrame:
    return pitches.groupBy("pitch_group", "home_team").agg(F.count(F.lit(1)).alias("n"))


def cell_buffers(pitches: DataFrame) -> DataFrame:
    """The single scan: mergeable sums and counts at the finest grain."""
    return pitches.groupBy(*CELL).agg(*M.buffers())


def multi_grain(pitches: DataFrame) -> DataFrame:
    """All three grains stacked, told apart by ``grain``.

    Pitches are scanned and shuffled once, reduced to cell buffers by the partial aggregate. One expand of the cells,
    a fraction of the pitches, serves all grains; nothing is written.
    """
    cells = cell_buffers(pitches)
    grains = [[F.col(c) for c in keys] for keys in (BATTER_YEAR, CELL, (*BATTER, "pitch_group"))]
    sums = [F.sum(c).alias(c) for c in cells.columns if c not in CELL]
    # One bit per key column, set where the grain adds up over it.
    rows = cells.groupingSets(grains, *CELL).agg(*sums, F.grouping_id().alias("over"))
    of_all, plain = M.from_buffers(M.plain, overall=True), M.from_buffers(M.plain)
    measures = [
        (F.when(F.col("over") == 2, of_all[m]).otherwise(plain[m]) if m in (*M.RATES, *M.IN_PLAY_ONLY) else plain[m]).alias(m)
        for m in plain
    ]
    grain = F.when(F.col("over") == 0, "cell").when(F.col("over") == 1, "year").otherwise("overall")
    return rows.select(*CELL, *measures, grain.alias("grain"))


def player_cells(pitches: DataFrame) -> DataFrame:
    """Season figures (_previous) beside pitch group figures (_pitch), plus share and count.

    The same rows as joining the batter-year summary, the cell summary and the counts. Every
    cell belongs to exactly one season, so the season side is a window sum over the at most
    three cells of that season: one scan, one exchange of pitches reduced to cells, one of
    cells, and no join.
    """
    season = Window.partitionBy(*BATTER_YEAR)
    own = M.from_buffers(M.plain)
    whole = M.from_buffers(lambda name: F.sum(name).over(season))
    return cell_buffers(pitches).select(
        *BATTER_YEAR,
        (F.col("game_year") + 1).alias("pred_year"),
        *(col.alias(f"{name}_previous") for name, col in whole.items()),
        "pitch_group",
        *(col.alias(f"{name}_pitch") for name, col in own.items()),
        share("total_pitches", BATTER_YEAR).alias("prop"),
        F.col("total_pitches").alias("num_pitches"),
    )
