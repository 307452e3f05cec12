"""The nearest and the farthest hitters of every hitter, by descent through a pyramid of grids.

Hitters with the same shares are one point, and a point is searched once for all of them. Points lie in cells of grids
whose cells halve from level to level. A search holds the cells that may still have one of its k points: those whose
least distance is not above the k-th greatest distance seen so far. It starts at a grid of at most 64 cells and goes
from cells to their parts until cells hold few points. So no pair of hitters is formed that is not a candidate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dugout.params import GROUPS
from dugout.sources.scratch import materialize

#: Level the search begins with (2^level cells a side), levels at most, and points of a cell that need no more levels.
FIRST, LAST, CELL_POINTS = 3, 20, 32
#: Grids up to this level are broadcast: at most 4^level cells.
BROADCAST_LEVEL = 7
#: Bounds are widened by this much, so that rounding never loses a tie.
SLACK = 1e-9


def square_distance(a: str, b: str) -> Column:
    """Squared Euclidean distance of two share points given by column prefixes."""
    gaps = [F.col(f"{a}{g}") - F.col(f"{b}{g}") for g in GROUPS]
    return gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2]


def share_points(hitters: DataFrame, keep: int) -> DataFrame:
    """(point, FB, BB, OS, n, first): distinct shares, their hitters' number and the ``keep`` with the smallest ids."""
    order = Window.partitionBy(*GROUPS).orderBy("batter_id", "player_name")
    few = hitters.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep)
    sizes = hitters.groupBy(*GROUPS).agg(F.count(F.lit(1)).alias("n"))
    first = few.groupBy(*GROUPS).agg(F.sort_array(F.collect_list(F.struct("batter_id", "player_name"))).alias("first"))
    return first.join(sizes, list(GROUPS)).withColumn("point", F.xxhash64(*GROUPS))


def cell_of(share: str, level: int) -> Column:
    side = 1 << level
    return F.least(F.greatest(F.floor(F.col(share) * side), F.lit(0)), F.lit(side - 1)).cast("int")


def grid(points: DataFrame, level: int) -> DataFrame:
    """(cx, cy, lo_*, hi_*, cell_n): the cells of a level that hold points, with the box around these."""
    box = [fn(g).alias(f"{tag}_{g}") for g in GROUPS for fn, tag in ((F.min, "lo"), (F.max, "hi"))]
    return (
        points.withColumns({"cx": cell_of("FB", level), "cy": cell_of("BB", level)})
        .groupBy("cx", "cy")
        .agg(*box, F.sum("n").alias("cell_n"), F.count(F.lit(1)).alias("cell_points"))
    )


def _bounds() -> tuple[Column, Column]:
    """Least and greatest squared distance from a target to any point of a cell's box."""
    least, most = F.lit(0.0), F.lit(0.0)
    for g in GROUPS:
        below, above = F.col(f"lo_{g}") - F.col(f"t_{g}"), F.col(f"t_{g}") - F.col(f"hi_{g}")
        gap = F.greatest(below, above, F.lit(0.0))
        reach = F.greatest(F.abs(below), F.abs(above))
        least, most = least + gap * gap, most + reach * reach
    return least, most


def _open_cells(cells: DataFrame, wanted: int, nearest: bool) -> DataFrame:
    """Cells that may hold one of the ``wanted`` nearest (farthest) hitters of their target."""
    least, most = _bounds()
    sure, hope = (most, least) if nearest else (-least, -most)
    ranked = cells.withColumns({"sure": sure, "hope": hope})
    order = Window.partitionBy("target").orderBy("sure", "cx", "cy")
    every = Window.partitionBy("target")
    counted = ranked.withColumn("within", F.sum("cell_n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    edge = F.min(F.when(F.col("within") >= wanted, F.col("sure"))).over(every)
    kept = counted.withColumn("edge", edge).where(F.col("edge").isNull() | (F.col("hope") <= F.col("edge") + SLACK))
    return kept.select("target", *(f"t_{g}" for g in GROUPS), "cx", "cy")


def search(targets: DataFrame, points: DataFrame, wanted: int, nearest: bool, cell_points: int = CELL_POINTS) -> DataFrame:
    """(target, found): the ``wanted`` first candidates of each target point, best first, ties by id.

    ``found`` is an array of structs (far, batter_id, player_name), ``far`` the squared distance, negative if the farthest are
    wanted. Both inputs are stored tables of distinct points.
    """
    named = targets.select(F.col("point").alias("target"), *(F.col(g).alias(f"t_{g}") for g in GROUPS))
    level = FIRST
    cells = grid(points, level)
    # The coarsest grid has 64 cells at most, so this is no join of all points.
    frontier = _open_cells(named.join(F.broadcast(cells), how="cross"), wanted, nearest)
    while level < LAST:
        widest = cells.agg(F.max("cell_points")).first()[0]
        if widest is None or widest <= cell_points:
            break
        level += 1
        cells = materialize(grid(points, level), f"grid-{level}")
        parts = cells.withColumns({"px": F.shiftright("cx", 1), "py": F.shiftright("cy", 1)})
        below = frontier.withColumnsRenamed({"cx": "px", "cy": "py"})
        side = F.broadcast(parts) if level <= BROADCAST_LEVEL else parts
        frontier = materialize(_open_cells(below.join(side, ["px", "py"]), wanted, nearest), "frontier")
    inside = points.withColumns({"cx": cell_of("FB", level), "cy": cell_of("BB", level)})
    met = frontier.join(inside.select("cx", "cy", *GROUPS, "first"), ["cx", "cy"])
    far = square_distance("t_", "")
    candidates = met.select("target", (far if nearest else -far).alias("far"), F.explode("first").alias("who"))
    order = Window.partitionBy("target").orderBy("far", "who")
    best = candidates.withColumn("place", F.row_number().over(order)).where(F.col("place") <= wanted)
    return best.groupBy("target").agg(
        F.sort_array(F.collect_list(F.struct("far", "who.batter_id", "who.player_name"))).alias("found")
    )


def similarity_of_all(wide: DataFrame, season: int, min_pitches: float, k: int = 3, cell_points: int = CELL_POINTS) -> DataFrame:
    """Two rows per hitter of a season: the k most and the k least similar others, one column per place.

    Others need ``min_pitches``; equal distances are settled by id, then name. The same rows as ``similarity_table`` for every
    hitter at once. A hitter with an unknown share has no similar ones; where fewer than k others exist, the last
    places are empty. Rows are hitters; equal (id, name) rows of one season are one hitter.
    """
    rows = wide.where(F.col("game_year") == season).select("batter_id", "player_name", "num_pitches", *GROUPS)
    known = rows.where(" AND ".join(f"{g} IS NOT NULL" for g in GROUPS))
    eligible = known.where(F.col("num_pitches") >= min_pitches)
    # One more than wanted, because a hitter is among the nearest of its own point.
    points = materialize(share_points(eligible, k + 1), "points")
    targets = materialize(known.select(*GROUPS).distinct().withColumn("point", F.xxhash64(*GROUPS)), "targets")
    who = rows.withColumn("target", F.when(F.expr(" AND ".join(f"{g} IS NOT NULL" for g in GROUPS)), F.xxhash64(*GROUPS)))
    out = None
    for label, nearest in (("Most Similar", True), ("Least Similar", False)):
        found = search(targets, points, k + 1, nearest, cell_points)
        is_self = lambda x: (x["batter_id"] == F.col("batter_id")) & x["player_name"].eqNullSafe(F.col("player_name"))
        others = F.filter(F.coalesce("found", F.array().cast(found.schema["found"].dataType)), lambda x: ~is_self(x))
        part = who.join(found, "target", "left").withColumn("others", others).select(
            "batter_id",
            "player_name",
            F.lit(label).alias("value"),
            *(F.get(F.col("others"), F.lit(i))["player_name"].alias(f"player_{i + 1}") for i in range(k)),
        )
        out = part if out is None else out.unionByName(part)
    return out
