"""The driver's star schema seen as pitch rows.

One SELECT serves both engines: Spark binds the braces to DataFrames, the check fills in
table names. All measures are exact binary fractions, so sums do not depend on row order.

The pitch name is the one part written per engine: Spark takes it from a constant array,
because a CASE of 21 branches pushes the generated code of the projection past the 8,000
bytes up to which the JVM compiles a method, and everything then runs interpreted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Pitch name by part key modulo 22; the last remainder has none.
PITCH_NAMES = (
    "4-Seam Fastball",
    "Four-Seam",
    "FourSeamFastBall",
    "TwoSeamFastBall",
    "Cutter",
    "Sinker",
    "Changeup",
    "ChangeUp",
    "Split-Finger",
    "Forkball",
    "Screwball",
    "Slider",
    "Curveball",
    "Knuckle Curve",
    "Sweeper",
    "Slurve",
    "Slow Curve",
    "Other",
    "Knuckleball",
    "Eephus",
    "Pitch Out",
)

TABLES = ("lineitem", "orders", "customer", "supplier", "nation")

PITCHES_SQL = """
SELECT o.o_custkey AS batter_id, c.c_name AS player_name,
 CAST(year(l.l_shipdate) AS INT) AS game_year,
 <PITCH_NAME> AS pitch_name,
 CASE WHEN l.l_returnflag = 'A' THEN 'X' WHEN l.l_returnflag = 'R' THEN 'S' WHEN l.l_suppkey % 20 = 0 THEN NULL ELSE 'B' END AS type,
 CASE WHEN l.l_returnflag = 'A' THEN 'hit_into_play' WHEN l.l_returnflag = 'N' THEN CASE WHEN l.l_linenumber = 7 THEN NULL ELSE 'ball' END WHEN l.l_linenumber = 1 THEN 'swinging_strike' WHEN l.l_linenumber = 2 THEN 'swinging_strike_blocked' WHEN l.l_linenumber = 3 THEN 'foul_tip' WHEN l.l_linenumber <= 5 THEN 'foul' ELSE 'called_strike' END AS description,
 CASE WHEN l.l_returnflag = 'A' THEN CASE l.l_linenumber WHEN 1 THEN 'single' WHEN 2 THEN 'double' WHEN 3 THEN 'triple' WHEN 4 THEN 'home_run' ELSE 'field_out' END WHEN l.l_returnflag = 'R' AND l.l_linenumber = 1 THEN 'strikeout' WHEN l.l_returnflag = 'R' AND l.l_linenumber = 2 THEN 'strikeout_double_play' WHEN l.l_returnflag = 'N' AND l.l_linenumber = 1 THEN 'walk' WHEN l.l_returnflag = 'N' AND l.l_linenumber = 2 THEN 'hit_by_pitch' END AS events,
 CASE WHEN l.l_suppkey % 15 IN (0, 10) THEN NULL ELSE CAST(l.l_suppkey % 15 AS INT) END AS zone,
 CASE WHEN l.l_returnflag = 'R' AND l.l_linenumber <= 2 THEN 2 ELSE CAST(l.l_partkey % 3 AS INT) END AS strikes,
 CASE WHEN l.l_returnflag = 'A' AND l.l_linenumber < 7 THEN 60.0E0 + l.l_quantity WHEN l.l_returnflag = 'R' AND l.l_linenumber IN (4, 5) THEN 50.0E0 + l.l_quantity END AS launch_speed,
 CASE WHEN l.l_returnflag = 'A' AND l.l_linenumber < 7 THEN CAST(l.l_partkey % 91 - 30 AS INT) WHEN l.l_returnflag = 'R' AND l.l_linenumber IN (4, 5) THEN CAST(l.l_partkey % 91 - 10 AS INT) END AS launch_angle,
 CASE WHEN l.l_linestatus = 'O' THEN 'Top' WHEN l.l_linenumber < 7 THEN 'Bot' END AS inning_topbot,
 (CAST(round(l.l_discount * 100) AS INT) - 5) / 64.0E0 AS delta_home_win_exp,
 CASE WHEN l.l_returnflag = 'A' THEN CASE l.l_linenumber WHEN 1 THEN 0.875E0 WHEN 2 THEN 1.25E0 WHEN 3 THEN 1.625E0 WHEN 4 THEN 2.0E0 ELSE 0.0E0 END WHEN l.l_linenumber <= 2 THEN CASE WHEN l.l_returnflag = 'N' THEN 0.6875E0 ELSE 0.0E0 END END AS woba_value,
 CASE WHEN l.l_returnflag = 'A' OR l.l_linenumber <= 2 THEN 1 WHEN l.l_linenumber = 3 THEN 0 END AS woba_denom,
 CASE WHEN l.l_returnflag = 'A' AND l.l_linenumber < 7 THEN floor(l.l_extendedprice) / 65536.0E0 END AS estimated_woba_using_speedangle,
 3.0E0 + CAST(round(l.l_tax * 100) AS INT) / 32.0E0 AS sz_top, 1.5E0 + CAST(round(l.l_tax * 100) AS INT) / 64.0E0 AS sz_bot,
 cn.n_name AS home_team, sn.n_name AS away_team,
 l.l_orderkey, l.l_linenumber
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {supplier} s ON l.l_suppkey = s.s_suppkey JOIN {nation} cn ON c.c_nationkey = cn.n_nationkey JOIN {nation} sn ON s.s_nationkey = sn.n_nationkey
"""


#: The same inner joins for Spark, which keeps the written order: orders find their customers before line items,
#: so the largest table is shuffled once, by order, and not once more by customer.
JOINED = "FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {supplier} s ON l.l_suppkey = s.s_suppkey JOIN {nation} cn ON c.c_nationkey = cn.n_nationkey JOIN {nation} sn ON s.s_nationkey = sn.n_nationkey"
JOINED_SMALL_FIRST = "FROM {lineitem} l JOIN ({orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} cn ON c.c_nationkey = cn.n_nationkey) ON l.l_orderkey = o.o_orderkey JOIN {supplier} s ON l.l_suppkey = s.s_suppkey JOIN {nation} sn ON s.s_nationkey = sn.n_nationkey"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pitches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw pitch rows of a data directory; unused columns are pruned down to the scans."""
    listed = ", ".join(f"'{n}'" for n in PITCH_NAMES)
    name = f"element_at(array({listed}, CAST(NULL AS STRING)), CAST(l.l_partkey % 22 AS INT) + 1)"
    tables = {t: table(spark, sf_dir, t) for t in TABLES}
    return spark.sql(PITCHES_SQL.replace("<PITCH_NAME>", name).replace(JOINED, JOINED_SMALL_FIRST), **tables)


def pitches_sql() -> str:
    """The same SELECT over tables registered under their own names."""
    whens = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(PITCH_NAMES))
    text = PITCHES_SQL.replace("<PITCH_NAME>", f"CASE l.l_partkey % 22 {whens} END")
    return text.format(**{name: name for name in TABLES})
