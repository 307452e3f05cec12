"""Missing values, ties and other corners the driver tables do not contain."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dugout.functions import formats, nullsafe
from dugout.functions.flags import with_flags
from dugout.operators import columns, ingest, joins, ranking, reshape, shares, topk
from dugout.params import Seasons
from dugout.plans import model_table, report, summaries
from dugout.sources import files
from dugout.sources.schema import PITCH_SCHEMA

BLANK = {name: None for name in PITCH_SCHEMA.names}


def pitch(**known):
    return tuple({**BLANK, "batter_id": 1, "player_name": "p", "game_year": 2000, **known}.values())


def flags_of(spark, **known):
    return with_flags(spark.createDataFrame([pitch(**known)], PITCH_SCHEMA)).first().asDict()


@pytest.mark.parametrize(
    "known, flag, want",
    [
        ({"strikes": 2}, "is_putaway", 0),
        ({"strikes": 2, "events": "strikeout"}, "is_putaway", 1),
        ({"strikes": 1, "events": "strikeout"}, "is_putaway", None),
        ({"type": "S", "launch_angle": 40}, "is_sweetspot", 0),
        ({"type": "S", "launch_angle": 4}, "is_sweetspot", None),
        ({"type": "X", "launch_angle": 8}, "is_sweetspot", 1),
        ({"type": "X", "launch_angle": 32}, "is_sweetspot", 1),
        ({"type": "X", "launch_angle": 33}, "is_sweetspot", 0),
        ({"type": "X"}, "is_hardhit", None),
        ({"type": "X", "launch_speed": 95.0}, "is_hardhit", 1),
        ({"type": "X", "launch_speed": 94.9}, "is_barrel", 0),
        ({"type": "X", "launch_speed": 99.0}, "is_barrel", None),
        ({"type": "X", "launch_speed": 99.0, "launch_angle": 20}, "is_barrel", 1),
        ({"type": "X", "launch_angle": 50}, "is_barrel", 0),
        ({"description": "foul_tip"}, "is_whiff", 1),
        ({"description": "foul"}, "is_whiff", 0),
        ({"description": "ball"}, "is_whiff", None),
        ({"zone": 10, "description": "foul"}, "is_zone_swing", None),
        ({"zone": 10, "description": "foul"}, "is_chase_swing", None),
        ({"zone": 14}, "is_chase_swing", 0),
        ({}, "is_bip", None),
        ({}, "is_single", None),
        ({}, "is_walk", 0),
        ({}, "is_strikeout", 0),
        ({"inning_topbot": "Top", "delta_home_win_exp": 0.5}, "delta_bat_win_exp", -0.5),
        ({"inning_topbot": "Bot", "delta_home_win_exp": 0.5}, "delta_bat_win_exp", 0.5),
        ({"delta_home_win_exp": 0.5}, "delta_bat_win_exp", None),
    ],
)
def test_flags(spark, known, flag, want):
    assert flags_of(spark, **known)[flag] == want


def test_pitch_groups(spark):
    names = ["Sinker", "Forkball", "Other", "Eephus", "Pitch Out", None]
    df = ingest.bucket_pitch_group(spark.createDataFrame([(n,) for n in names], "pitch_name string"))
    assert [r.pitch_group for r in df.collect()] == ["FB", "OS", "BB", "BB", "Other", "Other"]


def test_snake_names():
    got = ingest.snake_names(["BATTER_ID", "PlayerName", "Zone (1-14)", "% hit", "2b", "team", "Team", "TEAM"])
    assert got == ["batter_id", "player_name", "zone_1_14", "percent_hit", "x2b", "team", "team_2", "team_3"]


def test_empty_sum_is_zero_and_empty_mean_is_missing(spark):
    df = summaries.yearly_summary(with_flags(spark.createDataFrame([pitch()], PITCH_SCHEMA)))
    row = df.first()
    assert (row.win_prob_added, row.singles, row.total_bases, row.total_pitches) == (0.0, 0, 0, 1)
    assert row.woba is None and row.chase_prop is None


def test_window_form_equals_joined_form(spark, sf_dir):
    from dugout.plans import queries as Q

    one = Q.cells(spark, sf_dir).drop("num_pitches")
    two = Q.joined_summaries(spark, sf_dir).select(*one.columns)
    assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()


def test_clamp_keeps_missing_and_all_zero_has_no_share(spark):
    rows = [(1, "a", -2.0), (1, "a", 3.0), (1, "a", 1.0), (2, "b", -1.0), (2, "b", 0.0), (3, "c", None)]
    df = shares.clamp_and_share(spark.createDataFrame(rows, "batter_id long, player_name string, p double"), "p", "s")
    got = {}
    for r in df.collect():
        got.setdefault(r.batter_id, []).append((r.p, r.s))
    assert sorted(got[1]) == [(0.0, 0.0), (1.0, 0.25), (3.0, 0.75)]
    assert got[2] == [(0.0, None), (0.0, None)] and got[3] == [(None, None)]


def test_missing_keys_join_each_other(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y"), (2, "z")], "k int, u string")
    b = spark.createDataFrame([(1, 10), (None, 20)], "k int, v int")
    got = {r.u: r.v for r in joins.left_join_natural(a, b).collect()}
    assert got == {"x": 10, "y": 20, "z": None}
    assert [r.k for r in joins.names_missing_from(a, b, "k").collect()] == [2]


def test_suffix_goes_to_clashing_columns_only(spark):
    a = spark.createDataFrame([(1, 2, 3)], "k int, m int, only_a int")
    b = spark.createDataFrame([(1, 5, 6)], "k int, m int, only_b int")
    df = joins.left_join_suffixed(a, b, ["k"], ("_previous", "_pitch"))
    assert df.columns == ["k", "m_previous", "only_a", "m_pitch", "only_b"]


def test_carry_over_moves_only_absent_names(spark):
    seasons = Seasons(2000, 2001, 2002)
    rows = [("a", 2000), ("a", 2001), ("b", 2000), ("b", 1999), (None, 2000)]
    df = spark.createDataFrame(rows, "player_name string, game_year int").withColumn("pred_year", F.col("game_year") + 1)
    got = {(r.player_name, r.game_year): r.pred_year for r in model_table.carry_over(df, seasons).collect()}
    assert got == {("a", 2000): 2001, ("a", 2001): 2002, ("b", 2000): 2002, ("b", 1999): 2000, (None, 2000): 2002}


def test_average_rank_with_ties_hot_key_and_missing(spark):
    values = [3.0, 1.0, 3.0, None, 2.0]
    rows = [("hot", v) for v in values] + [(None, 7.0)] + [("big", float(i % 50)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, v double")
    up = ranking.average_rank(df, "v", ["k"], "up")
    both = ranking.average_rank(up, "v", ["k"], "down", descending=True).collect()
    assert len(both) == len(rows)
    hot = sorted(((r.v, r.up, r.down) for r in both if r.k == "hot"), key=str)
    assert hot == sorted([(1.0, 1.0, 3.5), (2.0, 2.0, 2.5), (3.0, 3.5, 1.0), (3.0, 3.5, 1.0), (None, None, None)], key=str)
    assert [(r.up, r.down) for r in both if r.k is None] == [(1.0, 1.0)]
    assert all(r.up == 10 * r.v + 5.5 for r in both if r.k == "big")


def test_position_of_single_point_domain(spark):
    df = spark.createDataFrame([(2.0, 2.0, 2.0), (1.0, 0.0, 4.0), (None, 0.0, 4.0)], "v double, lo double, hi double")
    args = [F.col(c) for c in ("v", "lo", "hi")]
    got = df.select(ranking.position(*args, F.lit(False)).alias("a"), ranking.position(*args, F.lit(True)).alias("b"))
    assert [tuple(r) for r in got.collect()] == [(0.5, 0.5), (0.25, 0.75), (None, None)]


def test_top_k_keeps_ties(spark):
    rows = [(i, f"p{i}", 2002, float(d)) for i, d in enumerate([1, 2, 3, 3, 3, 9])]
    df = spark.createDataFrame(rows, "batter_id long, player_name string, game_year int, distance double")
    assert {r.batter_id for r in topk.with_ties(df, 3).collect()} == {0, 1, 2, 3, 4}
    assert {r.batter_id for r in topk.with_ties(df, 1, nearest=False).collect()} == {5}
    table = {r.value: (r.player_1, r.player_2, r.player_3) for r in topk.similarity_table(df).collect()}
    assert table == {"Most Similar": ("p0", "p1", "p2"), "Least Similar": ("p5", "p2", "p3")}


def test_sort_puts_missing_last_both_ways(spark):
    df = spark.createDataFrame([(2,), (None,), (1,)], "v int")
    assert [r.v for r in columns.sort_missing_last(df, "v").collect()] == [1, 2, None]
    assert [r.v for r in columns.sort_missing_last(df, "v", descending=True).collect()] == [2, 1, None]


def test_formats(spark):
    df = spark.createDataFrame([(2.5, 1), (-0.04, 2), (1234.5, 3), (None, 4)], "v double, i int")
    out = df.orderBy("i").select(
        formats.format_value(F.col("v"), "number", 0),
        formats.format_value(F.col("v"), "number", 1, "  "),
        formats.format_value(F.col("v"), "currency", 1),
        formats.format_value(F.col("v"), "percent", 0),
        formats.format_value(F.col("v"), "plain", 0),
    )
    assert [tuple(r) for r in out.collect()] == [
        ("2", "2.5  ", "$2.5", "250%", "2"),
        ("-0", "-0.0  ", "$-0.0", "-4%", "0"),
        ("1234", "1234.5  ", "$1,234.5", "123450%", "1234"),
        (None,) * 5,
    ]


def test_pivot_and_stack(spark):
    rows = [(1, "FB", 0.5), (1, "OS", 0.5), (2, "BB", 1.0)]
    df = spark.createDataFrame(rows, "id int, pitch_group string, v double")
    got = {r.id: (r.FB, r.BB, r.OS) for r in reshape.pivot_groups(df, ["id"], "v").collect()}
    assert got == {1: (0.5, None, 0.5), 2: (None, 1.0, None)}
    filled = {r.id: (r.FB, r.BB, r.OS) for r in reshape.pivot_groups(df, ["id"], "v", fill=0.0).collect()}
    assert filled == {1: (0.5, 0.0, 0.5), 2: (0.0, 1.0, 0.0)}


def test_published_shares_sum_to_one(spark, sf_dir):
    from dugout.plans import queries as Q

    final = Q.QUERIES["final_prediction_table"](spark, sf_dir)
    parts = [F.coalesce(f"PITCH_TYPE_{g}", F.lit(0.0)) for g in ("FB", "BB", "OS")]
    known = final.where("coalesce(PITCH_TYPE_FB, PITCH_TYPE_BB, PITCH_TYPE_OS) is not null")
    assert known.count() > 0
    assert known.where(F.abs(parts[0] + parts[1] + parts[2] - 1) > 1e-12).isEmpty()


def test_csv_missing_markers(spark, tmp_path):
    text = "batter_id,player_name,events\n1,\"Peña, J\",NA\n2,,\"\"\nNA,x,single\n"
    (tmp_path / "in.csv").write_text(text, encoding="utf-8")
    schema = StructType([PITCH_SCHEMA[c] for c in ("batter_id", "player_name", "events")])
    df = files.scan_csv(spark, str(tmp_path / "in.csv"), schema)
    assert [tuple(r) for r in df.collect()] == [(1, "Peña, J", None), (2, None, None), (None, "x", "single")]


def test_nan_becomes_missing(spark):
    df = nullsafe.no_nan(spark.createDataFrame([(float("nan"), 1), (2.0, 2)], "v double, i int"))
    assert [tuple(r) for r in df.collect()] == [(None, 1), (2.0, 2)]


def test_report_tags(spark):
    df = report.tag_type(spark.createDataFrame([(2001,), (2002,), (None,)], "game_year int"), Seasons(2000, 2001, 2002))
    assert [r.type for r in df.collect()] == ["True", "Pred", None]
