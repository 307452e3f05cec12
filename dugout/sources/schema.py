"""Declared schema of the raw pitch table; nothing is inferred from the files."""

from __future__ import annotations

from pyspark.sql import types as T

PITCH_SCHEMA = T.StructType(
    [
        T.StructField("batter_id", T.LongType()),
        T.StructField("player_name", T.StringType()),
        T.StructField("game_year", T.IntegerType()),
        T.StructField("pitch_name", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("events", T.StringType()),
        T.StructField("zone", T.IntegerType()),
        T.StructField("strikes", T.IntegerType()),
        T.StructField("launch_speed", T.DoubleType()),
        T.StructField("launch_angle", T.IntegerType()),
        T.StructField("inning_topbot", T.StringType()),
        T.StructField("delta_home_win_exp", T.DoubleType()),
        T.StructField("woba_value", T.DoubleType()),
        T.StructField("woba_denom", T.IntegerType()),
        T.StructField("estimated_woba_using_speedangle", T.DoubleType()),
        T.StructField("sz_top", T.DoubleType()),
        T.StructField("sz_bot", T.DoubleType()),
        T.StructField("home_team", T.StringType()),
        T.StructField("away_team", T.StringType()),
        T.StructField("l_orderkey", T.LongType()),
        T.StructField("l_linenumber", T.IntegerType()),
    ]
)

PREDICTION_SCHEMA = T.StructType(
    [
        T.StructField("BATTER_ID", T.LongType()),
        T.StructField("PLAYER_NAME", T.StringType()),
        T.StructField("GAME_YEAR", T.IntegerType()),
        T.StructField("PITCH_TYPE_FB", T.DoubleType()),
        T.StructField("PITCH_TYPE_BB", T.DoubleType()),
        T.StructField("PITCH_TYPE_OS", T.DoubleType()),
    ]
)
