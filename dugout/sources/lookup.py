"""Small literal tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Report colour of each pitch group and of the total.
GROUP_COLOURS = {"FB": "#d22d4a", "OS": "#1fbe3a", "BB": "#04d1ed", "All": "grey20"}


def group_colours(spark: SparkSession) -> DataFrame:
    """Four rows, so always safe to broadcast."""
    return spark.createDataFrame(list(GROUP_COLOURS.items()), "pitch_group string, pitch_hex string")
