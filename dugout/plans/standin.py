"""A deterministic stand-in for the model's prediction.

The queries behind the model (clamp, share, pivot, report, metrics) are checked against SQL,
which cannot run the model. They take any numeric column; this one is whole-numbered and
takes both signs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def standin(factor: int = 3) -> Column:
    value = F.col("num_pitches") * factor - F.col("total_pitches_previous")
    return value.cast("double")


def with_standin(df: DataFrame) -> DataFrame:
    return df.withColumn("prediction", standin())
