"""Predictors and the preparation learned on training rows."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Transformer
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dugout.functions.measures import MEASURES
from dugout.functions.nullsafe import ratio
from dugout.operators import correlation as corr
from dugout.params import CORR_CUTOFF

OUTCOME = "num_pitches"
#: Carried along but never predicted from; total_pitches_pitch equals the outcome.
ID_COLUMNS = ("batter_id", "player_name", "total_pitches_pitch", "prop")
NOMINAL = "pitch_group"
#: Indicators of the nominal predictor; its first level in alphabetical order, BB, is the reference.
DUMMIES = {"pitch_group_FB": "FB", "pitch_group_OS": "OS"}


def predictors() -> list[str]:
    """The 47 numeric predictors in table order."""
    names = [
        "game_year",
        "pred_year",
        *(f"{m}_previous" for m in MEASURES),
        *(f"{m}_pitch" for m in MEASURES),
    ]
    return [n for n in names if n not in ID_COLUMNS]


def with_dummies(df: DataFrame) -> DataFrame:
    return df.withColumns({name: (F.col(NOMINAL) == level).cast("int") for name, level in DUMMIES.items()})


def variance_report(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per column: is there at most one distinct known value? A single min/max aggregate."""
    extremes = [agg(F.col(c)).cast("double").alias(f"{c}__{tag}") for c in names for agg, tag in ((F.min, "lo"), (F.max, "hi"))]
    wide = df.agg(*extremes)
    cells = F.explode(
        F.array(
            *(
                F.struct(F.lit(c).alias("column"), F.col(f"{c}__lo").alias("lo"), F.col(f"{c}__hi").alias("hi"))
                for c in names
            )
        )
    )
    constant = F.coalesce(F.col("lo") == F.col("hi"), F.lit(True))
    return wide.select(cells.alias("c")).select("c.*").withColumn("zero_variance", constant.cast("int"))


def normalized(df: DataFrame, train: DataFrame, names: Sequence[str]) -> DataFrame:
    """Append ``z_x`` = (x - mean) / sample sd, both learned on ``train``; missing stays missing."""
    learned = train.agg(
        *(F.avg(c).alias(f"{c}__mean") for c in names), *(F.stddev_samp(c).alias(f"{c}__sd") for c in names)
    ).first()
    return df.withColumns(
        {f"z_{c}": ratio(F.col(c) - F.lit(learned[f"{c}__mean"]).cast("double"), F.lit(learned[f"{c}__sd"])) for c in names}
    )


@dataclass(frozen=True)
class Recipe:
    """What was learned on training rows: which predictors stay, and their mean and sd."""

    inputs: tuple[str, ...]
    means: tuple[float, ...]
    sds: tuple[float, ...]

    @property
    def outputs(self) -> list[str]:
        return [f"z_{name}" for name in self.inputs]

    def stages(self) -> list[Transformer]:
        """Scale, then assemble. A missing value becomes the mean, which is 0 after scaling."""
        cells = ", ".join(f"{cell} AS `{z}`" for cell, z in zip(self._cells(), self.outputs))
        scale = SQLTransformer(statement=f"SELECT *, {cells} FROM __THIS__")
        return [scale, VectorAssembler(inputCols=self.outputs, outputCol="features")]

    def assembled(self, df: DataFrame) -> DataFrame:
        """Append ``features`` with the same values as the stages, in about half the time of the assembler's rows.

        NaN is refused, as it is there.
        """
        refused = F.raise_error(F.lit("NaN among the predictors"))
        rows = df.withColumn("features", F.array(*(F.expr(cell) for cell in self._cells())))
        valid = ~F.array_contains("features", float("nan"))
        return rows.withColumn("features", F.when(valid, array_to_vector("features")).otherwise(refused))

    def _cells(self) -> list[str]:
        scaled = zip(map(self._source, self.inputs), self.means, self.sds)
        return [f"coalesce(try_divide({x} - {m!r}D, {s!r}D), 0.0D)" for x, m, s in scaled]

    @staticmethod
    def _source(name: str) -> str:
        if name in DUMMIES:
            return f"CAST({NOMINAL} = '{DUMMIES[name]}' AS DOUBLE)"
        return f"CAST(`{name}` AS DOUBLE)"


def resample_moments(train: DataFrame, folds: dict[int, str]) -> DataFrame:
    """What ``fit_recipe`` needs of the analysis rows of every resample."""
    return corr.resample_moments(with_dummies(train), [*predictors(), *DUMMIES], folds)


def fit_recipe(
    train: DataFrame, cutoff: float = CORR_CUTOFF, numeric: Sequence[str] | None = None, moments: DataFrame | None = None
) -> Recipe:
    """Correlation filter, zero-variance filter, indicators and scaling from one pass.

    The pass yields p * p moments; everything below works on those few thousand numbers. With
    ``numeric`` the filter on correlation has been done before and these predictors are what it left.
    ``moments`` are those of the training rows where they are known already.
    """
    filtered = numeric is not None
    numeric = list(numeric) if filtered else predictors()
    names = [*numeric, *DUMMIES]
    if moments is None:
        moments = corr.pair_moments(with_dummies(train), names)
    redundant = set()
    if not filtered:
        among = moments.where((F.col("i") < len(numeric)) & (F.col("j") < len(numeric)))
        pairs = corr.redundant_pairs(corr.correlations(among), len(numeric), cutoff)
        dropped = F.when(F.col("drop_j"), F.col("j")).otherwise(F.col("i"))
        redundant = {row.drop for row in pairs.select(dropped.alias("drop")).collect()}
    stats = {row.i: row for row in moments.where(F.col("i") == F.col("j")).collect()}
    kept = []
    for at, name in enumerate(names):
        s = stats.get(at)
        if at in redundant or s is None or not s.lo < s.hi:
            continue
        mean = s.sx / s.n
        var = (s.sxx - s.sx * mean) / (s.n - 1)
        kept.append((name, s["shift"] + mean, math.sqrt(max(var, 0.0))))
    inputs, means, sds = zip(*kept)
    return Recipe(inputs, means, sds)
