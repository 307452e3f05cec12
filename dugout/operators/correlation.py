"""Pairwise-complete correlation of many columns in one pass.

With p columns there are p * p sets of moments. As SQL aggregates that is thousands of
expressions in one plan; here each task turns its rows into p x p matrices with a few matrix
products, and Spark adds the matrices up. The result is p * p rows however large the input.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dugout.functions.nullsafe import ratio
from dugout.sources.scratch import materialize

MOMENTS_SCHEMA = "i int, j int, n double, sx double, sxx double, sxy double, lo double, hi double"


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """Rows x columns as doubles, NULL as NaN."""
    return np.column_stack([c.to_numpy(zero_copy_only=False).astype("float64") for c in batch.columns])


class _Sums:
    """Sums over the rows where both columns of a pair are known, column i in the lead."""

    def __init__(self, shift: np.ndarray):
        p = len(shift)
        self.shift = shift
        self.n, self.sx, self.sxx, self.sxy = (np.zeros((p, p)) for _ in range(4))
        self.lo, self.hi = np.full((p, p), np.inf), np.full((p, p), -np.inf)

    def add(self, raw: np.ndarray) -> None:
        known = ~np.isnan(raw)
        mask = known.astype("float64")
        x = np.where(known, raw - self.shift, 0.0)
        self.n += mask.T @ mask
        self.sx += x.T @ mask
        self.sxx += (x * x).T @ mask
        self.sxy += x.T @ x
        # Only a column with a new extreme in this batch can widen what its pairs have met so far.
        lo, hi = self.lo, self.hi
        least = np.fmin.reduce(raw, axis=0, initial=np.inf)
        most = np.fmax.reduce(raw, axis=0, initial=-np.inf)
        wider = (least[:, None] < lo) | (most[:, None] > hi)
        for j in np.flatnonzero(wider.any(axis=0)):
            rows, cols = known[:, j], np.flatnonzero(wider[:, j])
            if rows.any():
                found = raw[np.ix_(rows, cols)]
                lo[cols, j] = np.fmin(lo[cols, j], np.fmin.reduce(found, axis=0))
                hi[cols, j] = np.fmax(hi[cols, j], np.fmax.reduce(found, axis=0))

    def table(self) -> dict[str, np.ndarray]:
        i, j = np.indices(self.n.shape, dtype="int32")
        cols = {"i": i, "j": j, "n": self.n, "sx": self.sx, "sxx": self.sxx, "sxy": self.sxy, "lo": self.lo, "hi": self.hi}
        return {name: c.ravel() for name, c in cols.items()}


def _moments(shift: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(shift)
        for batch in batches:
            if batch.num_rows:
                sums.add(_matrix(batch))
        if sums.n.any():
            yield pa.RecordBatch.from_pydict(sums.table())

    return run


def _moments_by_fold(shift: np.ndarray, repeats: Sequence[int]):
    """The same sums once per repeat and fold; folds come in the last columns, one per repeat."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], _Sums] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = _matrix(batch)
            raw, folds = cells[:, : len(shift)], cells[:, len(shift) :]
            for repeat, fold in zip(repeats, folds.T):
                for f in np.unique(fold[~np.isnan(fold)]):
                    found.setdefault((repeat, int(f)), _Sums(shift)).add(raw[fold == f])
        for (repeat, fold), sums in found.items():
            told = sums.table()
            at = {"repeat": np.full(len(told["i"]), repeat, "int32"), "fold": np.full(len(told["i"]), fold, "int32")}
            yield pa.RecordBatch.from_pydict(at | told)

    return run


def _shifted(df: DataFrame, columns: Sequence[str], *others: str) -> tuple[DataFrame, np.ndarray]:
    """Columns as doubles, and the mean of each."""
    x = df.select(*(F.col(c).cast("double").alias(c) for c in columns), *others)
    means = x.agg(*(F.avg(c).alias(c) for c in columns)).first()
    return x, np.array([0.0 if m is None else m for m in means])


def _added(parts: DataFrame, shift: np.ndarray, *by: str) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("n", "sx", "sxx", "sxy")]
    totals = parts.groupBy(*by, "i", "j").agg(*sums, F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    shifts = F.array(*(F.lit(float(s)) for s in shift))
    return materialize(totals.withColumn("shift", F.get(shifts, F.col("i"))), "moments")


def pair_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per ordered column pair (i, j): moments of i where j is known too.

    Values are shifted by the column mean first, which keeps the sums of squares accurate. The few thousand rows
    are stored: what is made of them reads them several times, and must not read the data again each time.
    """
    x, shift = _shifted(df, columns)
    return _added(x.mapInArrow(_moments(shift), MOMENTS_SCHEMA), shift)


def resample_moments(df: DataFrame, columns: Sequence[str], folds: dict[int, str]) -> DataFrame:
    """(repeat, fold, ...): pair moments of the rows outside each fold, of all resamples in one pass.

    ``folds`` names the column with a row's fold for each repeat. Sums are taken per fold; those of a resample are
    the sums of its repeat's other folds.
    """
    x, shift = _shifted(df, columns, *folds.values())
    told = x.mapInArrow(_moments_by_fold(shift, list(folds)), f"repeat int, fold int, {MOMENTS_SCHEMA}")
    per_fold = _added(told, shift, "repeat", "fold").drop("shift")
    resamples = per_fold.select("repeat", F.col("fold").alias("left_out")).distinct()
    rest = per_fold.join(resamples, "repeat").where(F.col("fold") != F.col("left_out"))
    return _added(rest.drop("fold").withColumnRenamed("left_out", "fold"), shift, "repeat", "fold")


def correlations(moments: DataFrame) -> DataFrame:
    """r of each unordered pair i < j; NULL for a constant column or fewer than two rows."""
    a, b = moments.where(F.col("i") < F.col("j")).alias("a"), moments.where(F.col("i") > F.col("j")).alias("b")
    n = F.col("a.n")
    cov = F.col("a.sxy") - ratio(F.col("a.sx") * F.col("b.sx"), n)
    var = [F.col(f"{s}.sxx") - ratio(F.col(f"{s}.sx") * F.col(f"{s}.sx"), n) for s in "ab"]
    varies = (F.col("a.lo") < F.col("a.hi")) & (F.col("b.lo") < F.col("b.hi"))
    r = F.when(varies & (var[0] > 0) & (var[1] > 0), ratio(cov, F.sqrt(var[0]) * F.sqrt(var[1])))
    met = (F.col("a.i") == F.col("b.j")) & (F.col("a.j") == F.col("b.i"))
    return a.join(b, met).select(F.col("a.i").alias("i"), F.col("a.j").alias("j"), r.alias("r"))


def with_names(pairs: DataFrame, columns: Sequence[str]) -> DataFrame:
    names = F.array(*(F.lit(c) for c in columns))
    return pairs.select(F.get(names, F.col("i")).alias("col_a"), F.get(names, F.col("j")).alias("col_b"), "*")


def corr_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long form (col_a, col_b, r) of the upper triangle."""
    return with_names(correlations(pair_moments(df, columns)), columns).select("col_a", "col_b", "r")


def redundant_pairs(pairs: DataFrame, n_columns: int, cutoff: float) -> DataFrame:
    """Pairs with |r| above the cutoff and which of the two goes (``drop_j``).

    The one with the larger mean |r| over all columns (itself included) goes; on equality the
    earlier one. Works on the p * p correlations, never on data rows.
    """
    size = F.abs(F.coalesce(F.col("r"), F.lit(0.0)))
    both = pairs.select(F.col("i").alias("c"), size.alias("s")).unionByName(
        pairs.select(F.col("j").alias("c"), size.alias("s"))
    )
    mean = both.groupBy("c").agg(F.round((F.sum("s") + 1) / F.lit(n_columns), 9).alias("mean_r"))
    of_i = mean.select(F.col("c").alias("i"), F.col("mean_r").alias("mean_i"))
    of_j = mean.select(F.col("c").alias("j"), F.col("mean_r").alias("mean_j"))
    above = pairs.where(F.abs("r") > cutoff)
    return above.join(of_i, "i").join(of_j, "j").withColumn("drop_j", F.col("mean_j") > F.col("mean_i"))
