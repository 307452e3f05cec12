"""Uniform shuffle into shards of exact size through a hypergeometric communication matrix."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dugout.llm.common import boxed
from dugout.sources.scratch import materialize

#: Populations from here on are beyond the sampler of numpy.
NUMPY_LIMIT = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Number of good ones among draws without replacement, exact at any size.

    Large populations: propose from the binomial distribution and accept in the ratio of the two probabilities. The
    ratio's logarithm is concave with its top at the mean, so the acceptance rate is at least 0.7.
    """
    total = good + bad
    if draws == 0 or good == 0:
        return 0
    if bad == 0:
        return draws
    if total < NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, draws))
    if 2 * draws > total:
        return good - hypergeometric(rng, good, bad, total - draws)

    def ratio(x: int) -> float:
        if x < 0 or x > good or draws - x > bad:
            return -math.inf
        return -math.lgamma(good - x + 1) - x * math.log(good) - math.lgamma(bad - draws + x + 1) - (draws - x) * math.log(bad)

    mean = draws * good // total
    top = max(ratio(mean), ratio(mean + 1))
    while True:
        x = int(rng.binomial(draws, good / total))
        if math.log(1.0 - rng.random()) < ratio(x) - top:
            return x


def split_columns(rng: np.random.Generator, columns: np.ndarray, left: int) -> np.ndarray:
    """How many rows of each shard fall to the left part, of left rows, of a uniform deal."""
    out, rest, draws = np.zeros_like(columns), int(columns.sum()), left
    for s, n in enumerate(map(int, columns)):
        rest -= n
        out[s] = hypergeometric(rng, n, rest, draws)
        draws -= int(out[s])
    return out


class Matrix:
    """Partition-to-shard counts, drawn without a table of all partitions times all shards.

    A binary tree over the partitions splits the shard sizes at each node by one multivariate hypergeometric draw
    whose seed is the node, so every task finds the row of its partition in a logarithmic number of draws, and all
    tasks, retries included, see the same matrix.
    """

    def __init__(self, rows: np.ndarray, shards: int, seed: int):
        self.ends = np.concatenate([[0], np.cumsum(rows, dtype=np.int64)])
        self.shards, self.seed = shards, seed

    def __reduce__(self):
        return Matrix, (np.diff(self.ends), self.shards, self.seed)

    def sizes(self) -> np.ndarray:
        """Rows of each shard: at most one apart; a draw decides which shards have one more."""
        total = int(self.ends[-1])
        out = np.full(self.shards, total // self.shards, dtype=np.int64)
        more = np.random.default_rng([self.seed, 0]).permutation(self.shards)[: total % self.shards]
        out[more] += 1
        return out

    def row(self, part: int) -> np.ndarray:
        lo, hi, counts = 0, len(self.ends) - 1, self.sizes()
        while hi - lo > 1:
            mid = (lo + hi) // 2
            left = self._left(lo, mid, hi, counts)
            lo, hi, counts = (lo, mid, left) if part < mid else (mid, hi, counts - left)
        return counts

    def _left(self, lo: int, mid: int, hi: int, counts: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng([self.seed, 1, lo, hi])
        return split_columns(rng, counts, int(self.ends[mid] - self.ends[lo]))

    def labels(self, part: int) -> np.ndarray:
        """The partition's local permutation: the shard of each of its rows in turn."""
        out = np.repeat(np.arange(self.shards, dtype=np.int32), self.row(part))
        np.random.default_rng([self.seed, 2, part]).shuffle(out)
        return out


def dealer(matrix: Matrix, parts: np.ndarray):
    """Shard of each row from its position: partition number in the upper bits, place in it in the lower 33."""

    @F.pandas_udf("int")
    def shard(positions: pd.Series) -> pd.Series:
        places = positions.to_numpy()
        out, of = np.empty(len(places), dtype=np.int32), places >> 33
        for p in np.unique(of):
            at = of == p
            number = int(np.searchsorted(parts, p))
            if held.get("number") != number:
                held.update(number=number, labels=matrix.labels(number))
            out[at] = held["labels"][places[at] & ((1 << 33) - 1)]
        return pd.Series(out)

    held: dict = {}
    return shard


def shuffle_into_shards(
    docs: DataFrame, shards: int = 40, *, seed: int = 20, rows_per_bucket: int = 200_000
) -> DataFrame:
    """Every row of docs in one of the shards, uniformly at random, shard sizes at most one apart.

    Returns row (struct of the input's columns), shard (int from 0) and slot (long, gapless from 0 in each shard).
    The rows are written once with their position, so that partitions stay what they are when tasks are run again.
    Partition sizes give the communication matrix; each partition permutes its own rows over its row of the matrix;
    one exchange brings the shards together; a fresh draw per row orders each shard anew. The second permutation is
    cut into buckets by the leading bits of the draw, so that no task holds a whole shard: a slot is the number of
    rows in the shard's earlier buckets plus the place within the bucket.

    The driver sees one count per partition. Rows are dealt by position alone: nulls, repeated rows, empty and very
    long texts are like any other row, and no key can make a hot task. An empty table gives no rows.
    """
    spark = docs.sparkSession
    staged = materialize(docs.select(boxed(docs).alias("row"), F.monotonically_increasing_id().alias("position")), "shards")
    sizes = staged.groupBy(F.shiftright("position", 33).alias("part")).count().orderBy("part").collect()
    if not sizes:
        return staged.select("row", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    parts = np.array([r["part"] for r in sizes], dtype=np.int64)
    matrix = Matrix(np.array([r["count"] for r in sizes], dtype=np.int64), shards, seed)
    bits = max(0, math.ceil(math.log2(max(1, int(matrix.ends[-1])) / shards / rows_per_bucket)))
    draw = F.xxhash64(F.lit(seed), "position")
    dealt = (
        staged.withColumn("shard", dealer(matrix, parts)("position"))
        .withColumn("draw", draw)
        .withColumn("bucket", F.shiftrightunsigned("draw", 64 - bits) if bits else F.lit(0).cast("long"))
    )
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (
        dealt.groupBy("shard", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    )
    within = Window.partitionBy("shard", "bucket").orderBy("draw", "position")
    return (
        dealt.withColumn("place", F.row_number().over(within))
        .join(buckets, ["shard", "bucket"])
        .select("row", "shard", (F.col("before") + F.col("place") - 1).cast("long").alias("slot"))
    )
