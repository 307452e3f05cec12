"""Approximate nearest neighbours by cosine with a forest of hash-prefix trees."""

from __future__ import annotations

import math
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dugout.llm.common import col
from dugout.sources.scratch import materialize

#: Trees; rows of a sorted array that one task holds; blocks a tree is cut into at most.
TREES, BLOCK_ROWS, MOST_BLOCKS = 40, 50_000, 4096
#: Candidates gathered over all trees before the ascent ends: FACTOR * rows ** POWER.
FACTOR, POWER = 16.0, 2.0 / 3.0
#: Coordinates of a random rotation that make up a hash string, and bits of a string that carry meaning.
MOST_COORDINATES, STRING_BITS, TIE_BITS = 64, 48, 14


class Strings:
    """Hash strings of vectors, one per tree, as sortable non-negative 62-bit numbers.

    A tree rotates the vector at random and lists its coordinates from the largest in absolute value down, each with
    its sign. Near vectors agree on a long beginning of that list. The last bits are a hash of the vector's bytes and only
    spread equal strings, such as those of a vector's multiples, over many labels and so over many blocks.
    """

    def __init__(self, size: int, trees: int = TREES, seed: int = 1):
        self.size, self.trees = size, trees
        wide = min(size, MOST_COORDINATES)
        self.bits = max(1, math.ceil(math.log2(2 * wide)))
        self.symbols = min(wide, STRING_BITS // self.bits)
        rng = np.random.default_rng(seed)
        self.rotations = [np.linalg.qr(rng.normal(size=(size, size)))[0][:, :wide] if size <= 1024 else rng.normal(size=(size, wide)) for _ in range(trees)]

    @property
    def depth(self) -> int:
        return self.bits * self.symbols

    def labels(self, vectors: np.ndarray) -> np.ndarray:
        """(rows, trees)."""
        out = np.zeros((len(vectors), self.trees), dtype=np.int64)
        unit = vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
        ties = np.array([crc32(v.tobytes()) & ((1 << TIE_BITS) - 1) for v in vectors], dtype=np.int64)
        for t, rotation in enumerate(self.rotations):
            turned = unit @ rotation
            first = np.argsort(-np.abs(turned), axis=1, kind="stable")[:, : self.symbols]
            signs = np.take_along_axis(turned, first, axis=1) > 0
            text = np.zeros(len(vectors), dtype=np.int64)
            for s in range(self.symbols):
                text = (text << self.bits) | (first[:, s] << 1) | signs[:, s]
            out[:, t] = (text << TIE_BITS) | ties
        return out


def unpacked(column: pd.Series, kind: str, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=kind).reshape(len(column), size).astype(np.float64)


def in_range(vector, kind: str) -> np.ndarray:
    """The vector; one of doubles times a power of two that brings its largest part to between a half and one.

    That changes no cosine and keeps squares from over- and underflowing. Squares of single floats fit a double.
    """
    out = np.asarray(vector, dtype=kind) + 0
    return out if kind == "<f4" else np.ldexp(out, -np.frexp(np.abs(out).max())[1])


def span(label: np.ndarray, depth: np.ndarray, whole: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last label that share the beginning of so many bits."""
    free = (whole + TIE_BITS - depth).astype(np.int64)
    low = (label >> free) << free
    return low, low + (np.int64(1) << free) - 1


def nearest(
    vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", wanted: Column, k: int = 5, trees: int = TREES
) -> DataFrame:
    """(query, rank, id, score): the k nearest found for each row that wanted selects, by cosine, itself left out.

    Rows with equal vectors, or multiples of each other by a power of two where parts are doubles, are one entry that
    keeps its k + 1 smallest keys, all a top-k can ever use. Other multiples share their strings but not their labels,
    so blocks cut them apart. Entries are numbered, as two vectors may have one key. Each entry has a hash string
    per tree; a tree is its entries in the order of their strings, cut at quantiles into blocks of bounded size, one
    task each. First every query descends: a block finds by binary search how many entries share each length of prefix
    with it. Then all trees ascend together: the depth is the longest prefix length at which the
    trees hold enough candidates in sum. Last, the blocks that the query's prefix range touches score all entries in
    that range, whole levels, in double precision on the original vectors, and keep their k + 1 best.

    Null and zero vectors, those with null or non-finite parts, and those of another length than most take no part.
    Ties go to the smaller key. A repeated key counts as a row each time. Fewer rows than k give what there is.
    """
    spark = vectors.sparkSession
    kind = "<f4" if "float" in vectors.schema[vector].dataType.simpleString() else "<f8"
    part = lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x)
    usable = vectors.filter(F.col(vector).isNotNull() & col(key).isNotNull()).filter(
        F.forall(col(vector), part) & F.exists(col(vector), lambda x: x != 0)
    )
    lengths = usable.groupBy(F.size(col(vector)).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).head(1)
    if not lengths:
        return spark.createDataFrame([], "query long, rank int, id long, score double")
    size = lengths[0]["size"]

    @F.pandas_udf("binary")
    def packed(values: pd.Series) -> pd.Series:
        return pd.Series([in_range(v, kind).tobytes() for v in values], dtype=object)

    rows = materialize(
        usable.filter(F.size(col(vector)) == size).select(
            col(key).cast("long").alias("id"), packed(col(vector)).alias("packed"), F.coalesce(wanted, F.lit(False)).alias("wanted")
        ),
        "vectors",
    )
    by_vector = Window.partitionBy("packed").orderBy("id")
    few = rows.select("id", "packed").withColumn("n", F.row_number().over(by_vector)).filter(F.col("n") <= k + 1)
    strings = spark.sparkContext.broadcast(Strings(size, trees))

    @F.pandas_udf("array<long>")
    def labels(values: pd.Series) -> pd.Series:
        return pd.Series(list(strings.value.labels(unpacked(values, kind, size))), dtype=object)

    entries = materialize(
        few.groupBy("packed")
        .agg(F.array_sort(F.collect_list("id")).alias("ids"))
        .select(F.monotonically_increasing_id().alias("entry"), "ids", "packed", labels("packed").alias("labels")),
        "entries",
    )
    total = entries.count()
    queries = materialize(
        rows.filter("wanted").select(F.col("id").alias("query"), "packed").join(entries.select("entry", "packed"), "packed").select("query", "entry"),
        "queries",
    )
    asked = materialize(entries.join(queries.select("entry").distinct(), "entry", "left_semi"), "asked")
    whole = strings.value.depth
    enough = min(max(FACTOR * total**POWER, trees * (k + 1)), trees * (total - 1))

    cuts = np.zeros((trees, 0), dtype=np.int64)
    blocks = min(MOST_BLOCKS, -(-total // BLOCK_ROWS))
    if blocks > 1:
        shares = [i / blocks for i in range(1, blocks)]
        points = (
            entries.select(F.posexplode("labels").alias("tree", "label"))
            .groupBy("tree").agg(F.percentile_approx("label", shares, 10 * blocks).alias("cuts")).orderBy("tree").collect()
        )
        cuts = np.array([r["cuts"] for r in points], dtype=np.int64)
    held = spark.sparkContext.broadcast(cuts)

    @F.pandas_udf("first int, last int")
    def block_of(tree: pd.Series, low: pd.Series, high: pd.Series) -> pd.DataFrame:
        """Blocks of a tree that hold labels from low to high: the first and the last."""
        which, out = tree.to_numpy(), np.zeros((2, len(tree)), dtype=np.int32)
        for t in np.unique(which):
            own = np.flatnonzero(which == t)
            for row, ends in zip(out, (low, high)):
                row[own] = np.searchsorted(held.value[t], ends.to_numpy()[own], side="right")
        return pd.DataFrame({"first": out[0], "last": out[1]})

    def placed(frame: DataFrame) -> DataFrame:
        return frame.withColumn("block", block_of("tree", "label", "label")["first"] if blocks > 1 else F.lit(0))

    trees_of = lambda frame, *more: frame.select("entry", *more, F.posexplode("labels").alias("tree", "label"))
    index = placed(trees_of(entries))

    def descend(key, arrays: pd.DataFrame, lookups: pd.DataFrame) -> pd.DataFrame:
        """Entries of the block that share each prefix length with a query, itself not counted."""
        ordered, own = np.sort(arrays["label"].to_numpy()), lookups["label"].to_numpy()
        own_entry = lookups["entry"].to_numpy()
        counts = np.zeros((len(own), whole + 1), dtype=np.int64)
        for depth in range(whole + 1):
            low, high = span(own, np.full(len(own), depth), whole)
            counts[:, depth] = np.searchsorted(ordered, high, "right") - np.searchsorted(ordered, low, "left") - 1
        return pd.DataFrame({"entry": own_entry, "counts": pd.Series(list(np.maximum(counts, 0)), dtype=object)})

    profiles = (
        index.groupBy("tree", "block")
        .cogroup(placed(trees_of(asked)).groupBy("tree", "block"))
        .applyInPandas(descend, "entry long, counts array<long>")
        .groupBy("entry")
        .agg(*[F.sum(F.col("counts")[d]).alias(f"c{d}") for d in range(whole + 1)])
    )
    deepest = F.greatest(F.lit(0), *[F.when(F.col(f"c{d}") >= enough, F.lit(d)) for d in range(whole + 1)])
    depths = materialize(profiles.select("entry", deepest.alias("depth")), "depths")

    free = F.lit(whole + TIE_BITS) - F.col("depth")
    low = F.call_function("shiftleft", F.call_function("shiftright", F.col("label"), free), free)
    sought = (
        trees_of(asked.join(depths, "entry"), "packed", "depth")
        .withColumn("low", low)
        .withColumn("high", F.col("low") + F.call_function("shiftleft", F.lit(1).cast("long"), free) - 1)
    )
    if blocks > 1:
        touched = block_of("tree", "low", "high")
        sought = sought.withColumn("touched", touched).withColumn("block", F.explode(F.sequence(F.col("touched.first"), F.col("touched.last"))))
    else:
        sought = sought.withColumn("block", F.lit(0))

    def gather(key, arrays: pd.DataFrame, lookups: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(arrays) and len(lookups):
            arrays = arrays.sort_values("label", kind="stable")
            ordered, entry, least_id = (arrays[c].to_numpy() for c in ("label", "entry", "least_id"))
            points = unpacked(arrays["packed"], kind, size)
            norms = np.sqrt((points * points).sum(axis=1))
            asks = unpacked(lookups["packed"], kind, size)
            starts = np.searchsorted(ordered, lookups["low"].to_numpy(), "left")
            ends = np.searchsorted(ordered, lookups["high"].to_numpy(), "right")
            for who, ask, start, end in zip(lookups["entry"].to_numpy(), asks, starts, ends):
                if start == end:
                    continue
                scores = (points[start:end] * ask).sum(axis=1) / (norms[start:end] * np.sqrt((ask * ask).sum()))
                if end - start > k + 1:
                    least = np.partition(scores, end - start - k - 1)[end - start - k - 1]
                    near = np.flatnonzero(scores >= least)
                else:
                    near = np.arange(end - start)
                near = near[np.lexsort((least_id[start + near], -scores[near]))][: k + 1]
                out.append(pd.DataFrame({"asked": who, "entry": entry[start + near], "score": scores[near]}))
        return pd.concat(out) if out else pd.DataFrame({"asked": [], "entry": [], "score": []})

    found = (
        placed(trees_of(entries.withColumn("least_id", F.col("ids")[0]), "least_id", "packed"))
        .groupBy("tree", "block")
        .cogroup(sought.select("tree", "block", "entry", "packed", "low", "high").groupBy("tree", "block"))
        .applyInPandas(gather, "asked long, entry long, score double")
        .groupBy("asked", "entry")
        .agg(F.max("score").alias("score"))
    )
    best = Window.partitionBy("asked").orderBy(F.desc("score"), "id")
    top = (
        found.join(entries.select("entry", "ids"), "entry")
        .select("asked", "score", F.explode("ids").alias("id"))
        .withColumn("n", F.row_number().over(best))
        .filter(F.col("n") <= k + 1)
        .select("asked", "score", "id")
    )
    # the query's own row goes once; another row with its key, if there is one, is not itself a neighbour either
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return (
        queries.withColumnRenamed("entry", "asked").join(top, "asked")
        .filter("id <> query")
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query", "rank", "id", "score")
    )
