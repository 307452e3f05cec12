"""Mixing sources to target weights by systematic sampling, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dugout.llm.common import boxed, col, row_hash, source_key
from dugout.sources.scratch import materialize

#: Rows that share source and size class are cut into so many ordered hash buckets.
BUCKET_BITS = 12


def size_class(size: Column) -> Column:
    """Orders sizes by their four leading binary digits, so a class holds sizes within an eighth of each other."""
    digits = F.length(F.bin(size))
    return (digits * 8 + F.call_function("shiftright", size, F.greatest(digits - 4, F.lit(0))) % 8).cast("int")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, ceiling: float) -> DataFrame:
    """Target size of each source. sizes: skey, source_size, one row per source.

    Sources in the order of skey take the weights in turn. The share of all sizes is dealt out by weight; a source
    stops at ceiling times its own size, and its excess goes to the others by weight until none is above. That fixed
    point is a water level: source s gets min(ceiling * size, level * weight). Runs over one row per source.
    """
    everything = Window.orderBy("fill", "skey")
    earlier = everything.rowsBetween(Window.unboundedPreceding, -1)
    later = everything.rowsBetween(0, Window.unboundedFollowing)
    turn = F.row_number().over(Window.orderBy("skey")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    return (
        sizes.withColumn("weight", weight)
        .withColumn("room", F.col("source_size") * F.lit(float(ceiling)))
        .withColumn("fill", F.col("room") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share)))
        .withColumn(
            "level",
            (F.col("total") - F.coalesce(F.sum("room").over(earlier), F.lit(0.0))) / F.sum("weight").over(later),
        )
        # the sources that fill up come first; the level of the first that does not holds for it and all behind it
        .withColumn("open", F.col("level") < F.col("fill"))
        .withColumn("level", F.min(F.when(F.col("open"), F.struct("fill", "skey", "level"))).over(Window.partitionBy())["level"])
        .withColumn("target", F.when(F.col("open"), F.col("level") * F.col("weight")).otherwise(F.col("room")))
        .select("skey", "source_size", "target")
    )


def systematic_mix(
    docs: DataFrame,
    size: Column,
    *,
    source: str = "source",
    key: str = "doc_id",
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    ceiling: float = 2.0,
    seed: str = "mix",
) -> DataFrame:
    """Copies of each row that bring every source near its target size.

    Returns row (struct of the input's columns), size, source_size, target, copies. Within a source, rows stand in
    the order of size class, then of a hash of their key. With r = target / source size, row i covers the stretch
    from (i - 1) * r + u to i * r + u, u in [0, 1) drawn once per source from the seed, and is taken once for each
    integer boundary in it: floor(r) or ceil(r) copies, never more than the ceiling. Size classes spread the copies
    evenly over short and long texts, which keeps the taken size near the target.

    A row's place is the count of all rows in earlier buckets of its source plus its number within its own bucket.
    A bucket is source, size class and the leading bits of the hash, so no task holds a whole source or class,
    whatever share of the rows it has. Counts are aggregated before they move and written once, one row per bucket, so
    the rows are read twice: to be counted and to be dealt. A size that is costly to tell is best a column of a table.

    Null sources are one source, which comes last; null sizes count as 0; a source of size 0 is not taken. Rows with
    the same key and size stand in the order of a hash of all columns; identical rows take any order, which gives the
    same multiset of results. An empty table gives no rows. Reruns agree: all draws are functions of seed and rows.
    """
    hashed = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(col(key).cast("string"), F.lit("null"))))
    rows = docs.select(
        boxed(docs).alias("row"),
        F.coalesce(size, F.lit(0)).cast("long").alias("size"),
        source_key(col(source)).alias("skey"),
        hashed.alias("draw"),
        row_hash(docs).alias("tie"),
    ).select(
        "*",
        size_class(F.col("size")).alias("klass"),
        F.shiftright(F.conv(F.substring("draw", 1, 4), 16, 10).cast("int"), 16 - BUCKET_BITS).alias("bucket"),
    )
    counts = materialize(
        rows.groupBy("skey", "klass", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")), "counts"
    )
    sizes = counts.groupBy("skey").agg(F.sum("words").cast("long").alias("source_size"))
    # first the classes of a source, then the buckets of a class, so no task has all buckets of a source
    classes = Window.partitionBy("skey").orderBy("klass").rowsBetween(Window.unboundedPreceding, -1)
    buckets = Window.partitionBy("skey", "klass").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = (
        counts.groupBy("skey", "klass")
        .agg(F.sum("n").alias("in_class"))
        .select("skey", "klass", F.coalesce(F.sum("in_class").over(classes), F.lit(0)).alias("ahead"))
    )
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "/"), F.col("skey"))), 1, 8), 16, 10).cast("double")
    places = (
        counts.withColumn("before", F.coalesce(F.sum("n").over(buckets), F.lit(0)))
        .join(ahead, ["skey", "klass"])
        .withColumn("before", F.col("before") + F.col("ahead"))
        .join(targets(sizes, weights, share, ceiling), "skey")
        .select(
            "skey", "klass", "bucket", "before", "source_size", "target",
            F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"),
            (offset / F.lit(2.0**32)).alias("start"),
        )
    )
    within = Window.partitionBy("skey", "klass", "bucket").orderBy("draw", "size", "tie")
    place = F.col("before") + F.row_number().over(within)
    return (
        rows.join(places, ["skey", "klass", "bucket"])
        .withColumn("place", place)
        .withColumn(
            "copies",
            F.floor(F.col("place") * F.col("rate") + F.col("start"))
            - F.floor((F.col("place") - 1) * F.col("rate") + F.col("start")),
        )
        .select("row", "size", "source_size", "target", F.col("copies").cast("long").alias("copies"))
    )
