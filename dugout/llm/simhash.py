"""SimHash near-duplicates, found through deletion variants of fingerprint segments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dugout.llm.common import boxed, col, row_hash
from dugout.llm.components import components
from dugout.sources.scratch import materialize

BITS = 64
#: Buckets up to here are joined with themselves; up to the next bound, one task links them; beyond, they are cut on.
JOIN_UP_TO, LINK_UP_TO = 32, 2048
#: Shingle hashes added up at once.
CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int) -> int:
    """64-bit SimHash of the word shingles of a text, as a signed number; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return 0
    if len(words) < shingle:
        grams: Iterator[bytes] = iter([b" ".join(words)])
        total = 1
    else:
        grams = map(b" ".join, zip(*[words[i:] for i in range(shingle)]))
        total = len(words) - shingle + 1
    ones = np.zeros(BITS, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for start in range(0, total, CHUNK):
        n = min(CHUNK, total - start)
        hashes = np.fromiter((digest(next(grams), 42) for _ in range(n)), dtype="<u8", count=n)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<i8")[0])


def fingerprint_column(text: Column, shingle: int) -> Column:
    @F.pandas_udf("long")
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return prints(text)


def forest(distance: int):
    """Links that hold a bucket's linked fingerprints together, one fewer than those they connect."""

    def link(group: pd.DataFrame) -> pd.DataFrame:
        prints = group["fp"].to_numpy()
        bits = prints.view(np.uint64)
        rest, out = np.arange(len(bits)), []
        while len(rest):
            front, rest = [rest[0]], rest[1:]
            while front:
                at = front.pop()
                near = np.bitwise_count(bits[rest] ^ bits[at]) <= distance
                out += [(prints[at], prints[i]) for i in rest[near]]
                front += list(rest[near])
                rest = rest[~near]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return link


def close_pairs(prints: DataFrame, distance: int = 3) -> DataFrame:
    """Links (a, b) between distinct fingerprints fp (long, each once) that connect all within distance 3 or less.

    Of two halves of 32 bits, one differs in at most one bit if all 64 differ in at most three; so two near
    fingerprints share one of the 64 variants with one wildcard bit. Rows are joined on equal variants and verified
    by the bits that differ. A bucket of 2 is a pair; one of up to 32 is joined with itself; one of up to 2,048 is
    linked by a forest in one task. Larger buckets are cut again by the same rule on the half that may differ (16
    and 16 bits, then 8 and 8), after which a bucket agrees on 53 bits and cannot hold more than 2,048 distinct
    fingerprints. No bucket is dropped, and no bucket emits pairs in the square of its size.
    """
    if distance > 3:
        raise ValueError("two halves with one wildcard each cover up to three differing bits")
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance
    items, found, more = prints.select("fp"), None, []
    for width in (32, 16, 8):
        keys = [*more, "bucket"]  # the first level has no more columns: it moves all rows
        rows = variants(items, width, more)
        sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
        sizes = materialize(sizes.filter("n > 1"), "buckets")
        pairs = sizes.filter("n = 2").filter(near("a", "b")).select("a", "b")
        rows = materialize(rows.join(sizes.filter("n > 2").select(*keys, "n"), keys), "members")
        few = rows.filter(F.col("n") <= JOIN_UP_TO)
        pairs = pairs.union(
            few.select(*keys, F.col("fp").alias("a"))
            .join(few.select(*keys, F.col("fp").alias("b")), keys)
            .filter("a < b")
            .filter(near("a", "b"))
            .select("a", "b")
        )
        some = rows.filter((F.col("n") > JOIN_UP_TO) & ((F.col("n") <= LINK_UP_TO) | F.lit(width == 8)))
        pairs = pairs.union(some.groupBy(*keys).applyInPandas(forest(distance), "a long, b long"))
        found = pairs if found is None else found.union(pairs)
        large = rows.filter(F.col("n") > LINK_UP_TO)
        if width == 8 or large.isEmpty():
            break
        # the half that may differ more is the one the wildcard is not in
        second = F.shiftright("bucket", 32) >= width
        shift = F.col("shift") if more else F.lit(0)
        path = F.concat_ws("/", *(F.col(c).cast("string") for c in keys))
        items = large.select("fp", (shift + F.when(second, 0).otherwise(width)).alias("shift"), path.alias("path"))
        more = ["path", "shift"]
    return found


def variants(items: DataFrame, width: int, more: list[str]) -> DataFrame:
    """One row per fingerprint, half and wildcard bit of its field of 2 * width bits, which begins at bit shift or 0.

    Fields that differ in at most one bit of a half share the row of that half and bit. bucket has half and bit in
    its upper 32 bits and the half's other bits below; more are columns of items that rows of a bucket agree on.
    """
    ones = (1 << width) - 1
    options = F.array(*[
        F.struct(
            F.lit((half * width + bit) << 32).cast("long").alias("tag"),
            F.lit(half * width).alias("at"),
            F.lit(ones & ~(1 << bit)).cast("long").alias("mask"),
        )
        for half in (0, 1)
        for bit in range(width)
    ])
    shift = F.col("shift") if more else F.lit(0)
    field = F.call_function("shiftrightunsigned", F.col("fp"), shift + F.col("wild.at"))
    return items.select("*", F.explode(options).alias("wild")).select(
        "fp", *more, F.col("wild.tag").bitwiseOR(field.bitwiseAND(F.col("wild.mask"))).alias("bucket")
    )


def simhash_components(
    docs: DataFrame, *, text: str = "text", key: str = "doc_id", shingle: int = 3, distance: int = 3
) -> DataFrame:
    """Fingerprint and component of each row: key, row_hash, fingerprint (long), component, first.

    component is the smallest key reachable over links of distance or fewer differing bits, null if no row of the
    component has a key; first is true on the rows equal to its representative: smallest key, then smallest row hash.
    Copies share a fingerprint and collapse before the search. Fewer words than a shingle: the whole sequence is the
    shingle. Null, empty and blank texts have fingerprint 0 and are linked like any other. Repeated rows get the same
    result each. No rows give no rows.
    """
    rows = materialize(
        docs.select(
            col(key).alias("key"), row_hash(docs).alias("row_hash"), fingerprint_column(col(text), shingle).alias("fp")
        ),
        "prints",
    )
    order = F.struct(F.col("key").isNull().alias("none"), "key", "row_hash")
    firsts = materialize(rows.groupBy("fp").agg(F.min(order).alias("head")), "heads")
    roots = components(close_pairs(firsts.select("fp"), distance))
    joined = firsts.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    heads = joined.groupBy("root").agg(F.min("head").alias("best"))
    classes = joined.select("fp", "root").join(heads, "root").select("fp", "best")
    return rows.join(classes, "fp").select(
        "key",
        "row_hash",
        F.col("fp").alias("fingerprint"),
        F.col("best.key").alias("component"),
        (F.col("key").eqNullSafe(F.col("best.key")) & (F.col("row_hash") == F.col("best.row_hash"))).alias("first"),
    )


def drop_near_duplicates(
    docs: DataFrame, *, text: str = "text", key: str = "doc_id", shingle: int = 3, distance: int = 3
) -> DataFrame:
    """docs with one row of each component: that of the smallest key, whole and with its own columns.

    Of rows that are equal in every column, one is kept. Only rows that occur more than once are moved for that.
    """
    classes = simhash_components(docs, text=text, key=key, shingle=shingle, distance=distance)
    kept = classes.filter("first").groupBy("key", "row_hash").agg(F.count(F.lit(1)).alias("copies"))
    boxes = docs.select(boxed(docs).alias("row"), col(key).alias("key"), row_hash(docs).alias("row_hash"))
    match = lambda k: boxes.join(
        k.select(F.col("key").alias("kept_key"), F.col("row_hash").alias("kept_hash")),
        F.col("key").eqNullSafe(F.col("kept_key")) & (F.col("row_hash") == F.col("kept_hash")),
        "left_semi",
    )
    kept = materialize(kept, "kept")
    out = match(kept.filter("copies = 1"))
    repeated = kept.filter("copies > 1")
    if not repeated.isEmpty():
        out = out.union(match(repeated).dropDuplicates(["key", "row_hash"]))
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
