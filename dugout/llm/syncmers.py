"""Document fingerprints from closed syncmers, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dugout.llm.common import col
from dugout.sources.scratch import materialize

#: Code points of a k-mer and of the substrings inside it that are compared.
K, S = 8, 5
#: Anchors in a fingerprint: those with the smallest hashes.
ANCHORS = 48
#: Code points handled at once, so that what is held of a text does not grow with it.
PIECE = 32768
#: An anchor is one long: 32 bits of hash above 31 bits of position.
PLACE_BITS = 31
HASHES = 1 << 32
#: K-mers tested at first for every anchor wanted; about half of them are closed.
SPARE = 6


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often the body and its own lambdas use it."""
    return F.transform(F.array(value), body)[0]


def is_closed(kmer: Column) -> Column:
    """Is the smallest inner substring the first or the last one? Order is that of code points."""
    inner = [F.substring(kmer, i + 1, S) for i in range(K - S + 1)]
    return F.least(inner[0], inner[-1]) <= F.least(*inner[1:-1])


def hashed(text: Column) -> Column:
    return F.xxhash64(text).bitwiseAND(F.lit(HASHES - 1))


def anchor(text: Column, place: Column) -> Column:
    return F.shiftleft(hashed(text), PLACE_BITS).bitwiseOR(place.cast("long"))


def hash_of(anchor: Column) -> Column:
    return F.shiftright(anchor, PLACE_BITS)


def place_of(anchor: Column) -> Column:
    return anchor.bitwiseAND(F.lit((1 << PLACE_BITS) - 1))


def smallest(anchors: Column) -> Column:
    """The anchors with the smallest hashes, one (the first place) per hash, ascending."""
    fresh = lambda a: F.filter(
        a, lambda x, i: (i == 0) | (hash_of(x) != hash_of(F.get(a, F.greatest(i - 1, F.lit(0)))))
    )
    return F.slice(let(F.sort_array(anchors), fresh), 1, ANCHORS)


def syncmers(text: Column, start: Column) -> Column:
    """The smallest anchors among all closed syncmers of a text that begins at that place of its document.

    The smallest hashes of a long text are far below the rest. K-mers with larger ones are passed over before they are
    tested; where that leaves too few anchors, as in texts that repeat themselves, all k-mers are tested.
    """
    length = F.greatest(F.char_length(text) - (K - 1), F.lit(1)).cast("long")
    bound = F.least(F.floor(F.lit(HASHES * ANCHORS * SPARE) / length), F.lit(HASHES)).cast("long")
    given = F.struct(text.alias("text"), start.cast("long").alias("start"), length.alias("length"), bound.alias("bound"))

    def upto(x: Column, limit: Column) -> Column:
        pieces = F.transform(
            F.sequence(F.lit(0).cast("long"), F.floor((x["length"] - 1) / PIECE)),
            lambda j: let(
                F.struct(
                    F.substring(x["text"], (j * PIECE + 1).cast("int"), F.lit(PIECE + K - 1)).alias("piece"),
                    (x["start"] + j * PIECE).alias("at"),
                ),
                lambda p: smallest(below(p["piece"], p["at"], limit)),
            ),
        )
        return smallest(F.flatten(pieces))

    def both(x: Column) -> Column:
        enough = lambda s: (F.size(s) == ANCHORS) | (x["bound"] == HASHES)
        return let(upto(x, x["bound"]), lambda s: F.when(enough(s), s).otherwise(upto(x, F.lit(HASHES))))

    return let(given, both)


def below(piece: Column, at: Column, limit: Column) -> Column:
    """Anchors of all closed syncmers of a piece whose hashes are below the limit."""
    kmers = F.regexp_extract_all(piece, F.lit(f"(?s)(?=(.{{{K}}}))."), F.lit(1))
    chosen = lambda x, i: F.when((hashed(x) < limit) & is_closed(x), anchor(x, at + i))
    return F.array_compact(F.transform(kmers, chosen))


def whole(text: Column) -> Column:
    """The one anchor of a text shorter than a k-mer; an empty text has none."""
    return F.when(text == "", F.array().cast("array<bigint>")).otherwise(F.array(anchor(text, F.lit(0))))


def joined(text: Column, left: Column, right: Column) -> Column:
    """Anchors of a text from those of its two parts: a syncmer is chosen by its own letters alone."""
    return F.when(F.char_length(text) < K, whole(text)).otherwise(smallest(F.concat(left, right)))


def likeness(a: Column, b: Column) -> Column:
    """Share of anchors two fingerprints have in common at one shift of places, 0 to 1.

    Among the smallest hashes of both together, those that both have are counted if they stand on the commonest
    diagonal, that is, at the commonest difference of places. Two empty fingerprints are alike.
    """

    def shared(both: Column) -> Column:
        ha, hb = both["ha"], both["hb"]
        near = F.slice(F.sort_array(F.array_union(ha, hb)), 1, ANCHORS)
        common = F.array_intersect(near, F.array_intersect(ha, hb))
        place = lambda own, hashes, h: place_of(F.get(both[own], (F.array_position(hashes, h) - 1).cast("int")))
        shifts = F.transform(common, lambda h: place("b", hb, h) - place("a", ha, h))
        votes = let(shifts, lambda s: F.array_max(F.transform(F.array_distinct(s), lambda x: F.size(F.filter(s, lambda y: y == x)))))
        return F.coalesce(votes, F.lit(0)) / F.size(near)

    hashes = lambda x: F.transform(x, hash_of)
    both = F.struct(a.alias("a"), b.alias("b"), hashes(a).alias("ha"), hashes(b).alias("hb"))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(let(both, shared))


def printed(anchors: Column) -> Column:
    """Sixteen hex digits per anchor."""
    return F.array_join(F.transform(anchors, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def followers(keyed: DataFrame) -> DataFrame:
    """Which text comes next: (null_key, key, h, n, times, next_null_key, next_key, next_h).

    ``keyed`` holds one row per document (null_key, key, h, n). Equal documents are one row that follows itself once
    less than it occurs, and then gives way to the next. Order is descending key, null last, then descending hash.
    The rows are range-partitioned and written with their partition; only the first row of each partition meets the
    other partitions.
    """
    name = F.struct("null_key", "key", "h")
    rows = keyed.groupBy("null_key", "key", "h").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("copies"))
    order = [F.col("null_key"), F.col("key").desc(), F.col("h").desc()]
    cut = materialize(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ordered")
    within = Window.partitionBy("part").orderBy(*order)
    placed = cut.withColumn("after", F.lead(name).over(within))
    firsts = cut.withColumn("place", F.row_number().over(within)).filter("place = 1").select("part", name.alias("first"))
    # One row per partition.
    parts = Window.orderBy("part")
    around = parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    beyond = firsts.select("part", F.coalesce(F.lead("first").over(parts), F.first("first").over(around)).alias("beyond"))
    steps = F.array_compact(
        F.array(
            F.when(F.col("copies") > 1, F.struct(name.alias("next"), (F.col("copies") - 1).alias("times"))),
            F.struct(F.coalesce("after", "beyond").alias("next"), F.lit(1).cast("long").alias("times")),
        )
    )
    return (
        placed.join(beyond, "part")
        .select("null_key", "key", "h", "n", F.explode(steps).alias("step"))
        .select(
            "null_key", "key", "h", "n", "step.times",
            *[F.col(f"step.next.{c}").alias(f"next_{c}") for c in ("null_key", "key", "h")],
        )
    )


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how alike these and the next documents are.

    Returns key, text, edited, anchors, edited_anchors (arrays of longs), near_edited, near_next. A closed syncmer is
    a k-mer whose smallest inner substring stands first or last in it. That depends on the k-mer alone, so the
    anchors of a text are those of its parts, cut with an overlap of a k-mer less one: the part that an edit keeps
    is read once for both texts. A fingerprint is the anchors with the smallest hashes, with their first places.
    The edited text has the last third of its code points replaced by as many first ones of the next document, in
    descending order of key.

    Null texts are empty, null keys come last. Repeated rows stay and follow each other. Texts shorter than a k-mer
    are one anchor, empty ones have none. A table of one document is its own next; an empty one gives no rows. Other
    columns are not read. No task holds all copies of a text or all rows of a key.
    """
    kind = docs.schema[key].dataType
    named = docs.select(
        col(key).isNull().alias("null_key"),
        F.coalesce(col(key), F.lit("0").cast(kind)).alias("key"),
        F.coalesce(col(text), F.lit("")).alias("text"),
    ).withColumn("h", F.xxhash64("text"))
    steps = followers(named.select("null_key", "key", "h", F.char_length("text").alias("n")))

    length = F.char_length("text")
    kept = length - F.floor(length / 3).cast("int")
    seam = F.greatest(kept - (K - 1), F.lit(0))
    head, tail = F.substring("text", F.lit(1), kept), F.substring("text", seam + 1, length)
    read = named.select("null_key", "key", "h", "text", syncmers(head, F.lit(0)).alias("head"), syncmers(tail, seam).alias("tail"))
    once = read.groupBy("null_key", "key", "h").agg(*[F.first(c).alias(c) for c in ("text", "head", "tail")])
    whole_text = joined(F.col("text"), F.col("head"), F.col("tail"))

    third = F.floor(F.col("n") / 3).cast("int")
    following = once.select(
        *[F.col(c).alias(f"next_{c}") for c in ("null_key", "key", "h", "text")], whole_text.alias("next_anchors")
    )
    given = steps.join(following, ["next_null_key", "next_key", "next_h"]).select(
        "null_key", "key", "h", "times", F.substring("next_text", F.lit(1), third).alias("given"), "next_anchors"
    )
    met = once.join(given, ["null_key", "key", "h"]).select(
        F.when(~F.col("null_key"), F.col("key")).alias("key"),
        "text",
        "head",
        "times",
        "next_anchors",
        whole_text.alias("anchors"),
        seam.alias("seam"),
        F.concat(head, "given").alias("edited"),
    )
    edited = F.col("edited")
    rest = syncmers(F.substring(edited, F.col("seam") + 1, F.char_length(edited)), F.col("seam"))
    marked = met.withColumn("edited_anchors", joined(edited, F.col("head"), rest))
    return marked.select(
        "key",
        "text",
        "edited",
        "anchors",
        "edited_anchors",
        likeness(F.col("anchors"), F.col("edited_anchors")).alias("near_edited"),
        likeness(F.col("anchors"), F.col("next_anchors")).alias("near_next"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("copy"),
    ).drop("copy")
