"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dugout.llm.common import boxed, col, row_hash
from dugout.sources.scratch import materialize

SHINGLE, THRESHOLD = 5, 0.8
#: Hash functions of a signature; each is a band of its own, as five-word shingles are rare enough.
HASHES = 32
#: Size classes (in shingles) end at these sizes times a power of two: 8, 11, 16, 22, 32, ...
BASES = (8, 11)
#: Bits of a table that tells which signature values, or shingles, items have; fixed, whatever the number of items.
TABLE_BITS = 26
#: Word hashes kept by a worker before it starts anew; shingles handled at once.
WORDS_KEPT, PIECE = 1 << 20, 1 << 17

_SPACED = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_ODD = np.random.default_rng(3).integers(1 << 62, size=SHINGLE + HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def words_of(text: str | None) -> list[bytes]:
    """Runs of letters, digits and characters beyond ASCII, A-Z as a-z."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_SPACED).split()


def gram_hashes(words: list[bytes], width: int, known: _WordHashes) -> np.ndarray:
    """Hash of each run of so many words in turn, which depends on the width too; fewer words have none."""
    n = len(words) - width + 1
    if n < 1:
        return np.array([], dtype=np.uint64)
    each = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    out = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        out += (each[k : k + n] ^ (each[k : k + n] >> np.uint64(31))) * _ODD[k]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def size_class(shingles: int) -> int:
    """The smallest end of a class that holds an item of so many shingles."""
    doublings = 0
    while BASES[-1] << doublings < shingles:
        doublings += 1
    return next(b << doublings for b in BASES if b << doublings >= shingles)


def halved(size: int) -> tuple[int, int]:
    """A class end as its base and the number of doublings."""
    doublings = 0
    while size not in BASES:
        size, doublings = size // 2, doublings + 1
    return size, doublings


def tokens(values: np.ndarray, number: int, size: int) -> np.ndarray:
    """One 64-bit token for class, hash function and signature value; non-negative."""
    band = (number + size * 0x9E3779B97F4A7C15) % (1 << 64)
    mixed = (values.astype(np.uint64) << np.uint64(31)) + np.uint64(band)
    mixed ^= mixed >> np.uint64(33)
    mixed *= np.uint64(0xC4CEB9FE1A85EC53)
    return (mixed ^ (mixed >> np.uint64(29))) >> np.uint64(1)


def block_starts(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of blocks of so many rows within runs of these lengths, and the blocks of each run."""
    blocks = -(-lengths // size)
    first = np.cumsum(blocks) - blocks
    return np.repeat(np.cumsum(lengths) - lengths - first * size, blocks) + np.arange(blocks.sum()) * size, blocks


def windows(hashes: np.ndarray, lengths: np.ndarray, sizes: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each class size: tokens (hash function, window), and the run and number of each window.

    hashes are the shingles of many runs, one behind the other. A window is two neighbouring blocks of the class size
    (a run of one block is one window), so any stretch of up to that size lies within a window. Smallest values of
    larger blocks come from those of the blocks they are made of.
    """
    plan: dict[int, list] = {}
    deepest = {base: max((halved(s)[1] for s in sizes if halved(s)[0] == base), default=-1) for base in BASES}
    for base, levels in deepest.items():
        runs = lengths
        for level in range(levels + 1):
            starts, runs = block_starts(runs, base if level == 0 else 2)
            last = np.zeros(len(starts), bool)
            last[np.cumsum(runs) - 1] = True
            alone = np.repeat(runs == 1, runs)
            kept = np.flatnonzero(~last | alone)
            of = np.repeat(np.arange(len(runs)), runs)
            number = np.arange(len(starts)) - np.repeat(np.cumsum(runs) - runs, runs)
            size = base << level
            out = np.empty((HASHES, len(kept)), np.uint64) if size in sizes else None
            plan[size] = [starts, alone[kept], kept, of[kept], number[kept], out]
    for j in range(HASHES):
        values = (hashes * _ODD[SHINGLE + j]) >> np.uint64(32)
        for base, levels in deepest.items():
            low = values
            for level in range(levels + 1):
                starts, alone, kept, _, _, out = plan[base << level]
                low = np.minimum.reduceat(low, starts)
                if out is not None:
                    beside = np.where(alone, low[kept], low[np.minimum(kept + 1, len(low) - 1)])
                    out[j] = tokens(np.minimum(low[kept], beside), j, base << level)
    return {size: (plan[size][5], plan[size][3], plan[size][4]) for size in sizes}


def item_tokens(items: DataFrame) -> DataFrame:
    """(mark, width, shingles, sizes, tokens) of each benchmark item (mark, text) that has a word.

    shingles are the hashes of its distinct five-word shingles; an item of fewer words is one shingle of that width,
    without classes. sizes are its classes, tokens its signature in each. The class is that of its length in shingles,
    as windows are stretches of a text; an item that repeats itself is also in the class of its distinct ones, as the
    long windows of the other hold few of them.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in batches:
            at, widths, distinct, classes, found = [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                words = words_of(text)
                if not words:
                    continue
                width = min(SHINGLE, len(words))
                hashes = gram_hashes(words, width, known)
                own = np.unique(hashes)
                sizes = sorted({size_class(len(hashes)), size_class(len(own))}) if width == SHINGLE else []
                lowest = [np.min((own * _ODD[SHINGLE + j]) >> np.uint64(32), keepdims=True) for j in range(HASHES)]
                at.append(i)
                widths.append(width)
                distinct.append(own.view(np.int64).tolist())
                classes.append(sizes)
                found.append([int(tokens(low, j, size)[0]) for size in sizes for j, low in enumerate(lowest)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("mark").take(pa.array(at, pa.int64())), pa.array(widths, pa.int32()),
                    pa.array(distinct, pa.list_(pa.int64())), pa.array(classes, pa.list_(pa.int32())),
                    pa.array(found, pa.list_(pa.int64())),
                ],
                names=["mark", "width", "shingles", "sizes", "tokens"],
            )

    return items.select("mark", "text").mapInArrow(
        sign, "mark long, width int, shingles array<long>, sizes array<int>, tokens array<long>"
    )


def bit_table(values: DataFrame) -> np.ndarray:
    """Which low bits the numbers of the only column have, joined to words of 64 bits before they reach the driver."""
    slot = F.col(values.columns[0]).bitwiseAND(F.lit((1 << TABLE_BITS) - 1))
    words = (
        values.select(slot.alias("slot"))
        .groupBy(F.shiftright("slot", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, int(slot & 63))")).alias("bits"))
        .toPandas()
    )
    bits = np.zeros(1 << TABLE_BITS - 6, dtype="<i8")
    bits[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return bits.view(np.uint8)


def met(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether the table has each number."""
    slot = values & np.uint64((1 << TABLE_BITS) - 1)
    return (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0


def searcher(sizes: list[int], widths: list[int], inside: bool, tables):
    """Of each text that may hold items: tokens of its windows, and shingles, that some item may have too, each once.

    widths: those of the items of fewer than five words, whose runs of words are looked for anywhere in a text
    (inside), or only in texts of just so many words. tables: bits of the items' tokens and of their shingles.
    """
    overlap = 2 * max(sizes, default=0) + SHINGLE

    def runs(texts: list[str | None]) -> Iterator[list[tuple[int, list[bytes]]]]:
        """(text, words) in groups of bounded size; pieces of a long text overlap by the largest window."""
        group: list[tuple[int, list[bytes]]] = []
        size = 0
        for i, text in enumerate(texts):
            words = words_of(text)
            for start in range(0, len(words), PIECE):
                if start and start + SHINGLE > len(words):
                    break  # the piece before has all that starts here
                group.append((i, words[start : start + PIECE + overlap]))
                size += len(group[-1][1])
                if size >= PIECE:
                    yield group
                    group, size = [], 0
        if group:
            yield group

    def distinct_by_run(of: list[np.ndarray], values: list[np.ndarray]) -> dict[int, list[int]]:
        of, values = np.concatenate(of), np.concatenate(values)
        out = {}
        order = np.argsort(of, kind="stable")
        texts, starts = np.unique(of[order], return_index=True)
        for i, part in zip(texts.tolist(), np.split(values[order], starts[1:])):
            out[i] = np.unique(part).astype(np.int64).tolist()
        return out

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, (bits, shingle_bits) = _WordHashes(), tables.value
        for batch in batches:
            at, found = [np.array([], np.int64)], [np.array([], np.uint64)]
            holders, held = [np.array([], np.int64)], [np.array([], np.uint64)]
            for group in runs(batch.column("text").to_pylist()):
                texts = np.array([i for i, _ in group], dtype=np.int64)
                for width in [*widths, SHINGLE]:
                    each = [
                        gram_hashes(words if width == SHINGLE or inside or len(words) == width else [], width, known)
                        for _, words in group
                    ]
                    lengths = np.array([len(h) for h in each], dtype=np.int64)
                    hashes, some = np.concatenate(each), lengths > 0
                    if width == SHINGLE and sizes and some.any():
                        owners = texts[some]
                        for marks, of, _ in windows(hashes, lengths[some], sizes).values():
                            for row in marks:
                                w = np.flatnonzero(met(bits, row))
                                at.append(owners[of[w]])
                                found.append(row[w])
                    place = np.flatnonzero(met(shingle_bits, hashes))
                    holders.append(np.repeat(texts, lengths)[place])
                    held.append(hashes[place])
            by_text, shingles_of = distinct_by_run(at, found), distinct_by_run(holders, held)
            rows = pa.array(list(shingles_of), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key").take(rows), batch.column("row_hash").take(rows),
                    pa.array([by_text.get(i, []) for i in shingles_of], pa.list_(pa.int64())),
                    pa.array(list(shingles_of.values()), pa.list_(pa.int64())),
                ],
                names=["key", "row_hash", "tokens", "held"],
            )

    return search


def find_items(
    docs: DataFrame, items: DataFrame, *, text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text",
    threshold: float = THRESHOLD, inside: bool = True,
) -> DataFrame:
    """(key, row_hash, item, containment): items of which a text holds the given share of shingles, wherever they stand.

    A short item is a small part of a long text, so the Jaccard similarity of whole texts says nothing. Items are put
    into size classes, and each text is cut, once per class in use, into overlapping windows of twice the class size.
    A text is a candidate for an item (an equality join) if one of its windows shares one of the item's 32 signature
    values. An item that stands in several parts has a chance in each window that holds a part. Each candidate is then
    verified in the whole text: the item's distinct five-word shingles (64-bit hashes), a row each, are joined to those
    the text holds, and counted. A text that holds many items costs no more than the sum of their shingles.

    Items of one to four words have no class: their words in a row are looked for anywhere in a text, or only in texts
    of just these words if not inside. Texts first pass two bit tables of fixed size, of the items' signatures and of
    their shingles, so that only what can match leaves the task. Items without a word are in no text. Null and empty
    texts hold nothing. Repeated rows give one result. Pairs of a text and an item are reported once. Empty tables give
    no rows.
    """
    spark = docs.sparkSession
    named = items.select(
        col(item).alias("item"), col(item_text).alias("text"), F.xxhash64(col(item), col(item_text)).alias("mark")
    ).dropDuplicates(["mark"])
    signed = materialize(item_tokens(named.filter("text is not null")), "item-tokens")
    sizes = sorted(r[0] for r in signed.select(F.explode("sizes")).distinct().collect())
    widths = sorted(r[0] for r in signed.filter(F.col("width") < SHINGLE).select("width").distinct().collect())
    keyed = docs.select(col(key).alias("key"), row_hash(docs).alias("row_hash"), col(text).alias("text"))
    kind = keyed.schema["key"].dataType.simpleString()
    shape = f"key {kind}, row_hash long, tokens array<long>, held array<long>"
    if not sizes and not widths:
        found = spark.createDataFrame([], shape)
    else:
        tables = spark.sparkContext.broadcast(tuple(bit_table(signed.select(F.explode(c))) for c in ("tokens", "shingles")))
        search = searcher(sizes, widths, inside, tables)
        found = materialize(keyed.filter("text is not null").mapInArrow(search, shape), "item-texts")
    met_by_windows = (
        found.select("key", "row_hash", F.explode("tokens").alias("token"))
        .join(signed.select("mark", F.explode("tokens").alias("token")), "token")
        .select("key", "row_hash", "mark")
        .distinct()
    )
    held = found.select(F.col("key").alias("held_key"), F.col("row_hash").alias("held_hash"), F.explode("held").alias("held")).distinct()
    wanted = met_by_windows.join(signed.select("mark", "shingles"), "mark").select(
        "key", "row_hash", "mark", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle")
    )
    long_ones = (
        wanted.join(
            held,
            F.col("key").eqNullSafe(F.col("held_key")) & (F.col("row_hash") == F.col("held_hash")) & (F.col("shingle") == F.col("held")),
        )
        .groupBy("key", "row_hash", "mark")
        .agg((F.count(F.lit(1)) / F.first("n")).alias("containment"))
        .filter(F.col("containment") >= threshold)
    )
    short_ones = held.join(
        signed.filter(F.col("width") < SHINGLE).select("mark", F.col("shingles")[0].alias("held")), "held"
    ).select(F.col("held_key").alias("key"), F.col("held_hash").alias("row_hash"), "mark", F.lit(1.0).alias("containment"))
    return (
        long_ones.unionByName(short_ones)
        .join(named.select("mark", "item"), "mark")
        .groupBy("key", "row_hash", "item")
        .agg(F.max("containment").alias("containment"))
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, *, text: str = "text", key: str = "doc_id", **names: str) -> DataFrame:
    """docs without the rows that hold an item.

    An item of one to four words, such as a number, stands in many clean texts; it drops only texts of just its words.
    """
    hits = find_items(docs, items, text=text, key=key, inside=False, **names).select(
        F.col("key").alias("hit_key"), F.col("row_hash").alias("hit_hash")
    ).distinct()
    boxes = docs.select(boxed(docs).alias("row"), col(key).alias("key"), row_hash(docs).alias("row_hash"))
    kept = boxes.join(hits, F.col("key").eqNullSafe(F.col("hit_key")) & (F.col("row_hash") == F.col("hit_hash")), "left_anti")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
