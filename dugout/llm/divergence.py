"""How the sources of a language differ from it and from each other, term by term."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dugout.llm.common import col
from dugout.sources.scratch import materialize

#: Bytes of a term: ASCII letters, upper case as lower case, and all that is not ASCII; others stand between terms.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Documents of a language that a kept term stands in.
MIN_DOCS = 3
#: Shares are whole numbers of this part.
SCALE = 1_000_000_000
#: Terms of one block of the matrix, and sources of one tile of its columns.
BLOCK, TILE = 512, 64
#: Counted terms a task holds before it hands them on, and texts read at once.
HELD, SLICE = 400_000, 256

COUNTS_SCHEMA = "lang string, source string, term string, n long, docs long"
JOINT_SCHEMA = "lang string, a int, level_a long, b int, level_b long, n long"


def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by language and source, added up within the task."""
    n: dict = defaultdict(Counter)
    docs: dict = defaultdict(Counter)
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), own in n.items():
            seen = docs[lang, source]
            if own:
                columns = [pa.array([lang] * len(own), pa.string()), pa.array([source] * len(own), pa.string())]
                columns.append(pa.array(own.keys(), pa.binary()).cast(pa.string()))
                columns += [pa.array(own.values(), pa.int64()), pa.array(map(seen.__getitem__, own), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
        n.clear(), docs.clear()

    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            rows = batch.slice(at, SLICE)
            texts = rows.column(2).cast(pa.binary()).to_pylist()
            for lang, source, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), texts):
                own = n[lang, source]
                before = len(own)
                words = text.translate(TERM_BYTES).split()
                own.update(words)
                docs[lang, source].update(set(words))
                held += len(own) - before
                if held > HELD:
                    yield from flush()
                    held = 0
    yield from flush()


def term_cells(named: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, term, cells, n_lang) of kept terms: cells is an array of (source number, occurrences).

    Tasks have added up their texts before, so a term is dealt once, with all its sources.
    """
    parts = named.select("lang", "source", "text").mapInArrow(counted, COUNTS_SCHEMA)
    dealt = parts.join(groups.select("lang", "source", "number"), ["lang", "source"]).repartition("lang", "term")
    cells = dealt.groupBy("lang", "term", "number").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return (
        cells.groupBy("lang", "term")
        .agg(
            F.collect_list(F.struct("number", "n")).alias("cells"),
            F.sum("n").alias("n_lang"),
            F.sum("docs").alias("docs"),
        )
        .filter(F.col("docs") >= MIN_DOCS)
        .drop("docs")
    )


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + terms)), exactly."""
    wide = (n + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.lit(1).cast("long") + F.call_function("div", wide, (total + terms).cast("decimal(20,0)"))


def price(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q), exactly; shares are at most SCALE + 1, so the square is a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def block_tables(key: tuple, rows: pd.DataFrame, tile: int) -> pd.DataFrame:
    """Joint tables of one block of terms for the sources of two tiles.

    One column per (source, count level) says which terms have that count in that source, level 0 included. The
    matrix of these columns times its transpose counts the terms for every two columns.
    """
    lang, _, tile_a, tile_b, sources = key
    spans = [np.arange(t * tile, min((t + 1) * tile, sources)) for t in (tile_a, tile_b)]
    members = spans[0] if tile_a == tile_b else np.concatenate(spans)
    place = {int(s): i for i, s in enumerate(members)}
    counts = np.zeros((len(rows), len(members)), dtype=np.int64)
    for r, (owners, ns) in enumerate(zip(rows["sources"], rows["counts"])):
        for s, n in zip(owners, ns):
            at = place.get(int(s))
            if at is not None:
                counts[r, at] = n
    levels, hot, owner = [], [], []
    for i in range(len(members)):
        own, inverse = np.unique(counts[:, i], return_inverse=True)
        levels.append(own)
        hot.append((inverse.ravel()[:, None] == np.arange(len(own))).astype(np.float32))
        owner.append(np.full(len(own), i))
    matrix, level, column_of = np.hstack(hot), np.concatenate(levels), np.concatenate(owner)
    out = []
    for i in range(len(spans[0])):
        # Each pair of sources once: within one tile the later ones, else those of the other tile.
        later = column_of > (i if tile_a == tile_b else len(spans[0]) - 1)
        if not later.any():
            continue
        product = hot[i].T @ matrix[:, later]
        at, to = np.nonzero(product)
        out.append((members[i], levels[i][at], members[column_of[later][to]], level[later][to], product[at, to]))
    columns = [np.concatenate([np.broadcast_to(o[c], o[4].shape) for o in out] or [np.empty(0)]) for c in range(5)]
    named = dict(zip(("a", "level_a", "b", "level_b", "n"), columns))
    kinds = {"a": "int32", "level_a": "int64", "b": "int32", "level_b": "int64", "n": "int64"}
    return pd.DataFrame(named).astype(kinds).assign(lang=lang)[["lang", "a", "level_a", "b", "level_b", "n"]]


def joint_tables(kept: DataFrame, langs: DataFrame, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """(lang, a, level_a, b, level_b, n): terms of a language with these counts in sources number a and b, a < b.

    ``kept`` holds (lang, term, cells), ``langs`` (lang, sources, terms). A language's terms are dealt into blocks of
    bounded size and its sources into tiles; each block meets each pair of tiles once, and the products of the blocks
    are added up.
    """
    tiles = F.ceil(F.col("sources") / tile).cast("int") - 1
    dealt = (
        kept.join(langs.select("lang", F.col("sources"), "terms"), "lang")
        .withColumn("block", F.pmod(F.xxhash64("term"), F.ceil(F.col("terms") / block)).cast("long"))
        .withColumn("tile_a", F.explode(F.sequence(F.lit(0), tiles)))
        .withColumn("tile_b", F.explode(F.sequence(F.col("tile_a"), tiles)))
        .select(
            "lang", "block", "tile_a", "tile_b", F.col("sources").alias("n_sources"),
            F.col("cells.number").alias("sources"), F.col("cells.n").alias("counts"),
        )
    )
    keys = ["lang", "block", "tile_a", "tile_b", "n_sources"]
    blocks = dealt.groupBy(*keys).applyInPandas(lambda key, rows: block_tables(key, rows, tile), JOINT_SCHEMA)
    return blocks.groupBy("lang", "a", "level_a", "b", "level_b").agg(F.sum("n").alias("n"))


def audit(
    docs: DataFrame, *, top: int = 200, text: str = "text", lang: str = "lang", source: str = "source",
    block: int = BLOCK, tile: int = TILE,
) -> DataFrame:
    """(lang, source, part, item, value, rank): divergence of each source from the others and from its language.

    Part ``pair``: item is another source of the language, value the sum over the language's kept terms of
    floor((p - q)^2 / q), p the source's share of the term and q the other's. A share depends on the term's count
    alone, so the sum runs over the joint table of the two sources' count levels, not over terms. Part ``term``:
    item is a term that the source has and uses more than its language does, value the same figure against the
    language, the ``top`` largest. All arithmetic is on whole numbers.

    Null text, language and source are ''. Groups without terms take part with counts of 0; a language without kept
    terms has pairs of value 0. Repeated documents count each time. An empty table gives no rows. Texts are counted
    within tasks before anything is shuffled, so a group with a third of all rows is a few rows per task by then.
    """
    named = docs.select(*[F.coalesce(col(c), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    own = Window.partitionBy("lang")
    sources = (
        named.select("lang", "source").distinct()
        .withColumn("number", (F.row_number().over(own.orderBy("source")) - 1).cast("int"))
        .withColumn("sources", F.count(F.lit(1)).over(own).cast("int"))
    )
    sources = materialize(sources, "sources")
    rows = materialize(term_cells(named, sources), "kept")
    langs = rows.groupBy("lang").agg(F.sum("n_lang").alias("lang_total"), F.count(F.lit(1)).alias("terms"))
    kept = rows.select("lang", "term", "n_lang", F.explode("cells").alias("cell")).select("lang", "term", "n_lang", "cell.*")
    totals = kept.groupBy("lang", "number").agg(F.sum("n").alias("total"))
    groups = (
        sources.join(totals, ["lang", "number"], "left")
        .join(langs, "lang", "left")
        .fillna(0, ["total", "lang_total", "terms"])
    )
    groups = materialize(groups, "groups")

    joint = materialize(joint_tables(rows, groups.select("lang", "sources", "terms").distinct(), block, tile), "joint")
    side = lambda x: groups.select(
        "lang", F.col("number").alias(x), F.col("source").alias(f"source_{x}"), F.col("total").alias(f"total_{x}"),
        *(["terms"] if x == "a" else []),
    )
    shared = joint.join(side("a"), ["lang", "a"]).join(side("b"), ["lang", "b"])
    p_a = share(F.col("level_a"), F.col("total_a"), F.col("terms"))
    p_b = share(F.col("level_b"), F.col("total_b"), F.col("terms"))
    priced = (
        shared.withColumns({"p_a": p_a, "p_b": p_b})
        .groupBy("lang", "source_a", "source_b")
        .agg(
            F.sum(F.col("n") * price(F.col("p_a"), F.col("p_b"))).alias("of_a"),
            F.sum(F.col("n") * price(F.col("p_b"), F.col("p_a"))).alias("of_b"),
        )
    )
    both = F.explode(
        F.array(
            F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item"), F.col("of_a").alias("value")),
            F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item"), F.col("of_b").alias("value")),
        )
    )
    pairs = priced.select("lang", both.alias("x")).select("lang", "x.*")
    # A language without kept terms has no joint table: its sources do not differ.
    bare = groups.filter("terms = 0").select("lang", "source")
    other = bare.withColumnRenamed("source", "item")
    pairs = pairs.unionByName(
        bare.join(other, "lang").filter("source <> item").withColumn("value", F.lit(0).cast("long"))
    )
    order = [F.col("value").desc(), F.col("item")]
    by_group = Window.partitionBy("lang", "source").orderBy(*order)
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_group).alias("rank"))

    p = share(F.col("n"), F.col("total"), F.col("terms"))
    q = share(F.col("n_lang"), F.col("lang_total"), F.col("terms"))
    ahead = (
        kept.join(groups, ["lang", "number"])
        .withColumns({"p": p, "q": q})
        .filter("p > q")
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), price(F.col("p"), F.col("q")).alias("value"))
        .withColumn("rank", F.row_number().over(by_group))
        .filter(F.col("rank") <= top)
    )
    return pairs.unionByName(ahead)
