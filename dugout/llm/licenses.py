"""License scans by diagonal voting."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dugout.llm.common import col

#: A word: a run of letters, digits and characters beyond ASCII, after A-Z became a-z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Share of a notice's word pairs that a span must hold, how far diagonals may shift within one, how long it may get.
MIN_SHARE, SLACK, STRETCH = 0.7, 3, 1.5


@dataclass(frozen=True)
class Template:
    """A phrase that must stand word for word (base), or a notice that may differ a little."""

    label: str
    text: str
    base: bool = False


# The base phrases, and opening words of well-known public licence notices.
TEMPLATES = (
    Template("cc-by", "cc by", base=True),
    Template("gpl", "general public license", base=True),
    Template("reserved", "all rights reserved", base=True),
    Template("apache", "licensed under the apache license version 2 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("cc-by-nc", "licensed under cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa"),
    Template("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    Template("gpl-notice", "this work is licensed under the gnu general public license version 3"),
    Template("lgpl", "under the terms of the gnu lesser general public license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("mit", "released under the mit license"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license"),
    Template("public-domain", "this is free and unencumbered software released into the public domain"),
)


def pairs(templates: tuple[Template, ...]) -> list[tuple[int, int, str, str]]:
    """(template, place, word, next word) of each word pair."""
    out = []
    for number, t in enumerate(templates):
        words = t.text.split()
        if not 2 <= len(words) <= 63:
            raise ValueError("a template has 2 to 63 words")
        out += [(number, i, a, b) for i, (a, b) in enumerate(zip(words, words[1:]))]
    return out


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def scan(
    spark: SparkSession, docs: DataFrame, *, text: str = "text", key: str = "doc_id", templates: tuple[Template, ...] = TEMPLATES
) -> DataFrame:
    """Licence phrases and notices of each row: key, n_words, n_base, first_word, last_word, base_labels, labels, score.

    All word pairs of all texts meet the templates' pairs in a broadcast join (the templates are a fixed list) on the
    pair's hash and words. A hit votes for the diagonal word place - template place; votes are aggregated by document,
    template and diagonal, as a bit per template place. A base phrase stands wherever one diagonal holds all its
    places. For notices, diagonals with at least two votes that lie within SLACK words of each other are merged, and
    the span is verified: at least MIN_SHARE of the notice's pairs, and no longer than STRETCH times the notice.

    n_base counts all places of base phrases; first_word and last_word are their smallest and largest start or null;
    score is the largest share of a template found, 1 for a base phrase. Null and empty texts, and texts without a
    template, have a row with no labels and score 0. Repeated rows are scanned each on its own; a number given to
    each row while it is read keeps them apart.
    """
    numbered = [(n, i, a, b, t.label, t.base, len(t.text.split()) - 1) for n, i, a, b in pairs(templates) for t in [templates[n]]]
    grams = spark.createDataFrame(
        numbered, "template int, place int, first string, second string, label string, base boolean, pairs int"
    ).withColumn("gram", F.xxhash64("first", "second"))
    every = docs.select(
        F.monotonically_increasing_id().alias("row"), col(key).alias("key"), words(col(text)).alias("words")
    )
    # the pair that ends in the first word has no word before it and matches nothing: it stands for the row itself
    behind = F.concat(F.array(F.lit(None).cast("string")), F.col("words"))
    placed = every.select(
        "row", "key", F.size("words").cast("long").alias("n_words"),
        F.posexplode(F.arrays_zip(behind.alias("a"), F.col("words").alias("b"))).alias("at", "pair"),
    ).select("row", "key", "n_words", (F.col("at") - 1).alias("at"), F.col("pair.a").alias("a"), F.col("pair.b").alias("b"))
    votes = (
        placed.join(
            F.broadcast(grams),
            (F.xxhash64("a", "b") == F.col("gram")) & (F.col("a") == F.col("first")) & (F.col("b") == F.col("second")),
            "left",
        )
        .filter(F.col("template").isNotNull() | (F.col("at") < 0))
        .withColumn("diagonal", F.col("at") - F.col("place"))
        .groupBy("row", "template", "diagonal")
        .agg(
            F.first("key").alias("key"), F.first("n_words").alias("n_words"),
            F.first("label").alias("label"), F.first("base").alias("base"), F.first("pairs").alias("pairs"),
            F.bit_or(F.expr("shiftleft(1L, place)")).alias("bits"), F.min("at").alias("from"), F.max("at").alias("to"),
        )
    )
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    joins = ~F.col("base") & (F.bit_count("bits") >= 2)
    near = F.coalesce(F.col("diagonal") - F.lag("diagonal", 1).over(along) <= SLACK, F.lit(False))
    useful = votes.filter(F.col("template").isNull() | F.col("base") | joins)
    notice = ~F.col("base") & (F.col("share") >= MIN_SHARE) & (F.col("to") - F.col("from") + 2 <= (F.col("pairs") + 1) * F.lit(STRETCH))
    spans = (
        useful.withColumn("group", F.sum(F.when(near & ~F.col("base"), 0).otherwise(1)).over(along))
        .groupBy("row", "template", "group")
        .agg(
            F.first("key").alias("key"), F.first("n_words").alias("n_words"),
            F.first("label").alias("label"), F.first("base").alias("base"), F.first("pairs").alias("pairs"),
            F.bit_count(F.bit_or("bits")).alias("held"), F.min("from").alias("from"), F.max("to").alias("to"),
        )
        .withColumn("share", F.col("held") / F.col("pairs"))
        .filter(F.col("template").isNull() | (F.col("base") & (F.col("held") == F.col("pairs"))) | notice)
    )
    return (
        spans.groupBy("row")
        .agg(
            F.first("key").alias("key"), F.first("n_words").alias("n_words"),
            F.count(F.when(F.col("base"), 1)).alias("n_base"),
            F.min(F.when(F.col("base"), F.col("from"))).cast("long").alias("first_word"),
            F.max(F.when(F.col("base"), F.col("from"))).cast("long").alias("last_word"),
            F.concat_ws(",", F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label"))))).alias("base_labels"),
            F.concat_ws(",", F.array_sort(F.collect_set("label"))).alias("labels"),
            F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
        )
        .drop("row")
    )
