"""Small awkward inputs: nulls, empty and long texts, repeated rows, and columns named like those operators add."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, row string, shard string, draw int"
LONG = " ".join(f"w{i % 997} x{i % 89}" for i in range(20_000))


def awkward_docs(spark):
    rng = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "Épsilon", "zeta", "eta", "theta", "iota", "kappa"]
    text = lambda n: " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))
    rows = [(i, text(rng.randrange(1, 60)), "en", f"s{i % 3}", 1, 0, "r", "z", 1) for i in range(60)]
    rows += [(100, None, None, None, None, None, None, None, None), (101, "", "en", "s0", 0, 0, "", "", 0)]
    rows += [(102, " \n\t", "en", None, 3, 0, "", "", 0), (None, "no key here", None, "s1", 1, 1, "", "", 0)]
    rows += [(103, LONG, "en", "s2", len(LONG), 0, "", "", 0), (104, "same text", "en", "s0", 9, 0, "", "", 0)]
    rows += [(105, "same text", "en", "s0", 9, 0, "", "", 0)] + [(106, "again and again", "de", "s1", 1, 1, "q", "q", 1)] * 3
    return spark.createDataFrame(rows, DOCS)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)
