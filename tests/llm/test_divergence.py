from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from compare import differences, duck
from fixtures import awkward_docs, empty_docs

import __spark_entry__ as contract
from dugout.llm.divergence import audit, block_tables

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def plain(rows: list[tuple], top: int = 200) -> list[tuple]:
    """rows of (text, lang, source)"""
    lower = {c: c + 32 for c in range(65, 91)}
    rows = [(Counter(re.findall(TERM, (t or "").translate(lower))), lang or "", source or "") for t, lang, source in rows]
    out = []
    for lang in {r[1] for r in rows}:
        docs, whole, own = Counter(), Counter(), {}
        for words, at, source in rows:
            if at == lang:
                docs.update(words.keys())
                whole.update(words)
                own.setdefault(source, Counter()).update(words)
        kept = [t for t in docs if docs[t] >= 3]

        def shares(counts, kept=kept):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (total + len(kept)) for t in kept}

        q = shares(whole)
        p = {s: shares(own[s]) for s in own}
        for s in own:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in own if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t) for t in kept if own[s][t] > 0 and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item, -value, i + 1) for i, (value, item) in enumerate(found)]
    return sorted(out)


def found(df) -> list[tuple]:
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def made(seed: int, docs: int, sources: int):
    rng = random.Random(seed)
    words = [f"wörd{c}" for c in "abcdefghijklmnop"] + ["The", "OF", "a"]
    rows = []
    for _ in range(docs):
        text = " ".join(rng.choices(words, weights=range(1, 20), k=rng.randrange(0, 30)))
        rows.append((text, rng.choice(["en", "de", None]), f"s{int(rng.random() ** 2 * sources)}"))
    return rows + [("only here", "xx", "s1"), (None, "xx", "s2"), ("123 !", "zz", None)]


@pytest.mark.parametrize(("block", "tile"), [(512, 64), (3, 2), (1, 1)])
def test_blocks_and_tiles_agree_with_plain_loops(spark, block, tile):
    rows = made(4, 200, 7)
    frame = spark.createDataFrame(rows, "text string, lang string, source string")
    assert found(audit(frame, block=block, tile=tile)) == plain(rows)
    assert found(audit(frame, top=2, block=block, tile=tile)) == plain(rows, 2)


def test_awkward_documents(spark):
    docs = awkward_docs(spark)
    assert found(audit(docs)) == plain([(r.text, r.lang, r.source) for r in docs.collect()])
    assert found(audit(empty_docs(spark))) == []


def test_random_documents_against_sql(spark):
    rows = made(8, 150, 4)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    got = audit(spark.createDataFrame(rows, "text string, lang string, source string"))
    assert differences(got, con, contract.oracle_sql()["op13_one_hot_levels"]) == []


def test_query_against_sql(spark, sf_dir):
    got = contract.queries()["op13_one_hot_levels"](spark, sf_dir)
    assert differences(got, duck(sf_dir), contract.oracle_sql()["op13_one_hot_levels"]) == []


def test_products_count_terms():
    """Each cell of a joint table is the number of terms with these two counts."""
    counts = np.random.default_rng(1).integers(0, 4, (40, 3))
    rows = pd.DataFrame({"sources": [np.flatnonzero(c) for c in counts], "counts": [c[c > 0] for c in counts]})
    table = block_tables(("en", 0, 0, 0, 3), rows, 64)
    assert len(table) == len(table.drop_duplicates(["a", "level_a", "b", "level_b"]))
    for r in table.itertuples():
        assert r.n == ((counts[:, r.a] == r.level_a) & (counts[:, r.b] == r.level_b)).sum()
    assert table["n"].sum() == 40 * 3
