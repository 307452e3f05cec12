from __future__ import annotations

from collections import Counter

import pytest
from compare import differences, duck

import __spark_entry__ as contract
import corpus_pipeline
from dugout.llm.common import table
from dugout.llm.language import UNKNOWN
from fixtures import awkward_docs
from test_containment import plain_shingles
from test_simhash import plain_components, plain_print

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_every_operator_is_registered():
    names = contract.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10
    assert names.keys() >= {"pipeline"}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "mixing", "sharding"]


@pytest.mark.parametrize("name", ["op8_diagonal_voting", "op9_quotation_linking", "op10_systematic_mix"])
def test_queries_agree_with_sql(spark, sf_dir, name):
    assert differences(contract.queries()[name](spark, sf_dir), duck(sf_dir), contract.oracle_sql()[name]) == []


def test_stages_against_plain_loops(spark, sf_dir, tmp_path):
    docs = table(spark, sf_dir, "documents")
    items = [r["text"] for r in table(spark, sf_dir, "benchmark").collect()]
    steps = dict(corpus_pipeline.STAGES)

    def stage(name, frame):
        out = steps[name](spark, frame, sf_dir)
        out.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    known = stage("language", docs)
    assert known.columns == COLUMNS
    assert {r["doc_id"] for r in docs.collect() if any(map(str.isalpha, r["text"] or ""))} == {r["doc_id"] for r in known.collect()}

    single = stage("near_duplicates", known)
    rows = known.collect()
    prints = {r["doc_id"]: plain_print(r["text"]) for r in rows}
    distinct = sorted(set(prints.values()))
    root = plain_components(distinct, [(a, b) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if (a ^ b).bit_count() <= 3])
    least = {}
    for doc, p in prints.items():
        least[root[p]] = min(doc, least.get(root[p], doc))
    assert Counter(r["doc_id"] for r in single.collect()) == Counter(least.values())

    clean = stage("decontamination", single)
    parts = [plain_shingles(t) for t in items]

    def leaks(text):
        own = plain_shingles(text)
        return any(len(p & own) >= 0.8 * len(p) for p in parts if p)

    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in single.collect() if not leaks(r["text"])}

    mixed = stage("mixing", clean)
    copies = Counter(r["doc_id"] for r in mixed.collect())
    assert mixed.columns == COLUMNS and copies.keys() <= {r["doc_id"] for r in clean.collect()} and max(copies.values()) <= 2
    words = lambda rows: sum(len((r["text"] or "").encode().split()) for r in rows)
    assert abs(words(mixed.collect()) / words(clean.collect()) - 1.5) < 0.15

    dealt = stage("sharding", mixed)
    assert dealt.columns == [*COLUMNS, "shard", "slot"]
    assert Counter(r["doc_id"] for r in dealt.collect()) == copies
    sizes = Counter(r["shard"] for r in dealt.collect())
    assert max(sizes[s] for s in range(40)) - min(sizes[s] for s in range(40)) <= 1


def test_awkward_documents_pass(spark, sf_dir):
    docs = awkward_docs(spark)
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, sf_dir)
        assert out.columns[: len(docs.columns) - (name == "sharding")] == [c for c in docs.columns if name != "sharding" or c != "shard"]
        docs = out
    assert docs.count() > 40
    empty = awkward_docs(spark).limit(0)
    for _, step in corpus_pipeline.STAGES:
        empty = step(spark, empty, sf_dir)
    assert empty.count() == 0
    assert UNKNOWN == "und"
