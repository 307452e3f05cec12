from __future__ import annotations

import random
import time
from collections import Counter

import numpy as np

from dugout.llm import containment
from dugout.llm.containment import drop_contaminated, find_items, halved, size_class, windows, words_of
from fixtures import LONG, awkward_docs, empty_docs

ITEMS = "item_id long, text string, containment string"


def plain_shingles(text):
    """Fewer than five words are one shingle."""
    words = [w.decode() for w in words_of(text)]
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def inputs(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(rng.randrange(15, 70))) for i in range(20)]
    docs = [(i, text(rng.randrange(5, 400))) for i in range(40)]
    for i, (item, passage) in enumerate(items):
        before, after = text(rng.randrange(0, 3000)), text(rng.randrange(0, 300))
        docs.append((100 + i, f"{before} {passage.upper()}. {after}"))
        words = passage.split()
        docs.append((200 + i, f"{before} {' '.join(words[: len(words) * 9 // 10])}, {after}"))
        docs.append((300 + i, f"{after} {' '.join(words[: len(words) // 2])} {before}"))
        docs.append((400 + i, f"{' '.join(words[:-1])} {word()} {word()} {' '.join(words[-1:])}"))
    return items, docs


def test_against_all_pairs(spark):
    items, docs = inputs(spark)
    frame = spark.createDataFrame([(i, t, "s") for i, t in docs], "doc_id long, text string, item string").repartition(5)
    found = {(r["key"], r["item"]): r["containment"] for r in find_items(frame, spark.createDataFrame([(i, t, "") for i, t in items], ITEMS)).collect()}
    wanted = {}
    for d, text in docs:
        own = plain_shingles(text)
        for i, passage in items:
            part = plain_shingles(passage)
            share = len(part & own) / len(part)
            if share >= 0.8:
                wanted[d, i] = share
    assert found.keys() == wanted.keys() and len(wanted) >= 40
    assert all(abs(found[k] - wanted[k]) < 1e-9 for k in found)


def test_items_that_repeat_themselves_or_stand_in_parts(spark):
    """Contained in the whole text, though in none of its windows; verified by plain shingles."""
    words = [f"w{i}" for i in range(60)]
    repeating = " ".join([*words[:30], *["again"] * 200, *words[30:]])
    split = [f"s{i}" for i in range(59)]
    between = lambda k, n: " ".join(f"b{k}x{i}" for i in range(n))
    many = [f"m{i}" for i in range(200)]
    parts = [" ".join(many[i : i + 40]) for i in range(0, 200, 40)]
    docs = [
        (1, f"{between(1, 500)} {repeating} {between(2, 500)}"),
        (2, f"{between(3, 300)} {' '.join(split[:30])} {between(4, 150)} {' '.join(split[30:])} {between(5, 40)}"),
        (3, " ".join(f"{between(6 + i, 3000)} {p}" for i, p in enumerate(parts))),
        (4, f"{' '.join(split[:30])} {between(20, 150)}"),
        (5, " ".join(["again"] * 300)),
    ]
    items = [(1, repeating), (2, " ".join(split)), (3, " ".join(many))]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = {(r["key"], r["item"]): r["containment"] for r in find_items(frame, spark.createDataFrame([(i, t, "") for i, t in items], ITEMS)).collect()}
    shares = {
        (d, i): len(plain_shingles(item) & plain_shingles(text)) / len(plain_shingles(item)) for d, text in docs for i, item in items
    }
    wanted = {k: share for k, share in shares.items() if share >= 0.8}
    assert wanted.keys() == {(1, 1), (2, 2), (3, 3)} and found.keys() == wanted.keys()
    assert all(abs(found[k] - wanted[k]) < 1e-9 for k in found)


def test_windows_alone_find_the_candidates(spark):
    """Recall over all pairs: verbatim, edited down to 0.8, in two parts, and of items that repeat themselves."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    some = lambda n: [word() for _ in range(n)]
    items, docs, verbatim = [], [], set()
    for i in range(150):
        words = some(rng.randrange(15, 120))
        if i % 5 == 0:
            words = [*words[:10], *["on"] * rng.randrange(5, 200), *words[10:]]
        items.append((i, " ".join(words), ""))
        cut = rng.randrange(5, len(words) - 5)
        keep = len(words) - (len(words) - 4) // 6
        for kind, parts in enumerate(([*words], [*words[:cut], *some(rng.randrange(1, 400)), *words[cut:]], words[:keep])):
            docs.append((i * 10 + kind, " ".join([*some(rng.randrange(0, 600)), *parts, *some(rng.randrange(0, 600))])))
        verbatim.add((i * 10, i))
    wanted = set()
    own = {i: plain_shingles(t) for i, t, _ in items}
    for d, text in docs:
        held = plain_shingles(text)
        wanted |= {(d, i) for i, part in own.items() if len(part & held) >= 0.8 * len(part)}
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    found = {(r["key"], r["item"]) for r in find_items(frame, spark.createDataFrame(items, ITEMS)).collect()}
    assert found <= wanted and verbatim <= found and len(wanted) > 380
    assert len(found) >= 0.98 * len(wanted)


def test_one_text_of_many_items(spark):
    items = [(i, " ".join(f"i{i}x{k}" for k in range(40)), "") for i in range(5000)]
    docs = [(1, " ".join(t for _, t, _ in items)), (2, items[7][1])]
    begin = time.monotonic()
    found = find_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEMS))
    assert Counter(r["key"] for r in found.collect()) == {1: 5000, 2: 1}
    assert time.monotonic() - begin < 60


def test_items_of_few_words(spark):
    items = [(1, "Forty two!", ""), (2, "yes", ""), (3, "one two three four", ""), (4, "two three four", "")]
    docs = [(1, "it is forty-two, she said"), (2, "Yes"), (3, "yes or no"), (4, "zero one two three four five"), (5, "forty and two"), (6, LONG + " forty two")]
    frame, marks = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEMS)
    found = {(r["key"], r["item"], r["containment"]) for r in find_items(frame, marks).collect()}
    assert found == {(1, 1, 1.0), (2, 2, 1.0), (3, 2, 1.0), (4, 3, 1.0), (4, 4, 1.0), (6, 1, 1.0)}
    assert {r["doc_id"] for r in drop_contaminated(frame, marks).collect()} == {1, 3, 4, 5, 6}


def test_pieces_of_long_texts(spark, monkeypatch):
    """The passage stands across the border of two pieces of a long text."""
    passage = " ".join(f"p{i}" for i in range(40))
    docs = [(1, f"{LONG} {passage} {LONG}")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(7, passage, "")], ITEMS)
    assert [(r["key"], r["item"], r["containment"]) for r in find_items(frame, items).collect()] == [(1, 7, 1.0)]


def test_windows_of_many_runs():
    """Against windows taken one by one."""
    rng = np.random.default_rng(4)
    lengths = np.array([1, 7, 8, 9, 16, 17, 31, 64, 200, 1, 90])
    hashes = rng.integers(0, 1 << 63, lengths.sum()).astype(np.uint64)
    ends = np.cumsum(lengths)
    for size, (marks, of, number) in windows(hashes, lengths, [8, 22, 32]).items():
        wanted = [(r, w) for r, n in enumerate(lengths) for w in range(max(1, -(-n // size) - 1))]
        assert list(zip(of.tolist(), number.tolist())) == wanted
        for k, (r, w) in enumerate(wanted):
            own = hashes[ends[r] - lengths[r] : ends[r]][w * size : (w + 2) * size]
            for j in (0, 7, 31):
                low = np.min((own * containment._ODD[5 + j]) >> np.uint64(32), keepdims=True)
                assert marks[j, k] == containment.tokens(low, j, size)[0]


def test_awkward_rows(spark):
    docs = awkward_docs(spark)
    items = spark.createDataFrame([(1, None, ""), (2, "", ""), (3, "same text", ""), (4, "!!", ""), (None, "again and again", "")], ITEMS)
    found = Counter((r["key"], r["item"]) for r in find_items(docs, items).collect())
    assert found == Counter({(104, 3): 1, (105, 3): 1, (106, None): 1})
    clean = drop_contaminated(docs, items)
    assert clean.columns == docs.columns
    gone = {104, 105, 106}
    assert Counter(r["doc_id"] for r in clean.collect()) == Counter(r["doc_id"] for r in docs.collect() if r["doc_id"] not in gone)
    assert find_items(empty_docs(spark), items).count() == 0
    assert drop_contaminated(docs, items.limit(0)).count() == docs.count()


def test_size_classes_hold_their_items():
    for n in range(1, 5000):
        size = size_class(n)
        assert n <= size <= max(8, 1.5 * n) and halved(size)[0] << halved(size)[1] == size
