from __future__ import annotations

import hashlib
import random
import zlib

import duckdb
import pytest
from compare import differences

import __spark_entry__ as contract
from dugout.llm.convtrie import prefix_trie

SHAPE = "conv_id long, turn long, role string, text string, path string, id int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows: list[tuple]) -> list[tuple]:
    turns: dict = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            turns.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(own)] for c, own in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        first = turns.get(c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5)), [])
        built[c] = first[:h] + own[h:]
    members: dict = {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
    children: dict = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)

    figures = {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        leaves = sum(figures[k][0] for k in below) or 1
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        figures[node] = leaves, own + sum(figures[k][1] for k in below)
    out = []
    for node, own in members.items():
        ends = ",".join(str(c) for c in sorted(own) if tuple(built[c]) == node)
        parent = min(members[node[:-1]]) if node else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(own), len(node), parent, len(own), len(children.get(node, [])), *figures[node], digest))
    return sorted(out, key=repr)


def found(spark, data, **more):
    frame = spark.createDataFrame([(*r, "p", 1) for r in data], SHAPE)
    return sorted((tuple(r) for r in prefix_trie(frame, **more).select(*COLUMNS).collect()), key=repr)


def threads(seed: int, convs: int, common: float):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.randrange(0, 7)):
            text = "hello" if rng.random() < common else rng.choice(["yes", "no", "pourquoi é", "", None])
            rows.append((c, t if rng.random() < 0.95 else None, rng.choice(["user", None]) if rng.random() < 0.1 else "user", text))
    return rows


@pytest.mark.parametrize(("rows", "finish"), [(4, 8), (16, 64), (1024, 4096)])
def test_levels_of_blocks_agree_with_a_plain_trie(spark, rows, finish):
    """Small blocks make many levels; a first turn and whole conversations are common to a great part."""
    data = threads(5, 300, 0.7)
    data += [(1000 + 5 * i, t, "user", f"copy {t}") for i in range(120) for t in range(3)]
    assert found(spark, data, rows=rows, finish=finish) == plain(data)


def test_awkward_messages(spark):
    data = [(None, 0, "a", "lost"), (3, None, None, None), (3, 1, "a", ""), (3, 1, "a", ""), (7, 0, "a", "x")]
    data += [(-7, 0, "a", "x"), (-5, 0, "b", "y"), (-5, 1, "b", "z"), (8, 0, "b", "long " * 5000), (10, 0, None, "x")]
    assert found(spark, data) == plain(data)
    assert found(spark, [(5, t, "a", f"turn {t}") for t in range(700)]) == plain([(5, t, "a", f"turn {t}") for t in range(700)])
    assert found(spark, []) == []
    assert found(spark, [(None, 0, "a", "x")]) == []


def test_turnless_conversations_end_at_the_root(spark):
    c = next(c for c in range(1, 50) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 0)
    assert found(spark, [(c, 0, "a", "gone")]) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_random_threads_against_sql(spark):
    data = threads(9, 200, 0.6)
    frame = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", data)
    got = prefix_trie(frame, rows=8, finish=16).drop("id")
    assert differences(got, con, contract.oracle_sql()["op11_prefix_trie"]) == []


def test_query_against_sql(spark, sf_dir):
    from compare import duck

    got = contract.queries()["op11_prefix_trie"](spark, sf_dir)
    assert differences(got, duck(sf_dir), contract.oracle_sql()["op11_prefix_trie"]) == []
