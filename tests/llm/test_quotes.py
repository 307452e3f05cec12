from __future__ import annotations

import random

import duckdb
from compare import differences

import __spark_entry__ as contract
from dugout.llm.quotes import link_quotes, positions, roots

SHAPE = "conv_id long, turn long, role string, text string, position string, id int"


def linked(spark, rows):
    frame = spark.createDataFrame([(*r, "p", 1) for r in rows], SHAPE)
    out = link_quotes(frame).collect()
    assert len(out) == len(rows)
    return {(r["row"]["conv_id"], r["row"]["turn"]): r for r in out}


def test_replies_follow_what_they_quote(spark):
    rows = [
        (1, 0, "a", "How do I bake bread?\nI have flour and yeast."),
        (1, 1, "b", "Unrelated: what time is it?"),
        (1, 2, "c", "> How do I bake  BREAD?\nMix, rest, bake."),
        (1, 3, "d", ">> how do i bake bread\n> Mix, rest, bake.\nFor how long?"),
        (1, 4, "e", "> Unrelated: what time is it?\n\nNoon."),
        (1, 5, "f", "> something nobody said\nHm."),
        (2, 0, "a", "> How do I bake bread?\nQuoting another conversation."),
    ]
    r = linked(spark, rows)
    assert [r[1, t]["parent_turn"] for t in range(6)] == [None, None, 0, 2, 1, None]
    assert [r[1, t]["thread_turn"] for t in range(6)] == [0, 1, 0, 0, 1, 5]
    assert [r[1, t]["depth"] for t in range(6)] == [0, 0, 1, 2, 1, 0]
    assert [r[1, t]["position"] for t in range(6)] == [0, 3, 1, 2, 4, 5]
    assert [r[1, t]["quote_levels"] for t in range(6)] == [0, 0, 1, 2, 1, 1]
    assert r[1, 2]["text"] == "Mix, rest, bake." and r[1, 3]["text"] == "For how long?" and r[1, 3]["quoted_lines"] == 2
    assert r[2, 0]["parent_turn"] is None


def test_interleaved_quotes_take_the_latest_original(spark):
    rows = [
        (1, 0, "a", "First point.\n\nSecond point."),
        (1, 1, "b", "Another idea here."),
        (1, 2, "c", "> First point.\nYes.\n> Another idea here.\nNo."),
        (1, 3, "d", "> Yes.\n> No.\nFine."),
    ]
    r = linked(spark, rows)
    assert r[1, 2]["parent_turn"] == 1 and r[1, 2]["text"] == "Yes.\n\nNo."
    assert r[1, 3]["parent_turn"] == 2 and r[1, 3]["thread_turn"] == 1 and r[1, 3]["depth"] == 2


def test_awkward_messages(spark):
    rows = [(1, 0, None, None), (1, 1, "a", ""), (1, 2, "a", ">"), (1, 3, "a", "> \n>>"), (None, 0, "a", "hello there"), (None, 1, "b", "> hello there"), (1, None, "a", "early"), (1, 9, "a", "x " * 5000)]
    r = linked(spark, rows)
    assert r[1, None]["position"] == 0 and r[1, None]["thread_turn"] is None
    assert r[None, 1]["parent_turn"] == 0 and r[None, 1]["text"] == ""
    assert r[1, 0]["text"] == "" and r[1, 3]["quote_levels"] == 2 and r[1, 3]["parent_turn"] is None
    twice = link_quotes(spark.createDataFrame([(1, 0, "a", "same", "", 0)] * 3, SHAPE)).collect()
    assert sorted(x["position"] for x in twice) == [0, 1, 2]
    assert link_quotes(spark.createDataFrame([], SHAPE)).count() == 0


def test_very_long_messages(spark):
    """Blank lines, quoted lines and marks in great numbers, and blanks before the end of a text."""
    many = 100_000
    rows = [(1, 0, "a", "first" + "\n \t" * many + "last"), (1, 1, "a", "> first\n" * many), (1, 2, "a", ">" * many + " deep")]
    rows += [(1, 3, "a", "> " * many + "x"), (1, 4, "a", "a" + " " * many + "b"), (1, 5, "a", "> y\n" + ">" * 3000 + " z\n" * 3000)]
    r = linked(spark, rows)
    assert r[1, 0]["text"] == "first\n\nlast" and r[1, 1]["parent_turn"] == 0 and r[1, 1]["quoted_lines"] == many
    assert r[1, 2]["quote_levels"] == r[1, 3]["quote_levels"] == many and r[1, 5]["quote_levels"] == 3000
    assert len(r[1, 4]["text"]) == many + 2


def test_one_conversation_with_a_common_line(spark):
    """Thousands share a line, and thousands quote it: links stay one per message."""
    rows = [(1, 2 * i, "a", f"thanks\nnote {i}") for i in range(300)] + [(1, 2 * i + 1, "b", f"> thanks\nreply {i}") for i in range(300)]
    r = linked(spark, rows)
    assert all(r[1, 2 * i + 1]["parent_turn"] == 0 for i in range(300))
    assert sorted(x["position"] for x in r.values()) == list(range(600))


def test_long_chains_and_positions(spark):
    chain = spark.createDataFrame([(i, i - 1) for i in range(1, 200)], "id long, parent long")
    rows = {r["id"]: (r["root"], r["depth"]) for r in roots(chain).collect()}
    assert rows == {i: (0, i) for i in range(1, 200)}
    frame = spark.range(0, 5000).selectExpr("cast(id % 3 = 0 as string) as g", "id % 17 as a", "id")
    got = {}
    for r in positions(frame, "g", ["a", "id"]).collect():
        got.setdefault(r["g"], []).append((r["position"], r["a"], r["id"]))
    for own in got.values():
        own.sort()
        assert [p for p, _, _ in own] == list(range(len(own)))
        assert [x[1:] for x in own] == sorted(x[1:] for x in own)


def test_random_threads_against_sql(spark):
    """The registered SQL, a plain recursive query, over messages that quote each other at random."""
    rng = random.Random(11)
    rows, said = [], {}
    for conv in range(12):
        for turn in range(rng.randrange(1, 14)):
            lines = []
            for _ in range(rng.randrange(0, 4)):
                if said.get(conv) and rng.random() < 0.6:
                    quote = rng.choice(said[conv])
                    lines += [rng.choice(["> ", ">", ">> ", " > > "]) + x.upper() for x in quote.split("\n")]
                own = " ".join(rng.choice("abcdefg") * 3 for _ in range(rng.randrange(1, 4))) + rng.choice(["", ".", "\n", "\r\nmore here"])
                lines.append(own)
            rows.append((conv if conv else None, turn, "r", "\n".join(lines)))
            said.setdefault(conv, []).append("\n".join(x for x in lines if not x.lstrip().startswith(">")) or "x")
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = link_quotes(frame)
    got = out.select("row.conv_id", "row.turn", "row.role", *[c for c in out.columns if c != "row"])
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert differences(got, con, contract.oracle_sql()["op9_quotation_linking"]) == []
    assert got.filter("depth > 1").count() > 3
