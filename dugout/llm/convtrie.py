"""The trie of all conversation prefixes, from neighbours in sorted order."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dugout.llm.common import col
from dugout.llm.quotes import positions
from dugout.sources.scratch import materialize

#: Bytes that name a prefix.
NAME = 16
#: Paths of one block, turns of one block, and items that one task can finish.
ROWS, TURNS, FINISH = 1024, 1 << 20, 4096
#: Members whose numbers are joined to one piece of text before they are hashed.
PIECE = 4096
#: Turns that a conversation may take over from another one, and the modulus of their number.
SHARED, FAMILY = 9, 5
#: Figures of a node, added up over the items that run through it; the smallest member by minimum.
MEMBERS, SMALLEST, KIDS, LEAVES, SAVED = range(5)
NOBODY = np.iinfo(np.int64).max

ITEM_SCHEMA = "path binary, sizes array<bigint>, conv long"
_STATS = [f"s{i}" for i in range(5)]
FOREST_SCHEMA = (
    "kind string, id binary, depth long, conv long, parent binary, parent_conv long, block string, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, path binary, sizes array<bigint>, "
    + ", ".join(f"{s} array<bigint>" for s in _STATS)
)
_ARROW = {"string": pa.string(), "binary": pa.binary(), "long": pa.int64(), "array<bigint>": pa.list_(pa.int64())}


def _batches(rows: Iterable[dict], schema: str, many: int = 4096) -> Iterator[pa.RecordBatch]:
    fields = [f.split(" ", 1) for f in schema.split(", ")]
    held: list[dict] = []

    def out() -> pa.RecordBatch:
        columns = [pa.array([r.get(name) for r in held], _ARROW[kind]) for name, kind in fields]
        return pa.RecordBatch.from_arrays(columns, names=[name for name, _ in fields])

    for row in rows:
        held.append(row)
        if len(held) >= many:
            yield out()
            held.clear()
    if held:
        yield out()


# --- conversations as paths ------------------------------------------------------------


def turns_of(messages: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turns): digest and text size of each turn in order; 24 bytes a turn, texts stay behind."""
    plain = messages.filter(col(conv).isNotNull()).select(
        col(conv).cast("long").alias("conv"),
        col(turn).alias("at"),
        F.coalesce(col(role), F.lit("")).alias("role"),
        F.coalesce(col(text), F.lit("")).alias("text"),
    )
    placed = positions(plain, "conv", ["at", "role", "text"])
    said = F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    turns = F.struct("position", F.unhex(F.md5(said.cast("binary"))).alias("digest"), F.octet_length("text").cast("long").alias("size"))
    return placed.select("conv", turns.alias("turn")).groupBy("conv").agg(F.sort_array(F.collect_list("turn")).alias("turns"))


def taken_over(conv: Column) -> Column:
    return F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(SHARED)).cast("int")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv, turns): the first turns of the family's first conversation, then the own ones after as many."""
    turns = materialize(turns, "turns")
    heads = turns.filter(F.col("conv") % FAMILY == 0).select(F.col("conv").alias("first"), F.slice("turns", 1, SHARED - 1).alias("head"))
    many = taken_over(F.col("conv"))
    none = F.array().cast(turns.schema["turns"].dataType)
    return (
        turns.withColumn("first", F.col("conv") - F.col("conv") % FAMILY)
        .join(heads, "first", "left")
        .select(
            "conv",
            F.concat(
                F.slice(F.coalesce("head", none), F.lit(1), many), F.slice("turns", many + 1, F.size("turns"))
            ).alias("turns"),
        )
        .select("conv", F.col("turns.digest").alias("digests"), F.col("turns.size").alias("sizes"))
    )


def _paths(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A path is the names of all prefixes in a row; a name is the hash of the name before and the turn."""
    for batch in batches:
        paths = []
        for digests in batch.column("digests").to_pylist():
            name, path = b"", []
            for digest in digests:
                name = hashlib.md5(name + digest).digest()
                path.append(name)
            paths.append(b"".join(path))
        yield pa.RecordBatch.from_arrays(
            [pa.array(paths, pa.binary()), batch.column("sizes").cast(pa.list_(pa.int64())), batch.column("conv")],
            names=["path", "sizes", "conv"],
        )


# --- forests of sorted blocks ----------------------------------------------------------


class Item:
    """A path with the figures of its nodes: a conversation, or the edge of a contracted block."""

    __slots__ = ("path", "sizes", "conv", "stats")

    def __init__(self, path: bytes, sizes, conv: int, stats: np.ndarray | None = None):
        self.path, self.sizes, self.conv = path, sizes, conv
        if stats is None:
            stats = np.zeros((5, self.depth + 1), dtype=np.int64)
            stats[MEMBERS] = 1
            stats[SMALLEST] = conv
        self.stats = stats

    @property
    def depth(self) -> int:
        return len(self.path) // NAME

    def name(self, depth: int) -> bytes:
        return self.path[NAME * (depth - 1) : NAME * depth] if depth else b""

    def shared(self, other: Item) -> int:
        """Turns both begin with; equal names mean equal prefixes, so the last equal name is searched by halving."""
        low, high = 0, min(self.depth, other.depth)
        while low < high:
            middle = (low + high + 1) // 2
            if self.name(middle) == other.name(middle):
                low = middle
            else:
                high = middle - 1
        return low

    def row(self) -> dict:
        figures = {s: self.stats[i].tolist() for i, s in enumerate(_STATS)}
        return {"kind": "item", "path": self.path, "sizes": list(self.sizes), "conv": self.conv} | figures


class Tree:
    """A component: neighbours joined so far, its topmost node not yet closed, and what hangs below that."""

    __slots__ = ("left", "right", "top", "stats", "hangs", "waiting")

    def __init__(self, at: int, item: Item):
        self.left = self.right = at
        self.top, self.stats = item.depth, item.stats
        self.hangs = (0, 0, 0)
        self.waiting: list[dict] = []


class Forest:
    """Union-find over one block of sorted items, edges in descending depth of what neighbours share.

    A union at a depth makes the branching node there; the unary nodes between it and the nodes below are closed on
    the way up. A node that reaches an edge of the block may go on in the next block: it is left in the contracted
    forest, two items at most. All other nodes are final.
    """

    def __init__(self, items: list[Item], block: str, last: bool):
        self.items, self.block, self.last = items, block, last
        self.rows: list[dict] = []
        self.edges = [Item(i.path, i.sizes, i.conv, np.zeros_like(i.stats)) for i in (items[0], items[-1])]
        for edge in self.edges:
            edge.stats[SMALLEST] = NOBODY

    def close(self, tree: Tree) -> None:
        depth, item = tree.top, self.items[tree.left]
        stats = tree.stats[:, depth]
        kids, leaves, saved = (int(stats[i]) + tree.hangs[i - KIDS] for i in (KIDS, LEAVES, SAVED))
        members, smallest, name = int(stats[MEMBERS]), int(stats[SMALLEST]), item.name(depth)
        at_edge = tree.left == 0 or tree.right == len(self.items) - 1
        for row in tree.waiting:
            row["parent"] = name
        if at_edge and not self.last:
            edge = self.edges[0 if tree.left == 0 else 1]
            edge.stats[:, depth] = members, smallest, kids, leaves, saved
            if tree.waiting:
                self.rows.append({"kind": "open", "id": name, "block": self.block})
            tree.hangs, tree.waiting = (0, 0, 0), []
        else:
            leaves = leaves if kids else 1
            saved += (members - 1) * int(item.sizes[depth - 1]) if depth else 0
            for row in tree.waiting:
                row["parent_conv"] = smallest
            row = {
                "kind": "node", "id": name, "depth": depth, "conv": smallest, "block": self.block, "n_convs": members,
                "n_children": kids, "n_leaves": leaves, "saved_tokens": saved,
            }
            self.rows.append(row)
            tree.hangs, tree.waiting = (1, leaves, saved), [row]
        tree.top -= 1

    def lift(self, tree: Tree, depth: int) -> Tree:
        while tree.top > depth:
            self.close(tree)
        return tree

    def unite(self, a: Tree, b: Tree, depth: int) -> Tree:
        self.lift(a, depth), self.lift(b, depth)
        both = a.stats[:, : depth + 1] + b.stats[:, : depth + 1]
        both[SMALLEST] = np.minimum(a.stats[SMALLEST, : depth + 1], b.stats[SMALLEST, : depth + 1])
        if len(a.waiting) < len(b.waiting):
            a.waiting, b.waiting = b.waiting, a.waiting
        a.waiting += b.waiting
        a.hangs = tuple(x + y for x, y in zip(a.hangs, b.hangs))
        a.left, a.right, a.stats = min(a.left, b.left), max(a.right, b.right), both
        return a

    def grow(self) -> list[dict]:
        items = self.items
        above = list(range(len(items)))
        trees = [Tree(i, item) for i, item in enumerate(items)]

        def find(i: int) -> int:
            while above[i] != i:
                above[i] = above[above[i]]
                i = above[i]
            return i

        shared = [a.shared(b) for a, b in zip(items, items[1:])]
        for edge in sorted(range(len(shared)), key=lambda e: -shared[e]):
            a, b = find(edge), find(edge + 1)
            above[b] = a
            trees[a] = self.unite(trees[a], trees[b], shared[edge])
        self.lift(trees[find(0)], -1)
        if not self.last:
            self.rows += [edge.row() for edge in self.edges[: 1 if len(items) == 1 else 2]]
        return self.rows


def _forests(level: int, rows: int, last: bool):
    def items(batches: Iterable[pa.RecordBatch]) -> Iterator[Item]:
        for batch in batches:
            for r in batch.to_pylist():
                stats = np.array([r[s] for s in _STATS], dtype=np.int64) if r.get("s0") is not None else None
                yield Item(r["path"], r["sizes"], r["conv"], stats)

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        part, number, held, turns = TaskContext.get().partitionId(), 0, [], 0
        for item in items(batches):
            held.append(item)
            turns += item.depth
            if not last and (len(held) >= rows or turns >= TURNS):
                yield from Forest(held, f"{level}:{part}:{number}", last).grow()
                number, held, turns = number + 1, [], 0
        if held:
            yield from Forest(held, f"{level}:{part}:{number}", last).grow()

    return lambda batches: _batches(blocks(batches), FOREST_SCHEMA)


# --- members that end at a node --------------------------------------------------------


def _runs(batches: Iterable[pa.RecordBatch], name: str, value: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(batch.column(name).to_pylist(), batch.column(value).to_pylist())


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[dict]:
        now, held = None, []
        for name, conv in _runs(batches, "id", "conv"):
            if held and (name != now or len(held) >= PIECE):
                yield {"id": now, "first": held[0], "members": ",".join(map(str, held))}
                held = []
            now = name
            held.append(conv)
        if held:
            yield {"id": now, "first": held[0], "members": ",".join(map(str, held))}

    return _batches(rows(), "id binary, first long, members string", 256)


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[dict]:
        now, sha = None, None
        for name, members in _runs(batches, "id", "members"):
            if sha is not None and name == now:
                sha.update(b",")
            else:
                if sha is not None:
                    yield {"id": now, "ends_sha256": sha.hexdigest()}
                now, sha = name, hashlib.sha256()
            sha.update(members.encode())
        if sha is not None:
            yield {"id": now, "ends_sha256": sha.hexdigest()}

    return _batches(rows(), "id binary, ends_sha256 string")


def ended(items: DataFrame) -> DataFrame:
    """(id, ends_sha256): hash of the members that end at a node, ascending and joined by commas.

    A hash runs over its input from end to end, so one task reads a node's members; they come as pieces of thousands,
    joined where a range partition has sorted them, and are not held.
    """
    own = items.select(F.substring("path", -NAME, NAME).alias("id"), "conv")
    sorted_members = own.repartitionByRange("id", "conv").sortWithinPartitions("id", "conv")
    pieces = sorted_members.mapInArrow(_pieces, "id binary, first long, members string")
    return pieces.repartition("id").sortWithinPartitions("id", "first").mapInArrow(_digests, "id binary, ends_sha256 string")


def prefix_trie(
    messages: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    rows: int = ROWS, finish: int = FINISH,
) -> DataFrame:
    """One row per node of the trie of rebuilt conversations, a node being a distinct sequence of first turns.

    Returns id (hash of the sequence, empty for the root), depth, conv_id (smallest member), parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens and ends_sha256. Conversations are sorted by path. Neighbours in a sorted
    block are joined in descending depth of what they share; nodes inside a block are final, and those that reach
    its edges stay on two contracted items, which are sorted and joined again, level by level, until one block
    holds them all. So a turn that a third of all conversations begin with is one node on the edge of many blocks.

    Turns go by number, null first; equal numbers by role and text. Null role and text are empty, messages without a
    conversation are left out, repeated messages are turns of their own. Other columns are not read. An empty
    table gives no rows. A conversation is one row of 24 bytes a turn; a block has a bounded number of paths and
    turns, at least one path.
    """
    whole = rebuilt(turns_of(messages, conv, turn, role, text))
    items = first = materialize(whole.mapInArrow(_paths, ITEM_SCHEMA), "paths")
    level, built = 0, []
    while True:
        many = items.count()
        last = many <= finish and (level > 0 or many <= rows)
        if last:
            ordered = items.coalesce(1)
        elif level == 0:
            ordered = items.repartitionByRange("path", "conv")
        else:
            ordered = items.repartitionByRange(math.ceil(many / finish), "path", "conv")
        grown = ordered.sortWithinPartitions("path", "conv").mapInArrow(_forests(level, rows, last), FOREST_SCHEMA)
        grown = materialize(grown, f"forest-{level}")
        built.append(grown)
        if last:
            break
        items = grown.filter("kind = 'item'").select("path", "sizes", "conv", *_STATS)
        level += 1
    found = built[0]
    for more in built[1:]:
        found = found.unionByName(more)
    nodes = found.filter("kind = 'node'").drop("kind", "path", "sizes", *_STATS)
    # A node closed below an open one learns its parent's member by the block both were in: few rows a block.
    opened = found.filter("kind = 'open'").select("block", F.col("id").alias("parent"))
    known = opened.join(nodes.select(F.col("id").alias("parent"), F.col("conv").alias("found")), "parent")
    return (
        nodes.join(known, ["block", "parent"], "left")
        .join(ended(first), "id", "left")
        .select(
            "id",
            "depth",
            F.col("conv").alias("conv_id"),
            F.coalesce("parent_conv", "found").alias("parent_conv_id"),
            "n_convs",
            "n_children",
            "n_leaves",
            "saved_tokens",
            F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        )
    )
