"""Reply-ordered conversations from quoting messages, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dugout.llm.common import boxed, col
from dugout.sources.scratch import materialize

#: White space around a message, and the blank lines between paragraphs. No pattern here repeats a group: such loops
#: recurse, and a message of many lines or marks would end the JVM.
BLANKS, BETWEEN = " \t\n\x0b\f\r", r"\n[ \t]*\n[ \t\n]*"


def marks_of(line: Column) -> Column:
    """Quote marks before a line, each with one blank behind it at most; blanks before the first do not count."""
    run = F.regexp_extract(line, r"^[ \t]*(>[> \t]*)", 1)
    return F.when(run.rlike(r"[ \t][ \t]"), F.regexp_extract(run, r"^(.*?[ \t])[ \t]", 1)).otherwise(run)


def parsed_lines(text: Column) -> Column:
    """array<struct<level, body>>: quote level of each line, and the line behind its marks."""
    lines = F.split(F.coalesce(text, F.lit("")), r"\r\n|\n|\r")
    marked = F.transform(lines, lambda line: F.struct(line.alias("line"), marks_of(line).alias("marks")))
    behind = lambda x: F.length(F.regexp_extract(x["line"], r"^([ \t]*)", 1)) + F.length(x["marks"]) + 1
    return F.transform(
        marked,
        lambda x: F.struct(
            F.length(F.regexp_replace(x["marks"], "[^>]", "")).alias("level"),
            F.when(x["marks"] == "", x["line"]).otherwise(F.substring(x["line"], behind(x), F.length(x["line"]))).alias("body"),
        ),
    )


def at_level(lines: Column, level: Column) -> Column:
    """The lines of one level as text; each run of other lines leaves a blank line."""
    return F.array_join(F.transform(lines, lambda x: F.when(x["level"] == level, x["body"]).otherwise(F.lit(""))), "\n")


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def passages(text: Column) -> Column:
    """Distinct hashes of the whole text, of its paragraphs and of its lines, blank ones left out."""
    parts = F.concat(F.array(text), F.split(text, BETWEEN), F.split(text, r"\n"))
    filled = F.filter(F.transform(parts, normalised), lambda x: x != "")
    return F.array_distinct(F.transform(filled, lambda x: F.xxhash64(x, F.length(x))))


def roots(links: DataFrame) -> DataFrame:
    """(id, root, depth) for each id of links (id, parent); parents come before their children, so no cycles.

    Pointers double with each round; rounds end in a written table.
    """
    ptr = materialize(links.select("id", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth")), "replies")
    while True:
        up = ptr.select(F.col("id").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        if ptr.join(up, "root", "left_semi").isEmpty():
            return ptr
        ptr = materialize(
            ptr.join(up, "root", "left").select(
                "id", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")
            ),
            "replies",
        )


def positions(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with position, gapless from 0 in the given order within each group, however large a group is.

    The rows are range-partitioned by group and order and written with the number of their partition; a row's
    position is the count of its group in earlier partitions plus its place in its own.
    """
    cut = rows.repartitionByRange(F.col(group), *order).withColumn("part", F.spark_partition_id())
    cut = materialize(cut, "ordered")
    earlier = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        cut.groupBy(group, "part").agg(F.count(F.lit(1)).alias("n"))
        .select(F.col(group), "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    )
    place = F.row_number().over(Window.partitionBy(group, "part").orderBy(*order))
    return (
        cut.withColumn("place", place)
        .join(before, [group, "part"])
        .withColumn("position", (F.col("before") + F.col("place") - 1).cast("long"))
        .drop("before", "place", "part")
    )


def link_quotes(
    messages: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", text: str = "text"
) -> DataFrame:
    """Each message without its quotes, tied to the message it answers, and its place in its conversation.

    Returns row (struct of the input's columns), text, quote_levels, quoted_lines, parent_turn, thread_turn, depth,
    position. Lines that begin with > are quoted, as deep as they have marks. Quoted text of each level and the
    unquoted text of all messages are cut into whole text, paragraphs and lines, normalised (lower case, letters and
    digits only) and hashed. A quoted passage is joined to the first message of the conversation that has it
    unquoted; so a line that thousands share is one row on that side. The parent is the original of the shallowest
    level that has one, the latest of several, always an earlier message. Threads follow the parents to the top;
    a conversation is ordered by the turn of its threads' first messages, then by turn, so replies stand behind what
    they answer and each thread stands together. Messages that quote nothing known begin a thread of their own.

    Null texts are empty and null turns come first; a null conversation is one of its own. Repeated messages stay, in
    any order among themselves. An empty table gives no rows. No task holds a conversation, whatever its size.
    """
    staged = materialize(
        messages.select(
            boxed(messages).alias("row"),
            F.monotonically_increasing_id().alias("id"),
            F.when(col(conversation).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), col(conversation).cast("string"))).alias("conv"),
            F.coalesce(col(turn).cast("long"), F.lit(-(1 << 62))).alias("at"),
            parsed_lines(col(text)).alias("lines"),
        ),
        "messages",
    ).withColumn("own", at_level(F.col("lines"), F.lit(0)))
    levels = F.array_max(F.transform("lines", lambda x: x["level"]))
    quoting = staged.filter(F.exists("lines", lambda x: x["level"] > 0))
    occurring = F.array_distinct(F.filter(F.transform("lines", lambda x: x["level"]), lambda level: level > 0))
    quoted = (
        quoting.select("id", "conv", "at", "lines", F.explode(occurring).alias("level"))
        .select("id", "conv", "at", "level", F.explode(passages(at_level(F.col("lines"), F.col("level")))).alias("passage"))
    )
    quoted = materialize(quoted, "quoted")
    firsts = (
        staged.select("id", "conv", "at", F.explode(passages(F.col("own"))).alias("passage"))
        .join(quoted.select("conv", "passage").distinct(), ["conv", "passage"], "left_semi")
        .groupBy("conv", "passage")
        .agg(F.min(F.struct("at", "id")).alias("first"))
    )
    parents = (
        quoted.join(firsts, ["conv", "passage"])
        .filter(F.struct("first.at", "first.id") < F.struct("at", "id"))
        .groupBy("id")
        .agg(F.max(F.struct((-F.col("level")).alias("nearest"), F.col("first.at").alias("at"), F.col("first.id").alias("id"))).alias("best"))
        .select("id", F.col("best.id").alias("parent"), F.col("best.at").alias("parent_at"))
    )
    parents = materialize(parents, "parents")
    tops = roots(parents).join(staged.select(F.col("id").alias("root"), F.col("at").alias("root_at")), "root")
    threads = (
        staged.select("id", "conv", "at")
        .join(parents.select("id", "parent_at"), "id", "left")
        .join(tops, "id", "left")
        .select(
            "id", "conv", "at", "parent_at", F.coalesce("root_at", "at").alias("thread_at"),
            F.coalesce("root", "id").alias("root"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        )
    )
    placed = positions(threads, "conv", ["thread_at", "root", "at", "id"])
    known = lambda c: F.when(F.col(c) != -(1 << 62), F.col(c))
    return staged.join(placed.drop("conv", "at"), "id").select(
        "row",
        F.btrim(F.regexp_replace("own", BETWEEN, "\n\n"), F.lit(BLANKS)).alias("text"),
        levels.alias("quote_levels"),
        F.size(F.filter("lines", lambda x: x["level"] > 0)).alias("quoted_lines"),
        known("parent_at").alias("parent_turn"),
        known("thread_at").alias("thread_turn"),
        "depth",
        "position",
    )
