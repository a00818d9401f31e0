"""Quotation linking: conversations in reply order, without the quotations that tell it.

A line's quote level is the number of ``>`` marks before its text. Consecutive lines of one level
form a passage. Quoted passages, and their lines of three words or more, are normalised and hashed;
so are the messages' own passages and lines. Within a conversation the original of a hash is the
first message that holds it as its own text; a message answers the latest original of its
shallowest quotations. Roots and depths follow by pointer doubling over the links alone. Built-in
functions only; no conversation is gathered into one task, and a passage that many messages share
is one row per conversation before it is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.llm.quality import let
from footfall.plans.scratch import materialise

# What may stand before a quoted line.
MARKS = "^[ \\t]*((?:>[ \\t]*)+)"


def _level(line: Column) -> Column:
    marks = F.regexp_extract(line, MARKS, 1)
    return F.length(marks) - F.length(F.translate(marks, ">", ""))


def normalised(text: Column) -> Column:
    """Lower case, with everything but letters and digits as single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", " "))


def parse_lines(text: Column) -> Column:
    """Lines of a text as structs of quote level and body; null for null."""
    return F.transform(
        F.split(text, "\n"), lambda x: F.struct(_level(x).alias("level"), F.regexp_replace(x, MARKS, "").alias("body"))
    )


def passages(lines: Column) -> Column:
    """Maximal runs of lines of one level: structs of level and normalised text."""

    def runs(x: Column) -> Column:
        changed = lambda i: F.coalesce(F.get(x, i)["level"] != F.get(x, i - 1)["level"], F.lit(True))
        starts = F.filter(F.sequence(F.lit(0), F.size(x) - 1), changed)

        def cut(s: Column) -> Column:
            def run(a: Column, k: Column) -> Column:
                end = F.coalesce(F.get(s, k + 1), F.size(x))
                bodies = F.transform(F.slice(x, a + 1, end - a), lambda y: y["body"])
                return F.struct(F.get(x, a)["level"].alias("level"), normalised(F.array_join(bodies, " ")).alias("text"))

            return F.transform(s, run)

        return let(starts, cut)

    none = F.array().cast("array<struct<level: int, text: string>>")
    return let(lines, lambda x: F.when(F.size(x) > 0, runs(x)).otherwise(none))


def own_text(lines: Column) -> Column:
    """The text without quoted lines, trimmed of the blank lines that they leave at its ends."""
    own = F.filter(lines, lambda x: x["level"] == 0)
    return F.regexp_replace(F.array_join(F.transform(own, lambda x: x["body"]), "\n"), "^\\s*\\n|\\s+$", "")


def _units(lines: Column, whole: Column | None) -> Column:
    """Structs of level and hash of what a passage can be recognised by."""
    single = F.transform(lines, lambda x: F.struct(x["level"].alias("level"), normalised(x["body"]).alias("text")))
    single = F.filter(single, lambda x: F.size(F.split(x["text"], " ")) >= 3)
    parts = [passages(lines), single]
    if whole is not None:
        parts.append(F.array(F.struct(F.lit(0).alias("level"), normalised(whole).alias("text"))))
    named = F.filter(F.concat(*parts), lambda x: x["text"] != "")
    return F.array_distinct(F.transform(named, lambda x: F.struct(x["level"].alias("level"), F.xxhash64(x["text"], F.length(x["text"])).alias("h"))))


def reply_links(messages: DataFrame) -> DataFrame:
    """``conv, turn, parent``: the message that each quoting message answers, at most one per turn.

    ``messages`` has ``_conv, _turn, _lines, _own``. Only conversations that quote are looked at.
    """
    quoting = messages.where(F.exists("_lines", lambda x: x["level"] > 0))
    quotes = quoting.select("_conv", "_turn", F.explode(_units(F.col("_lines"), None)).alias("u")).where(F.col("u.level") > 0)
    quotes = materialise(quotes.select("_conv", "_turn", "u.level", "u.h").distinct(), "chat-quotes")
    own = messages.join(quotes.select("_conv").distinct(), "_conv", "left_semi")
    own = own.select("_conv", "_turn", F.explode(_units(F.filter("_lines", lambda x: x["level"] == 0), F.col("_own"))).alias("u"))
    first = own.groupBy("_conv", F.col("u.h").alias("h")).agg(F.min("_turn").alias("parent"))
    met = quotes.join(first, ["_conv", "h"]).where(F.col("parent") < F.col("_turn"))
    best = F.max(F.struct(-F.col("level"), F.col("parent")))
    return met.groupBy("_conv", "_turn").agg(best.alias("b")).select("_conv", "_turn", F.col("b.parent").alias("parent"))


def threads(links: DataFrame) -> DataFrame:
    """``_conv, _turn, parent, root, depth`` of all linked messages, by pointer doubling.

    A parent's turn is before its child's, so there are no cycles; rounds grow with the logarithm of
    the longest chain, and each round shuffles rows of fixed size.
    """
    at = materialise(links.select("*", F.col("parent").alias("root"), F.lit(1).cast("bigint").alias("depth")), "chat-links")
    while True:
        up = at.select("_conv", F.col("_turn").alias("root"), F.col("root").alias("far"), F.col("depth").alias("more"))
        at = at.join(up, ["_conv", "root"], "left").select(
            "_conv", "_turn", "parent", F.coalesce("far", "root").alias("root"),
            (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("far").isNotNull().alias("moved"),
        )
        at = materialise(at, "chat-threads")
        if not at.where("moved").limit(1).count():
            return at.drop("moved")
        at = at.drop("moved")


def reply_order(
    messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text"
) -> DataFrame:
    """All messages without quoted lines, and where they belong: ``n_quoted, parent_turn, root_turn, depth``.

    Sorted by conversation, ``root_turn``, ``depth`` and turn, every message comes after the one it
    answers. A message whose quotations match nothing before it begins a thread of its own (depth 0,
    no parent). One row per input row: repeated rows stay, messages of the same conversation and
    turn are linked alike, and null texts stay null. Messages without conversation or turn are never linked.
    """
    wide = messages.select("*", F.col(conv).alias("_conv"), F.col(turn).alias("_turn"), parse_lines(F.col(text)).alias("_lines"))
    wide = wide.withColumn("_own", own_text(F.col("_lines")))
    links = reply_links(wide.select("_conv", "_turn", "_lines", "_own"))
    found = threads(links).withColumnsRenamed({"_conv": "_c", "_turn": "_t", "parent": "_parent", "root": "_root", "depth": "_depth"})
    out = wide.join(found, (F.col("_conv") == F.col("_c")) & (F.col("_turn") == F.col("_t")), "left")
    added = {
        "n_quoted": F.coalesce(F.size(F.filter("_lines", lambda x: x["level"] > 0)), F.lit(0)).cast("bigint"),
        "parent_turn": F.col("_parent"),
        "root_turn": F.coalesce("_root", "_turn"),
        "depth": F.coalesce("_depth", F.lit(0).cast("bigint")),
    }
    old = [F.col("_own").alias(c) if c == text else F.col(c) for c in messages.columns if c not in added]
    return out.select(*old, *[v.alias(k) for k, v in added.items()])
