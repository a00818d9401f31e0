"""Line dedup by an exact set-similarity join, in built-in functions only.

A line is the set of its words. Words are ordered by rarity: first by the frequency class of their
hash bucket, counted over all texts, then by hash. Lines with equal sets are collapsed to the first
of them. Of the others, any two that reach the similarity share a word among their rarest few
(prefix filter); what remains of the two lines behind that word (positional filter), their lengths
(length filter) and 64-bit sketches bound the overlap from above, and the survivors are verified on
the words themselves. A line goes if any earlier line matches it.

Lines are first compared with the earliest line of each shared word, one candidate per row, which
settles groups of near copies in linear work. Only lines still standing meet all their candidates;
for words that many lines share, the length and positional filters are part of the join key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.llm.quality import _BLANKS
from footfall.llm.small import checked_broadcast
from footfall.plans.scratch import Passing, materialise

#: Hash buckets whose word counts make the rarity classes, one byte each; a fixed number, so they
#: fit the driver. They arrive there as strings of ROW classes.
BUCKETS, ROW = 1 << 18, 1 << 10

#: Lines beyond which a shared word is joined by length class and position, and lines of such a word that one task meets.
HOT, SALT = 20_000, 65_536


def _spaced(text: str) -> Column:
    """The text, empty for null, with a space for each white space but the ends of lines."""
    t = F.coalesce(F.col(text), F.lit(""))
    inner = _BLANKS.replace(" ", "").replace("\n", "")
    found = F.lit(False)
    for sign in inner:
        found = found | F.contains(t, F.lit(sign))
    return F.when(found, F.translate(t, inner, " " * len(inner))).otherwise(t)


def _words(body: Column) -> Column:
    """The words of a line of a spaced text."""
    return F.array_remove(F.split(body, " "), "")


def rarity_classes(docs: DataFrame, text: str) -> bytearray:
    """A class 1..125 for each hash bucket: quarter steps of the logarithm of its words' count in all texts."""
    words = docs.select(F.explode(F.split(F.replace(_spaced(text), F.lit("\n"), F.lit(" ")), " ")).alias("w")).where(F.col("w") != "")
    counts = words.groupBy(_bucket(F.xxhash64("w")).alias("b")).count()
    letter = F.char(F.least(F.lit(125), F.floor(F.log2(F.col("count") + 1) * 4) + 1))
    place = F.struct((F.col("b") % ROW).alias("i"), letter.alias("c"))
    rows = counts.groupBy(F.floor(F.col("b") / ROW).cast("int").alias("r")).agg(F.collect_list(place).alias("l"))
    classes = bytearray(b"\1" * BUCKETS)
    for row in rows.select("r", F.transform("l", lambda x: x["i"]).alias("i"), F.array_join(F.transform("l", lambda x: x["c"]), "").alias("c")).toLocalIterator():
        for i, c in zip(row["i"], row["c"], strict=True):
            classes[row["r"] * ROW + i] = ord(c)
    return classes


def _bucket(h: Column) -> Column:
    return h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def row_id(key: str, text: str) -> Column:
    """Key and hash of the text: what tells rows apart that share a key."""
    return F.struct(F.col(key).alias("key"), F.xxhash64(text).alias("hash"))


def line_sets(docs: DataFrame, key: str, text: str, classes: bytearray) -> DataFrame:
    """``id, line, keys``: each line with words, and its words as numbers in the order of rarity."""
    table = F.split(F.lit(",".join(map(str, classes))), ",").cast("array<int>")  # folded into one array of the plan

    def number(w: Column) -> Column:
        h = F.xxhash64(w)
        rarity = F.coalesce(F.get(table, _bucket(h)), F.lit(1)).cast("bigint")
        return F.shiftleft(rarity, 56).bitwiseOR(h.bitwiseAND(F.lit((1 << 56) - 1)))

    lines = docs.select(row_id(key, text).alias("id"), F.posexplode(F.split(_spaced(text), "\n")).alias("line", "body"))
    # Hashes that agree in their lower 56 bits may be one number.
    keys = F.sort_array(F.array_distinct(F.transform(_words(F.col("body")), number)))
    return lines.where(F.trim("body") != "").select("id", "line", keys.alias("keys"))


def _ceil(a: Column, b: int) -> Column:
    """The quotient of whole numbers, rounded up."""
    return ((a + (b - 1)) / b).cast("bigint").cast("int")


def _overlap(n: Column, m: Column, percent: int) -> Column:
    """Words that sets of n and m must share."""
    return _ceil((n + m) * percent, 100 + percent)


def representatives(sets: DataFrame, percent: int) -> DataFrame:
    """The first line of each set: ``id, line, n, sketch, prefix, index`` (length of the prefix when the other set is larger)."""
    n = F.size("keys")
    rows = sets.select(
        F.xxhash64("keys").alias("h"),
        F.hash("keys").alias("g"),
        F.struct(
            "id", "line", n.alias("n"),
            F.expr("aggregate(keys, 0L, (a, k) -> a | shiftleft(1L, cast(k & 63 as int)))").alias("sketch"),
            F.slice("keys", F.lit(1), n - _ceil(n * percent, 100) + 1).alias("prefix"),
        ).alias("r"),
    )
    first = rows.groupBy("h", "g").agg(F.min("r").alias("r")).select("r.*")
    return first.withColumn("index", F.col("n") - _overlap(F.col("n"), F.col("n"), percent) + 1)


def _row(a: str, *names: str) -> list[Column]:
    return [F.col(f"{a}.{x}") for x in names]


def _possible(a: Column, b: Column, percent: int) -> Column:
    """Length, positional and sketch filters, for rows that share a word."""
    need = _overlap(a["n"], b["n"], percent)
    least, most = F.least(a["n"], b["n"]), F.greatest(a["n"], b["n"])
    return (
        (least * 100 >= most * percent)
        & (((b["n"] <= a["n"]) & (b["at"] < b["index"])) | ((a["n"] <= b["n"]) & (a["at"] < a["index"])))
        & (F.least(a["n"] - a["at"], b["n"] - b["at"]) >= need)
        & (F.bit_count(a["sketch"].bitwiseXOR(b["sketch"])) <= a["n"] + b["n"] - need * 2)
    )


def _before(a: Column, b: Column) -> Column:
    return F.struct(a["id"], a["line"]) < F.struct(b["id"].alias("id"), b["line"].alias("line"))


def verified(docs: DataFrame, key: str, text: str, pairs: DataFrame, percent: int, passing: Passing) -> DataFrame:
    """``id, line`` of the later lines of pairs (``id, line, o_id, o_line``) whose words reach the similarity."""
    pairs = passing.store(pairs.distinct(), "line-pairs")
    ends = pairs.select("id", "line").union(pairs.select("o_id", "o_line")).distinct()
    wanted = passing.store(ends.groupBy("id").agg(F.collect_list("line").alias("at")), "line-wanted")
    wide = docs.select(row_id(key, text).alias("_k"), F.col(text).alias("_t"))
    found = wide.join(checked_broadcast(wanted, "at"), F.col("_k").eqNullSafe(F.col("id")))
    found = found.select("id", "at", F.split(_spaced("_t"), "\n").alias("body"))
    found = found.select("id", F.explode(F.transform("at", lambda i: F.struct(i.alias("line"), F.get("body", i).alias("t")))).alias("x"))
    found = found.select("id", "x.line", F.col("x.t").alias("w"), F.size(F.array_distinct(_words(F.col("x.t")))).alias("n"))
    words = found.dropDuplicates(["id", "line"])  # texts: a shuffled array of words takes thrice the bytes
    # Both sides name the columns alike, so that the lines are fetched once for the two joins.
    both = pairs.alias("p").join(words.alias("a"), F.col("p.id").eqNullSafe(F.col("a.id")) & (F.col("p.line") == F.col("a.line")))
    both = both.select("p.id", "p.line", "p.o_id", "p.o_line", "a.w", "a.n").alias("p")
    both = both.join(words.alias("b"), F.col("p.o_id").eqNullSafe(F.col("b.id")) & (F.col("p.o_line") == F.col("b.line")))
    # shared / union >= percent / 100, with shared named once: what a filter names twice is computed twice
    shared = F.size(F.array_intersect(_words(F.col("p.w")), F.split("b.w", " ")))
    alike = both.where(shared * (100 + percent) >= (F.col("p.n") + F.col("b.n")) * percent)
    return alike.select("p.id", "p.line").distinct()


def _length_class(n: Column, percent: int) -> Column:
    """Sets whose sizes let them reach the similarity are in the same class or in neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / (max(math.log(100 / percent), 1e-3) * 1.001)).cast("int")


def meetings(shared: DataFrame, gone: DataFrame, percent: int) -> DataFrame:
    """Lines that share a word: ``x`` of those not in ``gone`` beside the ``y`` of each line that may match it, but the word's first.

    No line is before a word's first, so the first is on neither side, and words of two lines are settled.

    For a word of more than HOT lines, one of two lines, the shorter one, holds the word in its index
    prefix, and their lengths are in neighbouring classes. Both are join keys there, so that lines which
    only share a template's words do not meet; its lines are dealt to tasks by SALT.
    """
    x, y = F.col("x"), F.col("y")
    others = shared.where(~F.col("head") & (F.col("df") > 2))
    gone = checked_broadcast(gone).select(F.col("id").alias("g_id"), F.col("line").alias("g_line"))

    def standing(rows: DataFrame) -> DataFrame:
        # No left_anti: Spark would move that below the shuffle, which then is not the other side's.
        marked = rows.join(gone, x["id"].eqNullSafe(F.col("g_id")) & (x["line"] == F.col("g_line")), "left")
        return marked.where(F.col("g_line").isNull()).drop("g_id", "g_line")

    few = others.where(F.col("df") <= HOT).select("word", "x").repartition("word")  # one shuffle for both sides
    cold = standing(few).join(few.select("word", x.alias("y")), "word")
    crowd, own = others.where(F.col("df") > HOT), _length_class(x["n"], percent)
    indexed, salts = x["at"] < x["index"], F.ceil(F.col("df") / SALT).cast("int")
    salt = F.pmod(F.xxhash64(x["id"], x["line"]), salts).cast("int")
    # Side 0: the other line is the shorter one (or as long) and holds the word in its index prefix. Side 1: this line does.
    sides = F.when(indexed, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))
    held = crowd.select("word", F.explode(sides).alias("side"), own.alias("length"), salt.alias("salt"), x.alias("y"))
    spot = lambda side, length: F.struct(F.lit(side).alias("side"), length.alias("length"))
    spots = F.array(spot(0, own - 1), spot(0, own))
    spots = F.when(indexed, F.concat(spots, F.array(spot(1, own), spot(1, own + 1)))).otherwise(spots)
    asked = standing(crowd).select("word", "x", F.explode(spots).alias("s"), F.sequence(F.lit(0), salts - 1).alias("salts"))
    asked = asked.select("word", "x", "s.side", "s.length", F.explode("salts").alias("salt"))
    hot = asked.join(held, ["word", "side", "length", "salt"])
    hot = hot.where(F.when(F.col("side") == 0, y["n"] <= x["n"]).otherwise(x["n"] <= y["n"]))
    return cold.select("x", "y").union(hot.select("x", "y"))


def kept_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 90) -> DataFrame:
    """``id, kept``: of each document, the numbers (from 0) of the lines with words that stay; ``id`` is :func:`row_id`.

    A line goes if its set of words has a Jaccard similarity of ``percent`` / 100 or more with that of
    any line before it, in the order of key, hash of the text and line number, whether that one stays or not. Lines
    without words are not listed (they stay); null texts have no lines. Documents of which no line
    with words stays are absent. Rows that share a key, null included, are documents of their own if their texts
    differ; rows alike in key and text count as one document and keep the same lines.
    """
    docs = docs.select(key, text)
    passing = Passing(docs.sparkSession)
    sets = line_sets(docs, key, text, rarity_classes(docs, text))
    reps = passing.store(representatives(sets, percent), "line-reps")
    able = reps.where((F.col("n") * 100 >= (F.col("n") + 1) * percent) | (_ceil(F.col("n") * percent, 100) < F.col("n")))
    rows = able.select("id", "line", "n", "sketch", "index", F.posexplode("prefix").alias("at", "word"))
    rows = rows.select("word", F.struct("id", "line", "n", "sketch", "index", "at").alias("x"))
    word = Window.partitionBy("word")
    rows = rows.select("word", "x", F.min("x").over(word).alias("first"), F.count(F.lit(1)).over(word).alias("df")).where(F.col("df") > 1)
    x, f = F.col("x"), F.col("first")
    head = (x["id"].eqNullSafe(f["id"]) & (x["line"] == f["line"])).alias("head")
    shared = passing.store(rows.select("*", head), "line-shared")

    pairs = shared.where(_before(f, x) & _possible(x, f, percent)).select(
        *_row("x", "id", "line"), F.col("first.id").alias("o_id"), F.col("first.line").alias("o_line")
    )
    gone = passing.store(verified(docs, key, text, pairs, percent, passing), "line-gone")

    y = F.col("y")
    pairs = meetings(shared, gone, percent).where(_before(y, x) & _possible(x, y, percent))
    pairs = pairs.select(*_row("x", "id", "line"), y["id"].alias("o_id"), y["line"].alias("o_line"))
    gone = gone.union(verified(docs, key, text, pairs, percent, passing))
    same = F.col("r.id").eqNullSafe(F.col("g.id")) & (F.col("r.line") == F.col("g.line"))
    kept = reps.select("id", "line").alias("r").join(gone.alias("g"), same, "left_anti")
    kept = materialise(kept.groupBy("id").agg(F.sort_array(F.collect_list("line")).alias("kept")), "line-kept")
    passing.remove()
    return kept


def _with_kept(docs: DataFrame, own: Column, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` beside their lines and the numbers of those that stay."""
    kept = checked_broadcast(kept, "kept").withColumnsRenamed({"id": "_line_id", "kept": "_line_kept"})
    return docs.join(kept, own.eqNullSafe(F.col("_line_id")), "left").drop("_line_id")


def _worded(body: Column) -> Column:
    return F.translate(body, _BLANKS, "") != ""


def count_lines(docs: DataFrame, key: str, text: str, kept: DataFrame) -> DataFrame:
    """``key, n_lines, n_removed, kept_lines``: lines with words, those removed, and the numbers of those that stay."""
    # One match for each line with words: from its first sign that is no white space to its end.
    lines = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit("[^\\x20\\x09-\\x0D][^\\n]*"))
    counted = docs.select(row_id(key, text).alias("_line_row"), lines.cast("bigint").alias("n_lines"))
    found = _with_kept(counted, F.col("_line_row"), kept)
    left = F.coalesce(F.col("_line_kept"), F.array().cast("array<int>"))
    return found.select(
        F.col("_line_row.key").alias(key), "n_lines", (F.col("n_lines") - F.size(left)).alias("n_removed"), F.array_join(left.cast("array<string>"), ",").alias("kept_lines")
    )


def remove_lines(docs: DataFrame, key: str, text: str, kept: DataFrame) -> DataFrame:
    """``docs`` with the removed lines cut out of the text; documents that lose every line with words are dropped.

    Lines without words stay where they are, and so do documents that have none but such lines.
    """
    wide = _with_kept(docs, row_id(key, text), kept).withColumn("_line_list", F.split(F.col(text), "\n"))
    blank = F.filter(F.sequence(F.lit(0), F.size("_line_list") - 1), lambda i: ~_worded(F.get("_line_list", i)))
    wide = wide.withColumn("_line_blank", F.when(F.col(text).isNotNull(), blank))
    wide = wide.where(F.col("_line_kept").isNotNull() | F.col(text).isNull() | (F.size("_line_blank") == F.size("_line_list")))
    stay = F.array_sort(F.concat(F.coalesce("_line_kept", F.array().cast("array<int>")), F.col("_line_blank")))
    body = F.array_join(F.transform(stay, lambda i: F.get("_line_list", i)), "\n")
    return wide.withColumn(text, F.when(F.col(text).isNotNull(), body)).select(*docs.columns)
