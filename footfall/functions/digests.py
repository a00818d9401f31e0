"""Fingerprints of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.plans.scratch import materialise

# 9 words of 7 hex digits: a sum of 28-bit words cannot overflow a long below 2^35 rows.
_WORDS, _WORD_HEX = 9, 7


# Hex digits of a line's hash that name its bucket: 65,536 leaves.
DEPTH = 4


def _word_sums() -> list[Column]:
    word = lambda i: F.conv(F.substring("h", 1 + i * _WORD_HEX, _WORD_HEX), 16, 10).cast("bigint")
    return [F.count(F.lit(1)).alias("n_lines"), *[F.coalesce(F.sum(word(i)), F.lit(0)).alias(f"w{i}") for i in range(_WORDS)]]


def _of_sums() -> Column:
    return F.sha2(F.concat_ws("-", *[F.col(c).cast("string") for c in ["n_lines", *(f"w{i}" for i in range(_WORDS))]]), 256)


def multiset_digest(df: DataFrame, line: Column) -> DataFrame:
    """One row ``n_lines, digest`` that depends on the lines and their multiplicity, not on order.

    Each line is hashed on its own and the words of the hashes are summed, so every task
    contributes a handful of numbers whatever the size of the table. (A hash over one sorted
    text cannot be split between tasks and is not offered.)
    """
    return df.select(F.sha2(line, 256).alias("h")).agg(*_word_sums()).select("n_lines", _of_sums().alias("digest"))


def digest_tree(df: DataFrame, line: Column, depth: int = DEPTH) -> DataFrame:
    """``level, bucket, n_lines, digest``: multiset digests of buckets, folded into one root.

    The bucket of a line is the start of its hash: ``depth`` hex digits at the leaves, one less a level up to
    the root (level 0, bucket ''). A leaf is the :func:`multiset_digest` of its lines, an inner node hashes
    its at most 16 children in order; empty buckets are absent, the root never is. A task contributes at most one
    row of sums per leaf. The leaves are stored once; a null line is left out.
    """
    hashed = df.select(F.sha2(line, 256).alias("h")).where(F.col("h").isNotNull())
    leaves = hashed.groupBy(F.substring("h", 1, depth).alias("bucket")).agg(*_word_sums())
    tree = level = materialise(leaves.select(F.lit(depth).alias("level"), "bucket", "n_lines", _of_sums().alias("digest")), "digest-leaves")
    for up in reversed(range(depth)):
        child = F.struct("bucket", F.concat_ws(":", "bucket", "digest").alias("line"))
        folded = [F.coalesce(F.sum("n_lines"), F.lit(0)).alias("n_lines"), F.sha2(F.array_join(F.sort_array(F.collect_list(child))["line"], ","), 256).alias("digest")]
        if up:
            level = level.groupBy(F.substring("bucket", 1, up).alias("bucket")).agg(*folded)
        else:
            level = level.agg(*folded).withColumn("bucket", F.lit(""))
        level = level.select(F.lit(up).alias("level"), "bucket", "n_lines", "digest")
        tree = tree.union(level)
    return tree


def matched_nodes(left: DataFrame, right: DataFrame) -> DataFrame:
    """``level, bucket, left_n, right_n, same`` of all nodes of two trees of equal depth; a missing node has 0 lines."""
    pick = lambda t, side: t.select("level", "bucket", F.col("n_lines").alias(f"{side}_n"), F.col("digest").alias(f"_{side}"))
    both = pick(left, "left").join(pick(right, "right"), ["level", "bucket"], "full")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return both.select("level", "bucket", zero("left_n"), zero("right_n"), F.col("_left").eqNullSafe(F.col("_right")).alias("same"))


def differing_lines(left: DataFrame, right: DataFrame, buckets: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``line, left_n, right_n`` of the lines whose numbers differ, looked for in the named leaf ``buckets`` only.

    ``left`` and ``right`` have a column ``line``. Equal lines are counted before anything is shuffled.
    """
    own = F.substring(F.sha2("line", 256), 1, depth).alias("bucket")
    side = lambda df, l, r: df.select("line", own, F.lit(l).alias("l"), F.lit(r).alias("r")).join(
        buckets.select("bucket").distinct(), "bucket", "left_semi"
    )
    both = side(left, 1, 0).union(side(right, 0, 1)).groupBy("line").agg(F.sum("l").alias("left_n"), F.sum("r").alias("right_n"))
    return both.where(F.col("left_n") != F.col("right_n"))
