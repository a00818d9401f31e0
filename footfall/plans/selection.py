"""Keeping n rows, or one row, of every group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.plans.scratch import materialise

# Up to this n Spark prunes row_number() <= n per map task before the shuffle.
_GROUP_LIMIT_CONF = "spark.sql.optimizer.windowGroupLimitThreshold"
_GROUP_LIMIT_DEFAULT = 1000


def top_n(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, rank: str | None = None
) -> DataFrame:
    """The first ``n`` rows of every group; ``rank`` names an optional 1-based rank column.

    For small n the window is pruned before the shuffle (``WindowGroupLimit``). Above Spark's
    threshold the rows of a group are first ranked in salted sub-groups, so that the final
    window sees at most ``salts * n`` rows of any group.
    """
    spark = df.sparkSession
    name = rank or "_rank"
    prune_up_to = int(spark.conf.get(_GROUP_LIMIT_CONF, None) or _GROUP_LIMIT_DEFAULT)
    if n > prune_up_to:
        salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salts)))
        inner = Window.partitionBy(*group, "_salt").orderBy(*order)
        df = salted.withColumn("_inner", F.row_number().over(inner)).where(F.col("_inner") <= n)
        df = df.drop("_salt", "_inner")
    window = Window.partitionBy(*group).orderBy(*order)
    kept = df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= n)
    return kept if rank else kept.drop(name)


def _winners(narrow: DataFrame, keys: Sequence[str], row_key: Sequence[str]) -> DataFrame:
    """``keys, _winner`` for keys that occur more than once; ``narrow`` has a ``_class`` column.

    However many copies a key has, each task first reduces them to one.
    """
    best = F.min(F.struct("_class", *row_key)).alias("_best")
    return (
        narrow.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_copies"), best)
        .where(F.col("_copies") > 1)
        .select(*keys, F.struct(*[F.col(f"_best.{c}").alias(c) for c in row_key]).alias("_winner"))
    )


def keep_one(
    df: DataFrame, keys: Sequence[str], row_key: Sequence[str], prefer: DataFrame | None = None
) -> DataFrame:
    """One row per ``keys``: the lowest ``row_key`` (which is unique within a key).

    The narrow key columns are pre-aggregated, and only keys that really repeat are joined back
    to the wide rows. Where repeats are few that side is broadcast and the wide rows are never
    shuffled.

    ``prefer`` may hold ``keys + row_key + [_class]`` for the same rows; a lower ``_class``
    then wins over a lower ``row_key``.
    """
    narrow = prefer if prefer is not None else df.select(*keys, *row_key).withColumn("_class", F.lit(0))
    own = F.struct(*[F.col(c) for c in row_key])
    winners = _winners(narrow, keys, row_key).withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:  # null keys are keys too
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return (
        df.join(winners, same, "left")
        .where(F.col("_winner").isNull() | own.eqNullSafe(F.col("_winner")))
        .select(*df.columns)
    )


def losing_rows(narrow: DataFrame, keys: Sequence[str], row_key: Sequence[str]) -> DataFrame:
    """The rows :func:`keep_one` would drop, as ``keys + row_key``.

    For keys that are costly to compute: store ``narrow`` once, take the losers from it, and
    anti-join the wide rows on their own columns.
    """
    own = F.struct(*[F.col(c) for c in row_key])
    winners = _winners(narrow.withColumn("_class", F.lit(0)), keys, row_key)
    return narrow.join(winners, list(keys)).where(~own.eqNullSafe(F.col("_winner"))).select(*keys, *row_key)


def lowest_hashed(
    ids: DataFrame, key: str, n: int, seed: int, priority: Column | None = None
) -> DataFrame:
    """Exactly ``n`` of the distinct ``key`` values, by ascending seeded hash; all if fewer.

    ``priority`` keys come before the others. A global sort-and-limit would gather n rows per
    map task in one reducer; instead keys are counted per hash bucket (at most 131,072 rows),
    whole buckets are taken, and only the bucket where the limit falls is sorted.
    """
    buckets = 1 << 16
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    late = F.lit(0) if priority is None else F.when(priority, 0).otherwise(buckets)
    slot = F.conv(F.substring(digest, 1, 4), 16, 10).cast("int") + late
    hashed = materialise(ids.select(key, digest.alias("_digest"), slot.alias("_slot")), "hashed-keys")  # read three times
    before = Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    counts = (
        hashed.groupBy("_slot")
        .agg(F.count(F.lit(1)).alias("_size"))
        .withColumn("_room", F.lit(n) - F.coalesce(F.sum("_size").over(before), F.lit(0)))
        .where(F.col("_room") > 0)
    )
    reached = hashed.join(F.broadcast(counts), "_slot")
    whole = reached.where(F.col("_size") <= F.col("_room")).select(key)
    in_slot = Window.partitionBy("_slot").orderBy("_digest", key)
    edge = (
        reached.where(F.col("_size") > F.col("_room"))
        .withColumn("_rank", F.row_number().over(in_slot))
        .where(F.col("_rank") <= F.col("_room"))
        .select(key)
    )
    return whole.unionByName(edge)
