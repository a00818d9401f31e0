"""Row positions in a total order, without sending all rows (or one hot group) to one task.

``row_number()`` over an unpartitioned window runs in a single task, and over a group it runs
in one task per group. Here rows are range-partitioned on the whole sort key, so even one huge
group is spread over many tasks, and positions come from per-partition row counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.plans.scratch import materialise

# monotonically_increasing_id(): partition index above this bit, row index within it below.
_LOCAL_BITS = 33


def _columns(keys: Sequence[str | Column]) -> list[Column]:
    return [F.col(k) if isinstance(k, str) else k for k in keys]


def with_global_position(df: DataFrame, order: Sequence[str | Column], tag: str = "positions") -> DataFrame:
    """Add ``position``: the 0-based place of each row in the total order ``order``.

    ``order`` must be unique per row for the result to be reproducible.
    """
    keys = _columns(order)
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # Range bounds are sampled, so the placement is stored once and read by both passes.
    stored = materialise(placed.withColumn("_slot", F.monotonically_increasing_id()), tag)
    stored = stored.withColumn("_part", F.shiftright("_slot", _LOCAL_BITS))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per written partition: the window and the broadcast are bounded by the task count.
    offsets = (
        stored.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    local = F.col("_slot").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    return (
        stored.join(F.broadcast(offsets), "_part")
        .withColumn("position", local + F.col("_offset"))
        .drop("_slot", "_part", "_offset")
    )


def with_group_position(
    df: DataFrame, group: Sequence[str], order: Sequence[str | Column], tag: str = "group-positions"
) -> DataFrame:
    """Add ``group_position`` (0-based) and ``group_size``; group columns must not be null.

    The join back carries one small row per group; AQE splits a hot group on the row side.
    """
    placed = with_global_position(df, [*group, *order], tag)
    heads = placed.groupBy(*group).agg(
        F.min("position").alias("_head"), F.count(F.lit(1)).alias("group_size")
    )
    return (
        placed.join(heads, list(group))
        .withColumn("group_position", F.col("position") - F.col("_head"))
        .drop("position", "_head")
    )


def dense_ids(df: DataFrame, key: str, out: str) -> DataFrame:
    """``key -> out``: sorted distinct keys numbered from 1 (0 stays free for padding)."""
    keys = df.select(key).where(F.col(key).isNotNull()).distinct()
    return with_global_position(keys, [key], f"ids-{out}").select(
        key, (F.col("position") + 1).alias(out)
    )
