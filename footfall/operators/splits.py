"""Chronological leave-last-out splits, the split manifest, and checks on both."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footfall.operators.reviews import KEYS
from footfall.plans.positions import dense_ids, with_group_position
from footfall.plans.selection import top_n

MAX_HISTORY = 200


def leave_last_out(df: DataFrame, max_history: int = MAX_HISTORY, tie_break: Sequence[str] = ()) -> DataFrame:
    """The last ``max_history + 2`` rows of every user with ``split``.

    The last row is ``test``, the one before ``valid``, the rest ``train``; users with fewer
    than three rows are all ``train``. Order is (timestamp, item_id), then ``tie_break``, then a hash
    of the row, so that it does not depend on the tasks.
    """
    recent = [*[F.col(c).desc() for c in ("timestamp", "item_id", *tie_break)], F.xxhash64(*df.columns).desc()]
    tail = top_n(df, ["user_id"], recent, max_history + 2, rank="_from_end")
    size = F.count(F.lit(1)).over(Window.partitionBy("user_id"))
    split = (
        F.when(F.col("_size") < 3, "train")
        .when(F.col("_from_end") == 1, "test")
        .when(F.col("_from_end") == 2, "valid")
        .otherwise("train")
    )
    return tail.withColumn("_size", size).withColumn("split", split).drop("_size", "_from_end")


def drop_unseen_targets(assigned: DataFrame) -> DataFrame:
    """Users whose valid *or* test item never occurs in train leave the evaluation with both rows.

    Train rows are kept, and the dropped targets do not move into train.
    """
    train_items = assigned.where(F.col("split") == "train").select("item_id").distinct()
    held_out = assigned.where(F.col("split") != "train")
    unseen = held_out.join(train_items, "item_id", "left_anti").select("user_id").distinct()
    marked = assigned.join(unseen.withColumn("_unseen", F.lit(True)), "user_id", "left")
    return marked.where((F.col("split") == "train") | F.col("_unseen").isNull()).drop("_unseen")


def unseen_target_rate(assigned: DataFrame) -> DataFrame:
    """Per split: targets, targets whose item is not in train, and their share (null when empty)."""
    train_items = assigned.where(F.col("split") == "train").select("item_id").distinct()
    targets = assigned.where(F.col("split") != "train").select("split", "item_id")
    marked = targets.join(train_items.withColumn("_seen", F.lit(True)), "item_id", "left")
    unseen = F.col("_seen").isNull().cast("int")
    return marked.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_users"), F.sum(unseen).alias("n_unseen"), F.avg(unseen).alias("rate")
    )


def split_manifest(assigned: DataFrame) -> DataFrame:
    """``split, user_id, item_id, timestamp, review_hash, history`` for every target that is left.

    ``assigned`` is :func:`leave_last_out` output with ``review_hash``; a user has at most
    ``max_history + 2`` rows there, so a user's rows fit in one array.
    """
    row = F.struct("timestamp", "item_id", "review_hash", "split")
    per_user = assigned.groupBy("user_id").agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    placed = per_user.select("user_id", "_rows", F.posexplode("_rows").alias("_i", "_r"))
    history = F.transform(F.slice("_rows", F.lit(1), F.col("_i")), lambda r: r["item_id"])
    return placed.where(F.col("_r.split") != "train").select(
        F.col("_r.split").alias("split"),
        "user_id",
        F.col("_r.item_id").alias("item_id"),
        F.col("_r.timestamp").alias("timestamp"),
        F.col("_r.review_hash").alias("review_hash"),
        history.alias("history"),
    )


def evaluable_manifest(assigned: DataFrame) -> DataFrame:
    """The manifest without users that :func:`drop_unseen_targets` removes."""
    return split_manifest(drop_unseen_targets(assigned))


def split_keys(manifest: DataFrame) -> DataFrame:
    """The distinct target keys of both splits with their split."""
    return manifest.select(*KEYS, "split").distinct()


def assign_split(df: DataFrame, manifest: DataFrame) -> DataFrame:
    """Take the split from the manifest by (user, item, time); everything else is ``train``.

    A key that is a target of both splits would double its row and is refused.
    """
    keys = split_keys(manifest)
    twice = keys.groupBy(*KEYS).count().where(F.col("count") > 1)
    if not twice.isEmpty():
        raise ValueError("a manifest key belongs to both valid and test")
    plain = df.drop("split") if "split" in df.columns else df
    return plain.join(keys, list(KEYS), "left").withColumn("split", F.coalesce("split", F.lit("train")))


def split_audit(assigned: DataFrame, manifest: DataFrame) -> DataFrame:
    """Per evaluation split: manifest keys, rows matched, and whether they agree."""
    expected = split_keys(manifest).groupBy("split").agg(F.count(F.lit(1)).alias("n_manifest"))
    matched = assigned.where(F.col("split") != "train").groupBy("split").agg(F.count(F.lit(1)).alias("n_matched"))
    return expected.join(matched, "split", "left").select(
        "split",
        "n_manifest",
        F.coalesce("n_matched", F.lit(0)).alias("n_matched"),
        (F.col("n_manifest") == F.coalesce("n_matched", F.lit(0))).alias("complete"),
    )


def with_sequence_position(df: DataFrame, tie_break: Sequence[str] = ()) -> DataFrame:
    """``seq_len`` and 0-based ``pos`` of every row in its user's (timestamp, item_id) order.

    Rows are stored on the way, so give it narrow ones; see :func:`prepare_log` for wide ones.
    """
    placed = with_group_position(df, ["user_id"], ["timestamp", "item_id", *tie_break], "sequence")
    return placed.withColumnsRenamed({"group_position": "pos", "group_size": "seq_len"})


def prepare_log(
    df: DataFrame, manifest: DataFrame, ids: Mapping[str, str] | None = None, tie_break: Sequence[str] = ()
) -> DataFrame:
    """Add ``split``, ``seq_len``, ``pos`` and dense ids (default ``uid`` and ``iid``) to a log.

    (user, item, time) plus ``tie_break`` identifies a row; a log where it does not is refused.
    Splits, positions and ids are worked out on these columns alone, so texts and other wide
    columns are moved by one join at the end.
    """
    ids = ids if ids is not None else {"user_id": "uid", "item_id": "iid"}
    row_key = [*KEYS, *tie_break]
    placed = with_sequence_position(assign_split(df.select(*row_key), manifest), tie_break)
    if not placed.groupBy(*row_key).count().where(F.col("count") > 1).isEmpty():
        raise ValueError(f"rows are not identified by {row_key}: deduplicate or name a tie_break")
    for key, out in ids.items():
        placed = placed.join(dense_ids(placed, key, out), key)
    return df.join(placed, row_key)


def split_counts(df: DataFrame) -> DataFrame:
    """Per split: rows, users, items."""
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("user_id").alias("n_users"),
        F.countDistinct("item_id").alias("n_items"),
    )


def verify_split(instances: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row of four counts that must be 0: instance keys outside the manifest, or in the other split.

    Instance keys are ``user_id, target_item_id, target_timestamp`` with ``split``.
    """
    final = instances.select(
        "user_id",
        F.col("target_item_id").alias("item_id"),
        F.col("target_timestamp").alias("timestamp"),
        F.col("split"),
    ).where(F.col("split") != "train").distinct()
    claims = split_keys(manifest).groupBy(*KEYS).agg(
        F.max((F.col("split") == "valid").cast("int")).alias("_valid"),
        F.max((F.col("split") == "test").cast("int")).alias("_test"),
    )
    joined = final.join(claims, list(KEYS), "left")

    def total(split: str, own: str, other: str) -> list:
        mine = F.col("split") == split
        return [
            F.count(F.when(mine & (F.coalesce(own, F.lit(0)) == 0), 1)).alias(f"{split}_not_in_manifest"),
            F.count(F.when(mine & (F.coalesce(other, F.lit(0)) == 1), 1)).alias(f"{split}_in_other_split"),
        ]

    return joined.agg(*total("valid", "_valid", "_test"), *total("test", "_test", "_valid"))
