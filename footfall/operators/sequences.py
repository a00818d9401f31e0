"""Per-user sequences and history instances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.text import single_line
from footfall.functions.vectors import elapsed_days, let, pad_left
from footfall.operators.splits import MAX_HISTORY
from footfall.plans.selection import top_n

# Rows of one user are handled in runs of this many, so a user of any length is split.
_RUN = 1000


def train_sequences(df: DataFrame, max_history: int = MAX_HISTORY) -> DataFrame:
    """``uid, user_id, item_seq, raw_item_seq, time_seq``: the last train rows of every user in order."""
    train = df.where(F.col("split") == "train").select("uid", "user_id", "iid", "item_id", "timestamp")
    tail = top_n(train, ["uid"], [F.col("timestamp").desc(), F.col("iid").desc()], max_history)
    row = F.array_sort(F.collect_list(F.struct("timestamp", "iid", "item_id")))
    return (
        tail.groupBy("uid", "user_id")
        .agg(row.alias("_s"))
        .select(
            "uid",
            "user_id",
            F.col("_s.iid").alias("item_seq"),
            F.col("_s.item_id").alias("raw_item_seq"),
            F.col("_s.timestamp").alias("time_seq"),
        )
    )


def seen_items(sequences: DataFrame) -> DataFrame:
    """``uid, iid`` rows of every user's train sequence."""
    return sequences.select("uid", F.explode(F.array_distinct("item_seq")).alias("iid"))


def item_popularity(df: DataFrame, item: str = "iid") -> DataFrame:
    return df.groupBy(item).agg(F.count(F.lit(1)).alias("n_inter"))


def query_instances(df: DataFrame, splits: tuple[str, ...] = ("train", "valid", "test"), max_history: int = MAX_HISTORY) -> DataFrame:
    """One row per target of the wanted splits with up to ``max_history`` rows before it.

    Expects ``uid, user_id, iid, item_id, timestamp, pos, split, query, is_c4_user`` with ``pos``
    from :func:`with_sequence_position`. History rows come from every split. A user's sequence
    is cut into runs by ``pos``; the last rows of a run are also handed to as many following runs
    as they can be history of, so no task holds more than ``_RUN + max_history`` rows of a user and
    the result is the same as over the whole sequence. Targets without history are left out.
    """
    wanted = F.col("split").isin(*splits)
    extra = [c for c in ("instance_id",) if c in df.columns]
    run = F.floor(F.col("pos") / _RUN)
    reached = F.sequence(run, F.floor((F.col("pos") + max_history) / _RUN))
    rows = df.withColumn("_run", F.explode(reached))
    # Only targets in their own run need their texts; context rows carry ids and times.
    payload = F.when(wanted & (F.col("_run") == run), F.struct(F.col("query"), F.col("is_c4_user"), F.col("split"), *extra))
    row = F.struct("pos", "iid", "item_id", "timestamp", payload.alias("target"))
    grouped = rows.groupBy("uid", "user_id", "_run").agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    narrow = F.transform("_rows", lambda r: F.struct(r["iid"].alias("iid"), r["item_id"].alias("item_id"), r["timestamp"].alias("timestamp")))
    grouped = grouped.withColumn("_past", narrow)

    def with_history(r: Column, i: Column) -> Column:
        start = F.greatest(i - max_history, F.lit(0)) + 1
        past = F.slice("_past", start, F.least(i, F.lit(max_history)))
        return F.when(r["target"].isNotNull() & (i > 0), F.struct(r.alias("t"), past.alias("h")))

    made = F.filter(F.transform("_rows", with_history), lambda x: x.isNotNull())
    targets = grouped.select("uid", "user_id", F.explode(made).alias("_x"))
    targets = targets.select("uid", "user_id", F.col("_x.t").alias("_t"), F.col("_x.h").alias("_h"))
    return targets.select(
        *[F.col(f"_t.target.{c}").alias(c) for c in extra],
        "uid",
        "user_id",
        F.col("_t.iid").alias("target_iid"),
        F.col("_t.item_id").alias("target_item_id"),
        F.col("_t.timestamp").alias("target_timestamp"),
        F.col("_h.iid").alias("history_iids"),
        F.col("_h.item_id").alias("history_item_ids"),
        F.col("_h.timestamp").alias("history_timestamps"),
        single_line(F.col("_t.target.query")).alias("query"),
        F.col("_t.target.split").alias("split"),
        F.col("_t.target.is_c4_user").alias("is_c4_user"),
    )


def usable_instances(instances: DataFrame) -> DataFrame:
    """Instances with at least one history row and a query."""
    return instances.where((F.size("history_iids") > 0) & (F.coalesce("query", F.lit("")) != ""))


def with_history_deltas(instances: DataFrame) -> DataFrame:
    """``delta_days``: days between each history row and the target."""
    now = F.col("target_timestamp")
    return instances.withColumn("delta_days", F.transform("history_timestamps", lambda t: elapsed_days(now, t)))


def with_padded_history(instances: DataFrame, length: int = MAX_HISTORY) -> DataFrame:
    """``padded_iids``: the history at a fixed length, 0 on the left."""
    return instances.withColumn("padded_iids", pad_left(F.col("history_iids"), length))


def history_rows(instances: DataFrame, key: str = "instance_id") -> DataFrame:
    """``key, position, iid, delta_days``: one row per history entry, position from 0."""
    zipped = F.arrays_zip("history_iids", "history_timestamps")
    rows = instances.select(key, "target_timestamp", F.posexplode(zipped).alias("position", "_h"))
    return rows.select(
        key,
        "position",
        F.col("_h.history_iids").alias("iid"),
        elapsed_days(F.col("target_timestamp"), F.col("_h.history_timestamps")).alias("delta_days"),
    )


def negative_samples(
    instances: DataFrame, sequences: DataFrame, n_items: int, seed: int = 42, tries: int = 100, key: str = "instance_id", keep: Sequence[str] = ()
) -> DataFrame:
    """``key, target_iid, negative_iid, found``: one item per instance that is not in the user's train sequence.

    Try ``i`` is a seeded hash of (key, i). After ``tries`` failures one more draw is taken
    whatever it is, and ``found`` is false. Sequences are bounded by the history length, so a
    user's seen items travel as one array. Later tries are only computed where the earlier ones
    failed, usually the first one alone. The columns ``keep`` of the instances follow.
    """
    seen = sequences.select("uid", F.col("item_seq").alias("_seen"))
    joined = instances.select(*dict.fromkeys([key, "uid", "target_iid", *keep])).join(seen, "uid", "left")
    seen_array = F.coalesce("_seen", F.array().cast("array<bigint>"))

    def draw(i):
        digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), i.cast("string")))
        return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % n_items + 1

    def first_free(low: int, high: int):
        drawn = F.transform(F.sequence(F.lit(low), F.lit(high)), draw)
        free = F.filter(drawn, lambda x: (x != F.col("target_iid")) & ~F.array_contains(seen_array, x))
        return F.get(free, F.lit(0))

    ends = [0, *(n for n in (1, 4) if n < tries), tries]
    found = F.coalesce(*(first_free(low + 1, high) for low, high in zip(ends, ends[1:])))
    drawn = let(found, lambda x: F.struct(F.coalesce(x, draw(F.lit(tries + 1))).alias("negative_iid"), x.isNotNull().alias("found")))
    return joined.select(key, "target_iid", drawn.alias("_drawn"), *keep).select(key, "target_iid", "_drawn.negative_iid", "_drawn.found", *keep)


def last_history_item(instances: DataFrame, key: str = "instance_id") -> DataFrame:
    """``key, iid`` of the most recent history entry."""
    return instances.select(key, F.element_at("history_iids", -1).alias("iid"))
