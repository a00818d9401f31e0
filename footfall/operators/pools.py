"""Per-item review pools and the held-out reviews kept away from them.

Ranking runs on narrow rows (item, votes, time, review id); texts are joined for the rows that
are picked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.plans.positions import with_group_position
from footfall.plans.selection import top_n

POOL_CAP, CARD_REVIEWS, FALLBACK_REVIEWS = 2000, 8, 5


def first_reviews(df: DataFrame, review_key: str, n: int = FALLBACK_REVIEWS) -> DataFrame:
    """``iid, item_id, review_titles, review_texts, train_queries``: first train reviews by time."""
    train = df.where(F.col("split") == "train")
    narrow = train.select("iid", "timestamp", review_key)
    picked = top_n(narrow, ["iid"], [F.col("timestamp").asc(), F.col(review_key).asc()], n)
    wide = train.join(picked.select(review_key), review_key, "left_semi")
    row = F.struct("timestamp", review_key, "review_title", "review_text", "query")
    return (
        wide.groupBy("iid", "item_id")
        .agg(F.array_sort(F.collect_list(row)).alias("_r"))
        .select(
            "iid",
            "item_id",
            F.col("_r.review_title").alias("review_titles"),
            F.col("_r.review_text").alias("review_texts"),
            F.col("_r.query").alias("train_queries"),
        )
    )


def leak_keys(manifest: DataFrame, kind: str = "eval") -> DataFrame:
    """Keys of held-out reviews: ``item_id, user_id, timestamp, review_hash``.

    Works on a manifest or on an assigned interaction table; kinds other than ``eval`` and
    ``valid_test`` give no keys.
    """
    keys = manifest.where(F.col("split").isin("valid", "test")).select(
        "item_id", "user_id", "timestamp", "review_hash"
    )
    return (keys if kind in ("eval", "valid_test") else keys.where(F.lit(False))).distinct()


def flag_held_out(reviews: DataFrame, keys: DataFrame) -> DataFrame:
    """Add ``held_out``: the review is a target row, or has the content of one for the same item.

    The content test does not ask for the same user, which makes the (item, user, content)
    test redundant. Both sides keep the flag; nothing is filtered.
    """
    rows = keys.select("item_id", "user_id", "timestamp").distinct().withColumn("_row", F.lit(True))
    contents = keys.select("item_id", "review_hash").distinct().withColumn("_content", F.lit(True))
    flagged = reviews.join(rows, ["item_id", "user_id", "timestamp"], "left").join(
        contents, ["item_id", "review_hash"], "left"
    )
    held = F.coalesce("_row", F.lit(False)) | F.coalesce("_content", F.lit(False))
    return flagged.withColumn("held_out", held).drop("_row", "_content")


def _votes() -> Column:
    """Votes; none where they are not known."""
    return F.coalesce(F.col("helpful_vote"), F.lit(0))


def _by_votes(review_key: str) -> list[Column]:
    return [_votes().desc(), F.col("timestamp").desc(), F.col(review_key).asc()]


def review_pool(narrow: DataFrame, review_key: str, cap: int = POOL_CAP, item: str = "item_id") -> DataFrame:
    """The ``cap`` most helpful reviews per item, newer first among equals; adds ``pool_rank``."""
    return top_n(narrow, [item], _by_votes(review_key), cap, rank="pool_rank")


def _half_top_half_strided(rank: Column, size: Column, n: int) -> Column:
    """Whether 0-based ``rank`` of ``size`` is picked: the top half of n, then every step-th of the rest."""
    top = max(1, n // 2)
    spare = n - top
    step = F.greatest(F.lit(1), F.floor((size - top) / max(1, spare)))
    past = rank - top
    strided = (past >= 0) & (past % step == 0) & (F.floor(past / step) < spare)
    return (rank < top) | strided


def select_reviews(pool: DataFrame, n: int = CARD_REVIEWS, item: str = "item_id") -> DataFrame:
    """From :func:`review_pool`: half by votes, half spread over the rest; keeps ``pool_rank``."""
    size = F.count(F.lit(1)).over(Window.partitionBy(item))
    picked = _half_top_half_strided(F.col("pool_rank") - 1, F.col("_size"), n)
    return pool.withColumn("_size", size).where(picked).drop("_size")


def would_be_selected(kept_pool: DataFrame, excluded: DataFrame, review_key: str, n: int = CARD_REVIEWS) -> DataFrame:
    """Items with held-out reviews and whether the pick would take one if they were pooled.

    Held-out reviews are added behind equally voted pool reviews and are not capped, so an item
    can have any number of them: ranks come from the range-partitioned positions.
    """
    columns = ["item_id", "helpful_vote", "timestamp", review_key]
    both = kept_pool.select(*columns, F.lit(0).alias("_late")).unionByName(
        excluded.select(*columns, F.lit(1).alias("_late"))
    )
    both = both.join(excluded.select("item_id").distinct(), "item_id", "left_semi")
    order = [(-_votes()).alias("_v"), "_late", (-F.col("timestamp")).alias("_t"), review_key]
    ranked = with_group_position(both, ["item_id"], order, "pool-union")
    taken = _half_top_half_strided(F.col("group_position"), F.col("group_size"), n) & (F.col("_late") == 1)
    return ranked.groupBy("item_id").agg(F.max(taken.cast("int")).alias("_t")).select(
        "item_id", (F.col("_t") == 1).alias("would_be_selected")
    )


def card_stats(items: DataFrame, kept_pool: DataFrame, excluded: DataFrame, review_key: str, cap: int = POOL_CAP, n: int = CARD_REVIEWS) -> DataFrame:
    """One row: items, items without reviews, items at the cap, items with held-out reviews, selected rate."""
    sizes = kept_pool.groupBy("item_id").agg(F.count(F.lit(1)).alias("_n"))
    selected = would_be_selected(kept_pool, excluded, review_key, n)
    per_item = items.select("item_id").distinct().join(sizes, "item_id", "left").join(selected, "item_id", "left")
    pooled = F.coalesce("_n", F.lit(0))
    return per_item.agg(
        F.count(F.lit(1)).alias("n_items"),
        F.count(F.when(pooled == 0, 1)).alias("n_items_no_review"),
        F.count(F.when(pooled >= cap, 1)).alias("n_items_pool_capped"),
        F.count("would_be_selected").alias("n_items_with_held_out"),
        F.avg(F.col("would_be_selected").cast("int")).alias("held_out_selected_rate"),
    )


def leak_check(selected: DataFrame, keys: DataFrame) -> DataFrame:
    """One row ``n_eval_ids, n_card_ids, n_leaked``: (item, content) ids shared by both sides."""
    evaluated = keys.select("item_id", "review_hash").distinct().withColumn("_side", F.lit(1))
    carded = selected.select("item_id", "review_hash").distinct().withColumn("_side", F.lit(2))
    sides = evaluated.unionByName(carded).groupBy("item_id", "review_hash").agg(F.sum("_side").alias("_s"))
    return sides.agg(
        F.count(F.when(F.col("_s").isin(1, 3), 1)).alias("n_eval_ids"),
        F.count(F.when(F.col("_s").isin(2, 3), 1)).alias("n_card_ids"),
        F.count(F.when(F.col("_s") == 3, 1)).alias("n_leaked"),
    )


def require_no_leak(selected: DataFrame, keys: DataFrame) -> DataFrame:
    leaked = leak_check(selected, keys).first()["n_leaked"]
    if leaked:
        raise ValueError(f"{leaked} held-out reviews are among the selected reviews")
    return selected
