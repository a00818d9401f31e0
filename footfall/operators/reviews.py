"""Canonical interactions, quality filters, deduplication and integrity checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions import text as tx
from footfall.plans.scratch import materialise
from footfall.plans.selection import keep_one, losing_rows

KEYS = ("user_id", "item_id", "timestamp")
# Column names, required columns and types of the tables that are exchanged.
_RENAMES = {"parent_asin": "item_id", "title": "review_title", "text": "review_text"}
_REQUIRED = ("user_id", "item_id", "timestamp", "query")
_CASTS = {
    "user_id": "string",
    "item_id": "string",
    "timestamp": "bigint",
    "query": "string",
    "review_title": "string",
    "review_text": "string",
}


def normalise_columns(df: DataFrame) -> DataFrame:
    """Canonical names and types, defaults for optional columns, rows without a query dropped."""
    df = df.withColumnsRenamed({old: new for old, new in _RENAMES.items() if old in df.columns})
    missing = [c for c in _REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    optional = {"review_title": F.lit(""), "review_text": F.lit(""), "is_c4_user": F.lit(False)}
    df = df.withColumns({c: v for c, v in optional.items() if c not in df.columns})
    df = df.withColumns({c: F.col(c).cast(t) for c, t in _CASTS.items()})
    return df.where(~tx.is_blank(F.col("query")))


def quality(min_rating: float = 5.0, min_chars: int = 100, rating: str = "rating", text: str = "text") -> Column:
    """Highly rated and long enough; false when rating is null, null text counts as empty."""
    return F.coalesce(F.col(rating) >= min_rating, F.lit(False)) & (F.length(tx.or_empty(F.col(text))) >= min_chars)


def quality_rate(df: DataFrame, predicate: Column) -> DataFrame:
    """One row: rows, rows passing, pass rate."""
    passed = predicate.cast("int")
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(passed).alias("n_pass"), F.avg(passed).alias("pass_rate")
    )


def dedup_user_item(df: DataFrame, row_key: Sequence[str], user: str = "user_id", item: str = "item_id") -> DataFrame:
    """The earliest row of every (user, item). ``row_key`` starts with the time and ends unique."""
    return keep_one(df, [user, item], row_key)


def dedup_user_item_protected(df: DataFrame, targets: DataFrame, row_key: Sequence[str]) -> DataFrame:
    """As :func:`dedup_user_item`, but a row that is an evaluation target beats earlier rows."""
    flags = targets.select(*KEYS).distinct().withColumn("_class", F.lit(0))
    extra = [c for c in row_key if c not in KEYS]
    narrow = (
        df.select(*KEYS, *extra).join(flags, list(KEYS), "left").withColumn("_class", F.coalesce("_class", F.lit(1)))
    )
    return keep_one(df, ["user_id", "item_id"], row_key, prefer=narrow)


def protected_counts(before: DataFrame, after: DataFrame, targets: DataFrame) -> DataFrame:
    """One row: rows and protected rows (evaluation targets) before and after a protected dedup.

    The difference of the protected ones had more than one target per (user, item).
    """
    flags = targets.select(*KEYS).distinct().withColumn("_p", F.lit(1))

    def counts(df: DataFrame, when: str) -> DataFrame:
        flagged = df.select(*KEYS).join(flags, list(KEYS), "left")
        return flagged.agg(F.count(F.lit(1)).alias(f"n_{when}"), F.count("_p").alias(f"n_protected_{when}"))

    return counts(before, "before").join(F.broadcast(counts(after, "after")))


def with_review_hash(df: DataFrame, title: str = "title", text: str = "text", out: str = "review_hash") -> DataFrame:
    return df.withColumn(out, tx.review_hash(F.col(title), F.col(text)))


def content_groups(hashed: DataFrame, item: str, user: str = "user_id", rating: str = "rating") -> DataFrame:
    """Groups of equal (item, time, content): rows, whether users differ, whether ratings conflict.

    Differences are told by min and max, so a group of any size is pre-aggregated per task. A
    null rating counts as a value of its own.
    """
    r = F.col(rating)
    mixed_null = (F.count(r) > 0) & (F.count(r) < F.count(F.lit(1)))
    several_users = F.min(user) != F.max(user)
    several_ratings = F.coalesce(F.min(r) != F.max(r), F.lit(False)) | mixed_null
    return (
        hashed.groupBy(item, "timestamp", "review_hash")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            several_users.alias("cross_user"),
            (several_users & several_ratings).alias("conflict"),
        )
        .where(F.col("n_rows") > 1)
    )


def content_conflicts(hashed: DataFrame, item: str, user: str = "user_id", rating: str = "rating") -> DataFrame:
    """One row of totals over :func:`content_groups`."""
    groups = content_groups(hashed, item, user, rating)
    return groups.agg(
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_dup_rows"),
        F.count(F.lit(1)).alias("n_dup_groups"),
        F.count(F.when(F.col("cross_user"), 1)).alias("n_cross_user_groups"),
        F.count(F.when(F.col("conflict"), 1)).alias("n_conflict_groups"),
    )


def dedup_content(
    df: DataFrame, item: str, row_key: Sequence[str], title: str = "title", text: str = "text", rating: str = "rating"
) -> DataFrame:
    """One row per (item, time, content); stops when copies across users disagree on the rating.

    ``row_key`` starts with the user and, with item and time, identifies a row. Texts are hashed
    in one pass into a stored narrow table; the conflict check and the choice of rows use that
    table, and the wide rows only lose the rows on the usually short list of repeats.
    """
    columns = list(dict.fromkeys([item, "timestamp", "review_hash", "user_id", rating, *row_key]))
    narrow = materialise(with_review_hash(df, title, text).select(*columns), "content-keys")
    conflicts = content_conflicts(narrow, item, rating=rating).first()["n_conflict_groups"]
    if conflicts:
        raise ValueError(f"{conflicts} groups of equal reviews across users disagree on the rating")
    repeats = losing_rows(narrow, [item, "timestamp", "review_hash"], row_key)
    own = [item, "timestamp", *row_key]
    return df.join(repeats.select(*own), own, "left_anti")


def key_integrity(df: DataFrame, keys: Sequence[str] = KEYS, time: str = "timestamp") -> DataFrame:
    """One row: rows, nulls per key, time range."""
    nulls = [F.count(F.when(F.col(k).isNull(), 1)).alias(f"null_{k}") for k in keys]
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), *nulls, F.min(time).alias("min_time"), F.max(time).alias("max_time")
    )


def require_integrity(df: DataFrame, required: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """``df`` itself, after checking that required columns exist and no key is null."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"required columns missing: {missing}")
    row = key_integrity(df, keys, keys[-1]).first()
    bad = {k: row[f"null_{k}"] for k in keys if row[f"null_{k}"]}
    if bad:
        raise ValueError(f"null keys: {bad}")
    return df


def shape(df: DataFrame, user: str = "user_id", item: str = "item_id") -> DataFrame:
    """One row: rows, distinct users, distinct items."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct(user).alias("n_users"),
        F.countDistinct(item).alias("n_items"),
    )


def interaction_stats(df: DataFrame, user: str = "user_id", item: str = "item_id") -> DataFrame:
    """One row of per-user and per-item interaction counts: mean, median, share of single-row items.

    The exact median keeps one entry per distinct count, and n rows have at most about
    sqrt(2n) distinct counts, so its state stays small. Rows with a null key count for the
    other side only.
    """
    degrees = df.groupingSets([[user], [item]], user, item).agg(F.count(F.lit(1)).alias("_d"))
    per_item = F.when(F.col(item).isNotNull(), F.col("_d"))
    per_user = F.when(F.col(user).isNotNull(), F.col("_d"))
    return degrees.agg(
        F.count(per_item).alias("n_items"),
        F.sum(per_item).alias("n_inter"),
        F.avg(per_item).alias("item_inter_mean"),
        F.median(per_item).alias("item_inter_median"),
        (F.avg((per_item == 1).cast("int")) * 100).alias("item_single_pct"),
        F.count(per_user).alias("n_users"),
        F.avg(per_user).alias("user_inter_mean"),
        F.median(per_user).alias("user_inter_median"),
    )


def limit_to_first_items(df: DataFrame, n: int, iid: str = "iid") -> DataFrame:
    """Rows of the first ``n`` catalog items; dense ids start at 1, so this is a range filter."""
    return df if n <= 0 else df.where(F.col(iid) <= n)
