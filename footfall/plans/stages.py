"""The three jobs end to end: build interactions, build instances, evaluate.

Each takes frames and returns a record of lazy frames; sinks are in ``footfall.sources.tables``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.functions import text as tx
from footfall.operators import attention as att
from footfall.operators import cores, metrics, pools, population, ranking, sequences, splits
from footfall.operators import reviews as rev
from footfall.plans.scratch import materialise
from footfall.sources.tables import scan_required

# Defaults of the published configuration.
SEED, USER_POOL = 42, 27_000
CORE_USER = CORE_ITEM = 5
MIN_RATING, MIN_CHARS = 5.0, 100
RAW_KEYS = ("user_id", "parent_asin", "timestamp")
RAW_COLUMNS = (*RAW_KEYS, "rating", "title", "text")


@dataclass(frozen=True)
class Interactions:
    """Frozen sample of a review corpus: its rows, the manifest, and statistics."""

    rows: DataFrame
    manifest: DataFrame
    core_rounds: int
    stats_before: DataFrame
    stats_after: DataFrame
    unseen_before: DataFrame
    unseen_after: DataFrame

    def sample(self) -> DataFrame:
        """Input of query generation: keys and texts with empty query columns."""
        return self.rows.select(
            "user_id", F.col("item_id").alias("parent_asin"), "timestamp", "title", "text",
            F.lit("").alias("query"), F.lit(False).alias("is_fallback"),
        )


def build_interactions(
    reviews: DataFrame, n_users: int = USER_POOL, ku: int = CORE_USER, ki: int = CORE_ITEM, seed: int = SEED,
    min_rating: float = MIN_RATING, min_chars: int = MIN_CHARS, max_history: int = splits.MAX_HISTORY,
) -> Interactions:
    """Raw reviews -> dedup -> priority sample -> in-sample k-core -> leave-last-out manifest.

    ``reviews`` has the raw columns and a unique ``row_id`` (see ``scan_with_row_id``).
    """
    raw = scan_required(reviews, [*RAW_COLUMNS, "row_id"], RAW_KEYS).withColumnRenamed("parent_asin", "item_id")
    content = rev.dedup_content(raw, "item_id", ["user_id", "row_id"])
    log = materialise(rev.dedup_user_item(content, ["timestamp", "row_id"]).drop("row_id"), "log")

    good = cores.priority_users(log, rev.quality(min_rating, min_chars), ku, ki)
    pool = cores.kcore(log.select("user_id", "item_id"), ku, ki).users()
    sampled = materialise(cores.sample_users_priority_first(pool, good, n_users, seed), "sampled-users")
    before = cores.rows_of(log, sampled)
    kept, rounds = cores.resampled_core(log, sampled, ku, ki)
    rows = materialise(kept, "sample-rows")

    narrow = rows.withColumn("review_hash", tx.review_hash(F.col("title"), F.col("text"))).drop("title", "text")
    assigned = materialise(splits.leave_last_out(narrow, max_history), "assigned")
    cleaned = splits.drop_unseen_targets(assigned)
    return Interactions(
        rows=rows,
        manifest=materialise(splits.split_manifest(cleaned), "manifest"),
        core_rounds=rounds,
        stats_before=rev.interaction_stats(before),
        stats_after=rev.interaction_stats(rows),
        unseen_before=splits.unseen_target_rate(assigned),
        unseen_after=splits.unseen_target_rate(cleaned),
    )


@dataclass(frozen=True)
class Prepared:
    """Everything training and evaluation read."""

    log: DataFrame
    train_sequences: DataFrame
    instances: DataFrame
    review_pool: DataFrame

    def users(self) -> DataFrame:
        return self.log.select("user_id", "uid").distinct()

    def items(self) -> DataFrame:
        return self.log.select("item_id", "iid").distinct()


def build_instances(
    queries: DataFrame, manifest: DataFrame, k_core: int = 0, n_users: int = 0, seed: int = SEED,
    max_history: int = splits.MAX_HISTORY, reviews_per_item: int = pools.FALLBACK_REVIEWS, dedup: bool = True,
) -> Prepared:
    """Generated queries + manifest -> split log, train sequences, query instances, train review pool.

    ``queries`` has one row per (user, item, time), as ``merge_latest`` leaves it. Stops when it
    does not, or when an instance disagrees with the manifest.
    """
    log = rev.normalise_columns(queries)
    if dedup:
        log = rev.dedup_user_item_protected(log, manifest, ["timestamp"])
    if k_core > 0:
        log = cores.kcore(log, k_core, k_core).restrict(log)
    if n_users > 0:
        sampled = cores.sample_users(log.select("user_id").distinct(), n_users, seed)
        log = cores.resampled_core(log, sampled, k_core, k_core)[0] if k_core > 0 else cores.rows_of(log, sampled)
    # Dense uids and positions make a stable id of every row, and so of every instance.
    placed = splits.prepare_log(log, manifest)
    ready = materialise(placed.withColumn("instance_id", F.shiftleft("uid", 32) + F.col("pos")), "prepared")
    instances = materialise(sequences.query_instances(ready, max_history=max_history), "instances")
    faults = splits.verify_split(instances, manifest).first().asDict()
    if any(faults.values()):
        raise ValueError(f"instances disagree with the manifest: {faults}")
    keyed = ready.withColumn("review_key", F.concat_ws("\t", "user_id", "item_id", F.col("timestamp").cast("string")))
    return Prepared(
        log=ready,
        train_sequences=sequences.train_sequences(ready, max_history),
        instances=instances,
        review_pool=pools.first_reviews(keyed, "review_key", reviews_per_item),
    )


def require_vectors(instances: DataFrame, queries: DataFrame, items: DataFrame) -> None:
    """Stops when an instance has no query vector, or its target or a history item no item vector.

    Such instances would drop out of the joins without a word, and two models would be compared on
    different users.
    """
    asked = instances.join(queries.select("instance_id"), "instance_id", "left_anti").count()
    needed = instances.select(F.explode(F.concat(F.array("target_iid"), "history_iids")).alias("iid")).distinct()
    unknown = needed.join(items.select("iid"), "iid", "left_anti").count()
    if asked or unknown:
        raise ValueError(f"{asked} instances without a query vector, {unknown} items without a vector")


def evaluate(
    instances: DataFrame, queries: DataFrame, items: DataFrame, dropped: DataFrame | None = None,
    attention: str = "hard", fusion: str = "context", mode: str = "full",
    tau_beh: float = att.TAU, tau_sem: float = att.TAU, cutoffs: tuple[int, ...] = metrics.CUTOFFS,
) -> DataFrame:
    """One row of metrics and rank percentiles of the usable instances over the whole catalog.

    ``instances`` are as :func:`build_instances` leaves them; ``queries`` is ``instance_id, query_vec, attn_vec`` with
    the text vector and its projection into the behaviour space; ``items`` is ``iid, text_vec,
    behaviour_vec``. ``mode`` is ``full``, ``query_only`` or ``behaviour_only``; residual fusion
    has no semantic term.
    """
    usable = sequences.usable_instances(instances)
    if dropped is not None:
        usable = population.drop_listed(usable, dropped)
    usable = materialise(usable, "evaluated")
    require_vectors(usable, queries, items)
    behaviour, semantic = mode != "query_only", mode != "behaviour_only" and not (mode == "full" and fusion == "residual")
    sides = queries.join(usable.select("instance_id"), "instance_id", "left_semi")
    if behaviour:
        asked = queries.select("instance_id", F.col("attn_vec").alias("query_vec"))
        attended = att.attend(usable, items, asked, attention, key="behaviour_vec", value="behaviour_vec")
        last = att.last_vectors(usable, items, "behaviour_vec")
        sides = sides.join(att.user_vectors(attended.select("instance_id", "context_vec"), last, asked, fusion), "instance_id")
    left = ranking.score_vectors(
        sides, "instance_id", "user_vec" if behaviour else None, "query_vec" if semantic else None, tau_beh, tau_sem
    )
    right = ranking.score_vectors(
        items, "iid", "behaviour_vec" if behaviour else None, "text_vec" if semantic else None
    )
    ranks = materialise(ranking.target_ranks(usable, left, right), "ranks")
    one = metrics.rank_metrics(ranks, cutoffs).first().asDict()
    return metrics.rank_percentiles(ranks).select("*", *[F.lit(value).alias(name) for name, value in one.items()])
