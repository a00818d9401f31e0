"""Ranking metrics, rank percentiles and pairwise losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.vectors import log_sigmoid
from footfall.plans.scratch import materialise

CUTOFFS = (10, 50)
# Bits of a value that one histogram settles.
_DIGIT = 16


def _metric_columns(cutoffs: tuple[int, ...], rank: str) -> list[Column]:
    r = F.col(rank)
    out = [F.count(r).alias("n_eval"), F.avg(F.lit(1.0) / r).alias("mrr")]
    for k in cutoffs:
        hit = r <= k
        out.append(F.avg(hit.cast("int")).alias(f"hr_{k}"))
        out.append(F.avg(F.when(hit, F.lit(1.0) / F.log2(r + 1)).otherwise(0.0)).alias(f"ndcg_{k}"))
    return out


def rank_metrics(ranks: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS, rank: str = "rank") -> DataFrame:
    """One row: n_eval, MRR, and HR and NDCG per cutoff; nulls and n_eval = 0 when there are no ranks."""
    return ranks.agg(*_metric_columns(cutoffs, rank))


def rank_metrics_by(ranks: DataFrame, groups: list[str], cutoffs: tuple[int, ...] = CUTOFFS, rank: str = "rank") -> DataFrame:
    """:func:`rank_metrics` per group, for instance per split."""
    return ranks.groupBy(*groups).agg(*_metric_columns(cutoffs, rank))


def rank_percentiles(ranks: DataFrame, rank: str = "rank", points: tuple[int, ...] = (50, 90)) -> DataFrame:
    """One row: mean rank and, per point p, the rank at 0-based place floor(n * p / 100) of the sorted ranks.

    Nothing is sorted. One aggregation counts each distinct rank, and a place is found digit by digit in the
    counts: a digit has 16 bits, so one histogram serves a catalog of 65,536 items and two serve 2^32. Ranks are
    not negative; null ranks are left out; without ranks all is null.
    """
    counts = ranks.where(F.col(rank).isNotNull()).groupBy(rank).agg(F.count(F.lit(1)).alias("n"))
    counts = materialise(counts, "rank-counts")
    facts = counts.agg(F.sum("n").alias("n"), F.max(rank).alias("top")).first()
    found = order_statistics(counts, rank, "n", facts["top"], [facts["n"] * p // 100 for p in points]) if facts["n"] else [None] * len(points)
    mean = F.sum(F.col(rank).cast("double") * F.col("n")) / F.sum("n")
    at = [F.lit(value).cast(counts.schema[rank].dataType).alias(f"rank_p{p}") for value, p in zip(found, points, strict=True)]
    return counts.agg(mean.alias("rank_mean")).select("rank_mean", *at)


def order_statistics(counts: DataFrame, value: str, n: str, top: int, places: list[int]) -> list[int]:
    """The values at 0-based ``places`` of the sorted multiset that ``value, n`` describes.

    ``top`` is the largest value. A round reads at most 2^16 sums per place, whatever the number of values.
    """
    heads, rest = [0] * len(places), list(places)
    for shift in reversed(range(0, max(1, int(top).bit_length()), _DIGIT)):
        head = F.shiftright(F.col(value).cast("bigint"), shift)
        open_ = F.shiftright(head, _DIGIT).isin(sorted(set(heads)))
        sums = sorted(counts.where(open_).groupBy(head.alias("head")).agg(F.sum(n).alias("n")).collect())
        for i, parent in enumerate(heads):
            for own, size in sums:
                if own >> _DIGIT != parent:
                    continue
                if rest[i] < size:
                    heads[i] = own
                    break
                rest[i] -= size
    return heads


def pairwise_loss(positive: Column, negative: Column) -> Column:
    """-log sigmoid(positive - negative)."""
    return -log_sigmoid(positive - negative)


def mean_losses(scored: DataFrame, aux_weight: float) -> DataFrame:
    """One row: mean joint loss, mean attention-only loss, and joint + weight * attention-only.

    Expects ``pos_score, neg_score, act_pos_score, act_neg_score``.
    """
    joint = F.avg(pairwise_loss(F.col("pos_score"), F.col("neg_score")))
    act = F.avg(pairwise_loss(F.col("act_pos_score"), F.col("act_neg_score")))
    return scored.agg(
        F.count(F.lit(1)).alias("n_pairs"),
        joint.alias("joint_loss"),
        act.alias("act_loss"),
        (joint + F.lit(float(aux_weight)) * act).alias("loss"),
    )
