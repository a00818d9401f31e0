"""Temperature mixing: source shares to a power, and budgeted block permutations.

The weight of a source is its token share to the power ``tau``, normalised. ``tau`` is bisected to
the largest value (closest to the natural mix) at which the weights reach a target entropy, or the
smallest at which no source is repeated more often than allowed. Every probe of the bisection is
one aggregate over the table of sources, so their number does not matter. The weights become whole
and part passes over each source: the documents of a source are dealt into blocks of bounded size
by a hash, blocks and documents are permuted by hashes, and the part pass takes whole blocks in
order until its budget ends inside one block, which is cut by a running sum.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.llm.quality import words_of
from footfall.plans.scratch import materialise

#: Documents of a block, on average.
BLOCK = 2048
#: Cuts per probe and probes of the bisection; 16 ** 8 steps between 0 and 1.
CUTS, PROBES = 16, 8


def source_tokens(docs: DataFrame) -> DataFrame:
    """``_source, n_docs, tokens`` of the sources; a null source is a source of its own."""
    return docs.groupBy("_source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("_tokens").alias("tokens"))


def _probe(sources: DataFrame, low: float, high: float) -> list:
    """Entropy of the weights and the most passes over a source at several exponents between low and high.

    Passes are counted against the source with most tokens per weight, which is read exactly once.
    """
    at = [low + (high - low) * i / CUTS for i in range(CUTS + 1)]
    powers = sources.select(F.explode(F.array(*[F.lit(x) for x in at])).alias("tau"), F.log("tokens").alias("l"))
    e, tau = F.exp(F.col("tau") * F.col("l")), F.col("tau")
    return (
        powers.groupBy("tau")
        .agg(
            (F.log(F.sum(e)) - F.sum(e * tau * F.col("l")) / F.sum(e)).alias("entropy"),
            F.exp((tau - 1) * F.min("l") - (tau - 1) * F.max("l")).alias("passes"),
        )
        .sort("tau")
        .collect()
    )


def _crossing(sources: DataFrame, measure: str, limit: float) -> tuple[float, float]:
    """Two neighbouring exponents between which a measure that falls with the exponent passes the limit."""
    low, high = 0.0, 1.0
    for _ in range(PROBES):
        rows = _probe(sources, low, high)
        above = [r.tau for r in rows if r[measure] >= limit]
        if not above:
            return low, low
        if len(above) == len(rows):
            return high, high
        low, high = above[-1], rows[len(above)].tau
    return low, high


def exponent(sources: DataFrame, entropy_share: float | None = None, most_passes: float | None = None) -> float:
    """The exponent in 0..1 by which token shares are evened out.

    ``entropy_share``: the largest exponent whose weights have this share of the highest possible
    entropy. ``most_passes``: the smallest one at which no source is read more often. With both, the
    limit of passes wins where they conflict; with neither, or with no tokens at all, 1.
    """
    sources = sources.where(F.col("tokens") > 0)
    n = sources.count()
    if not n:
        return 1.0
    tau = 1.0
    if entropy_share is not None:
        tau = _crossing(sources, "entropy", entropy_share * math.log(n) - 1e-12)[0]
    if most_passes is not None:
        least = _crossing(sources, "passes", most_passes + 1e-12)[1]
        tau = least if entropy_share is None else max(tau, least)
    return tau


def plan_passes(docs: DataFrame, entropy_share: float | None, most_passes: float | None, budget: float | None = None) -> DataFrame:
    """One row per source: weight, whole passes, and where the part pass ends.

    ``docs`` is a stored table of ``_source, _id, _tokens``. Without a budget the source with the
    smallest weight per token is read exactly once, so that no document is lost; with one, passes
    are scaled to that many tokens in all. A source without tokens is read once.
    """
    sources = materialise(source_tokens(docs), "mix-sources")
    tau = exponent(sources, entropy_share, most_passes)
    top = sources.where(F.col("tokens") > 0).agg(F.max(F.log("tokens")).alias("l")).first()["l"] or 0.0
    weight = F.when(F.col("tokens") > 0, F.exp(F.lit(tau) * (F.log("tokens") - F.lit(top)))).otherwise(0.0)
    total = sources.agg(F.sum(weight)).first()[0] or 1.0
    whole_mix = total * math.exp(top)  # tokens of a mix that reads the largest source once
    scale = 1.0 if budget is None else budget / whole_mix
    passes = F.when(F.col("tokens") > 0, F.round(F.exp(F.lit(tau - 1) * (F.log("tokens") - F.lit(top))) * F.lit(scale), 9)).otherwise(1.0)
    mix = sources.select(
        "*",
        (weight / F.lit(total)).alias("weight"),
        passes.alias("passes"),
        F.floor(passes).cast("int").alias("whole"),
        F.round((passes - F.floor(passes)) * F.col("tokens")).cast("bigint").alias("rest"),
        F.greatest(F.lit(1), F.ceil(F.col("n_docs") / BLOCK)).cast("bigint").alias("blocks"),
    )
    mix = materialise(mix, "mix-passes")
    dealt = docs.join(mix.select(F.col("_source").alias("_s"), "blocks", "rest"), F.col("_source").eqNullSafe(F.col("_s")))
    dealt = dealt.select("_source", "_id", "_tokens", "rest", _block("blocks").alias("block"))
    sums = dealt.groupBy("_source", "block", "rest").agg(F.sum("_tokens").alias("sum"))  # one row per BLOCK documents
    order = Window.partitionBy("_source").orderBy(*_place("block")).rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("end", F.sum("sum").over(order))
    cut = sums.where((F.col("end") > F.col("rest")) & (F.col("end") - F.col("sum") <= F.col("rest")))
    cut = cut.select(F.col("_source").alias("_s"), F.col("block").alias("cut"), (F.col("rest") - F.col("end") + F.col("sum")).alias("left"))
    inside = dealt.join(cut, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("cut")))
    within = Window.partitionBy("_source").orderBy(*_place("_id"), "_tokens").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("run", F.sum("_tokens").over(within)).where(F.col("run") <= F.col("left"))
    last = inside.groupBy(F.col("_source").alias("_l")).agg(F.max(F.struct(*_place("_id"))).alias("last"))
    ends = cut.select("_s", "cut").join(last, F.col("_s").eqNullSafe(F.col("_l")), "left").select("_s", "cut", "last")
    return mix.join(ends, F.col("_source").eqNullSafe(F.col("_s")), "left").select(
        "_source", "n_docs", "tokens", "weight", "passes", "whole", "rest", "blocks", "cut", "last"
    )


def _place(name: str) -> list[Column]:
    """The permuted order of blocks or documents."""
    return [F.xxhash64(F.lit(name), F.col(name)), F.col(name)]


def _block(blocks: str) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), F.col("_id")), F.col(blocks))


def mix(
    docs: DataFrame, key: str, source: str, text: str,
    entropy_share: float | None = 0.95, most_passes: float | None = 4.0, budget: float | None = None,
) -> DataFrame:
    """Every document as often as the mix reads it: the input's columns and ``pass`` from 0, ``block``, ``place``.

    Sorted by ``pass, block, place`` the rows are the training order: blocks and the documents in
    them come in an order of hashes that differs from pass to pass. Documents with equal keys go
    together. Null sources are one source; null and empty texts have no tokens and ride along.
    The large side is never shuffled on the source: only narrow rows are summed, and a stored table
    of one row per source is joined back.
    """
    tokens = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("bigint")
    narrow = docs.select(F.col(source).alias("_source"), F.col(key).alias("_id"), tokens.alias("_tokens"))
    passes = materialise(plan_passes(materialise(narrow, "mix-docs"), entropy_share, most_passes, budget), "mix-plan")
    passes = passes.select(F.col("_source").alias("_s"), "whole", "rest", "blocks", "cut", "last")
    own = [F.col(f"`{c}`") for c in docs.columns if c not in ("pass", "block", "place")]  # replaced
    wide = docs.select(F.struct(*own).alias("_row"), F.col(source).alias("_source"), F.col(key).alias("_id"))
    wide = wide.join(passes, F.col("_source").eqNullSafe(F.col("_s"))).withColumn("block", _block("blocks"))
    before = F.struct(*_place("block")) < F.struct(F.xxhash64(F.lit("block"), F.col("cut")).alias("a"), F.col("cut").alias("block"))
    at_cut = (F.col("block") == F.col("cut")) & (F.struct(*_place("_id")) <= F.col("last"))
    more = (F.col("rest") > 0) & (F.col("cut").isNull() | before | F.coalesce(at_cut, F.lit(False)))
    times = F.col("whole") + F.when(more, 1).otherwise(0)
    read = wide.where(times > 0).select("_row", "_id", "block", F.explode(F.sequence(F.lit(0), times - 1)).alias("pass"))
    return read.select(
        "_row.*", "pass", F.xxhash64("pass", "block").alias("block"), F.xxhash64("pass", "_id").alias("place")
    )
