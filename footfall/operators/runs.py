"""Analysis of training runs: best epochs, retained epochs, early stopping, summaries over seeds.

A run log has one row per (run, epoch); a run has at most a few hundred epochs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.plans.selection import top_n

PATIENCE, RETAINED = 20, 3


def flatten_log(log: DataFrame, run: Sequence[str], metrics: str = "valid_full", fallback: str | None = "valid") -> DataFrame:
    """``run, epoch`` and the fields of the nested metrics struct; epochs without metrics are dropped.

    A run that has no ``metrics`` in any epoch is read from ``fallback``.
    """
    if metrics not in log.columns or fallback not in log.columns:
        nested = F.col(metrics if metrics in log.columns else fallback)
    else:
        has = F.max(F.col(metrics).isNotNull()).over(Window.partitionBy(*run))
        log = log.withColumn("_has", has)
        nested = F.when(F.col("_has"), F.col(metrics)).otherwise(F.col(fallback))
    rows = log.select(*run, "epoch", nested.alias("_m"))
    return rows.where(F.col("_m").isNotNull()).select(*run, "epoch", "_m.*")


def best_epochs(log: DataFrame, run: Sequence[str], metric: str, retained: DataFrame | None = None) -> DataFrame:
    """Per run: the first epoch with the largest metric; if it is not retained, the best retained one.

    ``retained`` is ``run + epoch``. Adds ``best_epoch``, ``used_epoch`` and their metric.
    """
    order = [F.col(metric).desc(), F.col("epoch").asc()]
    best = top_n(log, run, order, 1).select(
        *run, F.col("epoch").alias("best_epoch"), F.col(metric).alias("best_metric")
    )
    if retained is None:
        return best.withColumn("used_epoch", F.col("best_epoch")).withColumn("used_metric", F.col("best_metric"))
    have = top_n(log.join(retained.select(*run, "epoch"), [*run, "epoch"], "left_semi"), run, order, 1)
    # The best epoch heads the retained ones whenever it is retained itself.
    used = have.select(*run, F.col("epoch").alias("used_epoch"), F.col(metric).alias("used_metric"))
    return best.join(used, list(run), "left")


def top_epochs(log: DataFrame, run: Sequence[str], metrics: Sequence[str], k: int = RETAINED) -> DataFrame:
    """``run, metric, place, epoch``: the k best epochs per metric, the earlier one first among equals."""
    frames = []
    for name in metrics:
        best = top_n(log, run, [F.col(name).desc(), F.col("epoch").asc()], k, rank="place")
        frames.append(best.select(*run, F.lit(name).alias("metric"), "place", "epoch"))
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def evicted_epochs(log: DataFrame, run: Sequence[str], metrics: Sequence[str], k: int = RETAINED) -> DataFrame:
    """``run, epoch``: epochs that were among the k best of some metric when they ended, but not at the end."""
    before = Window.partitionBy(*run).orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)

    def among_best(name: str) -> Column:
        return F.size(F.filter(f"_earlier_{name}", lambda x: x >= F.col(name))) < k

    entered = F.lit(False)
    for name in metrics:
        log = log.withColumn(f"_earlier_{name}", F.collect_list(name).over(before))
        entered = entered | among_best(name)
    kept_once = log.where(entered).select(*run, "epoch")
    return kept_once.exceptAll(top_epochs(log, run, metrics, k).select(*run, "epoch").distinct())


def early_stop(log: DataFrame, run: Sequence[str], metric: str, patience: int = PATIENCE) -> DataFrame:
    """Per run: the epoch training stops at (the last one if never), the best metric and epochs without gain.

    A gain is a value strictly above all earlier ones.
    """
    ordered = Window.partitionBy(*run).orderBy("epoch")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
    gain = F.col("_before").isNull() | (F.col(metric) > F.col("_before"))
    tracked = (
        log.withColumn("_step", F.row_number().over(ordered))
        .withColumn("_before", F.max(metric).over(before))
        .withColumn("_gain_step", F.max(F.when(gain, F.col("_step"))).over(upto))
        .withColumn("_bad", F.col("_step") - F.col("_gain_step"))
        .withColumn("_best", F.max(metric).over(upto))
    )
    last = Window.partitionBy(*run).orderBy((F.col("_bad") >= patience).desc(), F.when(F.col("_bad") >= patience, F.col("_step")).otherwise(-F.col("_step")))
    return (
        tracked.withColumn("_pick", F.row_number().over(last))
        .where(F.col("_pick") == 1)
        .select(
            *run,
            F.col("epoch").alias("stop_epoch"),
            (F.col("_bad") >= patience).alias("stopped_early"),
            F.col("_best").alias("best_metric"),
            F.col("_bad").alias("epochs_without_gain"),
        )
    )


def run_results(nested: DataFrame, metrics: Mapping[str, str], *keep: str) -> DataFrame:
    """One flat row per result document: ``seed``, ``best_epoch``, ``n_eval`` and the named test metrics.

    A document holds ``args.seed``, ``best_epoch`` and a struct ``test`` with ``n_eval`` and metrics;
    ``metrics`` maps their names to column names, ``keep`` lists further top-level columns. Only these fields are read.
    """
    values = [F.col(f"test.`{name}`").alias(out) for name, out in metrics.items()]
    return nested.select(*keep, F.col("args.seed").alias("seed"), "best_epoch", F.col("test.n_eval").alias("n_eval"), *values)


def seed_summary(
    results: DataFrame, dataset: str, seed: str, metrics: Sequence[str], expected_n: int | None = None, epoch: str | None = None
) -> DataFrame:
    """Per dataset: seeds, mean and sample standard deviation of each metric, agreement on ``n_eval``.

    Metrics are rounded to 6 digits before and after averaging; one seed has deviation 0. ``epoch`` names
    the column of best epochs and adds ``seeds`` and ``best_epochs``, two parallel lists in the order of seeds.
    """
    rounded = results.select(dataset, seed, "n_eval", *([epoch] if epoch else []), *[F.round(m, 6).alias(m) for m in metrics])
    stats = []
    for m in metrics:
        stats.append(F.round(F.avg(m), 6).alias(f"{m}_mean"))
        stats.append(F.round(F.coalesce(F.stddev_samp(m), F.lit(0.0)), 6).alias(f"{m}_std"))
    same = F.min("n_eval") == F.max("n_eval")
    expected = F.lit(None).cast("boolean") if expected_n is None else same & (F.min("n_eval") == expected_n)
    runs = [F.sort_array(F.collect_list(F.struct(F.col(seed).alias("s"), F.col(epoch).alias("e")))).alias("_runs")] if epoch else []
    found = rounded.groupBy(dataset).agg(
        F.count(F.lit(1)).alias("n_seeds"), *stats, same.alias("n_eval_agrees"), expected.alias("n_eval_expected"), *runs
    )
    if not epoch:
        return found
    return found.withColumns({"seeds": F.col("_runs.s"), "best_epochs": F.col("_runs.e")}).drop("_runs")
