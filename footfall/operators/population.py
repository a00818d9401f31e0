"""Fingerprints of the evaluated population, and the leak-drop list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions import digests
from footfall.plans.scratch import materialise


def instance_line(instances: DataFrame) -> Column:
    """The line of an instance: user, target, time and history, tab separated."""
    return F.concat_ws(
        "\t",
        F.col("user_id"),
        F.col("target_item_id"),
        F.col("target_timestamp").cast("string"),
        F.array_join("history_item_ids", ","),
    )


def drop_listed(instances: DataFrame, dropped: DataFrame) -> DataFrame:
    """Instances whose ``uid`` is not in the exclusion list."""
    return instances.join(dropped.select("uid").distinct(), "uid", "left_anti")


def population_digest(instances: DataFrame) -> DataFrame:
    """One row ``n_lines, digest``; constant state per task, for populations of any size."""
    return digests.multiset_digest(instances, instance_line(instances))


def check_population(instances: DataFrame, expected_n: int | None = None, expected_digest: str | None = None) -> DataFrame:
    """One row with obtained and expected values and ``status``: PASS, FAIL or SKIP."""
    expected = {"n_lines": expected_n, "digest": expected_digest}
    tests = [F.col(c) == F.lit(v) for c, v in expected.items() if v is not None]
    if tests:
        ok = tests[0]
        for test in tests[1:]:
            ok = ok & test
        status = F.when(ok, "PASS").otherwise("FAIL")
    else:
        status = F.lit("SKIP")
    return population_digest(instances).select(
        F.lit(expected_n).cast("bigint").alias("expected_n"),
        F.col("n_lines").alias("obtained_n"),
        F.lit(expected_digest).cast("string").alias("expected_digest"),
        F.col("digest").alias("obtained_digest"),
        status.alias("status"),
    )


def population_tree(instances: DataFrame) -> DataFrame:
    """The :func:`digests.digest_tree` of the population's lines: what to keep for a later comparison."""
    return digests.digest_tree(instances, instance_line(instances))


def compare_trees(obtained: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: ``status`` PASS or FAIL, both line numbers, and ``differing``, the leaf buckets that differ, in order.

    ``differing`` has at most as many entries as a tree has leaves (65,536).
    """
    leaf = (F.col("level") == digests.DEPTH) & ~F.col("same")
    of_root = lambda c: F.max(F.when(F.col("level") == 0, F.col(c)))
    return digests.matched_nodes(obtained, expected).agg(
        F.when(of_root("same"), "PASS").otherwise("FAIL").alias("status"),
        of_root("left_n").alias("obtained_n"),
        of_root("right_n").alias("expected_n"),
        F.sort_array(F.collect_list(F.when(leaf, F.col("bucket")))).alias("differing"),
    )


def differing_instances(obtained: DataFrame, expected: DataFrame) -> DataFrame:
    """``line, left_n, right_n``: the lines in which two populations differ, read from the differing buckets only."""
    trees = [population_tree(df) for df in (obtained, expected)]
    buckets = materialise(digests.matched_nodes(*trees).where((F.col("level") == digests.DEPTH) & ~F.col("same")), "differing-buckets")
    lines = [df.select(instance_line(df).alias("line")) for df in (obtained, expected)]
    return digests.differing_lines(*lines, buckets)


def user_set_tag(users: DataFrame, user: str = "user_id") -> DataFrame:
    """One row ``tag``: 8 hex digits that depend on the set of distinct users, for lists of any length."""
    ids = users.select(F.col(user).cast("string").alias("u")).distinct()
    return digests.multiset_digest(ids, F.col("u")).select(F.substring("digest", 1, 8).alias("tag"))
