"""Positions and selections, always with one group that holds most rows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from footfall.plans import positions, scratch, selection


@pytest.fixture(scope="module")
def skewed(spark):
    """4,000 rows, three quarters of them in group 'hot'; ``v`` has many ties, ``i`` is unique."""
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.75 else f"g{rng.randrange(40)}", rng.randrange(50), i) for i in range(4000)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "g string, v int, i int").repartition(8)


def test_global_position(skewed):
    rows, df = skewed
    got = {r["i"]: r["position"] for r in positions.with_global_position(df, ["v", "i"]).collect()}
    want = {i: p for p, (_, i) in enumerate(sorted((v, i) for _, v, i in rows))}
    assert got == want


def test_group_position_of_a_hot_group(skewed):
    rows, df = skewed
    placed = positions.with_group_position(df, ["g"], ["v", "i"])
    got = {r["i"]: (r["group_position"], r["group_size"]) for r in placed.collect()}
    want = {}
    for g in {r[0] for r in rows}:
        members = sorted((v, i) for h, v, i in rows if h == g)
        want.update({i: (p, len(members)) for p, (_, i) in enumerate(members)})
    assert got == want


def test_hot_group_is_spread_over_partitions(skewed):
    _, df = skewed
    ordered = df.repartitionByRange(8, "g", "v", "i").where(F.col("g") == "hot")
    assert ordered.select(F.spark_partition_id().alias("p")).distinct().count() > 3


def test_dense_ids(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",), ("Z",)], "x string")
    assert {r["x"]: r["n"] for r in positions.dense_ids(df, "x", "n").collect()} == {"Z": 1, "a": 2, "b": 3}


@pytest.mark.parametrize("threshold", ["1000", "2"])
def test_top_n_with_and_without_salting(spark, skewed, threshold):
    rows, df = skewed
    conf = "spark.sql.optimizer.windowGroupLimitThreshold"
    before = spark.conf.get(conf)
    spark.conf.set(conf, threshold)
    try:
        top = selection.top_n(df, ["g"], [F.col("v").desc(), F.col("i").asc()], 7, rank="r")
        got = sorted((r["g"], r["r"], r["i"]) for r in top.collect())
    finally:
        spark.conf.set(conf, before)
    want = []
    for g in {r[0] for r in rows}:
        members = sorted((-v, i) for h, v, i in rows if h == g)[:7]
        want += [(g, p + 1, i) for p, (_, i) in enumerate(members)]
    assert got == sorted(want)


def test_small_top_n_is_pruned_before_the_shuffle(skewed):
    _, df = skewed
    plan = selection.top_n(df, ["g"], [F.col("v").asc()], 7)._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_keep_one_and_preference(spark, skewed):
    rows, df = skewed
    got = {r["g"]: r["i"] for r in selection.keep_one(df, ["g"], ["v", "i"]).collect()}
    want = {g: min((v, i) for h, v, i in rows if h == g)[1] for g in {r[0] for r in rows}}
    assert got == want
    prefer = df.withColumn("_class", (F.col("i") % 5 != 0).cast("int"))
    got = {r["g"]: r["i"] for r in selection.keep_one(df, ["g"], ["v", "i"], prefer).collect()}
    want = {g: min((i % 5 != 0, v, i) for h, v, i in rows if h == g)[2] for g in {r[0] for r in rows}}
    assert got == want


def test_keep_one_does_not_shuffle_the_wide_side(spark, tmp_path):
    path = str(tmp_path / "wide")
    spark.range(2000).select("id", (F.col("id") % 1990).alias("k"), F.repeat(F.lit("x"), 500).alias("wide")).write.parquet(path)
    df = spark.read.parquet(path)
    kept = selection.keep_one(df, ["k"], ["id"])
    assert kept.count() == 1990
    plan = kept._jdf.queryExecution().executedPlan().toString()
    shuffled = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert all("wide" not in line for line in shuffled)


@pytest.mark.parametrize("n", [0, 1, 37, 300, 900])
def test_lowest_hashed_is_exact(spark, n):
    ids = spark.range(300).select(F.col("id").alias("u"))
    got = {r["u"] for r in selection.lowest_hashed(ids, "u", n, 42).collect()}
    order = sorted(range(300), key=lambda u: (hashlib.md5(f"42:{u}".encode()).hexdigest(), u))
    assert got == set(order[:n])
    early = selection.lowest_hashed(ids, "u", n, 42, priority=F.col("u") < 50)
    order.sort(key=lambda u: u >= 50)
    assert {r["u"] for r in early.collect()} == set(order[:n])


def test_intermediates_are_removed_on_demand(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(scratch, "_own_folder", lambda _: str(tmp_path / "own"))
    stored = scratch.materialise(spark.range(5), "kept")
    assert stored.count() == 5 and (tmp_path / "own").exists()
    scratch.remove_intermediates(spark)
    assert not (tmp_path / "own").exists()
    scratch.remove_intermediates(spark)
