"""Cleaning, deduplication, cores and sampling."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from footfall.operators import cores
from footfall.operators import reviews as rev
from registry import views


def brute_core(rows, ku, ki):
    rounds = 0
    while True:
        rounds += 1
        users, items = Counter(u for u, _ in rows), Counter(i for _, i in rows)
        kept = [(u, i) for u, i in rows if users[u] >= ku and items[i] >= ki]
        if len(kept) == len(rows):
            return sorted(rows), rounds
        rows = kept


@pytest.mark.parametrize("seed,bucket_edges", [(1, 10**6), (2, 3), (3, 60)])
def test_core_is_the_fixed_point(spark, seed, bucket_edges):
    rng = random.Random(seed)
    rows = [(f"u{int(40 * rng.random() ** 2)}", f"i{int(30 * rng.random() ** 2)}") for _ in range(260)]
    df = spark.createDataFrame(rows, "user_id string, item_id string")
    want, rounds = brute_core(rows, 5, 6)
    core = cores.kcore(df, 5, 6, bucket_edges=bucket_edges)
    assert core.rounds == rounds
    assert sorted(map(tuple, core.restrict(df).collect())) == want
    again = cores.kcore(core.restrict(df), 5, 6)
    assert again.rounds == 1


def test_a_round_reads_the_edges_of_dropped_keys_only(spark):
    # A path whose end falls off round by round, beside a block that stays.
    path = [(f"u{i}", f"i{i + d}") for i in range(5) for d in (0, 1)]
    block = [(f"b{u}", f"c{i}") for u in range(20) for i in range(20)]
    core = cores.kcore(spark.createDataFrame(path + block, "user_id string, item_id string"), 2, 2, bucket_edges=10)
    want, rounds = brute_core(path + block, 2, 2)
    assert (core.rounds, core.pairs.count()) == (rounds, len(want)) == (6, 400)
    assert core.dropped == (2, 2, 2, 2, 2, 0) and max(core.edges_read) <= 4


@pytest.mark.parametrize("scan_rounds", [0, 1, 3])
def test_a_long_peeling_goes_on_with_stored_edges(spark, monkeypatch, scan_rounds):
    path = [(f"u{i}", f"i{i + d}") for i in range(5) for d in (0, 1)]
    block = [(f"b{u}", f"c{i}") for u in range(20) for i in range(20)]
    df = spark.createDataFrame(path + block, "user_id string, item_id string")
    tags, written = [], cores._written
    monkeypatch.setattr(cores, "_written", lambda df, tag, *p, **f: tags.append(tag) or written(df, tag, *p, **f))
    assert cores.kcore(df, 2, 2).dropped == (2, 2, 2, 2, 2, 0)
    assert "core-edges" not in tags  # few rounds read the pairs where they are
    core = cores.kcore(df, 2, 2, bucket_edges=10, scan_rounds=scan_rounds)
    assert tags.count("core-edges") == 1 and core.dropped == (2, 2, 2, 2, 2, 0)
    assert sorted(map(tuple, core.restrict(df).collect())) == sorted(block)


def test_core_counts_rows_and_skips_nulls(spark):
    rows = [("a", 1)] * 3 + [("b", 1), ("a", 2), ("a", 2), (None, 1), ("c", None), ("b", 2)]
    core = cores.kcore(spark.createDataFrame(rows, "user_id string, item_id int"), 3, 3)
    assert core.rounds == 3 and sorted(map(tuple, core.pairs.collect())) == [("a", 1, 3)]
    assert cores.kcore(spark.createDataFrame([], "user_id string, item_id int"), 2, 2).rounds == 1


def test_restrict_by_pairs_and_by_lists(spark, monkeypatch):
    rows = [(u, i) for u in range(6) for i in range(4)] + [(9, 0), (None, 1), (8, None)]
    df = spark.createDataFrame(rows, "user_id int, item_id int")
    core = cores.kcore(df, 2, 3)
    short = sorted(map(tuple, core.restrict(df).collect()))
    monkeypatch.setattr(cores, "SHORT_LIST", 0)
    assert short == sorted(map(tuple, core.restrict(df).collect())) == rows[:24]


@pytest.mark.parametrize("k,want", [((20, 20), (4790, 135, 180, 6)), ((5, 5), (5382, None, None, 1)), ((25, 24), (0, 0, 0, 6))])
def test_core_facts(spark, sf, k, want):
    core = cores.kcore(views.purchases(spark, sf), *k)
    shape = rev.shape(core.pairs).first()
    got = (shape["n_rows"], shape["n_users"], shape["n_items"], core.rounds)
    assert all(w is None or g == w for g, w in zip(got, want)), got


def test_resampled_core(spark):
    rows = [(u, i) for u in range(6) for i in range(4)] + [(9, 0)]
    df = spark.createDataFrame(rows, "user_id int, item_id int")
    users = spark.createDataFrame([(0,), (1,), (2,), (9,)], "user_id int")
    kept, rounds = cores.resampled_core(df, users, 2, 3)
    assert sorted(map(tuple, kept.collect())) == [(u, i) for u in range(3) for i in range(4)]
    assert rounds == 2


def test_sample_without_limit_keeps_all(spark):
    users = spark.range(5).select(F.col("id").alias("user_id"))
    assert cores.sample_users(users, 0).count() == 5
    assert cores.sample_users(users, 99).count() == 5


def test_priority_users_outside_the_pool_are_ignored(spark):
    pool = spark.range(5).select(F.col("id").alias("user_id"))
    priority = spark.createDataFrame([(3,), (77,)], "user_id long")
    got = {r[0] for r in cores.sample_users_priority_first(pool, priority, 1).collect()}
    assert got == {3}


def test_normalise_columns(spark):
    df = spark.createDataFrame(
        [(1, "a", 10, "q"), (2, "b", 11, "   "), (3, "c", 12, None)], "user_id int, parent_asin string, timestamp int, query string"
    )
    out = rev.normalise_columns(df)
    assert dict(out.dtypes) == {
        "user_id": "string", "item_id": "string", "timestamp": "bigint", "query": "string",
        "review_title": "string", "review_text": "string", "is_c4_user": "boolean",
    }
    assert [r["user_id"] for r in out.collect()] == ["1"]
    with pytest.raises(ValueError, match="query"):
        rev.normalise_columns(df.drop("query"))


def test_quality_treats_null_as_failing(spark):
    df = spark.createDataFrame([(5.0, "x" * 100), (None, "x" * 100), (5.0, None), (4.0, "x" * 100)], "rating double, text string")
    assert rev.quality_rate(df, rev.quality()).first().asDict() == {"n_rows": 4, "n_pass": 1, "pass_rate": 0.25}


def reviews(spark, rows):
    return spark.createDataFrame(rows, "user_id string, item_id string, timestamp long, rating double, title string, text string")


def test_content_dedup_and_conflicts(spark):
    fine = reviews(spark, [
        ("b", "i", 1, 5.0, "T", "same"), ("a", "i", 1, 5.0, "t", " SAME "), ("a", "i", 2, 1.0, "T", "same"),
        ("a", "j", 1, 2.0, None, None), ("b", "j", 1, 2.0, "", ""),
    ])
    kept = rev.dedup_content(fine, "item_id", ["user_id"])
    assert sorted((r["user_id"], r["item_id"], r["timestamp"]) for r in kept.collect()) == [("a", "i", 1), ("a", "i", 2), ("a", "j", 1)]
    clash = fine.unionByName(reviews(spark, [("c", "i", 1, None, "T", "same")]))
    hashed = rev.with_review_hash(clash)
    assert rev.content_conflicts(hashed, "item_id").first().asDict() == {
        "n_dup_rows": 5, "n_dup_groups": 2, "n_cross_user_groups": 2, "n_conflict_groups": 1,
    }
    with pytest.raises(ValueError, match="disagree"):
        rev.dedup_content(clash, "item_id", ["user_id"])


def test_same_user_may_disagree_with_itself(spark):
    df = rev.with_review_hash(reviews(spark, [("a", "i", 1, 5.0, "T", "x"), ("a", "i", 1, 1.0, "T", "x")]))
    assert rev.content_conflicts(df, "item_id").first()["n_conflict_groups"] == 0


def test_protected_target_beats_the_earliest(spark):
    df = spark.createDataFrame([("u", "i", 1, 7), ("u", "i", 5, 8), ("u", "j", 2, 9), ("u", "j", 1, 10)], "user_id string, item_id string, timestamp long, n int")
    targets = spark.createDataFrame([("u", "i", 5)], "user_id string, item_id string, timestamp long")
    kept = rev.dedup_user_item_protected(df, targets, ["timestamp", "n"])
    assert sorted(r["n"] for r in kept.collect()) == [8, 10]


def test_integrity(spark):
    df = spark.createDataFrame([("u", None, 3)], "user_id string, item_id string, timestamp long")
    with pytest.raises(ValueError, match="null keys"):
        rev.require_integrity(df, ["user_id"])
    with pytest.raises(ValueError, match="missing"):
        rev.require_integrity(df, ["query"])
    assert rev.require_integrity(df.na.fill("i"), ["user_id"]).count() == 1
