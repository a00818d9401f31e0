"""Splits, sequences, instances, populations."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from footfall.functions import digests
from footfall.operators import population, sequences, splits

LOG = "user_id string, item_id string, timestamp long"


def log(spark, rows):
    return spark.createDataFrame(rows, LOG)


def test_leave_last_out(spark):
    rows = [("a", f"i{t}", t) for t in range(5)] + [("b", "x", 1), ("b", "y", 2)] + [("c", "q", 3), ("c", "p", 3), ("c", "z", 1)]
    got = {(r["user_id"], r["item_id"]): r["split"] for r in splits.leave_last_out(log(spark, rows)).collect()}
    assert got[("a", "i4")] == "test" and got[("a", "i3")] == "valid" and got[("a", "i0")] == "train"
    assert got[("b", "x")] == got[("b", "y")] == "train"
    assert (got[("c", "z")], got[("c", "p")], got[("c", "q")]) == ("train", "valid", "test")


def test_sequence_is_cut_before_splitting(spark):
    rows = [("a", f"i{t:03d}", t) for t in range(30)]
    kept = splits.leave_last_out(log(spark, rows), max_history=5).withColumn("review_hash", F.lit("h"))
    assert kept.count() == 7
    manifest = {r["split"]: r["history"] for r in splits.split_manifest(kept).collect()}
    assert manifest["valid"] == [f"i{t:03d}" for t in range(23, 28)]
    assert manifest["test"] == [f"i{t:03d}" for t in range(23, 29)]


def test_unseen_targets_remove_the_user_from_both_splits(spark):
    rows = [("a", "i", 1), ("a", "j", 2), ("a", "new", 3), ("b", "j", 1), ("b", "i", 2), ("b", "j2", 3), ("c", "j2", 1), ("c", "i", 2), ("c", "j", 3)]
    assigned = splits.leave_last_out(log(spark, rows))
    rates = {r["split"]: (r["n_users"], r["n_unseen"]) for r in splits.unseen_target_rate(assigned).collect()}
    assert rates == {"test": (3, 1), "valid": (3, 0)}
    kept = splits.drop_unseen_targets(assigned)
    assert sorted((r["user_id"], r["split"]) for r in kept.where("user_id = 'a'").collect()) == [("a", "train")]
    assert kept.where("split != 'train'").count() == 4
    assert splits.unseen_target_rate(kept).agg(F.sum("n_unseen")).first()[0] == 0


def test_planted_split_violations(spark):
    keys = "split string, user_id string, item_id string, timestamp long, review_hash string, history array<string>"
    manifest = spark.createDataFrame([("valid", "a", "i", 1, "", []), ("test", "a", "j", 2, "", []), ("valid", "b", "i", 1, "", [])], keys)
    shape = "user_id string, target_item_id string, target_timestamp long, split string"
    clean = [("a", "i", 1, "valid"), ("a", "j", 2, "test"), ("a", "k", 9, "train")]
    names = ["valid_not_in_manifest", "valid_in_other_split", "test_not_in_manifest", "test_in_other_split"]

    def counts(rows):
        row = splits.verify_split(spark.createDataFrame(rows, shape), manifest).first()
        return [row[n] for n in names]

    assert counts(clean) == [0, 0, 0, 0]
    assert counts([*clean, ("z", "i", 1, "valid")]) == [1, 0, 0, 0]
    assert counts([*clean, ("a", "j", 2, "valid"), ("b", "i", 1, "test")]) == [1, 1, 1, 1]
    twice = manifest.unionByName(manifest.withColumn("split", F.lit("test")))
    with pytest.raises(ValueError, match="both"):
        splits.assign_split(log(spark, [("a", "i", 1)]), twice)
    audit = {r["split"]: tuple(r)[1:] for r in splits.split_audit(splits.assign_split(log(spark, [("a", "i", 1), ("a", "j", 2)]), manifest), manifest).collect()}
    assert audit == {"valid": (2, 1, False), "test": (1, 1, True)}


def brute_instances(rows, n):
    out = {}
    users = {}
    for uid, iid, ts, split in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        before = users.setdefault(uid, [])
        if before:
            out[(uid, iid, ts)] = (split, before[-n:])
        users[uid] = [*before, iid]
    return out


def test_instances_of_a_long_user_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(sequences, "_RUN", 7)
    rng = random.Random(5)
    rows = [(1 if rng.random() < 0.7 else rng.randrange(2, 6), i + 1, rng.randrange(60), rng.choice(["train", "valid", "test"])) for i in range(160)]
    df = spark.createDataFrame(rows, "uid long, iid long, timestamp long, split string").select(
        "*", F.concat(F.lit("u"), "uid").alias("user_id"), F.format_string("i%05d", "iid").alias("item_id"),
        F.lit(" a\nquery ").alias("query"), F.lit(True).alias("is_c4_user"),
    )
    placed = splits.with_sequence_position(df)
    for n in (3, 7):
        want = brute_instances(rows, n)
        got = sequences.query_instances(placed, max_history=n).collect()
        assert {(r["uid"], r["target_iid"], r["target_timestamp"]): (r["split"], r["history_iids"]) for r in got} == want
        assert {r["query"] for r in got} == {"a query"}
    only = sequences.query_instances(placed, ("test",), 3)
    assert only.count() == sum(s == "test" for s, _ in brute_instances(rows, 3).values())


def test_train_sequences_keep_the_tail(spark):
    rows = [(1, "u", t, f"i{t}", t, "train" if t != 3 else "test") for t in range(6)]
    df = spark.createDataFrame(rows, "uid long, user_id string, iid long, item_id string, timestamp long, split string")
    row = sequences.train_sequences(df, 3).first()
    assert (row["item_seq"], row["raw_item_seq"], row["time_seq"]) == ([2, 4, 5], ["i2", "i4", "i5"], [2, 4, 5])


def test_negative_samples(spark):
    instances = spark.createDataFrame([(i, 1, 5) for i in range(30)] + [(99, 2, 1)], "instance_id long, uid long, target_iid long")
    sequence = spark.createDataFrame([(1, [1, 2, 3, 4]), (2, [2, 3, 4, 5, 6, 7, 8])], "uid long, item_seq array<long>")
    got = sequences.negative_samples(instances, sequence, n_items=8).collect()
    ordinary = [r for r in got if r["instance_id"] != 99]
    assert all(r["found"] and r["negative_iid"] in (6, 7, 8) for r in ordinary)
    hopeless = next(r for r in got if r["instance_id"] == 99)
    assert not hopeless["found"] and 1 <= hopeless["negative_iid"] <= 8


def instances(spark, rows):
    return spark.createDataFrame(rows, "uid long, user_id string, target_item_id string, target_timestamp long, history_item_ids array<string>")


def test_population(spark):
    rows = [(1, "a", "x", 5, ["p", "q"]), (2, "b", "y", 6, []), (3, "c", "z", 7, ["p"])]
    df = instances(spark, rows)
    lines = ["\t".join([u, i, str(t), ",".join(h)]) for _, u, i, t, h in rows]
    words = [sum(int(hashlib.sha256(x.encode()).hexdigest()[7 * k : 7 * k + 7], 16) for x in lines) for k in range(9)]
    sha = hashlib.sha256("-".join(map(str, [len(lines), *words])).encode()).hexdigest()
    assert population.population_digest(df).first().asDict() == {"n_lines": 3, "digest": sha}
    assert population.population_digest(df).first() == population.population_digest(df.repartition(5)).first()
    dropped = population.drop_listed(df, spark.createDataFrame([(3,)], "uid long"))
    assert population.population_digest(dropped).first()["digest"] != population.population_digest(df).first()["digest"]
    status = lambda **e: population.check_population(df, **e).first()["status"]
    assert status() == "SKIP" and status(expected_n=3) == "PASS" and status(expected_n=2) == "FAIL"
    assert status(expected_n=3, expected_digest=sha) == "PASS" and status(expected_digest="0" * 64) == "FAIL"
    tag = population.user_set_tag(df).first()["tag"]
    assert tag == population.user_set_tag(df.union(df)).first()["tag"] != population.user_set_tag(dropped).first()["tag"]


def test_digest_tree_names_what_differs(spark):
    rows = [(i, f"u{i}", f"x{i % 7}", i, [f"p{i % 3}"]) for i in range(400)]
    old, same = instances(spark, rows), instances(spark, rows[::-1]).repartition(7)
    new = instances(spark, [*rows[:100], *rows[101:], rows[5], (0, "new", "x", 1, [])])
    trees = [population.population_tree(df) for df in (old, same, new, old.where("uid < 0"))]
    nodes = {(r["level"], r["bucket"]): r for r in trees[0].collect()}
    for (level, bucket), node in nodes.items():
        if level < 4:
            children = sorted(b for k, b in nodes if k == level + 1 and b.startswith(bucket))
            text = ",".join(f"{b}:{nodes[level + 1, b]['digest']}" for b in children)
            assert node["digest"] == hashlib.sha256(text.encode()).hexdigest()
            assert node["n_lines"] == sum(nodes[level + 1, b]["n_lines"] for b in children)
    assert population.compare_trees(trees[1], trees[0]).first().asDict() == {"status": "PASS", "obtained_n": 400, "expected_n": 400, "differing": []}
    line = lambda r: "\t".join([r[1], r[2], str(r[3]), ",".join(r[4])])
    changed = {line(rows[100]): (0, 1), line(rows[5]): (2, 1), "new\tx\t1\t": (1, 0)}
    got = population.compare_trees(trees[2], trees[0]).first()
    buckets = sorted({hashlib.sha256(x.encode()).hexdigest()[:4] for x in changed})
    assert (got["status"], got["obtained_n"], got["expected_n"], got["differing"]) == ("FAIL", 401, 400, buckets)
    assert {r["line"]: (r["left_n"], r["right_n"]) for r in population.differing_instances(new, old).collect()} == changed
    empty = trees[3].collect()
    assert [(r["level"], r["bucket"], r["n_lines"]) for r in empty] == [(0, "", 0)]
    assert population.compare_trees(trees[3], trees[3]).first()["status"] == "PASS"


def test_multiset_digest_counts_repeats(spark):
    one = spark.createDataFrame([("x",)], "l string")
    two = spark.createDataFrame([("x",), ("x",)], "l string")
    a, b = (digests.multiset_digest(d, F.col("l")).first()["digest"] for d in (one, two))
    assert a != b


def test_negative_samples_are_the_first_free_draws_and_keep_columns(spark):
    draw = lambda key, i, n: int(hashlib.md5(f"42:{key}:{i}".encode()).hexdigest()[:8], 16) % n + 1
    taken = list(range(1, 30))
    instances = spark.createDataFrame([(i, 1, 30, f"k{i}") for i in range(60)], "instance_id long, uid long, target_iid long, label string")
    sequence = spark.createDataFrame([(1, taken)], "uid long, item_seq array<long>")
    got = sequences.negative_samples(instances, sequence, n_items=32, tries=40, keep=("label",))
    assert got.columns == ["instance_id", "target_iid", "negative_iid", "found", "label"]
    tries = []
    for r in got.collect():
        free = [i for i in range(1, 41) if draw(r["instance_id"], i, 32) not in (*taken, 30)]
        tries.append(free[0] if free else 41)
        assert (r["negative_iid"], r["found"], r["label"]) == (draw(r["instance_id"], tries[-1], 32), bool(free), f"k{r['instance_id']}")
    assert min(tries) == 1 and max(tries) > 4
