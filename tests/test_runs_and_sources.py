"""Run analytics, and scans and sinks."""

import json

import pytest
from pyspark.sql import functions as F

from footfall.operators import runs
from footfall.sources import tables

RUN = ["run"]


def log(spark, values, other=None):
    rows = [("r", e + 1, v, (other or values)[e]) for e, v in enumerate(values)]
    return spark.createDataFrame(rows, "run string, epoch int, ndcg double, attn double")


def test_best_epoch_is_the_first_maximum(spark):
    row = runs.best_epochs(log(spark, [0.1, 0.3, 0.3, 0.2]), RUN, "ndcg").first()
    assert (row["best_epoch"], row["used_epoch"]) == (2, 2)
    kept = spark.createDataFrame([("r", 4), ("r", 1)], "run string, epoch int")
    row = runs.best_epochs(log(spark, [0.1, 0.3, 0.3, 0.2]), RUN, "ndcg", kept).first()
    assert (row["best_epoch"], row["used_epoch"]) == (2, 4)


def plain_retention(values, other):
    """Retained and evicted epochs by keeping two running top-3 lists."""
    tops, evicted = [[], []], set()
    for e, pair in enumerate(zip(values, other), 1):
        before = {x for top in tops for _, x in top}
        for top, value in zip(tops, pair):
            top.append((value, e))
            top.sort(key=lambda x: -x[0])
            del top[3:]
        after = {x for top in tops for _, x in top}
        evicted |= before - after
    return [[e for _, e in top] for top in tops], evicted


def test_retained_and_evicted_epochs(spark):
    values, other = [0.1, 0.4, 0.4, 0.2, 0.5, 0.4, 0.6], [0.9, 0.1, 0.2, 0.95, 0.1, 0.9, 0.3]
    frame = log(spark, values, other)
    tops, evicted = plain_retention(values, other)
    got = {}
    for r in runs.top_epochs(frame, RUN, ["ndcg", "attn"]).orderBy("metric", "place").collect():
        got.setdefault(r["metric"], []).append(r["epoch"])
    assert [got["ndcg"], got["attn"]] == tops
    assert {r["epoch"] for r in runs.evicted_epochs(frame, RUN, ["ndcg", "attn"]).collect()} == evicted


@pytest.mark.parametrize("values,want", [
    ([0.1, 0.2, 0.2, 0.1, 0.3], (4, True, 0.2, 2)),
    ([0.1, 0.2, 0.2, 0.3, 0.1], (5, False, 0.3, 1)),
    ([0.5, 0.4, 0.4], (3, True, 0.5, 2)),
])
def test_early_stop(spark, values, want):
    row = runs.early_stop(log(spark, values), RUN, "ndcg", patience=2).first()
    assert tuple(row)[1:] == want


def test_nested_log(spark):
    rows = [{"run": "r", "epoch": 0, "valid_full": {"ndcg": 0.1}}, {"run": "r", "epoch": 1, "valid_full": None}]
    frame = spark.createDataFrame(rows, "run string, epoch int, valid_full struct<ndcg: double>")
    assert [tuple(r) for r in runs.flatten_log(frame, RUN).collect()] == [("r", 0, 0.1)]
    both = frame.withColumn("valid", F.expr("named_struct('ndcg', 0.7D)"))
    empty = both.withColumn("run", F.lit("s")).withColumn("valid_full", F.expr("cast(null as struct<ndcg: double>)"))
    got = sorted(tuple(r) for r in runs.flatten_log(both.union(empty), RUN).collect())
    assert got == [("r", 0, 0.1), ("s", 0, 0.7), ("s", 1, 0.7)]


def test_seed_summary_of_published_results(spark):
    rows = [("books", 2026, 0.1512, 0.0931, 0.0836, 19748), ("books", 2027, 0.1388, 0.0861, 0.0780, 19748),
            ("books", 2028, 0.1411, 0.0860, 0.0772, 19748), ("books", 2029, 0.1455, 0.0897, 0.0808, 19748),
            ("one", 1, 0.5, 0.5, 0.5, 7)]
    frame = spark.createDataFrame(rows, "d string, seed int, hr double, ndcg double, mrr double, n_eval long")
    out = {r["d"]: r for r in runs.seed_summary(frame, "d", "seed", ["hr", "ndcg", "mrr"], expected_n=19748).collect()}
    b = out["books"]
    assert [b["hr_mean"], b["hr_std"], b["ndcg_mean"], b["ndcg_std"], b["mrr_mean"], b["mrr_std"]] == [
        0.14415, 0.00546, 0.088725, 0.003387, 0.0799, 0.00291,
    ]
    assert b["n_eval_agrees"] and b["n_eval_expected"]
    assert out["one"]["hr_std"] == 0.0 and not out["one"]["n_eval_expected"]


def test_json_lines_skip_blank_lines(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"a": 1}\n\n   \n{"a": 2}\n')
    assert sorted(r["a"] for r in tables.read_json_lines(spark, str(path), "a int").collect() if r["a"] is not None) == [1, 2]
    assert tables.read_json_lines(spark, str(path), "a int").count() == 2


def test_manifest_round_trip(spark, tmp_path):
    row = {"user_id": "u", "item_id": "i", "timestamp": 5, "review_hash": "h", "history": ["a", "b"]}
    path = tmp_path / "m.json"
    path.write_text(json.dumps({"dataset": "d", "n_users": 1, "n_items": 2, "valid": [row], "test": [row, {**row, "user_id": "w"}]}, indent=1))
    manifest = tables.read_manifest_json(spark, str(path))
    assert manifest.groupBy("split").count().orderBy("split").collect() == [("test", 2), ("valid", 1)]
    target = str(tmp_path / "table")
    tables.write_manifest(manifest, target)
    again = tables.read_manifest(spark, target).select(*manifest.columns)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, manifest.collect()))
    with pytest.raises(Exception, match="exists"):
        tables.write_manifest(manifest, target)
    plan = tables.read_manifest(spark, target).where("split = 'test'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


def test_exclusion_list(spark, tmp_path):
    path = tmp_path / "l.json"
    path.write_text(json.dumps({"per_split": {"valid": {"n": 1}}, "dropped": [12, 52, 12]}, indent=1))
    assert sorted(r["uid"] for r in tables.read_exclusion_list(spark, str(path), "dropped").collect()) == [12, 52]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 2.0], "train"), (2, [3.0, 4.0], "test")], "iid long, vec array<double>, split string")
    tables.write_vectors(df, str(tmp_path / "v"), "iid", "vec")
    assert dict(spark.read.parquet(str(tmp_path / "v")).dtypes) == {"iid": "bigint", "vec": "array<float>"}
    tables.write_splits(df, str(tmp_path / "s"))
    tables.write_splits(df, str(tmp_path / "s"), overwrite=True)
    assert spark.read.parquet(str(tmp_path / "s")).where("split = 'test'").count() == 1


def test_tolerant_scans(spark):
    df = spark.createDataFrame([("a", None)], "parent_asin string, text string")
    full = tables.scan_with_defaults(df, ["parent_asin", "user_id", "timestamp", "rating", "text", "helpful_vote"])
    assert tuple(full.first()) == ("a", "", 0, 0.0, None, 0)
    assert tables.select_available(df, ["text", "price", "parent_asin"]).columns == ["text", "parent_asin"]
    nested = df.select("parent_asin", F.array(F.repeat(F.lit("x"), 900)).alias("long"), F.lit(None).cast("array<string>").alias("none"))
    row = tables.flatten_nested(nested).first()
    assert len(row["long"]) == 800 and row["none"] is None


def test_scan_reads_only_the_needed_columns(spark, sf):
    plan = tables.scan_required(spark.read.parquet(f"{sf}/events.parquet"), ["event_id", "value"], ["event_id"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,value:double>" in text and "IsNotNull(event_id)" in text


def test_reuse_or_build(spark, tmp_path):
    calls = []

    def build(n):
        calls.append(n)
        return spark.range(n)

    get = lambda n: tables.reuse_or_build(spark, str(tmp_path), "core", {"ku": n, "ki": 5}, lambda: build(n))
    assert (get(3).count(), get(3).count(), get(4).count()) == (3, 3, 4)
    assert calls == [3, 4]


def test_nested_results_and_lists_of_seeds(spark):
    docs = [{"args": {"seed": s, "lr": 1}, "best_epoch": e, "test": {"n_eval": 9, "HR@10": h}} for s, e, h in ((8, 5, 0.25), (7, 3, 0.75))]
    nested = spark.createDataFrame(docs, "args struct<seed:int,lr:int>, best_epoch int, test struct<n_eval:int,`HR@10`:double>")
    flat = runs.run_results(nested.withColumn("dataset", F.lit("d")), {"HR@10": "hr_10"}, "dataset")
    one = runs.seed_summary(flat, "dataset", "seed", ["hr_10"], expected_n=9, epoch="best_epoch").first()
    assert (one["seeds"], one["best_epochs"], one["hr_10_mean"], one["n_eval_expected"]) == ([7, 8], [3, 5], 0.5, True)
