"""The three jobs end to end on the small tables, against step-by-step expectations in pandas."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from footfall.functions import text as tx
from footfall.operators import factors, learned
from footfall.plans import stages
from footfall.sources.tables import scan_with_row_id
from registry import views


@pytest.fixture(scope="module")
def raw(spark, sf, tmp_path_factory):
    """Purchases as reviews, some of them twice."""
    log = views.purchase_rows(spark, sf)
    log = log.select(
        F.col("user_id").cast("string").alias("user_id"), F.col("item_id").cast("string").alias("parent_asin"),
        "timestamp", (F.col("quantity") % 5 + 1).alias("rating"),
        F.concat(F.lit("bought "), F.col("quantity").cast("string")).alias("title"),
        F.repeat(F.concat(F.col("user_id").cast("string"), F.lit(" text ")), 20).alias("text"),
    )
    path = str(tmp_path_factory.mktemp("raw") / "reviews")
    log.unionByName(log.where(F.col("rating") == 3)).repartition(4).write.parquet(path)
    return scan_with_row_id(spark, path)


@pytest.fixture(scope="module")
def built(raw):
    return stages.build_interactions(raw, n_users=90, ku=5, ki=5, min_rating=4.0)


def test_interactions(built):
    rows = built.rows.toPandas()
    assert not rows.duplicated(["user_id", "item_id"]).any()
    assert rows.groupby("user_id").size().min() >= 5 and rows.groupby("item_id").size().min() >= 5
    assert rows["user_id"].nunique() <= 90
    rows = rows.sort_values(["user_id", "timestamp", "item_id"])
    train, targets = set(), {}
    for user, group in rows.groupby("user_id"):
        items, times = group["item_id"].tolist(), group["timestamp"].tolist()
        train.update(items[:-2])
        targets[user] = {"valid": (items[-2], times[-2], items[:-2]), "test": (items[-1], times[-1], items[:-1])}
    targets = {u: t for u, t in targets.items() if t["valid"][0] in train and t["test"][0] in train}
    got = {}
    for r in built.manifest.collect():
        got.setdefault(r["user_id"], {})[r["split"]] = (r["item_id"], r["timestamp"], r["history"])
    assert got == targets
    assert built.stats_after.first()["n_inter"] == len(rows)
    assert built.unseen_after.agg(F.sum("n_unseen")).first()[0] == 0
    assert built.core_rounds >= 1
    assert dict(built.sample().dtypes)["is_fallback"] == "boolean"


@pytest.fixture(scope="module")
def prepared(built):
    queries = built.sample().withColumn("query", F.concat(F.lit("want "), F.col("title")))
    return stages.build_instances(queries, built.manifest)


def test_instances(built, prepared):
    counts = Counter(r["split"] for r in prepared.instances.select("split").collect())
    assert counts["valid"] == counts["test"] == built.manifest.where("split = 'test'").count()
    n_rows, n_users = built.rows.count(), prepared.users().count()
    assert sum(counts.values()) == n_rows - n_users  # every row but a user's first has history
    ids = sorted(r["iid"] for r in prepared.items().collect())
    assert ids == list(range(1, len(ids) + 1))
    assert prepared.review_pool.where(F.size("review_texts") > 5).count() == 0
    assert prepared.log.count() == n_rows


def test_unidentified_rows_are_refused(built):
    queries = built.sample().withColumn("query", F.lit("q"))
    with pytest.raises(ValueError, match="identified"):
        stages.build_instances(queries.unionByName(queries), built.manifest, dedup=False)


def test_disagreeing_manifest_is_refused(built):
    queries = built.sample().withColumn("query", F.lit("q"))
    double = built.manifest.unionByName(built.manifest.withColumn("split", F.when(F.col("split") == "test", "valid").otherwise("test")))
    with pytest.raises(ValueError, match="both"):
        stages.build_instances(queries, double)


@pytest.mark.parametrize("mode,fusion", [("full", "context"), ("query_only", "context"), ("full", "residual")])
def test_evaluation(spark, prepared, mode, fusion):
    test = prepared.instances.where("split = 'test'")
    assert test.select("instance_id").distinct().count() == test.count()
    items, _ = factors.behaviour_vectors(prepared.log.where("split = 'train'"), rank=8, iterations=3)
    texts = learned.hashed_text_vectors(prepared.items(), "iid", "item_id", 32, tx.PASSAGE_PREFIX)
    catalog = texts.withColumnRenamed("vec", "text_vec").join(items.withColumnRenamed("vec", "behaviour_vec"), "iid")
    asked = learned.hashed_text_vectors(test, "instance_id", "query", 32, tx.QUERY_PREFIX)
    weights = np.random.default_rng(0).normal(size=(32, 8))
    asked = learned.project(asked.withColumnRenamed("vec", "query_vec"), "query_vec", weights, "attn_vec")
    dropped = spark.createDataFrame([(1,), (2,)], "uid long")
    with pytest.raises(ValueError, match="1 instances without a query vector"):
        some = asked.where(asked["instance_id"] != test.agg(F.max("instance_id")).first()[0])
        stages.evaluate(test, some, catalog, mode=mode, fusion=fusion)
    row = stages.evaluate(test, asked, catalog, dropped, mode=mode, fusion=fusion).first()
    assert row["n_eval"] == test.where("uid > 2").count()
    assert 0 <= row["hr_10"] <= row["hr_50"] <= 1 and 0 < row["mrr"] <= 1
    assert 1 <= row["rank_p50"] <= row["rank_p90"] <= catalog.count()
