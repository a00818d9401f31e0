"""Top-k against a full product; the query also has SQL."""

import math

import numpy as np
import pytest

from footfall.llm import topk


def plain(rows, every, k, scale=256):
    kept = {i: [math.floor(scale * x) for x in v] for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q in (i for i in kept if i % every == 0):
        alike = {i: v for i, v in kept.items() if i != q and len(v) == len(kept[q])}
        exact = {i: sum(a * b for a, b in zip(kept[q], v, strict=True)) for i, v in alike.items()}
        scores = sorted((-max(-(2**63), min(2**63 - 1, s)), i) for i, s in exact.items())
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)}
    return out


@pytest.mark.parametrize(("block", "ring", "pivots"), [(2048, 256, 48), (20, 4, 5), (7, 100, 1)])
def test_ties_copies_and_norms(spark, monkeypatch, block, ring, pivots):
    for name, value in (("BLOCK", block), ("RING", ring), ("PIVOTS", pivots)):
        monkeypatch.setattr(topk, name, value)
    rnd = np.random.default_rng(block)
    rows = [(i, (rnd.normal(size=4) * rnd.choice([0.01, 1, 30])).tolist()) for i in range(120)]
    rows += [(200 + i, [0.5, 0.5, 0.0, 0.0]) for i in range(90)] + [(1000, [0.0] * 4)]
    rows += [(300, None), (301, [None, 1.0, 1.0, 1.0]), (302, [math.nan] * 4), (303, [math.inf] * 4), (305, [])]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string").repartition(5)
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(frame, "vec_id", "embedding", 10, 5).collect()}
    assert got == plain(rows, 10, 5)


def test_fewer_than_k_repeats_and_large_scores(spark):
    rows = [(0, [1e6, 3.0]), (0, [1e6, 3.0]), (5, [1e6, -3.0]), (None, [1.0, 1.0]), (7, [1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(frame, "vec_id", "embedding", 5, 5).collect()}
    score = 256_000_000 * 256_000_000 - 768 * 768
    assert got == {(0, 1, 5, score), (5, 1, 0, score)}
    assert topk.search(frame.limit(0), "vec_id", "embedding", 5, 5).collect() == []
    assert topk.search(frame.where("vec_id = 0"), "vec_id", "embedding", 5, 5).collect() == []


@pytest.mark.parametrize("block", [2048, 9])
def test_large_components_and_several_lengths(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    rnd = np.random.default_rng(3)
    rows = [(i, (rnd.normal(size=3) * 8e6).tolist()) for i in range(60)]
    rows += [(100 + i, (rnd.normal(size=2) * rnd.choice([1, 9e6])).tolist()) for i in range(40)]
    rows += [(200, [9e6, 1.0]), (201, [1.0]), (210, [-4.0]), (300, []), (302, []), (400, [1.0] * 7)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(frame, "vec_id", "embedding", 10, 5).collect()}
    assert got == plain(rows, 10, 5)


def test_scores_beyond_a_long_are_its_ends(spark):
    rows = [(0, [1e15, 1e15, 1.0]), (1, [1e15, 1e15, 0.0]), (2, [1e300, 1.0, 0.0]), (3, [-1e15, -1e15, 0.0]), (4, [1e3, 2.0, 3.0]), (5, [1e15, -1e15, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in topk.search(frame, "vec_id", "embedding", 10, 5).orderBy("rank").collect()]
    assert got == [(1, 2**63 - 1), (2, 2**63 - 1), (4, 2**63 - 1), (5, 65536 * 2), (3, -(2**63))]
