"""Attention, ranking, metrics and learned inputs against plain numpy."""

import functools
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from footfall.functions import vectors as vx
from footfall.operators import attention as att
from footfall.operators import factors, learned, metrics, ranking
from footfall.plans import tiles
from registry import rank_queries

RNG = np.random.default_rng(11)
D, N_ITEMS, N_INST, DAY = 6, 40, 25, 86_400_000
ITEMS = RNG.normal(size=(N_ITEMS, D)).astype(np.float32)
ITEMS[7] = ITEMS[3]  # equal vectors, so scores tie
KEYS = RNG.normal(size=(N_ITEMS, D)).astype(np.float32)
QUERIES = RNG.normal(size=(N_INST, D)).astype(np.float32)
HISTORY = [list(map(int, RNG.integers(1, N_ITEMS + 1, size=RNG.integers(1, 12)))) for _ in range(N_INST)]
TIMES = [[int(t) for t in sorted(RNG.integers(1, 100, size=len(h)) * DAY)] for h in HISTORY]
TARGETS = [int(t) for t in RNG.integers(1, N_ITEMS + 1, size=N_INST)]
TARGETS[0], TARGETS[1] = 4, 8
NOW = 120 * DAY


@pytest.fixture(scope="module")
def frames(spark):
    inst = spark.createDataFrame(
        [(i, TARGETS[i], HISTORY[i], TIMES[i], NOW) for i in range(N_INST)],
        "instance_id long, target_iid long, history_iids array<long>, history_timestamps array<long>, target_timestamp long",
    )
    items = spark.createDataFrame(
        [(i + 1, KEYS[i].tolist(), ITEMS[i].tolist()) for i in range(N_ITEMS)], "iid long, key_vec array<float>, value_vec array<float>"
    )
    queries = spark.createDataFrame([(i, QUERIES[i].tolist()) for i in range(N_INST)], "instance_id long, query_vec array<float>")
    return inst, items, queries


def plain_attention(i, mode, gamma, k, tau):
    ids = np.array(HISTORY[i]) - 1
    sim = KEYS[ids].astype(float) @ QUERIES[i].astype(float) / math.sqrt(D)
    logit = sim - gamma * np.log1p([(NOW - t) / DAY for t in TIMES[i]])
    if mode == "mean":
        w = np.full(len(ids), 1 / len(ids))
    else:
        keep = np.arange(len(ids)) if mode == "soft" else np.argsort(-logit, kind="stable")[:k]
        z = logit[keep] / (1 if mode == "soft" else tau + 1e-3)
        w = np.zeros(len(ids))
        w[keep] = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    return sim, logit, w, w @ ITEMS[ids].astype(float)


@pytest.mark.parametrize("mode", ["soft", "mean", "hard"])
@pytest.mark.parametrize("sizes", [{}, {"broadcast_bytes": 0, "tile_rows": 3}, {"broadcast_bytes": 0, "tile_rows": 1000}])
def test_attention(frames, mode, sizes):
    inst, items, queries = frames
    out = att.attend(inst, items, queries, mode, gamma=0.3, k=3, tau=0.7, **sizes)
    contexts = {r["instance_id"]: r["context_vec"] for r in out.collect()}
    rows = {}
    for r in att.attention_rows(out).collect():
        rows.setdefault(r["instance_id"], {})[r["position"]] = r
    for i in range(N_INST):
        sim, logit, w, context = plain_attention(i, mode, 0.3, 3, 0.7)
        assert np.allclose(contexts[i], context)
        for p, iid in enumerate(HISTORY[i]):
            r = rows[i][p]
            assert r["iid"] == iid
            assert np.allclose([r["similarity"], r["logit"], r["weight"]], [sim[p], logit[p], w[p]])


def test_one_vector_as_key_and_value(frames):
    inst, items, queries = frames
    one = att.attend(inst, items, queries, "soft", key="value_vec", value="value_vec")
    two = att.attend(inst, items.withColumn("key_vec", F.col("value_vec")), queries, "soft")
    a, b = ({r["instance_id"]: r["context_vec"] for r in d.collect()} for d in (one, two))
    assert all(np.allclose(a[i], b[i]) for i in a) and len(a) == len(b) == N_INST


@pytest.mark.parametrize("sizes", [{}, {"broadcast_bytes": 0, "tile_rows": 4}])
def test_instances_that_hold_their_queries(frames, sizes):
    inst, items, queries = frames
    held = inst.join(queries, "instance_id").localCheckpoint()
    both = [att.attend(i, items, q, "soft", **sizes) for i, q in ((held, None), (inst, queries))]
    if not sizes:  # beside a small catalog nothing moves
        assert "Exchange" not in both[0]._jdf.queryExecution().executedPlan().toString()
    a, b = ({r["instance_id"]: r["context_vec"] for r in d.collect()} for d in both)
    assert a.keys() == b.keys() and all(np.allclose(a[i], b[i]) for i in a)


def test_a_shared_catalog_is_not_copied_by_tasks():
    vectors = np.random.default_rng(3).normal(size=(3000, 4))
    ids = np.random.default_rng(4).permutation(3000)
    place = ranking._in_blocks(ids, [vectors])
    ids, vectors = ids[place], vectors[place]
    blocks = [ranking._Block(ids[i : i + 1024], vectors[i : i + 1024]) for i in range(0, 3000, 1024)]
    assert all(np.shares_memory(b.vectors, vectors) for b in blocks)
    norms = np.sqrt((vectors**2).sum(1))
    assert all(norms[i : i + 1024].min() >= norms[i + 1024 :].max(initial=0) for i in range(0, 3000, 1024))
    assert np.shares_memory(tiles.Vectors(np.arange(3000), [vectors]).matrices[0], vectors)


@pytest.mark.parametrize("sizes", [{}, {"broadcast_bytes": 0, "tile_rows": 4}])
def test_unknown_items_and_missing_queries(frames, sizes):
    inst, items, queries = frames
    few, some = items.where("iid > 5"), queries.where("instance_id > 2")
    out = att.attend(inst, few, some, "soft", **sizes).collect()
    known = {i: [x for x in HISTORY[i] if x > 5] for i in range(3, N_INST)}
    assert {r["instance_id"]: r["iids"] for r in out} == {i: xs for i, xs in known.items() if xs}
    facts = att.unmatched(inst, few, some).first()
    assert tuple(facts) == (3, sum(x <= 5 for xs in HISTORY for x in xs))


def test_unknown_modes(frames):
    inst, items, queries = frames
    with pytest.raises(ValueError):
        att.attend(inst, items, queries, "sharp")
    with pytest.raises(ValueError):
        att.user_vectors(queries, mode="sum")


def test_fusion_modes(frames):
    inst, items, queries = frames
    context = att.attend(inst, items, queries, "soft").select("instance_id", "context_vec")
    last = att.last_vectors(inst, items, "value_vec")
    got = lambda df: {r["instance_id"]: np.array(r["user_vec"]) for r in df.collect()}
    unit = lambda x: x / np.linalg.norm(x)
    gated = got(att.user_vectors(context, last, mode="gated", gate=0.25))
    residual = got(att.user_vectors(context, queries=queries, mode="residual", alpha=0.4, normalise=False))
    for i in range(N_INST):
        c = plain_attention(i, "soft", att.GAMMA, 0, 0)[3]
        h = ITEMS[HISTORY[i][-1] - 1].astype(float)
        assert np.allclose(gated[i], unit(0.25 * h + 0.75 * c))
        assert np.allclose(residual[i], QUERIES[i] + 0.4 * c)


def test_diagnostics_of_a_single_row_history(spark):
    shape = "instance_id long, positions array<int>, similarities array<double>, weights array<double>"
    df = spark.createDataFrame([(1, [0], [0.5], [1.0]), (2, [2, 0, 1, 3], [0.1, 0.2, 0.3, 0.0], [0.4, 0.4, 0.0, 0.2])], shape)
    one, two = att.attention_diagnostics(df).orderBy("instance_id").collect()
    assert (one["top1_top2_margin"], one["top1_mass"], one["entropy"], one["top_positions"]) == (1.0, 1.0, 0.0, [0])
    assert two["top_positions"] == [0, 2, 3] and two["sim_last"] == 0.0 and two["sim_max"] == 0.3
    assert np.isclose(two["effective_n"], math.exp(two["entropy"]))


def plain_ranks(scores):
    """Rank by a full stable sort, seen items masked unless they are the target."""
    out = []
    for i in range(N_INST):
        s = np.round(scores[i].copy(), ranking.DIGITS)
        hidden = [h - 1 for h in HISTORY[i] if h != TARGETS[i]]
        s[hidden] = -np.inf
        order = np.argsort(-s, kind="stable")
        out.append(int(np.flatnonzero(order == TARGETS[i] - 1)[0]) + 1)
    return out


@pytest.mark.parametrize("plan", [dict(), dict(broadcast_bytes=0, tile_rows=7), dict(broadcast_bytes=0, tile_rows=1000)])
@pytest.mark.parametrize("mode", ["dual", "query"])
def test_ranks_equal_sorting(frames, plan, mode):
    inst, items, queries = frames
    beh = "query_vec" if mode == "dual" else None
    left = ranking.score_vectors(queries, "instance_id", beh, "query_vec", 2.0, 0.5)
    right = ranking.score_vectors(items, "iid", "value_vec" if beh else None, "value_vec")
    got = {r["instance_id"]: r["rank"] for r in ranking.target_ranks(inst, left, right, **plan).collect()}
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    e, q = ITEMS.astype(float), QUERIES.astype(float)
    scores = 0.5 * unit(q) @ unit(e).T + (2.0 * q @ e.T if beh else 0)
    assert [got[i] for i in range(N_INST)] == plain_ranks(scores)

    best = ranking.top_items(inst, left, right, 5, **plan)
    lists = {}
    for r in best.orderBy("instance_id", "place").collect():
        lists.setdefault(r["instance_id"], []).append(r["iid"])
    for i in range(N_INST):
        s = np.round(scores[i], ranking.DIGITS)
        s[[h - 1 for h in HISTORY[i] if h != TARGETS[i]]] = -np.inf
        order = [int(x) + 1 for x in np.argsort(-s, kind="stable") if np.isfinite(s[x])][:5]
        assert lists[i] == order


@pytest.mark.parametrize("plan", [dict(), dict(broadcast_bytes=0, tile_rows=9), dict(broadcast_bytes=0, tile_rows=1000)])
def test_blocks_that_cannot_matter_are_not_multiplied(spark, monkeypatch, plan):
    monkeypatch.setattr(ranking, "BLOCK_ROWS", 10)
    rng = np.random.default_rng(4)
    items = rng.normal(size=(200, 4)) * np.exp(-np.arange(200) / 25)[:, None]
    items[3] *= 30  # a long vector, the target of the first instances
    users = rng.normal(size=(30, 4))
    users[:10] = items[3] + 0.1 * users[:10]
    targets = [4] * 10 + [int(t) for t in rng.integers(1, 201, size=18)] + [999, 5]
    seen = [[int(x) for x in rng.integers(1, 201, size=rng.integers(0, 5))] for _ in users]
    inst = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(zip(targets, seen))], "instance_id long, target_iid long, history_iids array<long>")
    vecs = spark.createDataFrame([(i, u.tolist()) for i, u in enumerate(users[:29])], "instance_id long, vec array<double>")
    catalog = spark.createDataFrame([(i + 1, x.tolist()) for i, x in enumerate(items)], "iid long, vec array<double>")
    scores = np.round(users @ items.T, ranking.DIGITS)
    got = {r["instance_id"]: r for r in ranking.target_ranks(inst, vecs, catalog, report=True, **plan).collect()}
    assert sorted(got) == list(range(28))  # no vector for the last, no such target for the one before
    for i, r in got.items():
        s = scores[i].copy()
        s[[h - 1 for h in seen[i] if h != targets[i]]] = -np.inf
        assert r["rank"] == 1 + sum(s > s[targets[i] - 1]) + sum(s[: targets[i] - 1] == s[targets[i] - 1])
    assert all(got[i]["n_blocks"] <= 1 for i in range(10)) and max(r["n_blocks"] for r in got.values()) == 20
    best = ranking.top_items(inst, vecs, catalog, 3, report=True, **plan).collect()
    assert len(best) == 29 * 3 and min(r["n_blocks"] for r in best) < 20
    for r in best:
        s = scores[r["instance_id"]].copy()
        s[[h - 1 for h in seen[r["instance_id"]] if h != targets[r["instance_id"]]]] = -np.inf
        assert np.argsort(-s, kind="stable")[r["place"] - 1] == r["iid"] - 1


def test_gathered_vectors_are_bounded(monkeypatch):
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(5)), pa.array(QUERIES[:5].tolist()), pa.array([list(range(len(h))) for h in HISTORY[:5]]), pa.array(HISTORY[:5]),
         pa.array([[1.0] * len(h) for h in HISTORY[:5]])], names=["instance_id", "query_vec", "positions", "iids", "deltas"],
    )
    vectors = tiles.Vectors(np.arange(1, N_ITEMS + 1), [KEYS.astype(float), ITEMS.astype(float)])
    for mode in ("soft", "hard", "mean"):
        (whole,) = att._partial(batch, vectors, mode, 0.3, 3)
        monkeypatch.setattr(att, "_CELLS", 1)
        parts = list(att._partial(batch, vectors, mode, 0.3, 3))
        monkeypatch.setattr(att, "_CELLS", 4_000_000)
        assert len(parts) == 5 and np.allclose(np.concatenate([p.sums for p in parts]), whole.sums)
        assert np.allclose(np.concatenate([p.best_logits for p in parts]), whole.best_logits)


def test_vector_expressions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1, 2, 3]), ([0.0, 0.0], [])], "v array<double>, h array<long>")
    rows = df.select(vx.unit(F.col("v")), vx.pad_left(F.col("h"), 2), vx.softmax(F.col("v"))).collect()
    assert [list(r[0]) for r in rows] == [[0.6, 0.8], [0.0, 0.0]]
    assert [r[1] for r in rows] == [[2, 3], [0, 0]]
    assert np.allclose(rows[0][2], np.exp([3, 4]) / np.exp([3, 4]).sum())
    x = spark.createDataFrame([(-800.0,), (0.0,), (800.0,)], "x double").select(vx.log_sigmoid(F.col("x"))).collect()
    assert np.allclose([r[0] for r in x], [-800.0, -math.log(2), 0.0])
    t = spark.createDataFrame([(5 * DAY, 3 * DAY), (DAY, 2 * DAY), (DAY, 0)], "now long, then long")
    assert [r[0] for r in t.select(vx.elapsed_days(F.col("now"), F.col("then"))).collect()] == [2.0, 0.0, 0.0]


def test_metrics(spark):
    ranks = spark.createDataFrame([(i, r) for i, r in enumerate([1, 3, 11, 60])], "instance_id long, rank long")
    m = metrics.rank_metrics(ranks).first()
    assert m["n_eval"] == 4 and m["hr_10"] == 0.5 and m["hr_50"] == 0.75
    assert np.isclose(m["ndcg_10"], (1 + 0.5) / 4) and np.isclose(m["mrr"], (1 + 1 / 3 + 1 / 11 + 1 / 60) / 4)
    empty = metrics.rank_metrics(ranks.where("rank < 0")).first()
    assert empty["n_eval"] == 0 and empty["mrr"] is None and empty["hr_10"] is None


@pytest.mark.parametrize("n", [1, 2, 9, 10, 11, 100])
def test_rank_percentiles_by_index(spark, n):
    values = [int(x) for x in np.random.default_rng(n).integers(1, 30, size=n)]
    ranks = spark.createDataFrame(list(enumerate(values)), "instance_id long, rank long").repartition(4)
    p = metrics.rank_percentiles(ranks).first()
    ordered = sorted(values)
    assert (p["rank_p50"], p["rank_p90"]) == (ordered[int(n * 0.5)], ordered[int(n * 0.9)])
    assert np.isclose(p["rank_mean"], np.mean(values))


def test_rank_percentiles_of_wide_ranks_and_none(spark):
    values = [int(x) for x in np.random.default_rng(5).integers(1, 1 << 40, size=500)] + [7] * 200 + [1 << 16] * 3
    ranks = spark.createDataFrame([(x,) for x in [*values, None]], "rank long").repartition(5)
    p = metrics.rank_percentiles(ranks, points=(0, 10, 28, 50, 99)).first()
    ordered = sorted(values)
    assert [p[f"rank_p{x}"] for x in (0, 10, 28, 50, 99)] == [ordered[len(ordered) * x // 100] for x in (0, 10, 28, 50, 99)]
    none = metrics.rank_percentiles(ranks.where("rank < 0")).first()
    assert none["rank_mean"] is None and none["rank_p50"] is None and none["rank_p90"] is None


def test_ridge_projection(spark):
    rng = np.random.default_rng(2)
    x, w = rng.normal(size=(300, 5)), rng.normal(size=(5, 3))
    y = x @ w + 0.01 * rng.normal(size=(300, 3))
    df = spark.createDataFrame([(i, x[i].tolist(), y[i].tolist()) for i in range(300)], "i int, x array<double>, y array<double>").repartition(6)
    got = learned.ridge_projection(df, "x", "y", penalty=0.5)
    want = np.linalg.solve(x.T @ x + 0.5 * np.eye(5), x.T @ y)
    assert np.allclose(got, want)
    projected = {r["i"]: r["p"] for r in learned.project(df, "x", got, "p").collect()}
    assert all(np.allclose(projected[i], x[i] @ want) for i in range(300))


@pytest.mark.parametrize("parts,fan", [(1, 16), (7, 2), (40, 3), (23, 16)])
def test_ridge_projection_is_combined_in_a_tree(spark, parts, fan):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(200, 4)), rng.normal(size=(200, 2))
    rows = [(x[i].tolist(), y[i].tolist()) for i in range(200)] + [(None, [0.0, 0.0]), ([0.0] * 4, None)]
    df = spark.createDataFrame(rows, "x array<double>, y array<double>").repartition(parts)
    want = np.linalg.solve(x.T @ x + np.eye(4), x.T @ y)
    assert np.allclose(learned.ridge_projection(df, "x", "y", fan=fan), want)
    with pytest.raises(ValueError, match="no pairs"):
        learned.ridge_projection(df.where("x is null"), "x", "y")


def test_hashed_text_vectors(spark):
    df = spark.createDataFrame([(1, "red shoes"), (2, "Red  SHOES"), (3, "blue hat"), (4, None)], "k int, t string")
    got = {r["k"]: np.array(r["vec"]) for r in learned.hashed_text_vectors(df, "k", "t", 64).collect()}
    assert len(got) == 4 and all(len(x) == 64 for x in got.values())
    assert np.allclose(got[1], got[2]) and not np.allclose(got[1], got[3])
    assert np.isclose(np.linalg.norm(got[1]), 1, atol=1e-6)


def plain_factors(pairs, rank, iterations, start, penalty=0.1, alpha=1.0):
    """Alternating least squares over a dense matrix of counts; also the loss after each iteration."""
    users, items = sorted({u for u, _ in pairs}), sorted({i for _, i in pairs})
    n = np.zeros((len(users), len(items)))
    for u, i in pairs:
        n[users.index(u), items.index(i)] += 1
    x, losses = np.array([start[u] for u in users]), []
    solve = lambda n, y: np.array([
        np.linalg.solve(y.T @ y + (y.T * (alpha * r)) @ y + penalty * (r > 0).sum() * np.eye(rank), ((1 + alpha * r) * (r > 0)) @ y) for r in n
    ])
    for _ in range(iterations):
        y = solve(n.T, x)
        x = solve(n, y)
        sizes = penalty * (((n > 0).sum(1) * (x**2).sum(1)).sum() + ((n > 0).sum(0) * (y**2).sum(1)).sum())
        losses.append(((1 + alpha * n) * ((n > 0) - x @ y.T) ** 2).sum() + sizes)
    return dict(zip(items, y, strict=True)), dict(zip(users, x, strict=True)), losses


@pytest.mark.parametrize("most,parts", [(1 << 26, 1), (1 << 26, 9), (0, 5)])
def test_behaviour_vectors_equal_plain_ones_with_a_hot_item(spark, most, parts):
    rng = np.random.default_rng(11)
    big = 1 << 40
    pairs = [(u, big) for u in range(120)] + [(int(u), int(i)) for u, i in zip(rng.integers(0, 120, 240), rng.integers(0, 30, 240))]
    df = spark.createDataFrame([*pairs, (None, 3), (4, None)], "uid long, iid long")
    ids = spark.createDataFrame([(u,) for u in range(120)], "iid long")
    start = {r["iid"]: np.array(r["vec"]) for r in factors.start_vectors(ids, 6, 42).collect()}
    items, users, losses = plain_factors(pairs, 6, 3, start)
    assert losses == sorted(losses, reverse=True)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
        got = factors.behaviour_vectors(df, rank=6, iterations=3, most=most, tile_rows=16)
        for table, key, want in zip(got, ("iid", "uid"), (items, users), strict=True):
            have = {r[key]: np.array(r["vec"]) for r in table.collect()}
            assert have.keys() == want.keys() and all(np.allclose(have[k], want[k], atol=1e-5) for k in want)
    finally:
        for k, value in old.items():
            spark.conf.set(k, value)
    empty = factors.behaviour_vectors(df.where("uid < 0"), rank=6, iterations=1)
    assert [t.count() for t in empty] == [0, 0]


def test_matrices_are_summed_however_often_a_node_holds_a_row(spark):
    rng = np.random.default_rng(9)
    rows = [(int(n), int(i), [float(i), 1.0, float(n)]) for n, i in zip(rng.integers(0, 3, 200), rng.integers(0, 4, 200), strict=True)]
    got = learned.summed_matrices(spark.createDataFrame(rows, "node int, i int, v array<double>"), fan=2).collect()
    assert {r["i"]: r["v"] for r in got} == {k: np.sum([v for _, i, v in rows if i == k], axis=0).tolist() for k in range(4)}


def test_a_cut_key_is_added_up_from_partial_systems():
    rng = np.random.default_rng(4)
    ids, w, v = np.sort(rng.integers(0, 4, 5000)), rng.random(5000), rng.normal(size=(5000, 3))
    starts, states = factors._partials(ids, w, v)
    assert list(ids[starts]) == [0, 1, 2, 3]
    for k, state in enumerate(states):
        own = ids == k
        assert np.allclose(state[:9].reshape(3, 3), (v[own].T * w[own]) @ v[own]) and state[-1] == own.sum()
        assert np.allclose(state[9:12], (1 + w[own]) @ v[own])


def test_behaviour_vectors_reflect_co_use(spark):
    rows = [(u, i) for u in range(1, 21) for i in ((1, 2, 3) if u % 2 else (4, 5, 6))]
    items, users = factors.behaviour_vectors(spark.createDataFrame(rows, "uid long, iid long"), rank=4, iterations=8)
    v = {r["iid"]: np.array(r["vec"]) for r in items.collect()}
    cosine = lambda a, b: v[a] @ v[b] / np.linalg.norm(v[a]) / np.linalg.norm(v[b])
    assert len(v) == 6 and users.count() == 20
    assert cosine(1, 2) > 0.9 > 0.5 > abs(cosine(1, 4))


@pytest.mark.parametrize("sizes", [{}, {"broadcast_bytes": 0, "tile_rows": 2}])
def test_attention_hands_on_columns_of_its_instances(spark, sizes):
    rows = [(i, [] if i % 4 == 0 else [1 + i % 3, 99], [1, 2], 3, [float(i), 1.0], 10 * i) for i in range(9)]
    inst = spark.createDataFrame(rows, "instance_id long, history_iids array<long>, history_timestamps array<long>, target_timestamp long, query_vec array<double>, target_iid long")
    inst = inst.withColumn("history_timestamps", F.slice("history_timestamps", 1, F.size("history_iids")))
    items = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(1, 4)], "iid long, vec array<double>")
    got = att.attend(inst, items, None, "soft", key="vec", value="vec", keep=("target_iid", "query_vec"), **sizes)
    users = att.user_vectors(got, keep=("target_iid", "query_vec")).collect()
    assert {r["instance_id"]: (r["target_iid"], r["query_vec"]) for r in users} == {i: (10 * i, [float(i), 1.0]) for i in range(9) if i % 4}


def test_vectors_of_training_pairs_do_not_move(spark):
    pairs = spark.createDataFrame([(1, 1, 2, [1.0, 2.0], [3.0])], "instance_id long, target_iid long, negative_iid long, vec array<double>, act_vec array<double>")
    items = spark.createDataFrame([(1, [1.0, 0.0], [2.0]), (2, [0.0, 1.0], [5.0])], "iid long, vec array<double>, act_vec array<double>")
    scored = ranking.training_scores(pairs, items)
    assert [tuple(r) for r in scored.collect()] == [(1, 1, 2, 1.0, 2.0, 6.0, 15.0)]
    assert "hashpartitioning" not in scored._jdf.queryExecution().toString()


@pytest.mark.parametrize("parts", [5])
def test_factors_of_many_users_stay_where_they_are(spark, monkeypatch, parts):
    rng = np.random.default_rng(12)
    pairs = [(u, 7) for u in range(80)] + [(int(u), int(i)) for u, i in zip(rng.integers(0, 80, 300), rng.integers(0, 20, 300), strict=True)]
    df = spark.createDataFrame([*pairs, (None, 3)], "uid long, iid long").repartition(parts)
    want = factors.behaviour_vectors(df, rank=4, iterations=2)
    monkeypatch.setattr(factors, "_LIST", 3)
    seen = []
    shared = factors.tiles.StoredCatalog.shared
    monkeypatch.setattr(factors.tiles.StoredCatalog, "shared", lambda self, *a: (seen.append(self.rows), shared(self, *a))[1])
    got = factors.behaviour_vectors(df, rank=4, iterations=2, most=30 * 5 * 8)
    tiled = factors.behaviour_vectors(df, rank=4, iterations=2, most=30 * 5 * 8, tile_rows=16, systems=0)
    for a, b in zip(want * 2, got + tiled, strict=True):
        a, b = ({r[0]: np.array(r["vec"]) for r in t.collect()} for t in (a, b))
        assert a.keys() == b.keys() and all(np.allclose(a[k], b[k], atol=1e-5) for k in a)
    assert seen and max(seen) < 30  # only the items' factors went through the driver


def test_close_scores_are_taken_again_and_no_others(monkeypatch):
    rng = np.random.default_rng(21)
    items, users = rng.normal(size=(600, 8)), rng.normal(size=(50, 8))
    items[100:200] = items[:100]  # ties
    items[200:300] = items[:100] * (1 + 3e-9)  # apart in double precision only
    ids, targets = rng.permutation(600) + 1, rng.integers(0, 600, size=50)
    targets[:30] = rng.integers(0, 300, size=30)
    seen = [[int(x) for x in rng.integers(1, 601, size=9)] * 2 for _ in users]
    part = pa.table({"instance_id": np.arange(50), "target_iid": ids[targets], "seen_iids": seen, "vec": list(users)})
    scores = np.round(users @ items.T, ranking.DIGITS)
    pairs, exact = [], ranking._Block.exact
    monkeypatch.setattr(ranking._Block, "exact", lambda self, walk, rows, at: (pairs.append(len(rows)), exact(self, walk, rows, at))[1])
    count, best = ranking._Counting(part, scores[np.arange(50), targets]), ranking._Best(part, 7)
    for walk in (count, best):
        for i in range(0, 600, 64):
            walk.visit(ranking._Block(ids[i : i + 64], items[i : i + 64]))
    for i, t in enumerate(targets):
        s = scores[i].copy()
        s[np.isin(ids, [x for x in seen[i] if x != ids[t]])] = -np.inf
        order = np.lexsort((ids, -s))
        assert count.better[i] == np.flatnonzero(order == t)[0]
        assert best.found[i].tolist() == ids[order[:7]].tolist() and np.allclose(best.best[i], s[order[:7]], atol=1e-8)
    assert sum(pairs) < 0.15 * 2 * scores.size


def test_halves_in_proportion_are_multiplied_as_one():
    rng = np.random.default_rng(22)
    near = rng.normal(size=(200, 5))
    near /= np.linalg.norm(near, axis=1)[:, None] * (1 + 1e-5 * rng.random(200))[:, None]
    far = near * (1 + rng.random(200))[:, None]
    users, ids, targets = rng.normal(size=(40, 10)), rng.permutation(200) + 1, rng.integers(0, 200, size=40)
    part = pa.table({"instance_id": np.arange(40), "target_iid": ids[targets], "seen_iids": [[1, 2]] * 40, "vec": list(users)})
    for first, folds in ((near, True), (far, False)):
        items = np.hstack([first, first / np.linalg.norm(first, axis=1)[:, None]])
        scores = np.round(users @ items.T, ranking.DIGITS)
        count, best, block = ranking._Counting(part, scores[np.arange(40), targets]), ranking._Best(part, 4), ranking._Block(ids, items)
        assert (block.folded() is not None) == folds
        count.visit(block)
        best.visit(block)
        for i, t in enumerate(targets):
            s = np.where((ids <= 2) & (ids != ids[t]), -np.inf, scores[i])
            order = np.lexsort((ids, -s))
            assert count.better[i] == np.flatnonzero(order == t)[0] and best.found[i].tolist() == ids[order[:4]].tolist()


@pytest.mark.parametrize("large", [1e25, 1e33])
def test_scores_beyond_single_precision(large):
    users, items = np.array([[large, 1.0], [1.0, 2.0]]), np.array([[1.0, 0.0], [2.0, large], [0.0, 1.0]])
    part = pa.table({"instance_id": [0, 1], "target_iid": [1, 3], "seen_iids": [[7], [7]], "vec": list(users)})
    walk = ranking._Counting(part, np.array([large, 2.0]))
    walk.visit(ranking._Block(np.array([1, 2, 3]), items))
    assert walk.better.tolist() == [1, 1]


def test_every_slice_has_a_task(frames):
    inst, items, queries = frames
    left, right = ranking.score_vectors(queries, "instance_id", None, "query_vec"), ranking.score_vectors(items, "iid", None, "value_vec")
    ranks = ranking.target_ranks(inst, left, right, broadcast_bytes=0, tile_rows=5)
    assert sorted(r["count"] for r in ranks.groupBy(F.spark_partition_id()).count().collect()) == [5] * 5


def test_vectors_move_once_a_portion(spark, monkeypatch):
    """Instances of a user share the vectors of their histories; a user with most of the instances is spread."""
    rows = [(100 * u + n, u, [1 + (u + j) % 40 for j in range(n)], [1] * n, 3, [1.0, 2.0]) for u in range(12) for n in range(1, 20)]
    rows += [(10_000 + n, 99, [1, 2], [1, 1], 3, [1.0, 2.0]) for n in range(600)]
    inst = spark.createDataFrame(rows, "instance_id long, uid long, history_iids array<long>, history_timestamps array<long>, target_timestamp long, query_vec array<double>")
    items = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(1, 41)], "iid long, vec array<double>")
    stored, store = {}, tiles.materialise
    monkeypatch.setattr(tiles, "materialise", lambda df, tag: stored.setdefault(tag, store(df, tag)) if tag == "portion-items" else store(df, tag))
    got = att.attend(inst, items, None, "soft", key="vec", value="vec", broadcast_bytes=0, tile_rows=50)
    want = att.attend(inst, items, None, "soft", key="vec", value="vec")
    a, b = ({r["instance_id"]: r["context_vec"] for r in d.collect()} for d in (got, want))
    assert a.keys() == b.keys() and len(a) == len(rows) and all(np.allclose(a[i], b[i]) for i in a)
    needed = stored["portion-items"]
    assert needed.count() <= 12 * 19 + 2 * 20 and needed.groupBy("iid").count().where("iid = 1").first()["count"] > 5


def test_a_portion_names_a_bounded_part_of_the_catalog(spark, monkeypatch):
    rows = [(i, [1 + (3 * i + j) % 100 for j in range(3)], [1, 1, 1], 3, 1 + i % 90) for i in range(60)]
    inst = spark.createDataFrame(rows, "instance_id long, history_iids array<long>, history_timestamps array<long>, target_timestamp long, ask long")
    items = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(1, 98)], "iid long, vec array<float>")
    stored, store = [], tiles.materialise
    monkeypatch.setattr(tiles, "materialise", lambda df, tag: (stored.append(store(df, tag)), stored[-1])[1] if tag == "portion-items" else store(df, tag))
    monkeypatch.setattr(tiles, "beside_needed", functools.partial(tiles.beside_needed, portion_bytes=20 * 24))
    got = att.attend(inst, items, None, "soft", key="vec", value="vec", broadcast_bytes=0, named={"query_vec": "ask", "last": "ask"}, keep=("last",))
    want = att.attend(inst, items, None, "soft", key="vec", value="vec", named={"query_vec": "ask", "last": "ask"}, keep=("last",))
    a, b = ({r["instance_id"]: (r["last"], *r["context_vec"]) for r in d.collect()} for d in (got, want))
    assert a.keys() == b.keys() and all(a[i][0] == b[i][0] == [1.0 + i % 90, 1.0] and np.allclose(a[i][1:], b[i][1:]) for i in a)
    assert len(stored) > 1 and max(r["count"] for r in stored[-1].groupBy("portion").count().collect()) <= 20


def test_pairs_beside_a_large_catalog(spark, sf, monkeypatch):
    """Vectors of query, history and both items come to the instances at once; pairs do not move to vectors."""
    want = {r[0]: tuple(r)[1:] for r in rank_queries.pair_scores(spark, sf).collect()}
    monkeypatch.setattr(tiles, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(att, "attend", functools.partial(att.attend, broadcast_bytes=0))
    scored = rank_queries.pair_scores(spark, sf)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    got = {r[0]: tuple(r)[1:] for r in scored.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[i], want[i], atol=2e-6) for i in got)
    assert not any("Join" in x for x in plan[: plan.index("MapInArrow")].splitlines())
