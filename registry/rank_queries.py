"""Vectors, attention, ranking, losses, runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from footfall.functions import vectors as vx
from footfall.operators import attention as att
from footfall.operators import factors, learned, metrics, ranking, runs
from footfall.operators import sequences as seqs
from footfall.plans import tiles
from footfall.plans.scratch import Passing
from registry import views as v
from registry.base import query
from registry.views import sql

TAU_BEH, TAU_SEM = 2.0, 0.5
_RUN = ("dataset", "seed")


def r6(column, name=None):
    return F.round(F.col(column), 6).alias(name or column)


def vector_sums(df, vector):
    """Two sums over each instance's vector, so that vectors of all instances compare as plain values."""
    weighted = F.transform(vector, lambda x, i: x * (i + 1))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    return df.select("instance_id", F.round(total(F.col(vector)), 6).alias("total"), F.round(total(weighted), 6).alias("weighted"))


def everyone(spark, sf):
    """The instances of all splits; only ranking and evaluation leave those of train out."""
    return v.instances(spark, sf, "train", "valid", "test")


# --- SQL views --------------------------------------------------------------------------------


def _attention_sql(source: str) -> dict[str, str]:
    """History rows with logits, weights and context vectors of the instances in ``source``."""
    return {
        "qv": f"""
            SELECT instance_id, embedding::DOUBLE[] AS q FROM {source}
            JOIN embeddings ON vec_id = instance_id % (SELECT count(*) FROM embeddings)""",
        "hr": f"""
            SELECT instance_id, z[1]::INT AS position, z[2] AS iid,
                   greatest(0, (target_timestamp - z[3]) / 86400000.0) AS delta_days
            FROM (SELECT instance_id, target_timestamp, unnest(list_zip(range(len(history_iids)), history_iids,
                  history_timestamps)) AS z FROM {source})""",
        "lg": """
            SELECT hr.instance_id, position, hr.iid, vec, list_dot_product(q, vec) / sqrt(64) AS similarity,
                   list_dot_product(q, vec) / sqrt(64) - ln(2) * ln(1 + delta_days) AS logit
            FROM hr JOIN it ON it.iid = hr.iid JOIN qv ON qv.instance_id = hr.instance_id""",
        "soft": """
            SELECT *, e / sum(e) OVER (PARTITION BY instance_id) AS weight
            FROM (SELECT *, exp(logit - max(logit) OVER (PARTITION BY instance_id)) AS e FROM lg)""",
        "hard": """
            SELECT * REPLACE (coalesce(e, 0) AS e), coalesce(e, 0) / sum(e) OVER (PARTITION BY instance_id) AS weight
            FROM (SELECT *, CASE WHEN place <= 5 THEN exp((logit - max(logit) OVER (PARTITION BY instance_id))
                                                          / (ln(2) + 0.001)) END AS e
                  FROM (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY logit DESC, position) AS place
                        FROM lg))""",
        "ctx": """
            SELECT instance_id, list(s ORDER BY dim) AS c FROM (
                SELECT instance_id, dim, sum(weight * x) AS s
                FROM (SELECT instance_id, weight, unnest(vec) AS x, generate_subscripts(vec, 1) AS dim FROM soft)
                GROUP BY 1, 2)
            GROUP BY 1""",
        "ctxd": """
            SELECT instance_id, dim, sum(weight * x) AS c
            FROM (SELECT instance_id, weight, unnest(vec) AS x, generate_subscripts(vec, 1) AS dim FROM soft)
            GROUP BY 1, 2""",
        "qd": "SELECT instance_id, unnest(q) AS q, generate_subscripts(q, 1) AS dim FROM qv",
        "lastd": f"""
            SELECT instance_id, unnest(vec) AS l, generate_subscripts(vec, 1) AS dim
            FROM {source} JOIN it ON it.iid = history_iids[-1]""",
        "goald": f"""
            SELECT instance_id, target_iid, unnest(vec) AS x, generate_subscripts(vec, 1) AS dim
            FROM {source} JOIN it ON it.iid = target_iid""",
        "uv": """
            SELECT instance_id, list_transform(c, lambda x: x / greatest(sqrt(list_dot_product(c, c)), 1e-12)) AS u
            FROM ctx""",
    }


_ALL = _attention_sql("inst")
_EVAL = _attention_sql("eval")
_FIT = _attention_sql("fit")


def _sums_sql(source: str, m: str) -> str:
    """The sums of :func:`vector_sums` over unit vectors, from one row per dimension."""
    length = f"greatest(sqrt(sum(({m}) * ({m}))), 1e-12)"
    return (
        f"SELECT instance_id, round(sum({m}) / {length}, 6) AS total, round(sum(dim * ({m})) / {length}, 6) AS weighted "
        f"FROM {source} GROUP BY instance_id"
    )


def _ranked_sql(score: str) -> dict[str, str]:
    """All scores of the evaluation instances, seen items left out, and the target's rank."""
    return {
        **_EVAL,
        "sc": f"""
            SELECT e.instance_id, e.target_iid, it.iid, round({score}, 9) AS s
            FROM eval e JOIN qv USING (instance_id) JOIN uv USING (instance_id) CROSS JOIN it
            WHERE it.iid = e.target_iid OR NOT list_contains(e.history_iids, it.iid)""",
        "rk": """
            SELECT instance_id, target_iid, place AS rank FROM (
                SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY s DESC, iid) AS place FROM sc)
            WHERE iid = target_iid""",
    }


_COS = "list_dot_product(q, vec) / (sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(vec, vec)))"
_BEH = "list_dot_product(u, vec)"
_DUAL = f"{TAU_BEH} * {_BEH} + {TAU_SEM} * {_COS}"
_METRICS = """
    count(*) AS n_eval, round(avg(1.0 / rank), 6) AS mrr, avg((rank <= 10)::INT) AS hr_10,
    round(avg(CASE WHEN rank <= 10 THEN 1.0 / log2(rank + 1) ELSE 0 END), 6) AS ndcg_10,
    avg((rank <= 50)::INT) AS hr_50,
    round(avg(CASE WHEN rank <= 50 THEN 1.0 / log2(rank + 1) ELSE 0 END), 6) AS ndcg_50"""
_PERCENTILES = """
    SELECT round(avg(rank), 6) AS rank_mean, max(rank) FILTER (r = (n * 50) // 100) AS rank_p50,
           max(rank) FILTER (r = (n * 90) // 100) AS rank_p90
    FROM (SELECT rank, row_number() OVER (ORDER BY rank, instance_id) - 1 AS r, count(*) OVER () AS n FROM rk)"""


# --- vectors ----------------------------------------------------------------------------------


@query("vector_ops", """
    SELECT vec_id, round(sqrt(list_dot_product(v, v)), 6) AS norm, round(list_dot_product(v, v), 6) AS self_dot,
           round(list_sum(list_transform(s, lambda x: x * x)), 6) AS softmax_energy,
           round(ln(1 + exp(v[1])), 6) AS softplus_first, round(-ln(1 + exp(-v[1])), 6) AS log_sigmoid_first
    FROM (SELECT vec_id, v, list_transform(e, lambda x: x / list_sum(e)) AS s FROM (
          SELECT vec_id, embedding::DOUBLE[] AS v,
                 list_transform(embedding::DOUBLE[], lambda x: exp(x - list_max(embedding::DOUBLE[]))) AS e
          FROM embeddings))""")
def vector_ops(spark, sf):
    vec = F.col("embedding")
    first = vec[0].cast("double")
    energy = F.aggregate(vx.softmax(vec.cast("array<double>")), F.lit(0.0), lambda a, x: a + x * x)
    return v.table(spark, sf, "embeddings").select(
        "vec_id", F.round(vx.norm(vec), 6).alias("norm"), F.round(vx.dot("embedding", "embedding"), 6).alias("self_dot"),
        F.round(energy, 6).alias("softmax_energy"), F.round(vx.softplus(first), 6).alias("softplus_first"),
        F.round(vx.log_sigmoid(first), 6).alias("log_sigmoid_first"),
    )


def _queries(spark, sf, some):
    return v.queries_of(spark, sf, some)


def _attend(spark, sf, some, mode="soft"):
    asking, queries, named = v.asking(spark, sf, some)
    return att.attend(asking, v.catalog(spark, sf), queries, mode, key="vec", value="vec", named=named)


def _context(spark, sf, some, mode="soft"):
    return _attend(spark, sf, some, mode).select("instance_id", "context_vec")


@query("attention_logits", sql("""
    SELECT instance_id, position, iid, round(similarity, 6) AS similarity, round(logit, 6) AS logit FROM lg
    """, extra={k: _ALL[k] for k in ("qv", "hr", "lg")}))
def attention_logits(spark, sf):
    return att.attention_rows(_attend(spark, sf, everyone(spark, sf))).select(
        "instance_id", "position", "iid", r6("similarity"), r6("logit")
    )


def _weight_query(mode):
    return lambda spark, sf: att.attention_rows(_attend(spark, sf, everyone(spark, sf), mode)).select(
        "instance_id", "position", r6("weight")
    )


query("attention_soft", sql(
    "SELECT instance_id, position, round(weight, 6) AS weight FROM soft",
    extra={k: _ALL[k] for k in ("qv", "hr", "lg", "soft")}))(_weight_query("soft"))
query("attention_hard", sql(
    "SELECT instance_id, position, round(weight, 6) AS weight FROM hard",
    extra={k: _ALL[k] for k in ("qv", "hr", "lg", "hard")}))(_weight_query("hard"))
query("attention_mean", sql(
    "SELECT instance_id, position, round(1.0 / count(*) OVER (PARTITION BY instance_id), 6) AS weight FROM hr",
    extra={"hr": _ALL["hr"]}))(_weight_query("mean"))


@query("attention_diag", sql("""
    SELECT instance_id, round(entropy, 6) AS entropy, round(exp(entropy), 6) AS effective_n,
           round(w[1], 6) AS top1_mass, round(w[1] - coalesce(w[2], 0), 6) AS top1_top2_margin,
           array_to_string(p[1:3], ',') AS top_positions, round(sim_last, 6) AS sim_last, round(sim_max, 6) AS sim_max
    FROM (SELECT instance_id, -sum(greatest(weight, 1e-12) * ln(greatest(weight, 1e-12))) AS entropy,
                 list(weight ORDER BY weight DESC, position) AS w, list(position ORDER BY weight DESC, position) AS p,
                 arg_max(similarity, position) AS sim_last, max(similarity) AS sim_max
          FROM hard GROUP BY instance_id)""", extra={k: _ALL[k] for k in ("qv", "hr", "lg", "hard")}))
def attention_diag(spark, sf):
    diag = att.attention_diagnostics(_attend(spark, sf, everyone(spark, sf), "hard"))
    return diag.select(
        "instance_id", r6("entropy"), r6("effective_n"), r6("top1_mass"), r6("top1_top2_margin"),
        v.joined("top_positions"), r6("sim_last"), r6("sim_max"),
    )


@query("user_vector", sql(_sums_sql("ctxd", "c"), extra=_ALL))
def user_vector(spark, sf):
    return vector_sums(att.user_vectors(_context(spark, sf, everyone(spark, sf))), "user_vec")


@query("user_vector_last", sql(_sums_sql("lastd", "l"), extra=_ALL))
def user_vector_last(spark, sf):
    last = att.last_vectors(everyone(spark, sf), v.catalog(spark, sf))
    return vector_sums(att.user_vectors(None, last=last, mode="last"), "user_vec")


@query("user_vector_gated", sql(_sums_sql("ctxd JOIN lastd USING (instance_id, dim)", "0.3 * l + 0.7 * c"), extra=_ALL))
def user_vector_gated(spark, sf):
    some = everyone(spark, sf)
    last = att.last_vectors(some, v.catalog(spark, sf))
    return vector_sums(att.user_vectors(_context(spark, sf, some), last=last, mode="gated", gate=0.3), "user_vec")


@query("user_vector_residual", sql(_sums_sql("ctxd JOIN qd USING (instance_id, dim)", "q + 0.4 * c"), extra=_ALL))
def user_vector_residual(spark, sf):
    some = everyone(spark, sf)
    fused = att.user_vectors(_context(spark, sf, some), queries=_queries(spark, sf, some), mode="residual")
    return vector_sums(fused, "user_vec")


# --- scores and ranks -------------------------------------------------------------------------


def _sides(spark, sf, some, mode, user_mode="soft"):
    """Instance and item score vectors of a scoring mode: dual, query or behaviour."""
    asked = _queries(spark, sf, some)
    items = v.catalog(spark, sf)
    beh = "user_vec" if mode != "query" else None
    sem = "query_vec" if mode != "behaviour" else None
    both = asked if beh is None else att.user_vectors(_context(spark, sf, some, user_mode)).join(asked, "instance_id")
    left = ranking.score_vectors(both, "instance_id", beh, sem, TAU_BEH, TAU_SEM)
    right = ranking.score_vectors(items, "iid", "vec" if beh else None, "vec" if sem else None)
    return left, right


@query("semantic_score", sql(f"""
    SELECT instance_id, target_iid, round({TAU_SEM} * sum(q * x) / (sqrt(sum(q * q)) * sqrt(sum(x * x))), 6) AS score
    FROM goald JOIN qd USING (instance_id, dim) GROUP BY instance_id, target_iid""", extra=_ALL))
def semantic_score(spark, sf):
    some = everyone(spark, sf)
    left, right = _sides(spark, sf, some, "query")
    scored = ranking.pair_scores(some.select("instance_id", "target_iid"), left, right, "target_iid", "score")
    return scored.select("instance_id", "target_iid", r6("score"))


@query("dual_score", sql(f"""
    SELECT instance_id, target_iid, round({TAU_BEH} * sum(c * x) / greatest(sqrt(sum(c * c)), 1e-12)
           + {TAU_SEM} * sum(q * x) / (sqrt(sum(q * q)) * sqrt(sum(x * x))), 6) AS score
    FROM goald JOIN qd USING (instance_id, dim) JOIN ctxd USING (instance_id, dim) GROUP BY instance_id, target_iid""", extra=_ALL))
def dual_score(spark, sf):
    some = everyone(spark, sf)
    left, right = _sides(spark, sf, some, "dual")
    scored = ranking.pair_scores(some.select("instance_id", "target_iid"), left, right, "target_iid", "score")
    return scored.select("instance_id", "target_iid", r6("score"))


def _ranks(spark, sf, mode):
    some = v.instances(spark, sf)
    left, right = _sides(spark, sf, some, mode)
    return ranking.target_ranks(some, left, right)


def rounded_metrics(ranks):
    m = metrics.rank_metrics(ranks)
    return m.select("n_eval", r6("mrr"), "hr_10", r6("ndcg_10"), "hr_50", r6("ndcg_50"))


@query("full_catalog_rank", sql("SELECT instance_id, target_iid, rank FROM rk", extra=_ranked_sql(_DUAL)))
def full_catalog_rank(spark, sf):
    return _ranks(spark, sf, "dual")


@query("query_only_rank", sql("SELECT instance_id, target_iid, rank FROM rk", extra=_ranked_sql(f"{TAU_SEM} * {_COS}")))
def query_only_rank(spark, sf):
    return _ranks(spark, sf, "query")


@query("behaviour_only_rank", sql("SELECT instance_id, target_iid, rank FROM rk", extra=_ranked_sql(f"{TAU_BEH} * {_BEH}")))
def behaviour_only_rank(spark, sf):
    return _ranks(spark, sf, "behaviour")


@query("topk_items", sql("""
    SELECT instance_id, iid, round(s, 6) AS score,
           row_number() OVER (PARTITION BY instance_id ORDER BY s DESC, iid) AS place FROM sc QUALIFY place <= 10
    """, extra=_ranked_sql(_DUAL)))
def topk_items(spark, sf):
    some = v.instances(spark, sf)
    left, right = _sides(spark, sf, some, "dual")
    best = ranking.top_items(some, left, right, 10)
    return best.select("instance_id", "iid", r6("score"), F.col("place").cast("bigint"))


@query("rank_metrics", sql(f"SELECT {_METRICS} FROM rk", extra=_ranked_sql(f"{TAU_SEM} * {_COS}")))
def rank_metrics(spark, sf):
    return rounded_metrics(_ranks(spark, sf, "query"))


@query("rank_percentiles", sql(_PERCENTILES, extra=_ranked_sql(f"{TAU_SEM} * {_COS}")))
def rank_percentiles(spark, sf):
    p = metrics.rank_percentiles(_ranks(spark, sf, "query"))
    return p.select(r6("rank_mean"), "rank_p50", "rank_p90")


@query("full_catalog_eval", sql(f"""
    SELECT split, {_METRICS} FROM rk JOIN eval USING (instance_id) GROUP BY split""", "eval", extra=_ranked_sql(_DUAL)))
def full_catalog_eval(spark, sf):
    """Dual scores of all items, seen items masked, metrics per evaluation split."""
    some = v.instances(spark, sf)
    left, right = _sides(spark, sf, some, "dual")
    ranks = ranking.target_ranks(some, left, right).join(some.select("instance_id", "split"), "instance_id")
    m = metrics.rank_metrics_by(ranks, ["split"])
    return m.select("split", "n_eval", r6("mrr"), "hr_10", r6("ndcg_10"), "hr_50", r6("ndcg_50"))


# --- training pairs ---------------------------------------------------------------------------

_NEG = {
    "tries": """
        SELECT instance_id, uid, target_iid, i,
               ('0x' || substr(md5('42:' || instance_id || ':' || i), 1, 8))::BIGINT
               % (SELECT count(*) FROM embeddings) + 1 AS x
        FROM fit, generate_series(1, 101) AS g(i)""",
    "neg": """
        SELECT instance_id, target_iid,
               coalesce(arg_min(x, i) FILTER (ok AND i <= 100), max(x) FILTER (i = 101)) AS negative_iid,
               count(*) FILTER (ok AND i <= 100) > 0 AS found
        FROM (SELECT t.*, x <> target_iid AND NOT coalesce(list_contains(item_seq, x), false) AS ok
              FROM tries t LEFT JOIN tseq USING (uid))
        GROUP BY 1, 2""",
}


def _negatives(spark, sf, *keep):
    n_items = v.table(spark, sf, "embeddings").count()
    return seqs.negative_samples(v.instances(spark, sf, "train"), v.train_sequences(spark, sf), n_items, keep=keep)


@query("negative_samples", sql("SELECT instance_id, target_iid, negative_iid, found FROM neg", extra=_NEG))
def negative_samples(spark, sf):
    return _negatives(spark, sf)


_PAIRS = {
    **_FIT,
    **_NEG,
    "ps": f"""
        SELECT instance_id, {_DUAL.replace('vec', 'p.vec')} AS pos_score, {_DUAL.replace('vec', 'n.vec')} AS neg_score,
               {_BEH.replace('vec', 'p.vec')} AS act_pos_score, {_BEH.replace('vec', 'n.vec')} AS act_neg_score
        FROM neg JOIN qv USING (instance_id) JOIN uv USING (instance_id)
        JOIN it p ON p.iid = target_iid JOIN it n ON n.iid = negative_iid""",
}


def _pair_scores(spark, sf):
    """Dual and attention-only scores of every training pair.

    Where ids are unique, an instance meets its user's sequence once, with its history, and what it needs
    from then on stays beside it; vectors of instances do not move. Those of a large catalog come to portions of the
    instances, for query, history and both items at once.
    """
    some, pair, asked = v.instances(spark, sf, "train"), ("target_iid", "negative_iid"), ("query_vec",)
    catalog = v.catalog(spark, sf)
    stored = tiles.store(catalog, "vec")
    large = 3 * stored.bytes > tiles.BROADCAST_BYTES and not stored.repeats()
    sampled = _negatives(spark, sf, "uid", "history_iids", "history_timestamps", "target_timestamp")
    asking, queries, named = v.asking(spark, sf, sampled, some)
    if queries is None:
        sides = {"pos_vec": "target_iid", "neg_vec": "negative_iid"} if large else {}
        if named:  # read several times
            asking = Passing(spark).store(asking, "training-pairs")
        keep = pair + asked + tuple(sides)
        context = att.attend(asking, catalog, None, "soft", key="vec", value="vec", keep=keep, named=named | sides)
        users = att.user_vectors(context, keep=keep)
        if sides:
            return ranking.training_scores(users, None, TAU_BEH, TAU_SEM)
    else:
        users = att.user_vectors(_context(spark, sf, some)).join(queries, "instance_id")
        users = users.join(_negatives(spark, sf).drop("found"), "instance_id")
    pairs = users.select(
        "instance_id", *pair, F.col("user_vec").alias("act_vec"),
        ranking.score_vector("user_vec", "query_vec", TAU_BEH, TAU_SEM).alias("vec"),
    )
    right = catalog.select("iid", ranking.score_vector("vec", "vec").alias("vec"), F.col("vec").alias("act_vec"))
    return ranking.training_scores(pairs, right)


_SCORES = ("pos_score", "neg_score", "act_pos_score", "act_neg_score")


@query("pair_scores", sql(
    "SELECT instance_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in _SCORES) + " FROM ps", extra=_PAIRS))
def pair_scores(spark, sf):
    return _pair_scores(spark, sf).select("instance_id", *[r6(c) for c in _SCORES])


@query("bpr_loss", sql("""
    SELECT n_pairs, round(j, 6) AS joint_loss, round(a, 6) AS act_loss, round(j + 0.5 * a, 6) AS loss
    FROM (SELECT count(*) AS n_pairs, avg(ln(1 + exp(neg_score - pos_score))) AS j,
                 avg(ln(1 + exp(act_neg_score - act_pos_score))) AS a FROM ps)""", extra=_PAIRS))
def bpr_loss(spark, sf):
    losses = metrics.mean_losses(_pair_scores(spark, sf), 0.5)
    return losses.select("n_pairs", r6("joint_loss"), r6("act_loss"), r6("loss"))


# --- learned inputs ---------------------------------------------------------------------------


@query("behaviour_vectors")
def behaviour_vectors(spark, sf):
    """Item factors from train visits; checked by tests."""
    train = v.processed(spark, sf).where(F.col("split") == "train").select("uid", "iid")
    items, _ = factors.behaviour_vectors(train)
    return items


@query("query_projection")
def query_projection(spark, sf):
    """Queries of all train instances projected towards their target's vector; checked by tests."""
    some = v.instances(spark, sf, "train")
    targets = v.catalog(spark, sf).select(F.col("iid").alias("target_iid"), F.col("vec").alias("target_vec"))
    pairs = some.select("instance_id", "target_iid").join(_queries(spark, sf, some), "instance_id").join(targets, "target_iid")
    pairs = v.stage(spark, sf, "projection-pairs", lambda: pairs)
    weights = learned.ridge_projection(pairs, "query_vec", "target_vec")
    return learned.project(pairs, "query_vec", weights, "projected").select("instance_id", "projected")


# --- runs -------------------------------------------------------------------------------------

_EP = "SELECT * FROM ep"
_BOTH = ("ndcg_10", "attn_ndcg_10")


@query("best_epoch", sql("""
    SELECT b.dataset, b.seed, b.epoch AS best_epoch, b.ndcg_10 AS best_metric, u.epoch AS used_epoch, u.ndcg_10 AS used_metric
    FROM (SELECT * FROM ep QUALIFY row_number() OVER (PARTITION BY dataset, seed ORDER BY ndcg_10 DESC, epoch) = 1) b
    LEFT JOIN (SELECT * FROM ep WHERE n_eval >= 3
               QUALIFY row_number() OVER (PARTITION BY dataset, seed ORDER BY ndcg_10 DESC, epoch) = 1) u
    USING (dataset, seed)""", "ep"))
def best_epoch(spark, sf):
    """Retained epochs: those with at least three events."""
    log = v.epochs(spark, sf)
    kept = log.where(F.col("n_eval") >= 3).select(*_RUN, "epoch")
    return runs.best_epochs(log, _RUN, "ndcg_10", kept)


_TOP = " UNION ALL ".join(
    f"SELECT dataset, seed, '{m}' AS metric, row_number() OVER (PARTITION BY dataset, seed ORDER BY {m} DESC, epoch) "
    f"AS place, epoch FROM ep QUALIFY place <= 3" for m in _BOTH
)


@query("top_epochs", sql(_TOP, "ep"))
def top_epochs(spark, sf):
    best = runs.top_epochs(v.epochs(spark, sf), _RUN, _BOTH)
    return best.withColumn("place", F.col("place").cast("bigint"))


@query("evicted_epochs", sql(f"""
    SELECT dataset, seed, epoch FROM ep e WHERE
        ((SELECT count(*) FROM ep b WHERE b.dataset = e.dataset AND b.seed = e.seed AND b.epoch < e.epoch
          AND b.ndcg_10 >= e.ndcg_10) < 3
         OR (SELECT count(*) FROM ep b WHERE b.dataset = e.dataset AND b.seed = e.seed AND b.epoch < e.epoch
             AND b.attn_ndcg_10 >= e.attn_ndcg_10) < 3)
    EXCEPT SELECT dataset, seed, epoch FROM ({_TOP})""", "ep"))
def evicted_epochs(spark, sf):
    return runs.evicted_epochs(v.epochs(spark, sf), _RUN, _BOTH)


@query("early_stop_epoch", sql("""
    SELECT dataset, seed, epoch AS stop_epoch, bad >= 5 AS stopped_early, best AS best_metric, bad AS epochs_without_gain
    FROM (SELECT *, step - max(CASE WHEN prev IS NULL OR ndcg_10 > prev THEN step END)
                    OVER (PARTITION BY dataset, seed ORDER BY epoch) AS bad
          FROM (SELECT *, row_number() OVER w AS step, max(ndcg_10) OVER w AS best,
                       max(ndcg_10) OVER (PARTITION BY dataset, seed ORDER BY epoch
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
                FROM ep WINDOW w AS (PARTITION BY dataset, seed ORDER BY epoch)))
    QUALIFY row_number() OVER (PARTITION BY dataset, seed
            ORDER BY bad >= 5 DESC, CASE WHEN bad >= 5 THEN step ELSE -step END) = 1""", "ep"))
def early_stop_epoch(spark, sf):
    stop = runs.early_stop(v.epochs(spark, sf), _RUN, "ndcg_10", patience=5)
    return stop.withColumn("epochs_without_gain", F.col("epochs_without_gain").cast("bigint"))


@query("seed_summary", sql("""
    SELECT dataset, count(*) AS n_seeds, """ + ", ".join(
    f"round(avg(round({m}, 6)), 6) AS {m}_mean, round(coalesce(stddev_samp(round({m}, 6)), 0), 6) AS {m}_std"
    for m in ("hr_10", "ndcg_10", "mrr")) + """,
           min(n_eval) = max(n_eval) AS n_eval_agrees, min(n_eval) = max(n_eval) AND min(n_eval) = 4 AS n_eval_expected,
           string_agg(seed, ',' ORDER BY seed) AS seeds, string_agg(epoch, ',' ORDER BY seed) AS best_epochs
    FROM (SELECT * FROM ep QUALIFY row_number() OVER (PARTITION BY dataset, seed ORDER BY ndcg_10 DESC, epoch) = 1)
    GROUP BY dataset""", "ep"))
def seed_summary(spark, sf):
    """Each run is represented by its best epoch."""
    log = v.epochs(spark, sf)
    best = runs.best_epochs(log, _RUN, "ndcg_10").select(*_RUN, F.col("best_epoch").alias("epoch"))
    results = log.join(best, [*_RUN, "epoch"], "left_semi")
    found = runs.seed_summary(results, "dataset", "seed", ("hr_10", "ndcg_10", "mrr"), expected_n=4, epoch="epoch")
    return found.withColumns({c: v.joined(c) for c in ("seeds", "best_epochs")})
