"""Scans, cleaning, deduplication, cores, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from footfall.functions import text as tx
from footfall.operators import cores, enrich
from footfall.operators import reviews as rev
from footfall.plans.scratch import new_path
from footfall.sources import tables
from footfall.streaming import incremental as inc
from registry import views as v
from registry.base import query
from registry.views import sql

# --- scans ------------------------------------------------------------------------------------


@query("scan_project", """
    SELECT event_id, user_id, event_type, value FROM events
    WHERE event_id IS NOT NULL AND user_id IS NOT NULL""")
def scan_project(spark, sf):
    return tables.scan_required(
        v.table(spark, sf, "events"), ["event_id", "user_id", "event_type", "value"], ["event_id", "user_id"]
    )


@query("scan_defaults", """
    SELECT doc_id::VARCHAR AS user_id, source AS parent_asin, 0::BIGINT AS "timestamp", 0.0::DOUBLE AS rating,
           '' AS title, text, 0::INTEGER AS helpful_vote FROM documents""")
def scan_defaults(spark, sf):
    source = v.table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("user_id"), F.col("source").alias("parent_asin"), "text"
    )
    return tables.scan_with_defaults(
        source, ["user_id", "parent_asin", "timestamp", "rating", "title", "text", "helpful_vote"]
    )


@query("semi_join_users", sql("""
    SELECT review_id, user_id, item_id, "timestamp", substr(title, 1, 200) AS title, substr(text, 1, 800) AS text
    FROM rv WHERE user_id IN (SELECT user_id FROM rv GROUP BY 1 HAVING max(helpful_vote) = 12 AND avg(rating) >= 3)
    """, "rv"))
def semi_join_users(spark, sf):
    """Reviews of a user list (active, satisfied users) with bounded text columns."""
    reviews = v.reviews(spark, sf)
    users = reviews.groupBy("user_id").agg(F.max("helpful_vote").alias("h"), F.avg("rating").alias("r"))
    users = users.where((F.col("h") == 12) & (F.col("r") >= 3))
    rows = cores.rows_of(reviews, users)
    return rows.select(
        "review_id", "user_id", "item_id", "timestamp",
        tx.truncate(F.col("title"), tx.QUERY_TITLE_CHARS).alias("title"),
        tx.truncate(F.col("text"), tx.QUERY_TEXT_CHARS).alias("text"),
    )


@query("item_meta_semi", """
    SELECT p_partkey, p_name, p_brand, p_type FROM part
    WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')""")
def item_meta_semi(spark, sf):
    """Metadata of the catalog items only: parts that were ever returned."""
    returned = v.table(spark, sf, "lineitem").where(F.col("l_returnflag") == "R")
    part = v.table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return enrich.catalog_metadata(part, returned.select(F.col("l_partkey").alias("p_partkey")), "p_partkey")


@query("flatten_nested", """
    SELECT p_partkey, p_retailprice,
           substr('["' || p_brand || '","' || p_type || '"]', 1, 800) AS features,
           substr('{"name":"' || p_name || '","size":' || p_size || '}', 1, 800) AS details FROM part""")
def flatten_nested(spark, sf):
    nested = v.table(spark, sf, "part").select(
        "p_partkey", "p_retailprice",
        F.array("p_brand", "p_type").alias("features"),
        F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("size")).alias("details"),
    )
    return tables.flatten_nested(nested)


@query("json_scan_roundtrip", "SELECT conv_id, turn, role, text FROM conversations")
def json_scan_roundtrip(spark, sf):
    source = v.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    path = new_path(spark, "json")
    tables.write_json_lines(source, path)
    return tables.read_json_lines(spark, path, source.schema)


# --- cleaning ---------------------------------------------------------------------------------


@query("normalize_columns", sql(f"""
    SELECT user_id::VARCHAR AS user_id, item_id::VARCHAR AS item_id, "timestamp", raw AS query, role AS review_title,
           text AS review_text, false AS is_c4_user
    FROM tn WHERE length({v.sql_strip('raw')}) > 0""", "tn"))
def normalize_columns(spark, sf):
    raw = v.turns(spark, sf).select(
        "user_id", F.col("item_id").alias("parent_asin"), "timestamp", F.col("raw").alias("query"),
        F.col("role").alias("title"), "text",
    )
    return rev.normalise_columns(raw)


@query("review_hash", sql("SELECT review_id, review_hash FROM rv", "rv"))
def review_hash(spark, sf):
    return rev.with_review_hash(v.reviews(spark, sf)).select("review_id", "review_hash")


@query("quality_filter_rate", sql("""
    SELECT count(*) AS n_rows, sum((rating >= 5 AND length(text) >= 100)::INT)::BIGINT AS n_pass,
           avg((rating >= 5 AND length(text) >= 100)::INT) AS pass_rate FROM rv""", "rv"))
def quality_filter_rate(spark, sf):
    return rev.quality_rate(v.reviews(spark, sf), rev.quality())


@query("key_integrity", sql("""
    SELECT count(*) AS n_rows, sum((user_id IS NULL)::INT)::BIGINT AS null_user_id,
           sum((item_id IS NULL)::INT)::BIGINT AS null_item_id, sum(("timestamp" IS NULL)::INT)::BIGINT AS null_timestamp,
           min("timestamp") AS min_time, max("timestamp") AS max_time FROM ev""", "ev"))
def key_integrity(spark, sf):
    return rev.key_integrity(v.visits(spark, sf))


@query("shape_stats", sql("""
    SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items FROM fine
    """, "fine"))
def shape_stats(spark, sf):
    return rev.shape(v.visits(spark, sf, fine=True))


@query("interaction_stats", sql("""
    SELECT n_items, n_inter, item_inter_mean, item_inter_median, item_single_pct, n_users, user_inter_mean,
           user_inter_median
    FROM (SELECT count(*) AS n_items, sum(c)::BIGINT AS n_inter, avg(c) AS item_inter_mean,
                 median(c)::DOUBLE AS item_inter_median, avg((c = 1)::INT) * 100 AS item_single_pct
          FROM (SELECT count(*) AS c FROM fine GROUP BY item_id)),
         (SELECT count(*) AS n_users, avg(c) AS user_inter_mean, median(c)::DOUBLE AS user_inter_median
          FROM (SELECT count(*) AS c FROM fine GROUP BY user_id))""", "fine"))
def interaction_stats(spark, sf):
    return rev.interaction_stats(v.visits(spark, sf, fine=True))


@query("limit_items", sql("SELECT item_id, iid FROM rid WHERE iid <= 10", "rid"))
def limit_items(spark, sf):
    """The first items by id order; the limit is the operator's parameter."""
    return rev.limit_to_first_items(v.item_ids(spark, sf), 10)


# --- deduplication ----------------------------------------------------------------------------


@query("dedup_user_item", sql('SELECT event_id, user_id, item_id, "timestamp" FROM dd', "dd"))
def dedup_user_item(spark, sf):
    return v.visits_dedup(spark, sf).select("event_id", "user_id", "item_id", "timestamp")


@query("dedup_protected", sql("""
    SELECT e.event_id, e.user_id, e.item_id, e."timestamp"
    FROM ev e LEFT JOIN (SELECT DISTINCT user_id, item_id, max("timestamp") AS "timestamp" FROM ev GROUP BY 1, 2) t
    USING (user_id, item_id, "timestamp")
    QUALIFY row_number() OVER (PARTITION BY e.user_id, e.item_id
            ORDER BY (t.user_id IS NULL)::INT, e."timestamp", e.event_id) = 1""", "ev"))
def dedup_protected(spark, sf):
    """Each user's last visit of an item is its target, so it must beat the earlier ones."""
    kept = rev.dedup_user_item_protected(v.visits(spark, sf), _late_targets(spark, sf), ["timestamp", "event_id"])
    return kept.select("event_id", "user_id", "item_id", "timestamp")


def _late_targets(spark, sf):
    return v.visits(spark, sf).groupBy("user_id", "item_id").agg(F.max("timestamp").alias("timestamp"))


@query("dedup_protected_counts", sql("""
    SELECT count(*) AS n_before, count(*) FILTER (last) AS n_protected_before,
           count(DISTINCT (user_id, item_id)) AS n_after, count(DISTINCT (user_id, item_id)) AS n_protected_after
    FROM (SELECT *, "timestamp" = max("timestamp") OVER (PARTITION BY user_id, item_id) AS last FROM ev)""", "ev"))
def dedup_protected_counts(spark, sf):
    log, targets = v.visits(spark, sf), _late_targets(spark, sf)
    kept = rev.dedup_user_item_protected(log, targets, ["timestamp", "event_id"])
    return rev.protected_counts(log, kept, targets)


@query("dedup_content", sql("""
    SELECT review_id, user_id, title AS item_id, "timestamp" FROM rv
    QUALIFY row_number() OVER (PARTITION BY title, "timestamp", review_hash ORDER BY user_id, review_id) = 1""", "rv"))
def dedup_content(spark, sf):
    """Language as the item: exact copies share it, and with it rating and time."""
    reviews = v.reviews(spark, sf).withColumn("item_id", F.col("title"))
    kept = rev.dedup_content(reviews, "item_id", ["user_id", "review_id"])
    return kept.select("review_id", "user_id", "item_id", "timestamp")


@query("content_conflicts", sql("""
    SELECT coalesce(sum(n), 0)::BIGINT AS n_dup_rows, count(*) AS n_dup_groups,
           sum((u > 1)::INT)::BIGINT AS n_cross_user_groups, sum((u > 1 AND r > 1)::INT)::BIGINT AS n_conflict_groups
    FROM (SELECT count(*) AS n, count(DISTINCT user_id) AS u,
                 count(DISTINCT helpful_vote) + max((helpful_vote IS NULL)::INT) AS r
          FROM (SELECT * REPLACE (nullif(helpful_vote, 0) AS helpful_vote) FROM rv)
          GROUP BY title, "timestamp", review_hash HAVING count(*) > 1)""", "rv"))
def content_conflicts(spark, sf):
    """Votes in the place of ratings, with 0 as missing, so that conflicts occur."""
    votes = F.nullif(F.col("helpful_vote"), F.lit(0))
    hashed = rev.with_review_hash(v.reviews(spark, sf)).withColumn("rating", votes)
    return rev.content_conflicts(hashed, "title")


# --- cores and sampling -----------------------------------------------------------------------

_CORE = v.sql_core("pr", 20, 20, "c")
_POOL = {
    **_CORE,
    "good": "SELECT * FROM pr WHERE quantity >= 25",
    **v.sql_core("good", 8, 8, "g"),
}
_PICK = {
    **_POOL,
    "pick": """
        SELECT user_id FROM (SELECT DISTINCT user_id FROM c12)
        ORDER BY (user_id NOT IN (SELECT user_id FROM g12))::INT, md5('42:' || user_id), user_id LIMIT (SELECT count(*) // 2 FROM customer)""",
    "picked": "SELECT * FROM pr WHERE user_id IN (SELECT user_id FROM pick)",
    **v.sql_core("picked", 20, 8, "r"),
}


def _core(spark, sf):
    return cores.kcore(v.purchase_log(spark, sf), 20, 20)


@query("kcore", sql('SELECT user_id, item_id, "timestamp" FROM c12', extra=_CORE))
def kcore(spark, sf):
    log = v.purchase_log(spark, sf)
    return cores.kcore(log, 20, 20).restrict(log).select("user_id", "item_id", "timestamp")


@query("kcore_rounds", sql("""
    SELECT 1 + """ + " + ".join(
    f"(SELECT (count(*) > (SELECT count(*) FROM c{i + 1}))::INT FROM c{i})" for i in range(12)
) + """ AS n_rounds, (SELECT count(*) FROM c12) AS n_rows, (SELECT count(DISTINCT user_id) FROM c12) AS n_users,
    (SELECT count(DISTINCT item_id) FROM c12) AS n_items""", extra=_CORE))
def kcore_rounds(spark, sf):
    core = _core(spark, sf)
    return rev.shape(core.pairs).select(F.lit(core.rounds).alias("n_rounds"), "n_rows", "n_users", "n_items")


@query("sample_users", sql("""
    SELECT user_id FROM (SELECT DISTINCT user_id FROM pr) ORDER BY md5('42:' || user_id), user_id LIMIT 500""", "pr"))
def sample_users(spark, sf):
    return cores.sample_users(v.purchases(spark, sf).select("user_id").distinct(), 500)


@query("sampled_user_rows", sql("""
    SELECT user_id, item_id, "timestamp" FROM pr WHERE user_id IN (
        SELECT user_id FROM (SELECT DISTINCT user_id FROM pr) ORDER BY md5('7:' || user_id), user_id LIMIT 300)
    """, "pr"))
def sampled_user_rows(spark, sf):
    log = v.purchases(spark, sf)
    users = cores.sample_users(log.select("user_id").distinct(), 300, seed=7)
    return cores.rows_of(log, users).select("user_id", "item_id", "timestamp")


@query("exclude_users", sql("""
    SELECT user_id FROM (SELECT user_id FROM (SELECT DISTINCT user_id FROM pr)
                         ORDER BY md5('42:' || user_id), user_id LIMIT 500)
    WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""", "pr"))
def exclude_users(spark, sf):
    """Sampled users without those already processed: a market segment."""
    users = cores.sample_users(v.purchases(spark, sf).select("user_id").distinct(), 500)
    listed = v.table(spark, sf, "customer").where(F.col("c_mktsegment") == "BUILDING")
    return cores.without(users, listed.select(F.col("c_custkey").alias("user_id")))


@query("priority_users", sql(
    "SELECT DISTINCT user_id FROM q8",
    extra={"hq": "SELECT user_id, item_id FROM rv WHERE rating >= 4 AND length(text) >= 100",
           **v.sql_core("hq", 5, 5, "q", 8)}))
def priority_users(spark, sf):
    return cores.priority_users(v.reviews(spark, sf), rev.quality(4.0, 100), 5, 5)


def _picked(spark, sf):
    log = v.purchase_log(spark, sf)
    good = cores.priority_users(log, F.col("quantity") >= 25, 8, 8)
    half = v.table(spark, sf, "customer").count() // 2
    return cores.sample_users_priority_first(_core(spark, sf).users(), good, half)


@query("priority_sample", sql("SELECT user_id FROM pick", extra=_PICK))
def priority_sample(spark, sf):
    return _picked(spark, sf)


@query("resampled_kcore", sql('SELECT user_id, item_id, "timestamp" FROM r12', extra=_PICK))
def resampled_kcore(spark, sf):
    log = v.purchase_log(spark, sf).select("user_id", "item_id", "timestamp")
    rows, _ = cores.resampled_core(log, v.stage(spark, sf, "picked", lambda: _picked(spark, sf)), 20, 8)
    return rows.select("user_id", "item_id", "timestamp")


@query("surviving_rows", sql("""
    SELECT user_id, item_id, "timestamp", arg_min(p.quantity, row_id) AS quantity
    FROM (SELECT o_custkey AS user_id, l_partkey AS item_id, epoch_us(o_orderdate) // 1000 AS "timestamp",
                 l_quantity AS quantity, struct_pack(o := l_orderkey, l := l_linenumber, q := l_quantity) AS row_id
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey) p
    JOIN c12 USING (user_id, item_id, "timestamp") GROUP BY user_id, item_id, "timestamp" """, extra=_CORE))
def surviving_rows(spark, sf):
    """Light pass on the keys, then the wide rows of the surviving keys, the first of each key."""
    keys = ("user_id", "item_id", "timestamp")
    log = v.purchase_log(spark, sf)
    light = cores.kcore(log, 20, 20).restrict(log)
    return cores.surviving_rows(v.purchase_rows(spark, sf), light, keys).select(*keys, "quantity")


# --- resumable runs ---------------------------------------------------------------------------

_KEYS = ("user_id", "item_id", "timestamp")


@query("todo_anti_join", sql("""
    SELECT user_id, item_id, "timestamp", role FROM tn WHERE role <> 'assistant' AND item_id <> 0""", "tn"))
def todo_anti_join(spark, sf):
    """Done: assistant turns in the output, first turns in a shard."""
    turns = v.turns(spark, sf)
    done = inc.done_keys([turns.where(F.col("role") == "assistant"), turns.where(F.col("item_id") == 0)], _KEYS)
    return inc.todo(turns, done, _KEYS).select(*_KEYS, "role")


@query("merge_latest", sql("""
    SELECT user_id, item_id, "timestamp", CASE role WHEN 'user' THEN raw ELSE text END AS query,
           role = 'user' AS is_fallback FROM tn""", "tn"))
def merge_latest(spark, sf):
    """A first version of all turns, then a newer shard with the user turns."""
    turns = v.turns(spark, sf)
    old = turns.select(*_KEYS, F.col("text").alias("query"), F.lit(False).alias("is_fallback"))
    new = turns.where(F.col("role") == "user").select(*_KEYS, F.col("raw").alias("query"), F.lit(True).alias("is_fallback"))
    return inc.merge_latest([old, new], _KEYS, [*_KEYS, "query", "is_fallback"])
