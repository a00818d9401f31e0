"""Splits, sequences, populations."""

from __future__ import annotations

from pyspark.sql import functions as F

from footfall.operators import population, sequences as seqs, splits
from footfall.plans.positions import dense_ids as number
from registry import views as v
from registry.base import query
from registry.views import joined, sql


@query("leave_last_out", sql('SELECT event_id, user_id, item_id, "timestamp", split FROM llo', "llo"))
def leave_last_out(spark, sf):
    return v.visits_assigned(spark, sf).select("event_id", "user_id", "item_id", "timestamp", "split")


@query("drop_unseen_targets", sql("""
    SELECT event_id, user_id, split FROM fllo WHERE split = 'train' OR user_id NOT IN (
        SELECT user_id FROM fllo WHERE split <> 'train'
        AND item_id NOT IN (SELECT item_id FROM fllo WHERE split = 'train'))""", "fllo"))
def drop_unseen_targets(spark, sf):
    kept = splits.drop_unseen_targets(v.visits_assigned(spark, sf, fine=True))
    return kept.select("event_id", "user_id", "split")


@query("unseen_target_rate", sql("""
    SELECT split, count(*) AS n_users, sum(u)::BIGINT AS n_unseen, avg(u) AS rate
    FROM (SELECT split, (item_id NOT IN (SELECT item_id FROM fllo WHERE split = 'train'))::INT AS u
          FROM fllo WHERE split <> 'train') GROUP BY split""", "fllo"))
def unseen_target_rate(spark, sf):
    return splits.unseen_target_rate(v.visits_assigned(spark, sf, fine=True))


@query("split_manifest", sql("""
    SELECT split, user_id, item_id, "timestamp", review_hash, array_to_string(history, ',') AS history FROM fman
    """, "fman"))
def split_manifest(spark, sf):
    return v.visits_manifest(spark, sf, fine=True).withColumn("history", F.array_join("history", ","))


@query("split_keys_union", sql('SELECT DISTINCT user_id, item_id, "timestamp", split FROM fman', "fman"))
def split_keys_union(spark, sf):
    return splits.split_keys(v.visits_manifest(spark, sf, fine=True))


@query("split_assign", sql("""
    SELECT d.event_id, d.user_id, d.item_id, coalesce(m.split, 'train') AS split
    FROM fdd d LEFT JOIN fman m USING (user_id, item_id, "timestamp")""", "fdd", "fman"))
def split_assign(spark, sf):
    assigned = splits.assign_split(v.visits_dedup(spark, sf, fine=True), v.visits_manifest(spark, sf, fine=True))
    return assigned.select("event_id", "user_id", "item_id", "split")


@query("split_audit", sql("""
    SELECT m.split, count(*) AS n_manifest, count(d.event_id) AS n_matched, count(*) = count(d.event_id) AS complete
    FROM (SELECT user_id, item_id, "timestamp", split FROM fman
          UNION ALL SELECT user_id, item_id, "timestamp" + 1, split FROM fman WHERE split = 'valid') m
    LEFT JOIN fdd d USING (user_id, item_id, "timestamp") GROUP BY m.split""", "fdd", "fman"))
def split_audit(spark, sf):
    """The whole log, and a manifest with planted keys that the log does not have."""
    log = v.visits_dedup(spark, sf, fine=True)
    manifest = v.visits_manifest(spark, sf, fine=True)
    planted = manifest.where(F.col("split") == "valid").withColumn("timestamp", F.col("timestamp") + 1)
    manifest = manifest.unionByName(planted)
    return splits.split_audit(splits.assign_split(log, manifest), manifest)


@query("dense_ids", sql("""
    SELECT item_id, row_number() OVER (ORDER BY item_id) AS iid FROM (SELECT DISTINCT item_id FROM fine)""", "fine"))
def dense_ids(spark, sf):
    return number(v.visits(spark, sf, fine=True), "item_id", "iid")


@query("seq_positions", sql("SELECT event_id, user_id, item_id, split, uid, seq_len, pos FROM proc", "proc"))
def seq_positions(spark, sf):
    placed = splits.prepare_log(v.visits_dedup(spark, sf), v.visits_manifest(spark, sf), {"user_id": "uid"})
    return placed.select("event_id", "user_id", "item_id", "split", "uid", "seq_len", "pos")


@query("split_counts", sql("""
    SELECT split, count(*) AS n_rows, count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items
    FROM proc GROUP BY split""", "proc"))
def split_counts(spark, sf):
    return splits.split_counts(v.processed(spark, sf))


@query("train_sequences", sql("""
    SELECT uid, user_id, array_to_string(item_seq, ',') AS item_seq, array_to_string(raw_item_seq, ',') AS raw_item_seq,
           array_to_string(time_seq, ',') AS time_seq FROM tseq""", "tseq"))
def train_sequences(spark, sf):
    return v.train_sequences(spark, sf).select(
        "uid", "user_id", joined("item_seq"), joined("raw_item_seq"), joined("time_seq")
    )


@query("seen_items", sql("SELECT DISTINCT uid, unnest(item_seq) AS iid FROM tseq", "tseq"))
def seen_items(spark, sf):
    return seqs.seen_items(v.train_sequences(spark, sf))


@query("item_popularity", sql("SELECT iid, count(*) AS n_inter FROM dd GROUP BY iid", "dd"))
def item_popularity(spark, sf):
    return seqs.item_popularity(v.visits_dedup(spark, sf))


@query("query_instances", sql("""
    SELECT instance_id, uid, user_id, target_iid, target_item_id, target_timestamp, query, split, is_c4_user,
           array_to_string(history_iids, ',') AS history_iids, array_to_string(history_item_ids, ',') AS history_item_ids,
           array_to_string(history_timestamps, ',') AS history_timestamps FROM inst""", "inst"))
def query_instances(spark, sf):
    log = v.processed(spark, sf).withColumnRenamed("event_id", "instance_id")
    return seqs.query_instances(log).select(
        "instance_id", "uid", "user_id", "target_iid", "target_item_id", "target_timestamp", "query", "split",
        "is_c4_user", joined("history_iids"), joined("history_item_ids"), joined("history_timestamps"),
    )


@query("instance_filter", sql("""
    SELECT instance_id, uid, split FROM inst WHERE len(history_iids) > 0 AND query <> 'error'""", "inst"))
def instance_filter(spark, sf):
    """Failed visits carry no query."""
    every = v.instances(spark, sf, "train", "valid", "test")
    blanked = every.withColumn("query", F.when(F.col("query") != "error", F.col("query")).otherwise(F.lit("")))
    return seqs.usable_instances(blanked).select("instance_id", "uid", "split")


@query("history_deltas", sql("""
    SELECT instance_id, h.position, h.iid, greatest(0, (target_timestamp - h.ts) / 86400000.0) AS delta_days
    FROM (SELECT instance_id, target_timestamp, unnest(list_zip(range(len(history_iids)), history_iids,
          history_timestamps)) AS z FROM inst),
         LATERAL (SELECT z[1]::INT AS position, z[2] AS iid, z[3] AS ts) h""", "inst"))
def history_deltas(spark, sf):
    rows = seqs.history_rows(v.instances(spark, sf, "train", "valid", "test"))
    return rows.select("instance_id", "position", "iid", "delta_days")


@query("pad_left", sql("""
    SELECT instance_id, repeat('0,', greatest(0, 50 - len(history_iids))::INT) ||
           array_to_string(list_slice(history_iids, greatest(len(history_iids) - 49, 1), len(history_iids)), ',') AS padded_iids FROM inst""", "inst"))
def pad_left(spark, sf):
    padded = seqs.with_padded_history(v.instances(spark, sf, "train", "valid", "test"), 50)
    return padded.select("instance_id", joined("padded_iids"))


@query("split_verify", sql("""
    SELECT count(*) FILTER (f.split = 'valid' AND coalesce(m.mv, 0) = 0) AS valid_not_in_manifest,
           count(*) FILTER (f.split = 'valid' AND coalesce(m.mt, 0) = 1) AS valid_in_other_split,
           count(*) FILTER (f.split = 'test' AND coalesce(m.mt, 0) = 0) AS test_not_in_manifest,
           count(*) FILTER (f.split = 'test' AND coalesce(m.mv, 0) = 1) AS test_in_other_split
    FROM (SELECT DISTINCT user_id, item_id, "timestamp",
                 CASE WHEN is_c4_user THEN split WHEN split = 'test' THEN 'valid' ELSE 'test' END AS split
          FROM (SELECT user_id, target_item_id AS item_id, target_timestamp AS "timestamp", split, is_c4_user
                FROM eval)) f
    LEFT JOIN (SELECT user_id, item_id, "timestamp", max((split = 'valid')::INT) AS mv,
                      max((split = 'test')::INT) AS mt FROM man GROUP BY 1, 2, 3) m
    USING (user_id, item_id, "timestamp")""", "eval", "man"))
def split_verify(spark, sf):
    """The split of cheap visits is swapped on purpose, so that the counts are not 0."""
    swapped = F.when(F.col("is_c4_user"), F.col("split")).when(F.col("split") == "test", "valid").otherwise("test")
    mixed = v.instances(spark, sf).withColumn("split", swapped)
    return splits.verify_split(mixed, v.visits_manifest(spark, sf))


# --- populations ------------------------------------------------------------------------------

_LINE = "concat_ws(chr(9), user_id, target_item_id, target_timestamp, array_to_string(history_item_ids, ','))"
_WORDS = " || '-' || ".join(
    f"coalesce(sum(('0x' || substr(h, {1 + 7 * i}, 7))::BIGINT), 0)::BIGINT::VARCHAR" for i in range(9)
)
_DIGEST = f"SELECT count(*) AS n_lines, sha256(count(*)::VARCHAR || '-' || {_WORDS}) AS digest FROM (SELECT sha256(line) AS h FROM lines)"
_LINES = {"lines": f"SELECT {_LINE} AS line FROM inst WHERE split = 'test'"}
_LEAK = """
    SELECT DISTINCT uid FROM proc WHERE uid IN (SELECT uid FROM proc GROUP BY uid HAVING max(value) >= 250)"""


def _leaked(spark, sf):
    """The exclusion list: users with an outlier among their visits."""
    log = v.processed(spark, sf)
    return log.groupBy("uid").agg(F.max("value").alias("m")).where(F.col("m") >= 250).select("uid")


@query("population_fingerprint", sql(_DIGEST, extra=_LINES))
def population_fingerprint(spark, sf):
    return population.population_digest(v.instances(spark, sf, "test"))


@query("population_check", sql(f"""
    SELECT n.n_users AS expected_n, d.n_lines AS obtained_n, d.digest AS obtained_digest,
           CASE WHEN n.n_users = d.n_lines THEN 'PASS' ELSE 'FAIL' END AS status
    FROM ({_DIGEST}) d, (SELECT count(DISTINCT uid) AS n_users FROM proc) n""",
    "proc", extra={"lines": f"SELECT {_LINE} AS line FROM inst WHERE split = 'test' AND uid NOT IN ({_LEAK})"}))
def population_check(spark, sf):
    """Expected: every user is evaluated; after the leak-drop they are not."""
    expected = v.processed(spark, sf).select("uid").distinct().count()
    kept = population.drop_listed(v.instances(spark, sf, "test"), _leaked(spark, sf))
    checked = population.check_population(kept, expected_n=expected)
    return checked.select("expected_n", "obtained_n", "obtained_digest", "status")


def _tree_sql(lines):
    """The nodes of the digest tree of ``lines``."""
    fold = "string_agg(bucket || ':' || digest, ',' ORDER BY bucket)"
    levels = [f"""t4 AS (SELECT 4 AS level, substr(h, 1, 4) AS bucket, count(*) AS n_lines, sha256(count(*)::VARCHAR || '-' || {_WORDS}) AS digest
        FROM (SELECT sha256(line) AS h FROM {lines}) GROUP BY ALL)"""]
    for up in (3, 2, 1, 0):
        levels.append(f"""t{up} AS (SELECT {up} AS level, substr(bucket, 1, {up}) AS bucket, sum(n_lines)::BIGINT AS n_lines,
            sha256({fold}) AS digest FROM t{up + 1} GROUP BY 2)""")
    return "WITH " + ", ".join(levels) + " " + " UNION ALL ".join(f"SELECT * FROM t{i}" for i in range(5))


@query("population_tree", sql(f"SELECT * FROM ({_tree_sql('lines')})", extra=_LINES))
def population_tree(spark, sf):
    return population.population_tree(v.instances(spark, sf, "test"))


_TWO = {"all_lines": f"SELECT {_LINE} AS line FROM inst WHERE split = 'test'",
        "kept_lines": f"SELECT {_LINE} AS line FROM inst WHERE split = 'test' AND uid NOT IN ({_LEAK})"}


@query("population_tree_check", sql(f"""
    SELECT CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END AS status, (SELECT count(*) FROM kept_lines) AS obtained_n,
           (SELECT count(*) FROM all_lines) AS expected_n, coalesce(string_agg(bucket, ',' ORDER BY bucket), '') AS differing
    FROM (SELECT bucket FROM ({_tree_sql("kept_lines")}) k FULL JOIN ({_tree_sql("all_lines")}) a USING (level, bucket)
          WHERE level = 4 AND k.digest IS DISTINCT FROM a.digest)""", "proc", extra=_TWO))
def population_tree_check(spark, sf):
    """The population after the leak-drop against the one before."""
    every = v.instances(spark, sf, "test")
    kept = population.drop_listed(every, _leaked(spark, sf))
    found = population.compare_trees(population.population_tree(kept), population.population_tree(every))
    return found.withColumn("differing", F.array_join("differing", ","))


@query("population_difference", sql("""
    SELECT line, count(*) FILTER (side = 0) AS left_n, count(*) FILTER (side = 1) AS right_n
    FROM (SELECT line, 0 AS side FROM kept_lines UNION ALL SELECT line, 1 FROM all_lines)
    GROUP BY line HAVING left_n <> right_n""", "proc", extra=_TWO))
def population_difference(spark, sf):
    every = v.instances(spark, sf, "test")
    return population.differing_instances(population.drop_listed(every, _leaked(spark, sf)), every)


@query("leak_drop", sql(f"SELECT instance_id, uid, split FROM eval WHERE uid NOT IN ({_LEAK})", "eval", "proc"))
def leak_drop(spark, sf):
    kept = population.drop_listed(v.instances(spark, sf), _leaked(spark, sf))
    return kept.select("instance_id", "uid", "split")


@query("user_set_tag", sql(f"SELECT substr(digest, 1, 8) AS tag FROM ({_DIGEST})",
                          "ev", extra={"lines": "SELECT DISTINCT user_id AS line FROM ev"}))
def user_set_tag(spark, sf):
    return population.user_set_tag(v.visits(spark, sf))


