"""Review pools, leakage, texts, prompts, generation."""

from __future__ import annotations

from pyspark.sql import functions as F

from footfall.functions import text as tx
from footfall.operators import enrich, learned, pools
from registry import views as v
from registry.base import query
from registry.views import sql, sql_norm, sql_strip

_CAP = pools.POOL_CAP
CARD_TEMPLATE = "Describe the item in a short card.\n\n[METADATA]\n{meta}\n\n[REVIEWS]\n{reviews}"
QUERY_TEMPLATE = "Rephrase the review as a request.\n\n[REVIEW]\n{review}"
INSTRUCTION = "Represent this document for retrieval."
FALLBACK = tx.general_request(v.DOMAIN)


# --- pools and leakage ------------------------------------------------------------------------


def _keys(spark, sf):
    return pools.leak_keys(v.reviews_assigned(spark, sf))


def _flagged(spark, sf):
    """Narrow reviews with content hash and held-out flag."""

    def build():
        narrow = tx_hashed(spark, sf).drop("text")
        return pools.flag_held_out(narrow, _keys(spark, sf))

    return v.stage(spark, sf, "reviews-flagged", build)


def tx_hashed(spark, sf):
    body = tx.review_hash(F.col("title"), F.col("text"))
    return v.reviews(spark, sf).withColumn("review_hash", body)


def _pool(spark, sf):
    return pools.review_pool(_flagged(spark, sf).where(~F.col("held_out")), "review_id", _CAP)


@query("leak_keys_from_split", sql("""
    SELECT DISTINCT item_id, user_id, "timestamp", review_hash FROM held""", "held"))
def leak_keys_from_split(spark, sf):
    return _keys(spark, sf)


@query("leak_excluded_reviews", sql("SELECT review_id, item_id, user_id, held_out FROM flagged", "flagged"))
def leak_excluded_reviews(spark, sf):
    flagged = pools.flag_held_out(tx_hashed(spark, sf).drop("text"), _keys(spark, sf))
    return flagged.select("review_id", "item_id", "user_id", "held_out")


@query("review_pool_topk", sql("SELECT item_id, review_id, helpful_vote, pool_rank FROM pool", "pool"))
def review_pool_topk(spark, sf):
    return _pool(spark, sf).select("item_id", "review_id", "helpful_vote", F.col("pool_rank").cast("bigint"))


@query("select_reviews", sql("SELECT item_id, review_id, pool_rank FROM sel", "sel"))
def select_reviews(spark, sf):
    picked = pools.select_reviews(_pool(spark, sf))
    return picked.select("item_id", "review_id", F.col("pool_rank").cast("bigint"))


@query("leak_assert", sql("""
    SELECT (SELECT count(*) FROM (SELECT DISTINCT item_id, review_hash FROM held)) AS n_eval_ids,
           (SELECT count(*) FROM (SELECT DISTINCT item_id, review_hash FROM sel)) AS n_card_ids,
           (SELECT count(*) FROM (SELECT DISTINCT item_id, review_hash FROM held
                                  INTERSECT SELECT DISTINCT item_id, review_hash FROM sel)) AS n_leaked""",
    "held", "sel"))
def leak_assert(spark, sf):
    return pools.leak_check(pools.select_reviews(_pool(spark, sf)), _keys(spark, sf))


@query("card_stats", sql("""
    SELECT count(*) AS n_items, count(*) FILTER (coalesce(p.n, 0) = 0) AS n_items_no_review,
           count(*) FILTER (coalesce(p.n, 0) >= 2000) AS n_items_pool_capped, count(s.taken) AS n_items_with_held_out,
           avg(s.taken) AS held_out_selected_rate
    FROM (SELECT DISTINCT item_id FROM meta) i
    LEFT JOIN (SELECT item_id, count(*) AS n FROM pool GROUP BY 1) p USING (item_id)
    LEFT JOIN (
        SELECT item_id, max((late = 1 AND (r < 4 OR ((r - 4) % greatest(1, (c - 4) // 4) = 0
                             AND (r - 4) // greatest(1, (c - 4) // 4) < 4)))::INT) AS taken
        FROM (SELECT item_id, late, count(*) OVER (PARTITION BY item_id) AS c,
                     row_number() OVER (PARTITION BY item_id
                         ORDER BY helpful_vote DESC, late, "timestamp" DESC, review_id) - 1 AS r
              FROM (SELECT item_id, helpful_vote, "timestamp", review_id, 0 AS late FROM pool
                    UNION ALL SELECT item_id, helpful_vote, "timestamp", review_id, 1 FROM flagged WHERE held_out))
        GROUP BY item_id HAVING max(late) = 1) s USING (item_id)""", "meta", "pool", "flagged"))
def card_stats(spark, sf):
    held_out = _flagged(spark, sf).where("held_out")
    return pools.card_stats(v.meta(spark, sf), _pool(spark, sf), held_out, "review_id", cap=_CAP)


def _first_reviews(spark, sf):
    splits = v.reviews_assigned(spark, sf).select("review_id", "split")
    rows = v.reviews(spark, sf).join(splits, "review_id").join(v.item_ids(spark, sf), "item_id")
    named = rows.withColumnsRenamed({"title": "review_title", "text": "review_text"}).withColumn("query", F.col("review_title"))
    return pools.first_reviews(named, "review_id")


@query("item_review_pool", sql("""
    SELECT iid, item_id, array_to_string(titles, ',') AS review_titles, len(texts) AS n_reviews,
           sha256(array_to_string(texts, chr(10))) AS review_texts FROM rpool""", "rpool"))
def item_review_pool(spark, sf):
    """Whole texts are compared by hash."""
    return _first_reviews(spark, sf).select(
        "iid", "item_id", F.array_join("review_titles", ",").alias("review_titles"),
        F.size("review_texts").cast("bigint").alias("n_reviews"),
        F.sha2(F.array_join("review_texts", "\n"), 256).alias("review_texts"),
    )


# --- text functions ---------------------------------------------------------------------------


@query("safe_text", f"""
    SELECT conv_id, turn, {sql_strip("replace(replace(text, chr(10), ' '), chr(13), ' ')")} AS single_line,
           {sql_strip("text")} AS stripped FROM conversations""")
def safe_text(spark, sf):
    text = F.col("text")
    return v.table(spark, sf, "conversations").select(
        "conv_id", "turn", tx.single_line(text).alias("single_line"), tx.stripped(text).alias("stripped")
    )


@query("truncate_text", """
    SELECT doc_id, substr(lang, 1, 80) AS title, substr(text, 1, 400) AS card_text, substr(text, 1, 800) AS query_text,
           substr(text, 1, 500) AS piece_text FROM documents""")
def truncate_text(spark, sf):
    text = F.col("text")
    return v.table(spark, sf, "documents").select(
        "doc_id", tx.truncate(F.col("lang"), tx.CARD_TITLE_CHARS).alias("title"),
        tx.truncate(text, tx.CARD_TEXT_CHARS).alias("card_text"),
        tx.truncate(text, tx.QUERY_TEXT_CHARS).alias("query_text"),
        tx.truncate(text, tx.PIECE_CHARS).alias("piece_text"),
    )


_BREAK = r"[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def sql_clean_query(raw: str) -> str:
    line = sql_strip(f"regexp_extract({sql_strip(raw)}, '^[^{_BREAK[1:-1]}]*')")
    line = f"trim(trim({line}, '\"'), '''')"
    prefix = "(?i)^(?:query:|search query:|output:)"
    body = f"regexp_replace({line}, '{prefix}', '')"
    return (
        f"coalesce(nullif(CASE WHEN regexp_matches({line}, '{prefix}') THEN {sql_strip(body)} ELSE {line} END, ''), "
        f"'{FALLBACK}')"
    )


@query("clean_query", sql(f"SELECT user_id, item_id, {sql_clean_query('raw')} AS query FROM tn", "tn"))
def clean_query(spark, sf):
    return v.turns(spark, sf).select("user_id", "item_id", tx.clean_query(F.col("raw"), FALLBACK).alias("query"))


@query("clean_card", sql(f"""
    SELECT user_id, item_id, coalesce(nullif({sql_strip('raw')}, ''), 'Genre: unknown') AS card FROM tn""", "tn"))
def clean_card(spark, sf):
    return v.turns(spark, sf).select("user_id", "item_id", tx.clean_card(F.col("raw"), "Genre: unknown").alias("card"))


@query("fallback_rate", sql(f"""
    SELECT count(*) AS n_rows, sum(f)::BIGINT AS n_fallback, avg(f) AS fallback_rate
    FROM (SELECT ({sql_norm(sql_clean_query('raw'))} = '{FALLBACK}')::INT AS f FROM tn)""", "tn"))
def fallback_rate(spark, sf):
    cleaned = v.turns(spark, sf).withColumn("query", tx.clean_query(F.col("raw"), FALLBACK))
    return enrich.fallback_rate(cleaned.withColumn("is_fallback", tx.is_fallback(F.col("query"), FALLBACK)))


# --- prompts and item texts -------------------------------------------------------------------


@query("query_prompt", """
    SELECT doc_id AS review_id,
           sha256('Rephrase the review as a request.' || chr(10) || chr(10) || '[REVIEW]' || chr(10) ||
                  lang || '. ' || text) AS prompt
    FROM documents""")
def query_prompt(spark, sf):
    prompts = enrich.query_prompts(v.reviews(spark, sf), QUERY_TEMPLATE)
    return prompts.select("review_id", F.sha2("prompt", 256).alias("prompt"))


@query("card_prompt", sql("""
    SELECT item_id, 'Describe the item in a short card.' || chr(10) || chr(10) || '[METADATA]' || chr(10) ||
           concat_ws(chr(10), CASE WHEN length(author) > 2 THEN 'Author: ' || substr(author, 1, 500) END,
               CASE WHEN length(categories) > 2 THEN 'Categories: ' || substr(categories, 1, 500) END,
               CASE WHEN length(features) > 2 THEN 'Features: ' || substr(features, 1, 500) END,
               CASE WHEN length(description) > 2 THEN 'Description: ' || substr(description, 1, 500) END,
               'AvgRating: ' || average_rating || ' (' || rating_number || ' ratings)') ||
           chr(10) || chr(10) || '[REVIEWS]' || chr(10) || coalesce(l.lines, '(no reviews)') AS prompt
    FROM meta LEFT JOIN (
        SELECT item_id, string_agg('(' || rating || '/5) ' || substr(title, 1, 80) || ' — ' || substr(text, 1, 400),
                                   chr(10) ORDER BY pool_rank) AS lines
        FROM sel GROUP BY item_id) l USING (item_id)""", "meta", "sel"))
def card_prompt(spark, sf):
    meta = v.meta(spark, sf)
    picked = pools.select_reviews(_pool(spark, sf)).select("review_id", "item_id", "rating", "title", "pool_rank")
    texts = v.reviews(spark, sf).select("review_id", "text").join(picked, "review_id")
    return enrich.card_prompts(meta.select("item_id"), meta, texts, CARD_TEMPLATE, "pool_rank")


def _item_texts(spark, sf):
    return enrich.item_texts(
        v.item_ids(spark, sf), _first_reviews(spark, sf), v.cards(spark, sf), INSTRUCTION, v.DOMAIN
    )


_TEXTS = {
    "ptext": f"""
        SELECT iid, item_id, array_to_string(list_filter(list_transform(list_zip(titles, texts), lambda p:
            {sql_strip("concat('Review title: ', p[1], chr(10), CASE WHEN TXT <> '' THEN 'Review text: ' || substr(TXT, 1, 500) ELSE '' END)".replace("TXT", sql_strip("p[2]")))}),
            lambda x: x IS NOT NULL), chr(10) || chr(10)) AS body
        FROM rpool""",
    "itx": f"""
        SELECT i.iid, coalesce(nullif({sql_strip('c.card')}, ''), '') AS card, coalesce(p.body, '') AS body
        FROM rid i LEFT JOIN ptext p USING (iid) LEFT JOIN cards c ON c.item_id = i.item_id""",
}


@query("item_text", sql(f"""
    SELECT iid, 'passage: ' || CASE WHEN card <> '' THEN '{INSTRUCTION}' || chr(10) || chr(10) || card
                WHEN body <> '' THEN '{INSTRUCTION}' || chr(10) || chr(10) || body ELSE '{FALLBACK}' END AS item_text,
           card <> '' AS has_card, body <> '' AS has_pool FROM itx""", extra=_TEXTS))
def item_text(spark, sf):
    prefixed = F.concat(F.lit(tx.PASSAGE_PREFIX), F.col("item_text"))
    return _item_texts(spark, sf).select("iid", prefixed.alias("item_text"), "has_card", "has_pool")


@query("card_coverage", sql("""
    SELECT count(*) AS n_items, count(*) FILTER (card <> '') AS n_card, count(*) FILTER (body <> '') AS n_pool,
           count(*) FILTER (body <> '' AND card = '') AS n_pool_fallback,
           count(*) FILTER (body = '' AND card = '') AS n_no_text FROM itx""", extra=_TEXTS))
def card_coverage(spark, sf):
    return enrich.card_coverage(_item_texts(spark, sf))


# --- generation and encoding ------------------------------------------------------------------


def echo_review(prompts: list[str]) -> list[str]:
    """A deterministic stand-in for an external generator: answers with the review itself."""
    return ["Search query: " + p.split("[REVIEW]\n", 1)[1] for p in prompts]


@query("enrich_generate", sql(f"""
    SELECT review_id, query, {sql_norm('query')} = '{FALLBACK}' AS is_fallback
    FROM (SELECT review_id, {sql_clean_query("('Search query: ' || title || '. ' || text)")} AS query FROM rv)""", "rv"))
def enrich_generate(spark, sf):
    prompts = enrich.query_prompts(v.reviews(spark, sf), QUERY_TEMPLATE)
    return enrich.generate_queries(prompts, echo_review, v.DOMAIN).select("review_id", "query", "is_fallback")


@query("encode_text")
def encode_text(spark, sf):
    """Hashed TF-IDF vectors of the whole texts; checked by tests."""
    return learned.hashed_text_vectors(v.reviews(spark, sf), "review_id", "text", prefix=tx.PASSAGE_PREFIX)
