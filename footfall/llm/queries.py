"""Registered queries of the operators in this package.

Each runs its operator over the whole of its table. Operators that SQL cannot express are tested
in ``tests/llm`` against brute force instead.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.llm import align, bpe, bytespans, chat, langid, lines, merkle, mixing, nearjoin, quality, substrings, topk, urls
from registry.base import query

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def token_digests(docs: DataFrame, ranks_path: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """Number of tokens of each text, and digests of its ids and of the bytes decoded from them."""
    spark = docs.sparkSession
    docs = docs.drop("n_tokens", "ids_sha256", "decoded_sha256")  # replaced
    coded = docs.withColumn("_coded", bpe.round_trip(spark, F.coalesce("text", F.lit("")), ranks_path, pattern))
    return coded.select(*docs.columns, F.col("_coded.ids").alias("_ids"), F.col("_coded.bytes").alias("_bytes")).select(
        "*",
        F.size("_ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("_bytes", 256).alias("decoded_sha256"),
    )


@query("op2_byte_bpe")
def op2_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return token_digests(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(ls) AS body, generate_subscripts(ls, 1) - 1 AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
sets AS (
  SELECT doc_id, line, list_sort(list_distinct(list_filter(regexp_split_to_array(body, '[\x20\x09-\x0D]+'), lambda w: w <> ''))) AS ws
  FROM lines),
worded AS (SELECT * FROM sets WHERE len(ws) > 0),
reps AS (
  SELECT ws, min(struct_pack(d := doc_id, l := line)) AS id, len(ws) AS n FROM worded GROUP BY ws),
toks AS (SELECT id, n, unnest(ws) AS w FROM reps),
df AS (SELECT w, count(*) AS df FROM toks GROUP BY w),
ranked AS (
  SELECT id, n, toks.w, row_number() OVER (PARTITION BY id ORDER BY df.df, toks.w) AS pos
  FROM toks JOIN df ON toks.w = df.w),
pre AS (SELECT * FROM ranked WHERE pos <= n - (90 * n + 99) // 100 + 1),
cand AS (
  SELECT DISTINCT a.id AS id, b.id AS other FROM pre a JOIN pre b ON a.w = b.w AND b.id < a.id
  WHERE least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 90),
gone AS (
  SELECT DISTINCT c.id FROM cand c JOIN reps a ON c.id = a.id JOIN reps b ON c.other = b.id
  WHERE 100 * len(list_intersect(a.ws, b.ws)) >= 90 * (a.n + b.n - len(list_intersect(a.ws, b.ws)))),
kept AS (
  SELECT id.d AS doc_id, count(*) AS k, string_agg(id.l, ',' ORDER BY id.l) AS kept_lines
  FROM reps WHERE id NOT IN (SELECT id FROM gone) GROUP BY id.d),
total AS (SELECT doc_id, count(*) FILTER (len(ws) > 0) AS n_lines FROM sets GROUP BY doc_id)
SELECT total.doc_id, n_lines, n_lines - coalesce(k, 0) AS n_removed, coalesce(kept_lines, '') AS kept_lines
FROM total LEFT JOIN kept ON total.doc_id = kept.doc_id
"""


@query("op1_line_dedup", OP1_SQL)
def op1_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return lines.count_lines(docs, "doc_id", "text", lines.kept_lines(docs))


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
QUALIFY rank <= 5
"""


@query("op3_exact_topk", OP3_SQL)
def op3_exact_topk(spark: SparkSession, sf: str) -> DataFrame:
    return topk.search(table(spark, sf, "embeddings"), "vec_id", "embedding", 50, 5)


@query("op4_substring_dedup")
def op4_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = substrings.remove_repeats(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def language_model(docs: DataFrame) -> langid.Model | None:
    return langid.train(docs.where(~langid.held_out("doc_id")), "doc_id", "text", "lang")


@query("op5_language_id")
def op5_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    found = langid.predict(docs.select("doc_id", "text"), "text", language_model(docs))
    return found.select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")


OP6_SQL = r"""
WITH base AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws
  FROM documents),
grams AS (
  SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 4), ' ') AS g
  FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 4)) AS i FROM base WHERE len(ws) >= 5)),
twice AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, generate_series(0, 4) AS s(k) GROUP BY doc_id),
lined AS (
  SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '[\x20\x09-\x0D]', '', 'g') <> '') AS ls FROM base),
stats AS (
  SELECT base.doc_id, source, len(ws)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM base JOIN lined ON base.doc_id = lined.doc_id LEFT JOIN covered ON base.doc_id = covered.doc_id),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM stats),
hosts AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS k FROM judged GROUP BY source),
spread AS (
  SELECT count(*) AS h, sum(n) AS n_all, sum(k) / sum(n) AS mean, sum(k * k / n) AS kk, sum(n * n) AS nn FROM hosts),
extra AS (
  SELECT *, mean * (1 - mean) AS chance,
    CASE WHEN n_all - nn / n_all > 0 THEN (kk - n_all * mean * mean - (h - 1) * mean * (1 - mean)) / (n_all - nn / n_all) ELSE 0 END AS extra
  FROM spread),
prior AS (SELECT mean, CASE WHEN extra > 0 THEN greatest(1.0, chance / extra - 1) ELSE n_all / h END AS strength FROM extra),
rates AS (SELECT source, (k + mean * strength) / (n + strength) AS rate FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rate <= 0.5 AS kept
FROM judged JOIN rates ON judged.source IS NOT DISTINCT FROM rates.source
"""


@query("op6_quality_rules", OP6_SQL)
def op6_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return quality.judge(docs, "doc_id", "source", quality.base_rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


RULES = (
    urls.Rule("block", "net", "/"),
    urls.Rule("allow", "example.net", "/en/"),
    urls.Rule("block", "example.com", "/de/"),
    urls.Rule("allow", "org", "/fr/"),
)


@query("op7_url_filters")
def op7_url_filters(spark: SparkSession, sf: str) -> DataFrame:
    return urls.judge(table(spark, sf, "pages"), "page_id", "url", RULES)


@query("op8_near_dedup")
def op8_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return nearjoin.near_components(table(spark, sf, "documents"))


OP9_SQL = r"""
WITH lined AS (
  SELECT row_number() OVER () AS r, conv_id, turn, role, text, string_split(text, chr(10)) AS ls FROM conversations),
marked AS (
  SELECT r, list_transform(ls, lambda x: regexp_extract(x, '^[ \t]*((?:>[ \t]*)+)', 1)) AS ms FROM lined)
SELECT conv_id, turn, role,
  regexp_replace(regexp_replace(text, '^\s*\n', ''), '\s+$', '') AS text,
  len(list_filter(ms, lambda m: m <> ''))::BIGINT AS n_quoted,
  NULL::BIGINT AS parent_turn, turn AS root_turn, 0::BIGINT AS depth
FROM lined JOIN marked ON lined.r = marked.r
"""


@query("op9_chat_quotations", OP9_SQL)
def op9_chat_quotations(spark: SparkSession, sf: str) -> DataFrame:
    return chat.reply_order(table(spark, sf, "conversations"))


@query("op10_source_mixing")
def op10_source_mixing(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return mixing.mix(docs, "doc_id", "source", "text").select("doc_id", "source", "pass", "block", "place")


@query("op11_suffix_dedup")
def op11_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = bytespans.remove_repeats(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_bytes", bytespans.removed_bytes(F.col("removed")).alias("n_removed"),
        F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"),
    )


#: Levels that the SQL of op12 spells out: enough for 16 ** 7 leaves of a source.
_SQL_LEVELS = 7


def _sql_tree(name: str, nodes: str, tree: str) -> str:
    """CTEs with all levels of the trees over ``nodes`` (tree, place, size, digest), runs of 16."""
    parts = [f"{name}_0 AS (SELECT {tree} AS tree, place, size, digest FROM {nodes})"]
    for k in range(1, _SQL_LEVELS + 1):
        parts.append(
            f"{name}_{k} AS (SELECT tree, place // 16 AS place, (size + 15) // 16 AS size, "
            f"sha256(string_agg(digest, '' ORDER BY place)) AS digest FROM {name}_{k - 1} WHERE size > 1 GROUP BY tree, place // 16, size)"
        )
    tops = " UNION ALL ".join(f"SELECT tree, digest FROM {name}_{k} WHERE size = 1" for k in range(_SQL_LEVELS + 1))
    return ",\n".join([*parts, f"{name}_top AS ({tops})"])


def _sql_walk(name: str, leaves: str, columns: str) -> str:
    """CTEs that walk from the leaves to their trees' tops and collect siblings, the fold of ``other`` among them."""
    parts = []
    for k in range(_SQL_LEVELS):
        before = leaves if k == 0 else f"{name}_walk_{k - 1}"
        parts.append(
            f"{name}_runs_{k} AS (SELECT tree, place // 16 AS run, list(digest ORDER BY place) AS ds FROM {name}_{k} WHERE size > 1 GROUP BY ALL),\n"
            f"{name}_walk_{k} AS (SELECT {columns}, w.tree, w.place // 16 AS place, "
            "siblings || coalesce(array_to_string(ds[: w.place % 16] || ds[w.place % 16 + 2 :], ''), '') AS siblings, "
            "CASE WHEN ds IS NULL THEN other ELSE sha256(coalesce(array_to_string(ds[: w.place % 16], ''), '') || other || "
            "coalesce(array_to_string(ds[w.place % 16 + 2 :], ''), '')) END AS other "
            f"FROM {before} w LEFT JOIN {name}_runs_{k} r ON r.tree = w.tree AND r.run = w.place // 16)"
        )
    return ",\n".join(parts)


def _sql_field(value: str) -> str:
    return f"coalesce(octet_length(encode({value}))::VARCHAR || ':' || {value}, '-')"


_SQL_CRC = (
    "xor(list_reduce(flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda d: [ascii(d)::BIGINT, 0, 0, 0, 0, 0, 0, 0])), "
    "lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1)), 4294967295::BIGINT), 4294967295)"
)
_SQL_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _sql_leaf(text: str) -> str:
    fields = [_sql_field(c) for c in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)]
    return f"sha256({' || '.join(fields)})"


OP12_SQL = f"""
WITH leaves AS (
  SELECT doc_id, source, coalesce('1' || source, '0') AS tree, {_sql_leaf("text")} AS digest,
    CASE WHEN {_SQL_CRC} % 5 = 0 THEN {_sql_leaf(_SQL_LOWER)} END AS changed FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id, digest) - 1 AS place, count(*) OVER (PARTITION BY tree) AS size FROM leaves),
{_sql_tree("own", "placed", "tree")},
over_groups AS (SELECT tree AS own_tree, digest, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS size FROM own_top),
{_sql_tree("high", "over_groups", "1")},
started AS (SELECT doc_id, tree, place, digest AS leaf, '' AS siblings, coalesce(changed, digest) AS other FROM placed),
{_sql_walk("own", "started", "w.doc_id, w.leaf")},
crossed AS (
  SELECT doc_id, leaf, g.digest AS subroot, 1 AS tree, g.place, siblings, other
  FROM own_walk_{_SQL_LEVELS - 1} w JOIN over_groups g ON g.own_tree = w.tree),
{_sql_walk("high", "crossed", "w.doc_id, w.leaf, w.subroot")}
SELECT doc_id, leaf, subroot, t.digest AS root, sha256(siblings) AS proof_sha256, other AS folded_root, other = t.digest AS verified
FROM high_walk_{_SQL_LEVELS - 1}, high_top t
"""


def _doc_leaf(text: Column) -> Column:
    return merkle.leaf_of(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)


@query("op12_merkle_manifest", OP12_SQL)
def op12_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    changed = F.when(tampered, _doc_leaf(F.translate("text", upper, lower))).alias("changed")
    found = merkle.proofs(merkle.build(docs, "doc_id", "source", _doc_leaf(F.col("text")), [changed]))
    root = merkle.folded(F.coalesce("changed", "leaf"), F.col("proof"))
    out = found.select(
        F.col("key").alias("doc_id"), "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), root.alias("folded_root")
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


TOKENIZER_A, TOKENIZER_B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@query("op13_tokenizer_alignment")
def op13_tokenizer_alignment(spark: SparkSession, sf: str) -> DataFrame:
    found = align.align(table(spark, sf, "documents"), ["doc_id"], "text", TOKENIZER_A, TOKENIZER_B)
    digest = F.when(F.col("n_a") > 0, F.sha2("groups_text", 256)).otherwise("").alias("groups_sha256")
    counted = align.with_link_counts(found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "links"))
    return counted.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
