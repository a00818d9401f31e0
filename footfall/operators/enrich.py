"""Tables for batch text generation and encoding: prompts out, cleaned results in."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from footfall.functions import text as tx
from footfall.plans.selection import top_n

BATCH_ROWS = 64


def catalog_metadata(meta: DataFrame, items: DataFrame, key: str = "item_id") -> DataFrame:
    """Metadata rows of the given items."""
    return meta.join(items.select(key), key, "left_semi")


def query_prompts(df: DataFrame, template: str, title: str = "title", text: str = "text") -> DataFrame:
    """Add ``prompt``: the template with ``{review}`` filled."""
    return df.withColumn("prompt", tx.fill_template(template, review=tx.review_body(F.col(title), F.col(text))))


def card_prompts(
    items: DataFrame, meta: DataFrame, selected: DataFrame, template: str, order: str, fields: tuple[str, ...] = tx.META_FIELDS, key: str = "item_id"
) -> DataFrame:
    """``key, prompt`` for every item: its metadata block and selected review lines.

    ``selected`` holds at most a handful of rows per item (``rating, title, text, order``).
    Items without reviews get the fixed note.
    """
    block = meta.select(key, tx.meta_block(meta.columns, fields).alias("_meta"))
    line = tx.review_line(
        F.col("rating"),
        tx.truncate(F.col("title"), tx.CARD_TITLE_CHARS),
        tx.truncate(F.col("text"), tx.CARD_TEXT_CHARS),
    )
    lines = (
        selected.select(key, F.struct(F.col(order), line.alias("line")).alias("_l"))
        .groupBy(key)
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list("_l")), lambda r: r["line"]), "\n").alias("_reviews"))
    )
    joined = items.select(key).join(block, key, "left").join(lines, key, "left")
    reviews = F.coalesce(F.nullif(F.col("_reviews"), F.lit("")), F.lit(tx.NO_REVIEWS))
    # An item without metadata counts as one whose title is its id.
    named = F.when(F.length(key) > 2, F.concat(F.lit("Title: "), F.substring(key, 1, tx.META_CHARS)))
    unknown = F.coalesce(named, F.lit("")) if "title" in fields else F.lit("")
    block = F.coalesce(F.col("_meta"), unknown)
    return joined.select(key, tx.fill_template(template, meta=block, reviews=reviews).alias("prompt"))


def item_texts(
    catalog: DataFrame, pool: DataFrame, cards: DataFrame | None, instruction: str, domain: str, reviews: int = 5, chars: int = tx.PIECE_CHARS
) -> DataFrame:
    """``iid, item_text, has_card, has_pool``: a card where there is one, else the pooled reviews.

    ``catalog`` is ``iid, item_id``; ``pool`` is ``iid, review_titles, review_texts``; ``cards``
    is ``item_id, card``.
    """
    lists = tuple(isinstance(pool.schema[c].dataType, T.ArrayType) for c in ("review_titles", "review_texts"))
    pooled = pool.select("iid", tx.pool_text(F.col("review_titles"), F.col("review_texts"), reviews, chars, lists).alias("_pool"))
    joined = catalog.select("iid", "item_id").join(pooled, "iid", "left")
    if cards is None:
        joined = joined.withColumn("_card", F.lit(""))
    else:
        joined = joined.join(cards.select("item_id", tx.stripped(F.col("card")).alias("_card")), "item_id", "left")
    card, body = F.coalesce("_card", F.lit("")), F.coalesce("_pool", F.lit(""))
    return joined.select(
        "iid",
        tx.item_text(instruction, F.when(card != "", card).otherwise(body), domain).alias("item_text"),
        (card != "").alias("has_card"),
        (body != "").alias("has_pool"),
    )


def row_pool(rows: DataFrame, order: list[Column], reviews: int = 5, chars: int = tx.PIECE_CHARS) -> DataFrame:
    """Row-level reviews (``iid, review_title, review_text``) as a pool of the first non-empty pieces per item."""
    piece = tx.review_piece(F.col("review_title"), F.col("review_text"), chars)
    picked = top_n(rows.where(piece.isNotNull()), ["iid"], order, reviews, rank="_rank")
    row = F.struct("_rank", "review_title", "review_text")
    return picked.groupBy("iid").agg(F.array_sort(F.collect_list(row)).alias("_r")).select(
        "iid", F.col("_r.review_title").alias("review_titles"), F.col("_r.review_text").alias("review_texts")
    )


def card_coverage(texts: DataFrame) -> DataFrame:
    """One row: items, with a card, with a pool, falling back to the pool, without any text."""
    fallback = F.col("has_pool") & ~F.col("has_card")
    count = lambda c: F.count(F.when(c, 1))
    return texts.agg(
        F.count(F.lit(1)).alias("n_items"),
        count(F.col("has_card")).alias("n_card"),
        count(F.col("has_pool")).alias("n_pool"),
        count(fallback).alias("n_pool_fallback"),
        count(~F.col("has_card") & ~F.col("has_pool")).alias("n_no_text"),
    )


def fallback_rate(df: DataFrame) -> DataFrame:
    """One row: rows, fallback rows, their share."""
    flag = F.col("is_fallback").cast("int")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(flag).alias("n_fallback"), F.avg(flag).alias("fallback_rate"))


def map_texts(
    df: DataFrame, column: str, out: str, out_type: T.DataType, batch: Callable[[list[str]], list], batch_rows: int = BATCH_ROWS,
    retries: int = 2, retry_on: tuple[type[Exception], ...] = (OSError, RuntimeError), pause: float = 0.1,
) -> DataFrame:
    """Add ``out``: ``batch`` applied to lists of texts inside the tasks.

    This is the extension point for an external text generator or encoder. Only the text column
    goes to Python; the others stay as they are. A call that fails with one of ``retry_on`` is
    repeated after a pause that doubles; ``batch`` may also be called again for the same rows
    when a task is retried.
    """

    def call(texts: list[str]) -> list:
        for attempt in range(retries + 1):
            try:
                answers = list(batch(texts))
                break
            except retry_on:
                if attempt == retries:
                    raise
                time.sleep(min(30.0, pause * 2**attempt))
        if len(answers) != len(texts):
            raise ValueError(f"{len(texts)} texts in, {len(answers)} results out")
        return answers

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in columns:
            pieces = [call(texts.slice(i, batch_rows).to_pylist()) for i in range(0, len(texts), batch_rows)]
            yield pa.array([answer for piece in pieces for answer in piece], to_arrow_type(out_type))

    return df.withColumn(out, F.arrow_udf(run, out_type)(F.col(column)))


def generate_queries(prompts: DataFrame, generator: Callable[[list[str]], list[str]], domain: str) -> DataFrame:
    """Rows of :func:`query_prompts` with ``query`` and ``is_fallback``; the prompt is dropped."""
    fallback = tx.general_request(domain)
    raw = map_texts(prompts, "prompt", "_raw", T.StringType(), generator)
    cleaned = raw.withColumn("query", tx.clean_query(F.col("_raw"), fallback))
    return cleaned.withColumn("is_fallback", tx.is_fallback(F.col("query"), fallback)).drop("_raw", "prompt")


def generate_cards(prompts: DataFrame, generator: Callable[[list[str]], list[str]], fallback_card: str) -> DataFrame:
    """Rows of :func:`card_prompts` with ``card``; the prompt is dropped."""
    raw = map_texts(prompts, "prompt", "_raw", T.StringType(), generator)
    return raw.withColumn("card", tx.clean_card(F.col("_raw"), fallback_card)).drop("_raw", "prompt")
