"""From raw documents to token ids in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which :func:`run` writes and
reads again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.llm import langid, lines, mixing, nearjoin, queries
from footfall.plans.scratch import materialise
from footfall.session import ship_package
from registry import base

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _shipped(stage: Stage) -> Stage:
    """The stage with the packages made importable on the executors first."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        ship_package(spark, Path(base.__file__).parent)
        return stage(spark, docs, sf_dir)

    run_stage.__name__, run_stage.__doc__ = stage.__name__, stage.__doc__
    return run_stage


@_shipped
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; null texts and texts without letters go."""
    found = langid.predict(docs, "text", queries.language_model(docs))
    return found.where(~F.col("rejected")).select(*docs.columns)


@_shipped
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that match earlier ones; documents left without any line with words go."""
    cut = lines.remove_lines(docs, "doc_id", "text", lines.kept_lines(docs))
    return cut.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


@_shipped
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each component of near-duplicates, of a similarity of 0.8 or more."""
    found = nearjoin.near_components(docs, percent=80)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("_gone_id"), F.col("text_hash").alias("_gone_hash"))
    gone = materialise(gone, "near-gone")
    same = (docs["doc_id"] == gone["_gone_id"]) & (F.xxhash64(docs["text"]) == gone["_gone_hash"])
    return docs.join(nearjoin.checked_broadcast(gone), same, "left_anti")


@_shipped
def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, and those of small sources as often more as evens out the mix."""
    return mixing.mix(docs, "doc_id", "source", "text").select(*docs.columns)


@_shipped
def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every text, with digests of the ids and of the bytes decoded from them."""
    found = queries.token_digests(docs)
    return found.select("doc_id", "lang", "source", F.col("_ids").alias("ids"), "n_tokens", "ids_sha256", "decoded_sha256")


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("byte_bpe", byte_bpe),
]

#: Trained embeddings, hashes of the mix and merges cannot be put in SQL; the tests compare with brute force.
ORACLE_SQL: str | None = None


@base.query("pipeline", ORACLE_SQL)
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
