"""Scans and sinks: pruned parquet, tolerant schemas, JSON lines, manifests, versioned tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall.functions.text import FLAT_CHARS

REVIEW_SCHEMA = T.StructType(
    [
        T.StructField("user_id", T.StringType()),
        T.StructField("parent_asin", T.StringType()),
        T.StructField("rating", T.DoubleType()),
        T.StructField("title", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("helpful_vote", T.IntegerType()),
        T.StructField("verified_purchase", T.BooleanType()),
    ]
)
MANIFEST_ROW = "user_id string, item_id string, timestamp bigint, review_hash string, history array<string>"
_MANIFEST_ROWS = T.ArrayType(
    T.StructType()
    .add("user_id", T.StringType())
    .add("item_id", T.StringType())
    .add("timestamp", T.LongType())
    .add("review_hash", T.StringType())
    .add("history", T.ArrayType(T.StringType()))
)
MANIFEST_SCHEMA = (
    T.StructType()
    .add("dataset", T.StringType())
    .add("n_users", T.LongType())
    .add("n_items", T.LongType())
    .add("valid", _MANIFEST_ROWS)
    .add("test", _MANIFEST_ROWS)
)
# What a review scan assumes for columns a file does not have.
REVIEW_DEFAULTS: Mapping[str, tuple[object, str]] = {
    "rating": (0.0, "double"),
    "helpful_vote": (0, "int"),
    "title": ("", "string"),
    "text": ("", "string"),
    "user_id": ("", "string"),
    "timestamp": (0, "bigint"),
}


def select_available(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The wanted columns that exist, in the wanted order."""
    return df.select(*[c for c in wanted if c in df.columns])


def scan_required(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Exactly ``columns``, without rows that miss a key.

    Plain not-null filters are pushed into the scan, which ``na.drop`` is not.
    """
    df = df.select(*columns)
    for key in keys:
        df = df.where(F.col(key).isNotNull())
    return df


def scan_with_row_id(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table with ``row_id``: file and row number, so that even full copies can be told apart.

    The id follows the file order and is the same in every scan of the same files.
    """
    place = F.format_string("%s:%015d", F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    return spark.read.parquet(path).select("*", place.alias("row_id"))


def scan_with_defaults(
    df: DataFrame, wanted: Sequence[str], defaults: Mapping[str, tuple[object, str]] = REVIEW_DEFAULTS
) -> DataFrame:
    """The wanted columns; those the source lacks, and nulls in numeric ones it has, become their default."""

    def filled(c: str) -> Column:
        value = F.lit(defaults[c][0]).cast(defaults[c][1]) if c in defaults else None
        if c not in df.columns:
            return value.alias(c)
        return F.coalesce(F.col(c), value).alias(c) if value is not None and defaults[c][1] != "string" else F.col(c)

    return df.select(*[filled(c) for c in wanted])


def flatten_nested(df: DataFrame, chars: int = FLAT_CHARS) -> DataFrame:
    """Nested columns as JSON text of at most ``chars`` characters; scalars stay as they are."""
    nested = (T.ArrayType, T.MapType, T.StructType)

    def flat(field: T.StructField) -> Column:
        if isinstance(field.dataType, nested):
            return F.substring(F.to_json(F.col(field.name)), 1, chars).alias(field.name)
        return F.col(field.name)

    return df.select(*[flat(f) for f in df.schema.fields])


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines with a declared schema (no inference pass); empty lines are skipped."""
    return spark.read.schema(schema).json(path)


def read_manifest_json(spark: SparkSession, path: str) -> DataFrame:
    """A published manifest document as rows ``split, user_id, item_id, timestamp, review_hash, history``.

    One JSON document is one record, so use this once to import it, then :func:`write_manifest`.
    """
    doc = spark.read.schema(MANIFEST_SCHEMA).json(path, multiLine=True)
    rows = [
        doc.select(F.lit(split).alias("split"), F.explode(split).alias("r")).select("split", "r.*")
        for split in ("valid", "test")
    ]
    return rows[0].unionByName(rows[1])


def kept_path(folder: str, name: str, parameters: Mapping[str, object]) -> str:
    """Where :func:`reuse_or_build` keeps a table: its name and a hash of its parameters."""
    tag = hashlib.sha1(repr(sorted(parameters.items())).encode()).hexdigest()[:12]
    return f"{folder.rstrip('/')}/{name}-{tag}"


def reuse_or_build(
    spark: SparkSession, folder: str, name: str, parameters: Mapping[str, object], build: Callable[[], DataFrame], rows_per_file: int = 0
) -> DataFrame:
    """A table kept in ``folder`` under its name and a hash of its parameters; built when absent.

    A finished build is recorded in a table beside it; one that was cut short is done again.
    ``rows_per_file`` bounds the files of a table, 0 leaves them as they come.
    """
    path = kept_path(folder, name, parameters)
    done = f"{path}.done"
    try:
        spark.read.schema("id bigint").parquet(done).first()
    except AnalysisException:
        build().write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)
        spark.range(1).write.mode("overwrite").parquet(done)
    return spark.read.parquet(path)


def write_manifest(manifest: DataFrame, path: str) -> None:
    """The split manifest, one folder per split; an existing manifest is never replaced."""
    manifest.write.mode("errorifexists").partitionBy("split").parquet(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{MANIFEST_ROW}, split string").parquet(path)


def read_exclusion_list(spark: SparkSession, path: str, field: str) -> DataFrame:
    """The id array ``field`` of a JSON document as a one-column frame ``uid``."""
    doc = spark.read.schema(f"`{field}` array<bigint>").json(path, multiLine=True)
    return doc.select(F.explode(field).alias("uid")).distinct()


def write_splits(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """One table partitioned by ``split``, so a split reads only its own files."""
    df.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("split").parquet(path)


def write_json_lines(df: DataFrame, path: str, overwrite: bool = False) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").json(path)


def write_vectors(df: DataFrame, path: str, key: str, vector: str, overwrite: bool = False) -> None:
    """Vectors keyed by id, never by position."""
    out = df.select(key, F.col(vector).cast("array<float>").alias(vector))
    out.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)
