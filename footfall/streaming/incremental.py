"""Resumable processing of a keyed table."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.operators.reviews import require_integrity
from footfall.plans.scratch import materialise


def done_keys(outputs: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Distinct keys present in any of the outputs."""
    union = outputs[0].select(*keys)
    for other in outputs[1:]:
        union = union.unionByName(other.select(*keys))
    return union.distinct()


def todo(df: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not done yet."""
    return df.join(done, list(keys), "left_anti")


def merge_latest(
    versions: Sequence[DataFrame], keys: Sequence[str], required: Sequence[str], order: str | None = None, sort: Sequence[str] = ()
) -> DataFrame:
    """Union of the versions, oldest first; per key the last row of the latest version that has it.

    ``order`` names the column that tells the order of rows inside a version (see
    ``scan_with_row_id``); it is not returned. Without it, repeats of a key in one version are
    settled by a hash of the row, the same on every run. Missing columns become null. ``sort`` gives
    the order of the result.
    """
    merged = None
    for age, version in enumerate(versions):
        tagged = version.withColumn("_age", F.lit(age))
        merged = tagged if merged is None else merged.unionByName(tagged, allowMissingColumns=True)
    own = [c for c in merged.columns if c not in ("_age", order)]
    within = F.col(order) if order else F.lit(0)
    merged = materialise(merged.select(*own, F.struct("_age", within.alias("_o"), F.xxhash64(*own).alias("_h")).alias("_mark")), "merge")
    best = merged.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.max("_mark").alias("_best"))
    same = F.col("_mark") == F.col("_best")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    latest = materialise(merged.join(best, same).select(*own).dropDuplicates(list(keys)), "merged")
    latest = require_integrity(latest, required, keys)
    return latest.orderBy(*sort) if sort else latest


class VersionTaken(RuntimeError):
    """Another writer committed this version first."""


def _pointers(spark: SparkSession, base: str):  # noqa: ANN202
    """The folder of version pointers and its file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/versions")
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def newest_version(spark: SparkSession, base: str) -> tuple[int, str | None]:
    """Number and folder of the newest committed version; (0, None) before the first.

    A pointer that is still empty belongs to a commit under way and does not count.
    """
    folder, files = _pointers(spark, base)
    if not files.exists(folder):
        return 0, None
    for status in sorted(files.listStatus(folder), key=lambda s: s.getPath().getName(), reverse=True):
        if status.getLen():
            name = status.getPath().getName()
            return int(name), spark.read.text(status.getPath().toString()).first()["value"]
    return 0, None


def write_version(df: DataFrame, base: str) -> str:
    """Write rows into a folder of their own, which no reader sees before :func:`commit_version`."""
    path = f"{base.rstrip('/')}/rows-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return path


def commit_version(spark: SparkSession, base: str, version: int, path: str) -> None:
    """Make the rows in ``path`` version ``version``, one more than the version they were made from.

    The pointer file of a number is created only if it is not there, in one step of the file system, so of two writers that
    started from the same version one gets :class:`VersionTaken`: it reads the newest version and tries again.
    """
    if version != newest_version(spark, base)[0] + 1:
        raise VersionTaken(f"version {version} does not follow the newest one")
    folder, files = _pointers(spark, base)
    pointer = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, f"{version:012}")
    try:
        out = files.create(pointer, False)
    except Py4JJavaError as error:
        if not files.exists(pointer):
            raise
        raise VersionTaken(f"version {version} exists") from error
    out.write(bytearray(path.encode()))
    out.close()


def read_latest(spark: SparkSession, base: str) -> DataFrame:
    """The newest committed version, whole."""
    version, path = newest_version(spark, base)
    if path is None:
        raise FileNotFoundError(f"no version in {base}")
    return spark.read.parquet(path)
