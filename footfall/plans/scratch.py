"""Durable intermediate tables.

Lineage is cut by writing a parquet table into the shared folder the cluster names in
``spark.checkpoint.dir``. Against ``DataFrame.checkpoint`` this computes the last stage once
instead of twice, keeps column pruning, and gives Catalyst real file sizes, so that a small
intermediate is broadcast because it *is* small.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediates; a temporary one only where Spark itself is local."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    sc = spark.sparkContext
    active = sc.getCheckpointDir()
    if active:
        return active
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="footfall-"))
    return sc.getCheckpointDir()


def _own_folder(spark: SparkSession) -> str:
    return f"{scratch_root(spark).rstrip('/')}/footfall/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, tag: str) -> str:
    """A path in the application's scratch folder that no other table uses."""
    return f"{_own_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def remove_intermediates(spark: SparkSession) -> None:
    """Delete all intermediates of this application.

    Call it when the results are written: frames that read an intermediate cannot be used afterwards.
    """
    _delete(spark, _own_folder(spark))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once and return a frame that reads the written table."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Passing:
    """Intermediates that an operator needs only until its own result is written.

    Spark deletes a job's shuffle files when the driver's JVM finds its plan unreachable, which can be
    hours later on a driver with little to do. What has been stored needs them no more, so the JVM is asked.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def store(self, df: DataFrame, tag: str) -> DataFrame:
        """As :func:`materialise`."""
        path = new_path(self.spark, tag)
        self.paths.append(path)
        df.write.parquet(path)
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(path)

    def remove(self) -> None:
        """Delete them; frames that read one cannot be used afterwards."""
        for path in self.paths:
            _delete(self.spark, path)
        self.paths = []
