"""Session settings the library was tuned with; any existing session works too."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", memory: str = "12g") -> SparkSession:
    """A local session for tests and the bench. On a cluster use the session you are given."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("footfall")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[tuple[str, str]] = set()


def ship_package(spark: SparkSession, folder: str | Path | None = None) -> None:
    """Make a package folder (default: this one) importable in the Python workers.

    Done once per application, wherever the driver was started.
    """
    package = Path(folder or Path(__file__).parent).resolve()
    key = (spark.sparkContext.applicationId, str(package))
    if key in _shipped:
        return
    target = Path(tempfile.mkdtemp(prefix="footfall-py-"))
    archive = shutil.make_archive(str(target / package.name), "zip", package.parent, package.name)
    spark.sparkContext.addPyFile(archive)
    _shipped.add(key)
