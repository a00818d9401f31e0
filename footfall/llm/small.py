"""Joining a wide table with a list of keys whose size is checked first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows up to which a checked side is broadcast; beyond it both sides are shuffled.
ROWS, CELLS = 1_000_000, 4_000_000


def checked_broadcast(stored: DataFrame, cells: str | None = None) -> DataFrame:
    """``stored`` (a written table) with a broadcast hint if it is small.

    ``cells`` names an array column whose elements count too. The join gives the same rows either
    way; beyond the bound Spark joins by shuffling, and splits skewed keys.
    """
    size = F.sum(F.size(cells)) if cells else F.lit(0)
    found = stored.agg(F.count(F.lit(1)).alias("rows"), size.alias("cells")).first()
    return F.broadcast(stored) if found["rows"] <= ROWS and (found["cells"] or 0) <= CELLS else stored


def bounded_broadcast(stored: DataFrame, size: Column, most: int = 64 << 20) -> DataFrame:
    """``stored`` (a written table) with a broadcast hint if its rows, of ``size`` bytes each, take at most ``most``."""
    return F.broadcast(stored) if (stored.agg(F.sum(size).alias("n")).first()["n"] or 0) <= most else stored
