"""Rows meeting the vectors of a catalog: by broadcast while it is small (its bytes are checked), else in tiles.

A tile is a bounded part of the catalog. In :func:`past_tiles` rows that name a tile stream past it,
so a task holds one tile and any number of rows, and a tile that many rows name is dealt in slices.
In :func:`beside_needed` a tile is what a portion of the rows names, so that rows which name many items move once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions import vectors as vx
from footfall.plans.scratch import materialise

# A catalog up to this many bytes (float64) is broadcast; a larger one is cut into tiles.
BROADCAST_BYTES = 64 * 1024 * 1024
# Items of a tile: 16,384 x 256 float64 are 32 MB.
TILE_ROWS = 16_384
# Rows that stream past one copy of a tile.
SLICE_ROWS = 1_000_000
# Rows of a portion (fewer while cores have not three each), those below which a portion is not worth its start, and bytes (float64) of the vectors that a portion names.
PORTION_ROWS, LEAST_ROWS, PORTION_BYTES = 262_144, 4096, 256 * 1024 * 1024


class Vectors:
    """Item ids in ascending order with one matrix per vector column."""

    def __init__(self, ids: np.ndarray, matrices: Sequence[np.ndarray]):
        if (ids[1:] < ids[:-1]).any():
            order = np.argsort(ids, kind="stable")
            ids, matrices = ids[order], [m[order] for m in matrices]
        self.ids, self.matrices = ids, list(matrices)

    def places(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each id, and whether it is there."""
        at = np.searchsorted(self.ids, wanted)
        at[at == len(self.ids)] = 0
        return at, (self.ids[at] == wanted) if len(self.ids) else np.zeros(len(wanted), bool)


@dataclass(frozen=True)
class StoredCatalog:
    """``iid`` and vector columns as a written table, with its size."""

    table: DataFrame
    rows: int
    bytes: int
    columns: tuple[str, ...]

    def fits(self, most: int) -> bool:
        return self.bytes <= most

    def shared(self, order: Callable[[np.ndarray, list[np.ndarray]], np.ndarray] | None = None):  # noqa: ANN201
        """Ids and matrices as a broadcast variable; ask :meth:`fits` first.

        They are put in ascending order of ids, or in ``order``, here, so that no task copies them to sort them.
        """
        found = self.table.toArrow()
        ids, matrices = found["iid"].to_numpy(), [vx.matrix(found[c]) for c in self.columns]
        place = order(ids, matrices) if order else np.argsort(ids, kind="stable")
        return self.table.sparkSession.sparkContext.broadcast((ids[place], [m[place] for m in matrices]))

    def repeats(self) -> bool:
        """Whether an id comes more than once."""
        return not self.table.groupBy("iid").count().where("count > 1").isEmpty()

    def beside(self, most: int = BROADCAST_BYTES) -> DataFrame:
        """The table, with a broadcast hint if it fits."""
        return F.broadcast(self.table) if self.fits(most) else self.table


def store(catalog: DataFrame, *columns: str) -> StoredCatalog:
    """Write ``iid`` and the vector columns of a catalog and measure it."""
    columns = tuple(dict.fromkeys(columns))
    table = materialise(catalog.select("iid", *columns), "catalog")
    wide = [F.coalesce(F.max(F.size(c)), F.lit(0)).alias(f"_{c}") for c in columns]
    facts = table.agg(F.count(F.lit(1)).alias("rows"), *wide).first()
    width = 1 + sum(facts[f"_{c}"] for c in columns)
    return StoredCatalog(table, facts["rows"], facts["rows"] * width * 8, columns)


def tile_of(iid: str, tiles: int):  # noqa: ANN201
    return F.pmod(F.xxhash64(iid), F.lit(tiles)).cast("int")


def n_tiles(catalog: StoredCatalog, tile_rows: int) -> int:
    return max(1, ceil(catalog.rows / tile_rows))


def runs(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Slices of the batches in which the named integer columns do not change, with their values."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(n).to_numpy() for n in names])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
        for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            yield tuple(keys[:, start].tolist()), batch.slice(start, stop - start)


def unpacked(batch: pa.RecordBatch, name: str) -> pa.RecordBatch:
    """The fields of a struct column as a batch."""
    column = batch.column(name)
    return pa.RecordBatch.from_arrays(column.flatten(), names=[f.name for f in column.type])


def past_tiles(
    rows: DataFrame, catalog: StoredCatalog, tiles: int, work: Callable[[Vectors, pa.RecordBatch], Iterator[pa.RecordBatch]],
    schema: str, slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """``work(tile's vectors, rows)`` for rows with a ``tile`` column, in batches; the items' tile is :func:`tile_of`."""
    kept = materialise(rows, "tile-rows")
    crowd = kept.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / slice_rows).cast("int").alias("_slices"))
    crowd = F.broadcast(materialise(crowd, "tile-slices"))  # a row per tile of the catalog
    right = catalog.table.withColumn("tile", tile_of("iid", tiles)).join(crowd, "tile")
    right = right.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)))
    left = kept.withColumn("_at", F.monotonically_increasing_id()).join(crowd, "tile").withColumn("slice", F.pmod(F.xxhash64("_at"), F.col("_slices")).cast("int"))
    item, row = F.struct("iid", *catalog.columns), F.struct(*kept.columns)
    none = lambda df, c: F.lit(None).cast(df.select(c.alias("x")).schema["x"].dataType)
    both = right.select("tile", "slice", F.lit(0).alias("kind"), item.alias("item"), none(left, row).alias("row")).union(
        left.select("tile", "slice", F.lit(1).alias("kind"), none(right, item).alias("item"), row.alias("row"))
    )

    names = catalog.columns

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, vectors = None, [], None
        for (tile, part, kind), batch in runs(batches, "tile", "slice", "kind"):
            if now != (tile, part):
                now, parts, vectors = (tile, part), [], None
            if kind == 0:
                parts.append(unpacked(batch, "item"))
                continue
            if vectors is None:
                found = pa.Table.from_batches(parts) if parts else None
                vectors = Vectors(found["iid"].to_numpy(), [vx.matrix(found[c]) for c in names]) if found else Vectors(np.zeros(0, "int64"), [])
                parts = []
            yield from work(vectors, unpacked(batch, "row"))

    return both.repartition("tile", "slice").sortWithinPartitions("tile", "slice", "kind").mapInArrow(stream, schema)


def _portions(rows: DataFrame, near: str, key: str, most: int) -> tuple[DataFrame, int]:
    """``rows`` with ``portion``, and the number of portions of about ``most`` rows.

    Rows of equal ``near`` share a portion; only those of a ``near`` with more than ``most`` rows are spread by ``key``.
    """
    spark = rows.sparkSession
    crowd = materialise(rows.groupBy(near).agg(F.count(F.lit(1)).alias("_n")), "portion-rows")
    total = crowd.agg(F.sum("_n")).first()[0] or 0
    n = max(1, ceil(total / most), min(3 * spark.sparkContext.defaultParallelism, ceil(total / LEAST_ROWS)))
    # As many rows as portions at most.
    hot = crowd.where(F.col("_n") > most).select(F.col(near).alias("_near"), F.ceil(F.col("_n") / most).alias("_spread"))
    spread = rows.join(F.broadcast(hot), F.col(near).eqNullSafe(F.col("_near")), "left")
    own = F.when(F.col("_spread").isNotNull(), F.pmod(F.xxhash64(key), F.col("_spread")))
    portion = F.pmod(F.xxhash64(near, F.coalesce(own, F.lit(0))), F.lit(n)).cast("int")
    return spread.withColumn("portion", portion).drop("_near", "_spread"), n


def beside_needed(
    rows: DataFrame, wanted: Column, near: str, key: str, catalog: StoredCatalog, work: Callable[[Vectors, pa.RecordBatch], Iterator[pa.RecordBatch]],
    schema: str, made: Callable[[Callable[[str], Column]], list[Column]], portion_rows: int = PORTION_ROWS, portion_bytes: int = PORTION_BYTES,
) -> DataFrame:
    """``work(vectors, rows)`` for portions of rows beside the vectors of all items in their arrays ``wanted``.

    Rows move once, and a vector once for every portion that names it; ``near`` says which rows name the same items. A portion's
    vectors take ``portion_bytes`` at most, or those of one row. ``made`` gives the columns that ``work`` needs, which are made
    where the rows have arrived. ``rows`` are read several times.
    """
    width = catalog.bytes // max(1, catalog.rows)
    while True:
        left, n = _portions(rows, near, key, portion_rows)
        needed = left.select("portion", F.explode(F.array_distinct(wanted)).alias("iid")).distinct()
        needed = materialise(needed, "portion-items")
        most = (needed.groupBy("portion").count().agg(F.max("count")).first()[0] or 0) * width
        if most <= portion_bytes or portion_rows <= 1:
            break
        portion_rows = max(1, min(portion_rows - 1, int(0.8 * portion_rows * portion_bytes / most)))
    right = needed.join(catalog.table, "iid")
    item, row = F.struct("iid", *catalog.columns), F.struct(*rows.columns)
    none = lambda df, c: F.lit(None).cast(df.select(c.alias("x")).schema["x"].dataType)
    both = right.select("portion", F.lit(0).alias("kind"), item.alias("item"), none(left, row).alias("row")).union(
        left.select("portion", F.lit(1).alias("kind"), none(right, item).alias("item"), row.alias("row"))
    )
    met = both.repartitionById(n, F.col("portion")).sortWithinPartitions("portion", "kind")
    arrived = F.when(F.col("kind") == 1, F.struct(*made(lambda c: F.col(f"row.`{c}`"))))
    names = catalog.columns

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, vectors = None, [], None
        for (portion, kind), batch in runs(batches, "portion", "kind"):
            if now != portion:
                now, parts, vectors = portion, [], None
            if kind == 0:
                parts.append(unpacked(batch, "item"))
                continue
            if vectors is None:
                found = pa.Table.from_batches(parts) if parts else None
                parts = []
                vectors = Vectors(found["iid"].to_numpy(), [vx.matrix(found[c], None) for c in names]) if found else Vectors(np.zeros(0, "int64"), [])
                del found
            yield from work(vectors, unpacked(batch, "row"))

    return met.select("portion", "kind", "item", arrived.alias("row")).mapInArrow(stream, schema)
