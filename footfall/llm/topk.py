"""Exact top-k by inner product over a pivot-distance index.

Vectors are lifted by one coordinate to equal norms, which turns the largest inner product into the
smallest distance. A vector's key is its nearest pivot and the distance to it; keys are dealt by
ranges into blocks of bounded size, so a block is a few annuli around pivots. A query first looks
into its own block, which gives a k-th best score, and then into every block with an annulus that
the triangle inequality does not rule out. Within a block annuli are expanded from the query's own
distance outwards, until the bound of the next one is below the k-th best. Queries and blocks meet
in one shuffle; a block's vectors come first and the queries stream past them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footfall.plans.scratch import materialise

#: Pivots, vectors sampled (in the order of a hash) to choose them from, vectors of a block on
#: average, vectors of an annulus at most, and queries scored at once.
PIVOTS, SAMPLE, BLOCK, RING, STEP = 48, 1024, 2048, 256, 256
#: Size of a component at most, and of a score.
LARGEST, MOST = 2.0**62, 2**63 - 1


def quantised(vectors: DataFrame, key: str, vector: str, scale: int = 256) -> DataFrame:
    """``id, size, v``: the length of each vector and its components times ``scale``, rounded down.

    Left out are null keys, null vectors and vectors with null or non-finite components. Components beyond 2^62
    after scaling count as 2^62. A vector without components is one with a single 0. Equal rows count once.
    """
    x = F.col(vector)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    # Bounds as doubles: what lies beyond would not fit a long.
    near = lambda c: F.greatest(F.least(c.cast("double"), F.lit(LARGEST / scale)), F.lit(-LARGEST / scale))
    whole = F.transform(x, lambda c: F.floor(near(c) * scale).cast("bigint"))
    return vectors.where(F.col(key).isNotNull() & x.isNotNull() & finite).select(
        F.col(key).cast("bigint").alias("id"), F.size(x).alias("size"),
        F.when(F.size(x) > 0, whole).otherwise(F.array(F.lit(0).cast("bigint"))).alias("v"),
    ).distinct()


@dataclass(frozen=True)
class Pivots:
    """Pivot vectors, the coordinate that lifts each, and the norm to which vectors are lifted."""

    rows: np.ndarray
    lift: np.ndarray
    radius2: float

    def distances(self, v: np.ndarray, lifted: bool) -> np.ndarray:
        """Distances to all pivots of stored vectors (lifted) or of queries (their extra coordinate is 0)."""
        norm2 = np.einsum("ij,ij->i", v, v)
        extra = np.sqrt(np.maximum(self.radius2 - norm2, 0.0)) if lifted else np.zeros(len(v))
        dot = v @ self.rows.T + np.outer(extra, self.lift)
        return np.sqrt(np.maximum(norm2[:, None] + extra[:, None] ** 2 + self.radius2 - 2 * dot, 0.0))


def choose_pivots(vectors: DataFrame) -> Pivots:
    """Far apart members of a bounded sample; the radius is the largest norm of all vectors."""
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    radius2 = float(vectors.agg(F.max(norm2)).first()[0] or 0.0)
    n, order = vectors.count(), F.xxhash64("id", "v")
    # Some 4 * SAMPLE rows pass the threshold, so that a task does not send SAMPLE of its own.
    some = vectors if n <= 8 * SAMPLE else vectors.where(F.pmod(order, F.lit(1 << 40)) < (4 * SAMPLE << 40) // n)
    sample = some.orderBy(order, "id").limit(SAMPLE).collect()
    rows = np.array([r.v for r in sample] or np.zeros((0, 1)), "float64")
    lift = np.sqrt(np.maximum(radius2 - np.einsum("ij,ij->i", rows, rows), 0.0))
    whole = np.column_stack([rows, lift])
    picked = [0] if len(whole) else []
    near = ((whole - whole[0]) ** 2).sum(axis=1) if len(whole) else np.zeros(0)
    while len(picked) < min(PIVOTS, len(whole)) and near.max() > 0:
        picked.append(int(near.argmax()))
        near = np.minimum(near, ((whole - whole[picked[-1]]) ** 2).sum(axis=1))
    return Pivots(rows[picked], lift[picked], radius2)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype("float64") if len(column) else np.zeros((0, 0))


def index_blocks(vectors: DataFrame, pivots: Pivots) -> DataFrame:
    """Every vector with its key and block: ``id, v, cell, away, block``. A stored table."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = pivots.distances(_matrix(batch.column(1)), True)
                cell = d.argmin(axis=1)
                columns = [*batch.columns, pa.array(cell.astype("int32")), pa.array(d[np.arange(len(d)), cell])]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "v", "cell", "away"])

    rows = materialise(vectors.mapInArrow(keyed, "id bigint, v array<bigint>, cell int, away double"), "vector-keys")
    blocks = max(1, -(-rows.count() // BLOCK))
    dealt = rows.repartitionByRange(blocks, "cell", "away", "id").withColumn("block", F.spark_partition_id())
    return materialise(dealt, "vector-blocks")


def _inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows; the largest or smallest long where they do not fit one."""
    most = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] if a.size and b.size else 0.0
    if most < 2.0**53:
        return (a @ b.T).astype("int64")
    a, b = a.astype("int64"), b.astype("int64")
    if most < 2.0**62:
        return a @ b.T
    return np.clip(a.astype(object) @ b.astype(object).T, -MOST - 1, MOST).astype("int64")


class _Block:
    """One block's vectors, cut into annuli."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], pivots: Pivots):
        ids, v, cell, away = (np.concatenate(x) for x in zip(*rows, strict=True))
        order = np.lexsort((away, cell))
        self.ids, self.v, cell, away = ids[order], v[order], cell[order], away[order]
        edges = np.flatnonzero(np.append(True, np.diff(cell) != 0))
        starts = np.concatenate([np.arange(a, b, RING) for a, b in zip(edges, np.append(edges[1:], len(cell)), strict=True)])
        self.parts = list(zip(starts, np.append(starts[1:], len(cell)), strict=True))
        self.cell, self.low = cell[starts], away[starts]
        self.high = away[np.append(starts[1:], len(cell)) - 1]
        self.pivots = pivots

    def search(self, qid: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
        """Query, vector and score of up to k best vectors of each query that score at least its floor."""
        to = self.pivots.distances(q, False)[:, self.cell]
        gap = np.maximum(np.maximum(self.low - to, to - self.high), 0.0)
        most = (np.einsum("ij,ij->i", q, q)[:, None] + self.pivots.radius2 - gap**2) / 2
        most = most + 1e-6 * (1 + np.abs(most) + gap**2)  # rounding of the distances
        order = np.argsort(-most, axis=1)
        best = [(np.zeros(0, "int64"), np.zeros(0, "int64"))] * len(q)
        for step in range(len(self.parts)):
            part = order[:, step]
            open_ = most[np.arange(len(q)), part] >= floor
            if not open_.any():
                break
            for p in np.unique(part[open_]):
                rows = np.flatnonzero(open_ & (part == p))
                a, b = self.parts[p]
                score = _inner(q[rows], self.v[a:b])
                hit = (score >= floor[rows][:, None]) & (self.ids[a:b][None, :] != qid[rows][:, None])
                for i in np.flatnonzero(hit.any(axis=1)):
                    r, h = rows[i], hit[i]
                    ids, scores = np.append(best[r][0], self.ids[a:b][h]), np.append(best[r][1], score[i][h])
                    first = np.lexsort((ids, -scores))[:k]
                    best[r] = ids[first], scores[first]
                    if len(first) == k:
                        floor[r] = max(floor[r], best[r][1][-1])
        sizes = [len(x[0]) for x in best]
        return np.repeat(qid, sizes), np.concatenate([x[0] for x in best]), np.concatenate([x[1] for x in best])


def _visit(blocks: DataFrame, visits: DataFrame, pivots: Pivots, k: int) -> DataFrame:
    """``query_id, vec_id, score`` of the best of each visited block; ``visits`` has ``query_id, v, floor, block``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, block, at = [], None, None
        for batch in batches:
            names = batch.column("block").to_numpy()
            edges = np.append(np.flatnonzero(np.append(True, np.diff(names) != 0)), len(names)) if len(names) else []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                part = batch.slice(a, b - a)
                if at != names[a]:
                    rows, block, at = [], None, names[a]
                query = part.column("query").to_numpy(zero_copy_only=False)
                for kind in (False, True):
                    own = part.filter(pa.array(query == kind))
                    if not own.num_rows:
                        continue
                    ids, v, floor = own.column("id").to_numpy(), _matrix(own.column("v")), own.column("away").to_numpy()
                    if not kind:
                        rows.append((ids, v, own.column("cell").to_numpy(), floor))
                    elif rows:
                        block = block or _Block(rows, pivots)
                        for i in range(0, len(ids), STEP):
                            part_ = slice(i, i + STEP)
                            found = block.search(ids[part_], v[part_], floor[part_].copy(), k)
                            yield pa.RecordBatch.from_arrays([*map(pa.array, found)], names=["query_id", "vec_id", "score"])

    stored = blocks.select("block", F.lit(False).alias("query"), "id", "v", "cell", "away")
    asking = visits.select("block", F.lit(True), F.col("query_id"), "v", F.lit(0), F.col("floor"))
    n = max(1, blocks.agg(F.max("block")).first()[0] or 0) + 1
    tasks = min(n, max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // 8))
    dealt = stored.union(asking).repartition(tasks, "block").sortWithinPartitions("block", "query")
    return dealt.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")


def _best(rows: DataFrame, k: int) -> DataFrame:
    one = rows.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(vectors: DataFrame, key: str, vector: str, every: int, k: int) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best other vectors for each one whose key is a multiple of ``every``.

    Ties go to the smaller key; with fewer than k candidates all are returned. See :func:`quantised`
    for what takes no part. Only vectors of the same length have an inner product: each length has its own
    index. Of rows that share a key but not the vector, each is a candidate with its best score, and a query
    has the best of all its vectors. Every score is an exact integer; beyond a long it is the largest or smallest long.
    """
    rows = materialise(quantised(vectors, key, vector), "vectors")
    found = [_of_length(rows.where(F.col("size") == size).select("id", "v"), every, k) for (size,) in sorted(rows.select("size").distinct().collect())]
    if not found:
        return rows.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.col("id").alias("score"))
    if len(found) == 1:
        return _best(found[0], k).select("query_id", "rank", "vec_id", "score")
    return _best(reduce(DataFrame.union, found), k).select("query_id", "rank", "vec_id", "score")


def _of_length(rows: DataFrame, every: int, k: int) -> DataFrame:
    """``query_id, vec_id, score`` with the k best of each query, and others, among vectors ``id, v`` of one length."""
    pivots = choose_pivots(rows)
    blocks = index_blocks(rows, pivots)
    queries = blocks.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "v", F.col("block").alias("home"))
    home = queries.select("query_id", "v", F.lit(float("-inf")).alias("floor"), F.col("home").alias("block"))
    near = materialise(_visit(blocks, home, pivots, k), "near-home")
    floors = _best(near, k).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s"))
    floors = floors.select("query_id", F.when(F.col("n") >= k, F.col("s").cast("double")).otherwise(F.lit(float("-inf"))).alias("floor"))
    asked = queries.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column("v"))
                far = pivots.distances(v, False)
                n, cells = far.shape
                ids, home = (np.repeat(batch.column(c).to_numpy(), cells) for c in ("query_id", "home"))
                # Distance at which a vector would score just the floor.
                limit2 = np.einsum("ij,ij->i", v, v) + pivots.radius2 - 2 * batch.column("floor").to_numpy()
                slack = 1e-3 + 1e-6 * np.sqrt(np.einsum("ij,ij->i", v, v) + pivots.radius2)  # rounding of the distances
                limit = np.sqrt(np.maximum(limit2, 0.0)) * (1 + 1e-6) + slack
                columns = [ids, home, np.tile(np.arange(cells, dtype="int32"), n), far.ravel(), np.repeat(limit, cells)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=["query_id", "home", "cell", "far", "limit"])

    reached = asked.select("query_id", "v", "home", "floor").mapInArrow(reach, "query_id bigint, home int, cell int, far double, `limit` double")
    annuli = blocks.groupBy("block", "cell").agg(F.min("away").alias("low"), F.max("away").alias("high"))
    inside = (F.col("low") - F.col("far") <= F.col("limit")) & (F.col("far") - F.col("high") <= F.col("limit")) & (F.col("block") != F.col("home"))
    routes = reached.join(materialise(annuli, "annuli"), "cell").where(inside).select("query_id", "home", "block").distinct()
    visits = routes.join(asked, ["query_id", "home"]).select("query_id", "v", "floor", "block")
    return near.union(_visit(blocks, visits, pivots, k))
