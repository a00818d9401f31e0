"""Behaviour vectors: factors of implicit feedback by alternating least squares.

Half a step solves one small system per key (a user or an item) from the factors of its partners. The
pairs of a side are stored in the order of (key, partner), so the pairs of nearly every key lie together in one
task, which adds up its normal equations and solves them at once: no shuffle. A key that is cut by a
task border, as one with a third of all pairs is many times, leaves one partial system per task; these are added in
a tree and solved afterwards. Beside them stands one matrix shared by all systems, the inner products of all
factors of the other side.

Factors of a side with many keys do not travel to the pairs of one with few: the pairs of each many-side key are stored as
lists, meet its factors once a step, and a task adds up the systems of all few-side keys that it sees. Neither
factors nor pairs go through the driver then.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.functions.vectors import matrix
from footfall.operators.learned import FAN, gram_parts, summed_matrices
from footfall.plans import tiles
from footfall.plans.positions import with_group_position
from footfall.plans.scratch import materialise

_OUT = "id bigint, vec array<double>, node int, state array<double>"
# Factors up to this many bytes are looked up, every half step anew; systems up to this many are added up in one task.
LOOKED_UP, SYSTEMS = 8 * 1024 * 1024, 64 * 1024 * 1024
# Pairs of a list, and factors gathered at once.
_LIST, _CELLS = 1_000, 1_000_000


def _lists(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(rows).ravel()))


def start_vectors(ids: DataFrame, rank: int, seed: int) -> DataFrame:
    """``iid, vec``: a start from hashes of the id, the same however the rows are partitioned; entries within 1 / sqrt(rank)."""
    cell = lambda j: F.xxhash64("iid", j, F.lit(seed)).cast("double") / F.lit(2.0**63 * rank**0.5)
    return ids.select("iid", F.transform(F.sequence(F.lit(1), F.lit(rank)), cell).alias("vec"))


def _partials(ids: np.ndarray, weight: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place of each run of equal ids, and its state: sum w y y', sum (1 + w) y, and the number of pairs."""
    starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    rank = vectors.shape[1]
    states = np.empty((len(starts), rank * rank + rank + 1))
    for state, a, b in zip(states, starts, np.append(starts[1:], len(ids)), strict=True):
        v, w = vectors[a:b], weight[a:b]
        state[: rank * rank] = ((v.T * w) @ v).ravel()
        state[rank * rank : -1] = (1 + w) @ v
        state[-1] = b - a
    return starts, states


def _solved(states: np.ndarray, gram: np.ndarray, penalty: float) -> np.ndarray:
    """The factors of each state; the penalty grows with the number of pairs."""
    rank = len(gram)
    squares = states[:, : rank * rank].reshape(-1, rank, rank) + gram + (penalty * states[:, -1])[:, None, None] * np.eye(rank)
    return np.linalg.solve(squares, states[:, rank * rank : -1, None])[..., 0]


def _half_step(look_up: Callable[[pa.RecordBatch], np.ndarray], gram: np.ndarray, penalty: float):  # noqa: ANN202
    """Batches of ``id, partners, weight, node, ..`` in the order of id to solved keys and partial states of cut ones."""

    def out(ids: np.ndarray, partners: np.ndarray, states: np.ndarray, node: int) -> Iterator[pa.RecordBatch]:
        whole = states[:, -1] == partners
        for kind in (True, False):
            pick = whole == kind
            if not pick.any():
                continue
            vec = _lists(_solved(states[pick], gram, penalty)) if kind else pa.nulls(pick.sum(), pa.list_(pa.float64()))
            state = pa.nulls(pick.sum(), pa.list_(pa.float64())) if kind else _lists(states[pick])
            columns = [pa.array(ids[pick]), vec, pa.array(np.full(pick.sum(), node, np.int32)), state]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "vec", "node", "state"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, node = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch.column("node")[0].as_py()
            ids, partners = batch.column("id").to_numpy(), batch.column("partners").to_numpy()
            starts, states = _partials(ids, batch.column("weight").to_numpy(), look_up(batch))
            keys, sizes = ids[starts], partners[starts]
            if held and held[0][0] == keys[0]:
                states[0] += held[2][0]
            elif held:
                yield from out(*held, node)
            yield from out(keys[:-1], sizes[:-1], states[:-1], node)
            held = keys[-1:], sizes[-1:], states[-1:]
        if held:
            yield from out(*held, node)

    return run


def _side(counts: DataFrame, key: str, partner: str) -> DataFrame:
    """``id, partner, partners, weight`` stored in the order of (key, partner)."""
    placed = with_group_position(counts, [key], [partner], f"pairs-of-{key}")
    rows = placed.select(F.col(key).alias("id"), F.col(partner).alias("partner"), F.col("group_size").alias("partners"), "weight")
    return materialise(rows.repartitionByRange("id", "partner").sortWithinPartitions("id", "partner"), f"sorted-pairs-{key}")


def _lists_by_partner(counts: DataFrame, key: str, partner: str) -> DataFrame:
    """``partner, ids, weights``: the pairs of each partner in lists of about ``_LIST`` at most, stored."""
    sizes = counts.groupBy(partner).agg(F.ceil(F.count(F.lit(1)) / _LIST).alias("_parts"))
    rows = counts.join(sizes, partner).withColumn("_part", F.pmod(F.xxhash64(key), F.col("_parts")))
    pairs = F.sort_array(F.collect_list(F.struct(F.col(key).alias("id"), "weight")))
    rows = rows.groupBy(F.col(partner).alias("partner"), "_part").agg(pairs.alias("_p"))
    return materialise(rows.select("partner", F.col("_p.id").alias("ids"), F.col("_p.weight").alias("weights")), f"lists-of-{partner}")


def _gathered(lists: DataFrame, factors: DataFrame, rank: int, penalty: float) -> DataFrame:
    """:func:`_fitted` from lists of pairs; a task holds the systems of all keys it sees."""
    factors = materialise(factors, "factors")
    parts = materialise(gram_parts(factors, "vec", "vec"), "factor-gram")
    gram = matrix(summed_matrices(parts).orderBy("i").toArrow()["v"])[:, rank:]  # rank x rank
    # Neither side may be broadcast, which would send it through the driver every half step.
    met = lists.hint("merge").join(factors.withColumnRenamed("iid", "partner"), "partner").select("ids", "weights", "vec", F.spark_partition_id().alias("node"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        systems: dict[int, np.ndarray] = {}
        node = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch.column("node")[0].as_py()
            vectors, ids, weights = matrix(batch.column("vec")), batch.column("ids").flatten().to_numpy(), batch.column("weights").flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), batch.column("ids").value_lengths().to_numpy())
            order = np.argsort(ids, kind="stable")
            for start in range(0, len(order), max(1, _CELLS // rank)):
                at = order[start : start + max(1, _CELLS // rank)]
                starts, states = _partials(ids[at], weights[at], vectors[row[at]])
                for key, state in zip(ids[at][starts].tolist(), states, strict=True):
                    if key in systems:
                        systems[key] += state
                    else:
                        systems[key] = state.copy()
        if systems:
            keys = np.array(list(systems))
            for start in range(0, len(keys), _LIST):
                own = keys[start : start + _LIST]
                states = _lists(np.stack([systems[k] for k in own.tolist()]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), node, np.int32)), pa.array(own), states], names=["node", "i", "v"])

    parts = materialise(met.mapInArrow(add, "node int, i bigint, v array<double>"), "factor-systems")
    return _finished(summed_matrices(parts), gram, penalty)


def _finished(states: DataFrame, gram: np.ndarray, penalty: float) -> DataFrame:
    """``iid, vec`` from whole states ``i, v``."""

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vec = _lists(_solved(matrix(batch.column("v")), gram, penalty))
                yield pa.RecordBatch.from_arrays([batch.column("i"), vec], names=["iid", "vec"])

    return states.mapInArrow(finish, "iid bigint, vec array<double>")


def _fitted(side: DataFrame, factors: DataFrame, keys: int, rank: int, penalty: float, most: int, tile_rows: int) -> DataFrame:
    """``iid, vec`` of the keys of ``side`` from the factors of their partners, of which there are ``keys``."""
    catalog = tiles.StoredCatalog(factors, keys, keys * (rank + 1) * 8, ("vec",))
    if catalog.fits(most):
        shared = catalog.shared()
        gram = shared.value[1][0].T @ shared.value[1][0]
    else:
        catalog = replace(catalog, table=materialise(factors, "factors"))
        parts = materialise(gram_parts(catalog.table, "vec", "vec"), "factor-gram")
        gram = matrix(summed_matrices(parts).orderBy("i").toArrow()["v"])[:, rank:]  # rank x rank
    here = F.spark_partition_id().alias("node")
    if catalog.fits(most):

        def look_up(batch: pa.RecordBatch) -> np.ndarray:
            ids, found = shared.value
            vectors = tiles.Vectors(ids, found)
            return vectors.matrices[0][vectors.places(batch.column("partner").to_numpy())[0]]

        met = side.select("id", "partners", "weight", here, "partner")
    else:
        n = tiles.n_tiles(catalog, tile_rows)

        def give(vectors: tiles.Vectors, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            at, _ = vectors.places(batch.column("partner").to_numpy())
            columns = [*(batch.column(c) for c in ("id", "partner", "partners", "weight")), _lists(vectors.matrices[0][at])]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "partner", "partners", "weight", "vec"])

        rows = side.withColumn("tile", tiles.tile_of("partner", n))
        dealt = tiles.past_tiles(rows, catalog, n, give, "id bigint, partner bigint, partners bigint, weight double, vec array<double>")
        dealt = dealt.repartitionByRange("id", "partner").sortWithinPartitions("id", "partner")
        met = dealt.select("id", "partners", "weight", here, "vec")
        look_up = lambda batch: matrix(batch.column("vec"))

    step = materialise(met.mapInArrow(_half_step(look_up, gram, penalty), _OUT), "factor-step")
    nodes = step.where(F.col("vec").isNull()).agg(F.max("node")).first()[0]
    whole = step.where(F.col("vec").isNotNull()).select(F.col("id").alias("iid"), "vec")
    cut = step.where(F.col("vec").isNull()).select("node", F.col("id").alias("i"), F.col("state").alias("v"))
    if nodes is None:
        return whole
    return whole.union(_finished(summed_matrices(cut, FAN, nodes + 1), gram, penalty))


def behaviour_vectors(
    df: DataFrame, rank: int = 32, iterations: int = 10, seed: int = 42, user: str = "uid", item: str = "iid",
    penalty: float = 0.1, alpha: float = 1.0, most: int = LOOKED_UP, tile_rows: int = tiles.TILE_ROWS, systems: int = SYSTEMS,
) -> tuple[DataFrame, DataFrame]:
    """``iid, vec`` of items and ``uid, vec`` of users: factors of implicit feedback, repeats as strength.

    A pair seen n times has preference 1 with confidence 1 + ``alpha`` * n, all other pairs preference 0 with
    confidence 1; a key's penalty is ``penalty`` times its number of partners. Ids are any integers; rows with a null
    id are left out; without rows both tables are empty. Factors of up to ``most`` bytes are looked up
    where the pairs are; larger ones stay and give partial systems if those of the other side take up to ``systems`` bytes,
    or else come in tiles (:mod:`footfall.plans.tiles`).
    """
    known = df.where(F.col(user).isNotNull() & F.col(item).isNotNull())
    counts = known.groupBy(F.col(user).cast("bigint").alias("_u"), F.col(item).cast("bigint").alias("_i"))
    counts = materialise(counts.agg((F.count(F.lit(1)) * F.lit(float(alpha))).alias("weight")), "pair-counts")
    ids = [materialise(counts.select(F.col(c).alias("iid")).distinct(), "ids") for c in ("_u", "_i")]
    users, items = (start_vectors(own, rank, seed) for own in ids)
    n_users, n_items = (own.count() for own in ids)
    if n_users:

        def step(key: str, partner: str, n_keys: int, n_partners: int) -> Callable[[DataFrame], DataFrame]:
            if n_partners * (rank + 1) * 8 > most and n_keys * (rank * rank + rank + 1) * 8 <= systems:
                pairs = _lists_by_partner(counts, key, partner)
                return lambda factors: _gathered(pairs, factors, rank, penalty)
            pairs = _side(counts, key, partner)
            return lambda factors: _fitted(pairs, factors, n_partners, rank, penalty, most, tile_rows)

        to_items, to_users = step("_i", "_u", n_items, n_users), step("_u", "_i", n_users, n_items)
        for _ in range(iterations):
            items = to_items(users)
            users = to_users(items)
    single = F.col("vec").cast("array<float>").alias("vec")
    return items.select(F.col("iid").alias("iid"), single), users.select(F.col("iid").alias("uid"), single)
