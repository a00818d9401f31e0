"""Query-conditioned, time-decayed attention over histories, and the user vectors built from it.

Item vectors do not travel to history entries. Instances with their narrow histories and one query
vector meet the catalog where it is: a small one (its bytes are checked) by broadcast, a larger one tile
by tile, each tile turning its part of a history into a state. States merge in any order: for ``soft``
and ``mean`` the largest logit, the sum of exponentials and the weighted sum of vectors, for
``hard`` the entries with the largest logits and their vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions import vectors as vx
from footfall.operators.sequences import history_rows
from footfall.plans import tiles as tl
from footfall.plans.scratch import materialise

TOP_K, RESIDUAL_ALPHA = 5, 0.4
GAMMA = TAU = log(2.0)  # softplus(0): the learned scalars before any training
_MIN_WEIGHT = 1e-12
# Numbers of the vectors gathered at once inside a task.
_CELLS = 4_000_000

_RESULT = "instance_id bigint, positions array<int>, iids array<bigint>, similarities array<double>, logits array<double>, weights array<double>, context_vec array<double>"


class _States:
    """Attention states of instances, in numpy; entries of an instance stand together.

    ``owner`` names the state of each entry. A state of ``hard`` holds its best entries (``best_owner``,
    ``best``: their positions, logits and vectors), one of the other modes ``peak``, ``total`` and ``sums``.
    """

    def __init__(self, ids, owner, positions, iids, similarities, logits, peak, total, sums, best_owner, best, best_logits, best_values):  # noqa: ANN001
        self.ids, self.owner, self.positions, self.iids = ids, owner, positions, iids
        self.similarities, self.logits, self.peak, self.total, self.sums = similarities, logits, peak, total, sums
        self.best_owner, self.best, self.best_logits, self.best_values = best_owner, best, best_logits, best_values
        self.rows = np.arange(len(ids))  # the row of its batch that each state is of


def _lists(owner: np.ndarray, flat: np.ndarray, n: int) -> pa.Array:
    """A list column from values that stand together by owner."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), pa.array(flat))


def _rows(matrix: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]), pa.array(matrix.ravel()))


def _largest(owner: np.ndarray, positions: np.ndarray, logits: np.ndarray, k: int) -> np.ndarray:
    """The places of each owner's k largest logits, the earlier position first among equals."""
    order = np.lexsort((positions, -logits, owner))
    return order[np.arange(len(order)) - np.searchsorted(owner, owner[order]) < k]


def _partial(batch: pa.RecordBatch, vectors: tl.Vectors, mode: str, gamma: float, k: int) -> Iterator[_States]:
    """The states of rows ``instance_id, query_vec, positions, iids, deltas`` over the items among ``vectors``."""
    if not batch.num_rows or not len(vectors.ids):
        return
    query = vx.matrix(batch.column("query_vec"))
    sizes = batch.column("iids").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = [batch.column(c).flatten() for c in ("positions", "iids", "deltas")]
    iids = flat[1].fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
    place, known = vectors.places(iids)
    owner = np.repeat(np.arange(len(sizes)), sizes)[known]
    positions, deltas = (x.to_numpy(zero_copy_only=False)[known] for x in (flat[0], flat[2]))
    place, iids, ids = place[known], iids[known], batch.column("instance_id").to_numpy()
    keys, values = vectors.matrices[0], vectors.matrices[-1]
    start = 0
    while start < len(owner):  # whole instances, as many as the gathered vectors allow
        stop = min(len(owner), start + max(1, _CELLS // max(1, keys.shape[1])))
        stop = int(np.searchsorted(owner, owner[stop - 1], "right" if stop == len(owner) or owner[stop - 1] == owner[start] else "left"))
        part = slice(start, stop)
        start = stop
        rows, own = np.unique(owner[part], return_inverse=True)
        head = np.searchsorted(own, np.arange(len(rows)))
        at, where = place[part], positions[part]
        similarity = np.einsum("ij,ij->i", query[owner[part]], keys[at]) / np.sqrt(keys.shape[1])
        logits = similarity - gamma * np.log1p(np.maximum(deltas[part], 0.0))
        peak, total, sums = np.zeros(len(rows)), np.zeros(len(rows)), np.zeros((len(rows), values.shape[1]))
        best = np.zeros(0, np.int64)
        if mode == "hard":
            best = _largest(own, where, logits, k)
        else:
            if mode == "soft":
                peak = np.maximum.reduceat(logits, head)
            exps = np.exp(logits - peak[own]) if mode == "soft" else np.ones(len(own))
            total = np.add.reduceat(exps, head)
            sums = np.add.reduceat(exps[:, None] * values[at], head)
        states = _States(ids[rows], own, where, iids[part], similarity, logits, peak, total, sums, own[best], where[best], logits[best], values[at[best]])
        states.rows = rows
        yield states


def _finished(s: _States, mode: str, tau: float) -> pa.RecordBatch:
    """Weights and context vectors; entries in the order of their positions."""
    order = np.lexsort((s.positions, s.owner))
    n = len(s.ids)
    if mode == "hard":
        exps = s.best_logits / (tau + 1e-3)
        head = np.searchsorted(s.best_owner, np.arange(n))
        exps = np.exp(exps - np.maximum.reduceat(exps, head)[s.best_owner])
        share = exps / np.add.reduceat(exps, head)[s.best_owner]
        context = np.add.reduceat(share[:, None] * s.best_values, head)
        # The best entries are among the entries: a key of owner and position finds them.
        wide = int(s.positions.max()) + 1
        weights = np.zeros(len(order))
        weights[np.searchsorted((s.owner * wide + s.positions)[order], s.best_owner * wide + s.best)] = share
    else:
        exps = np.exp(s.logits - s.peak[s.owner]) if mode == "soft" else np.ones(len(order))
        weights, context = (exps / s.total[s.owner])[order], s.sums / s.total[:, None]
    flat = [_lists(s.owner, x[order], n) for x in (s.positions.astype(np.int32), s.iids, s.similarities, s.logits)]
    names = ["instance_id", "positions", "iids", "similarities", "logits", "weights", "context_vec"]
    return pa.RecordBatch.from_arrays([pa.array(s.ids), *flat, _lists(s.owner, weights, n), _rows(context)], names=names)


def attend(
    instances: DataFrame, items: DataFrame, queries: DataFrame | None, mode: str = "hard", gamma: float = GAMMA, k: int = TOP_K, tau: float = TAU,
    key: str = "key_vec", value: str = "value_vec", broadcast_bytes: int = tl.BROADCAST_BYTES, tile_rows: int = tl.PORTION_ROWS,
    keep: Sequence[str] = (), named: Mapping[str, str] | None = None,
) -> DataFrame:
    """``instance_id, positions, iids, similarities, logits, weights, context_vec`` per instance.

    Similarity is query . key / sqrt(d); the logit subtracts ``gamma * log1p(days)``. Weights sum
    to 1: ``soft`` is the softmax of the logits, ``mean`` is equal weights, ``hard`` the softmax
    at temperature ``tau`` over the ``k`` largest logits (the earlier position wins ties). The
    context is the weighted sum of the value vectors.

    ``queries`` is ``instance_id, query_vec``; without it ``instances`` hold ``query_vec`` themselves and,
    beside a small catalog, stay where they are. ``items`` is ``iid`` with the two vector columns; give the
    same one as key and value to carry it once. History entries of items without vectors are left
    out, as are instances without any entry or without a query; :func:`unmatched` counts both. A catalog of
    at most ``broadcast_bytes`` is looked up where the instances are. Beyond it instances are read several times and
    move once, into portions of about ``tile_rows``, those with equal ``uid`` (if they have it) together, and the vectors that a
    portion names come to it. The columns ``keep`` of the instances follow.

    ``named`` maps new columns to columns of item ids: they get the items' key vectors and may be named in ``keep``;
    ``query_vec`` may be one. Instances without one of them are left out. Ids of ``items`` must be unique then.
    """
    if mode not in ("soft", "mean", "hard"):
        raise ValueError(f"unknown attention mode: {mode}")
    named = dict(named or {})
    held = queries is None and "query_vec" not in named
    catalog = tl.store(items, key, value)
    kind = items.schema[key].dataType
    dtype = np.float32 if kind.elementType.typeName() == "float" else np.float64
    types = {c: (kind if c in named else instances.schema[c].dataType).simpleString() for c in keep}
    result = ", ".join([_RESULT, *(f"`{c}` {types[c]}" for c in keep)])

    def columns(at: Callable[[str], Column]) -> list[Column]:
        entry = F.zip_with(at("history_iids"), at("history_timestamps"), lambda _, then: vx.elapsed_days(at("target_timestamp"), then))
        made = [F.sequence(F.lit(0), F.size(at("history_iids")) - 1).alias("positions"), at("history_iids").alias("iids"), entry.alias("deltas")]
        plain = dict.fromkeys(["instance_id", *([] if "query_vec" in named else ["query_vec"]), *named.values(), *(c for c in keep if c not in named)])
        return [*made, *(at(c).alias(c) for c in plain)]

    def look_up(vectors: tl.Vectors, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        batch = _with_vectors(batch, vectors, named, dtype)
        for states in _partial(batch, vectors, mode, gamma, k):
            own = _finished(states, mode, tau)
            kept = batch.select(list(keep)).take(pa.array(states.rows))
            yield pa.RecordBatch.from_arrays([*own.columns, *kept.columns], names=[*own.schema.names, *keep])

    raw = ["instance_id", "history_iids", "history_timestamps", "target_timestamp"]
    raw = dict.fromkeys([*raw, *(["query_vec"] if held else []), *named.values(), *(c for c in keep if c not in named and (held or c != "query_vec"))])
    near = "uid" if "uid" in instances.columns else "instance_id"
    whole = instances.where(F.size("history_iids") > 0).select(*dict.fromkeys([*raw, near]))
    if held:
        whole = whole.where("query_vec is not null")
    elif queries is not None:
        whole = whole.join(queries.select("instance_id", "query_vec"), "instance_id")

    if catalog.fits(broadcast_bytes):
        shared = catalog.shared()

        def beside_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vectors = tl.Vectors(*shared.value)
            for batch in batches:
                yield from look_up(vectors, batch)

        return whole.select(*columns(F.col)).mapInArrow(beside_all, result)

    if queries is not None:
        whole = materialise(whole, "asking")
    wanted = F.concat(F.col("history_iids"), F.array(*(F.col(c).cast("bigint") for c in named.values())).cast("array<bigint>"))
    return tl.beside_needed(whole, wanted, near, "instance_id", catalog, look_up, result, columns, tile_rows)


def _with_vectors(batch: pa.RecordBatch, vectors: tl.Vectors, named: Mapping[str, str], dtype: type) -> pa.RecordBatch:
    """The rows whose ``named`` ids all have a vector, with the vectors."""
    if not named or not batch.num_rows:
        return batch
    places, there = {}, np.full(batch.num_rows, len(vectors.ids) > 0)
    for out, column in named.items():
        ids = batch.column(column)
        places[out], known = vectors.places(ids.fill_null(0).to_numpy(zero_copy_only=False))
        there &= known & ids.is_valid().to_numpy(zero_copy_only=False)
    batch = batch.filter(pa.array(there))
    if batch.num_rows:
        for out, place in places.items():
            batch = batch.append_column(out, _rows(vectors.matrices[0][place[there]].astype(dtype, copy=False)))
    return batch


def unmatched(instances: DataFrame, items: DataFrame, queries: DataFrame) -> DataFrame:
    """``n_without_query, n_without_vector``: instances without a query vector, and history entries without an item vector."""
    alone = instances.join(queries.select("instance_id"), "instance_id", "left_anti").agg(F.count(F.lit(1)).alias("n_without_query"))
    entries = history_rows(instances).join(items.select("iid"), "iid", "left_anti").agg(F.count(F.lit(1)).alias("n_without_vector"))
    return alone.join(F.broadcast(entries))


def attention_rows(attended: DataFrame) -> DataFrame:
    """``instance_id, position, iid, similarity, logit, weight``: one row per history entry."""
    entries = F.explode(F.arrays_zip("positions", "iids", "similarities", "logits", "weights"))
    names = {"positions": "position", "iids": "iid", "similarities": "similarity", "logits": "logit", "weights": "weight"}
    return attended.select("instance_id", entries.alias("_e")).select(
        "instance_id", *[F.col(f"_e.{c}").alias(n) for c, n in names.items()]
    )


def last_vectors(instances: DataFrame, items: DataFrame, vector: str = "vec") -> DataFrame:
    """``instance_id, last_vec``: the vector of the most recent history item."""
    last = instances.select("instance_id", F.element_at("history_iids", -1).alias("iid"))
    found = tl.store(items, vector).beside().withColumnRenamed(vector, "last_vec")
    return last.join(found, "iid").select("instance_id", "last_vec")


def user_vectors(
    context: DataFrame, last: DataFrame | None = None, queries: DataFrame | None = None, mode: str = "context",
    gate: float = 0.5, alpha: float = RESIDUAL_ALPHA, normalise: bool = True, keep: Sequence[str] = (),
) -> DataFrame:
    """``instance_id, user_vec`` by fusion mode.

    ``context``: the attention context. ``last``: the last history vector. ``gated``:
    ``gate * last + (1 - gate) * context``. ``residual``: ``query + alpha * context``. With ``context`` its columns ``keep`` follow.
    """
    if mode == "context":
        fused = context.select("instance_id", F.col("context_vec").alias("user_vec"), *keep)
    elif mode == "last":
        fused = last.select("instance_id", F.col("last_vec").alias("user_vec"))
    elif mode == "gated":
        mixed = vx.blend(F.col("last_vec"), gate, F.col("context_vec"), 1.0 - gate)
        fused = context.join(last, "instance_id").select("instance_id", mixed.alias("user_vec"))
    elif mode == "residual":
        mixed = vx.blend(F.col("query_vec"), 1.0, F.col("context_vec"), alpha)
        fused = context.join(queries, "instance_id").select("instance_id", mixed.alias("user_vec"))
    else:
        raise ValueError(f"unknown fusion mode: {mode}")
    return fused.withColumn("user_vec", vx.unit(F.col("user_vec"))) if normalise else fused


def attention_diagnostics(attended: DataFrame) -> DataFrame:
    """Per instance: entropy, effective count, top-1 mass and margin, top-3 positions, similarities.

    ``sim_last`` is the similarity of the most recent row, ``sim_max`` the largest one.
    """
    clamped = F.transform("weights", lambda w: F.greatest(w, F.lit(_MIN_WEIGHT)))
    entropy = -F.aggregate(clamped, F.lit(0.0), lambda a, w: a + w * F.log(w))
    entries = F.arrays_zip(F.transform("weights", lambda w: -w).alias("w"), F.col("positions").alias("p"))
    by_weight = F.array_sort(F.transform(entries, lambda e: F.struct(e["w"].alias("w"), e["p"].alias("p"))))
    by_place = F.array_sort(F.arrays_zip("positions", "similarities"))
    stats = attended.select(
        "instance_id", entropy.alias("entropy"), by_weight.alias("_w"), by_place.alias("_s"), "similarities"
    )
    place = lambda i: F.get(F.col("_w"), F.lit(i))
    return stats.select(
        "instance_id",
        "entropy",
        F.exp("entropy").alias("effective_n"),
        (-place(0)["w"]).alias("top1_mass"),
        (F.coalesce(place(1)["w"], F.lit(0.0)) - place(0)["w"]).alias("top1_top2_margin"),
        F.transform(F.slice("_w", 1, 3), lambda r: r["p"]).alias("top_positions"),
        F.element_at("_s", -1)["similarities"].alias("sim_last"),
        F.array_max("similarities").alias("sim_max"),
    )
