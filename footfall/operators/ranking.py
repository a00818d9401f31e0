"""Scores and full-catalog ranks.

A dual score ``tau_beh * u.e + tau_sem * cos(q, i)`` is one inner product of concatenated
vectors, so ranking only ever sees one vector per instance and one per item.

No score matrix is stored or shuffled and nothing is sorted: an item's rank is one plus the
number of items that beat it. The catalog is walked in blocks of falling norm. No score exceeds the
product of both norms, so a block none of whose items can beat an instance's target (or its k-th best
item so far) is counted as zero without a product. Products of blocks are taken in single precision;
where their error bound leaves open on which side of the target an item falls, its score is
taken again in double precision. Scores are rounded to ``DIGITS`` before they are
compared, since two ways to sum an inner product differ in their last bits.

A small catalog (its bytes are checked) is broadcast and instances stay where they are. For a larger
one instances are dealt once, into slices of instances that need about the same norm to be beaten, and a block
travels only to the slices that it can change; no instance is ever repeated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.functions import vectors as vx
from footfall.plans.positions import with_global_position
from footfall.plans.scratch import materialise
from footfall.plans.selection import top_n
from footfall.plans.tiles import BROADCAST_BYTES, TILE_ROWS, StoredCatalog, runs, store, unpacked

DIGITS = 9
# Items of a block, and instances whose bounds are looked at together.
BLOCK_ROWS = 1024
# Most times the rows of a tile that a slice of instances holds, and the rows below which a slice costs less than reading its blocks.
WIDER, NARROW = 8, 2048
# Bytes of a score block, which should stay in a core's cache: with more items fewer instances are scored at once.
_SCORE_BYTES = 2 * 1024 * 1024
# Rounding of scores and of the bound.
_SLACK = 1e-8
# Beyond it products are taken in double precision alone.
_LARGE = 1e30
# Share of the largest norm by which the items' second halves may miss one multiple of their first ones for both to be multiplied as one.
_FOLD = 1e-4
# Numbers of the vectors gathered at once for scores in double precision.
_CELLS = 4_000_000


def score_vector(behaviour: str | None, semantic: str | None, tau_beh: float = 1.0, tau_sem: float = 1.0) -> Column:
    """The scaled behaviour part followed by the scaled, normalised semantic part.

    Give the scales on one side only. ``None`` leaves a term out, which is how the query-only
    and behaviour-only modes are scored.
    """
    parts = []
    if behaviour is not None:
        parts.append(vx.scale(F.col(behaviour), tau_beh))
    if semantic is not None:
        parts.append(vx.scale(vx.unit(F.col(semantic)), tau_sem))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def score_vectors(vectors: DataFrame, key: str, behaviour: str | None, semantic: str | None, tau_beh: float = 1.0, tau_sem: float = 1.0) -> DataFrame:
    """``key, vec`` with :func:`score_vector`."""
    return vectors.select(key, score_vector(behaviour, semantic, tau_beh, tau_sem).alias("vec"))


def pair_scores(pairs: DataFrame, instance_vectors: DataFrame, item_vectors: DataFrame, item: str, out: str) -> DataFrame:
    """Add ``out``: the score of ``(instance_id, item)`` pairs; vectors are joined last and dropped.

    A small catalog (its bytes are checked) is broadcast, so that pairs move only to the instances' vectors.
    """
    left = instance_vectors.select("instance_id", F.col("vec").alias("_u"))
    right = store(item_vectors, "vec").beside().select(F.col("iid").alias(item), F.col("vec").alias("_e"))
    joined = pairs.join(right, item).join(left, "instance_id")
    return joined.withColumn(out, vx.dot("_u", "_e")).select(*pairs.columns, out)


def training_scores(pairs: DataFrame, item_vectors: DataFrame | None, tau_beh: float = 1.0, tau_sem: float = 1.0) -> DataFrame:
    """Joint and attention-only scores of positive and negative items.

    ``pairs`` is ``instance_id, target_iid, negative_iid`` beside the instance's ``vec`` for the joint score and
    ``act_vec`` for the attention-only one; ``item_vectors`` holds both for items. The catalog is joined once per
    role (a small one by broadcast, so that pairs stay where they are) and all four products are taken in one pass.

    Without ``item_vectors`` pairs hold ``user_vec, query_vec, pos_vec, neg_vec`` instead, one vector serving both terms of an item;
    the joint score is then the sum of its two terms, scaled by ``tau_beh`` and ``tau_sem``, and no vectors are concatenated.
    """
    if item_vectors is None:
        return _held_scores(pairs, tau_beh, tau_sem)
    catalog = store(item_vectors, "vec", "act_vec").beside()

    def side(item: str, prefix: str) -> DataFrame:
        return catalog.select(
            F.col("iid").alias(item), F.col("vec").alias(f"_{prefix}"), F.col("act_vec").alias(f"_{prefix}_act")
        )

    joined = (
        pairs.join(side("target_iid", "pos"), "target_iid")
        .join(side("negative_iid", "neg"), "negative_iid")
    )
    return joined.select(
        *(c for c in pairs.columns if c not in ("vec", "act_vec")),
        vx.dot("vec", "_pos").alias("pos_score"),
        vx.dot("vec", "_neg").alias("neg_score"),
        vx.dot("act_vec", "_pos_act").alias("act_pos_score"),
        vx.dot("act_vec", "_neg_act").alias("act_neg_score"),
    )


def _held_scores(pairs: DataFrame, tau_beh: float, tau_sem: float) -> DataFrame:
    act = {side: vx.dot("user_vec", f"{side}_vec") for side in ("pos", "neg")}
    joint = {side: act[side] * tau_beh + vx.cosine("query_vec", f"{side}_vec") * tau_sem for side in act}
    return pairs.select(
        *(c for c in pairs.columns if c not in ("user_vec", "query_vec", "pos_vec", "neg_vec")),
        *(joint[side].alias(f"{side}_score") for side in act),
        *(act[side].alias(f"act_{side}_score") for side in act),
    )


class _Block:
    """Items of a catalog with their largest norm."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        if (ids[1:] < ids[:-1]).any():
            order = np.argsort(ids, kind="stable")
            ids, vectors = ids[order], vectors[order]
        self.ids, self.vectors = ids, vectors
        self.norm = float(np.sqrt(np.einsum("ij,ij->i", vectors, vectors).max(initial=0.0)))

    def folded(self) -> tuple[np.ndarray, float, float] | None:
        """First halves of the items, a factor, and how far a second half is from that multiple of its first one, if not far.

        So it is where both terms of a score use the same vector and a block's norms are near, as those of a large catalog are.
        """
        half, odd = divmod(self.vectors.shape[1], 2)
        first, second = self.vectors[:, :half], self.vectors[:, half : 2 * half]
        square = np.einsum("ij,ij->", first, first)
        if odd or not square > 0:
            return None
        factor = float(np.einsum("ij,ij->", first, second) / square)
        rest = second - factor * first
        apart = float(np.sqrt(np.einsum("ij,ij->i", rest, rest).max()))
        return (first, factor, apart) if apart <= _FOLD * self.norm and abs(factor) < 1e6 else None

    def scores(self, walk: _Walk, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Instances, their scores of all items and the error of these, some at a time; masked items score -inf."""
        mine, factor, apart = self.vectors, 0.0, 0.0
        folded = self.folded() if self.norm < _LARGE else None
        if folded:
            mine, factor, apart = folded
        error = ((mine.shape[1] + 4) * 2.0**-24 * 1.01 * (1 + abs(factor)) * self.norm + 1.01 * apart) * walk.norms + _SLACK
        narrow = self.norm < _LARGE and bool((walk.norms[rows] < _LARGE).all() and (error[rows] < _LARGE).all())
        if not narrow:
            mine, folded, error = self.vectors, None, np.full(len(error), _SLACK)
        mine = mine.astype(np.float32) if narrow else mine
        half = mine.shape[1]
        own, at = walk.masked(self.ids, rows)
        step = max(1, _SCORE_BYTES // (4 * max(1, len(self.ids))))
        for i in range(0, len(rows), step):
            part = rows[i : i + step]
            if folded:
                whole = walk.vectors[part]
                theirs = (whole[:, :half] + factor * whole[:, half:]).astype(np.float32)
            else:
                theirs = (walk.narrow if narrow else walk.vectors)[part]
            scores = theirs @ mine.T
            here = slice(*np.searchsorted(own, [i, i + step]))
            scores[own[here] - i, at[here]] = -np.inf
            yield part, scores, error[part]

    def exact(self, walk: _Walk, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The rounded scores of pairs of an instance and an item."""
        step = max(1, _CELLS // max(1, self.vectors.shape[1]))
        found = [np.einsum("ij,ij->i", walk.vectors[rows[i : i + step]], self.vectors[at[i : i + step]]) for i in range(0, len(rows), step)]
        return np.round(np.concatenate([np.zeros(0), *found]), DIGITS)


def _beside(scores: np.ndarray, level: np.ndarray, up: bool) -> np.ndarray:
    """A column of bounds in the precision of the scores, not below (or not above) ``level``."""
    return np.nextafter(level.astype(scores.dtype), scores.dtype.type(np.inf if up else -np.inf))[:, None]


class _Walk:
    """Instances of a batch on their way through the blocks of a catalog, in any order.

    ``hidden`` lists the items that some instance does not meet, in order, and ``hiding`` those instances, from
    ``ends[i]`` to ``ends[i + 1]`` for the i-th.
    """

    def __init__(self, part: pa.Table, hide_target: bool):
        self.ids, self.vectors = part["instance_id"].to_numpy(), vx.matrix(part["vec"])
        self.target = part["target_iid"].to_numpy()
        seen = part["seen_iids"].combine_chunks()
        sizes = seen.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        hidden = seen.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
        own = np.repeat(np.arange(len(sizes)), sizes)
        if hide_target:  # the target does not beat itself
            hidden, own = np.append(hidden, self.target), np.append(own, np.arange(len(sizes)))
        else:  # the target is never masked
            stays = hidden != self.target[own]
            hidden, own = hidden[stays], own[stays]
        order = np.argsort(hidden, kind="stable")
        self.hiding = own[order]
        self.hidden, starts = np.unique(hidden[order], return_index=True)
        self.ends = np.append(starts, len(hidden))
        self.norms = np.sqrt(np.einsum("ij,ij->i", self.vectors, self.vectors)) if len(self.ids) else np.zeros(0)
        with np.errstate(over="ignore"):
            self.narrow = self.vectors.astype(np.float32)
        self.visited = np.zeros(len(self.ids), np.int64)

    def open(self, block: _Block, level: np.ndarray) -> np.ndarray:
        """The instances whose level an item of the block may reach."""
        rows = np.flatnonzero(self.norms * block.norm * (1 + 1e-12) + _SLACK >= level)
        self.visited[rows] += 1
        return rows

    def masked(self, ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``rows``, in order, and in ``ids`` (ascending; the first of equal ones) that do not meet."""
        at = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, np.int64)
        place = np.searchsorted(self.hidden, ids[at])
        there = place < len(self.hidden)
        there[there] = self.hidden[place[there]] == ids[at[there]]
        at, place = at[there], place[there]
        sizes = self.ends[place + 1] - self.ends[place]
        own = self.hiding[np.repeat(self.ends[place] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))]
        at = np.repeat(at, sizes)
        where = np.full(len(self.ids), -1)
        where[rows] = np.arange(len(rows))
        own = where[own]
        order = np.argsort(own, kind="stable")[int((own < 0).sum()) :]
        return own[order], at[order]


class _Counting(_Walk):
    """How many items rank before the target."""

    schema = "instance_id bigint, target_iid bigint, n_better bigint, n_blocks bigint"

    def __init__(self, part: pa.Table, goals: np.ndarray):
        super().__init__(part, hide_target=True)
        self.goals, self.better = goals, np.zeros(len(self.ids), np.int64)

    def visit(self, block: _Block) -> None:
        for rows, scores, error in block.scores(self, self.open(block, self.goals)):
            low, high = _beside(scores, self.goals[rows] - error, False), _beside(scores, self.goals[rows] + error, True)
            above = (scores > high).sum(1)
            self.better[rows] += above
            unsure = np.flatnonzero((scores >= low).sum(1) != above)
            own, at = np.nonzero((scores[unsure] >= low[unsure]) & (scores[unsure] <= high[unsure]))
            own = rows[unsure[own]]
            exact, goal = block.exact(self, own, at), self.goals[own]
            ahead = (exact > goal) | ((exact == goal) & (block.ids[at] < self.target[own]))
            np.add.at(self.better, own[ahead], 1)

    def result(self) -> pa.Table:
        return pa.table({"instance_id": self.ids, "target_iid": self.target, "n_better": self.better, "n_blocks": self.visited})


class _Best(_Walk):
    """The k best items so far, lower id first among equals."""

    schema = "instance_id bigint, iid bigint, score double, n_blocks bigint"

    def __init__(self, part: pa.Table, k: int):
        super().__init__(part, hide_target=False)
        self.found = np.zeros((len(self.ids), k), np.int64)
        self.best = np.full((len(self.ids), k), -np.inf)

    def visit(self, block: _Block) -> None:
        k = self.best.shape[1]
        for rows, scores, error in block.scores(self, self.open(block, self.best[:, -1])):
            level = self.best[rows, -1] - error
            new = np.flatnonzero(np.isneginf(level))
            if len(new) and scores.shape[1] > k:  # the k-th of the block bounds them
                level[new] = -np.partition(-scores[new], k - 1, axis=1)[:, k - 1] - 2 * error[new]
            reach = scores >= _beside(scores, level, False)
            own, at = np.divmod(np.flatnonzero(reach & np.isfinite(scores) if len(new) else reach), scores.shape[1])
            if not len(own):
                continue
            exact = block.exact(self, rows[own], at)
            # The best so far and the candidates of each instance that has any; score and then id decide.
            touched, own = np.unique(own, return_inverse=True)
            touched = rows[touched]
            both = np.concatenate([self.best[touched].ravel(), exact])
            ids = np.concatenate([self.found[touched].ravel(), block.ids[at]])
            own = np.concatenate([np.repeat(np.arange(len(touched)), k), own])
            real = np.isfinite(both)
            both, ids, own = both[real], ids[real], own[real]
            order = np.lexsort((ids, -both, own))
            own, ids, both = own[order], ids[order], both[order]
            place = np.arange(len(own)) - np.searchsorted(own, own)
            own, ids, both, place = (x[place < k] for x in (own, ids, both, place))
            found, best = np.zeros((len(touched), k), np.int64), np.full((len(touched), k), -np.inf)
            found[own, place], best[own, place] = ids, both
            self.found[touched], self.best[touched] = found, best

    def result(self) -> pa.Table:
        own, at = np.nonzero(np.isfinite(self.best))
        return pa.table({"instance_id": self.ids[own], "iid": self.found[own, at], "score": self.best[own, at], "n_blocks": self.visited[own]})


def _in_blocks(ids: np.ndarray, matrices: list[np.ndarray]) -> np.ndarray:
    """Places of the items in blocks of falling norm, by id within a block, so that a block is a view of the catalog."""
    order = np.argsort(-np.einsum("ij,ij->i", matrices[0], matrices[0]), kind="stable") if len(ids) else np.zeros(0, np.int64)
    return order[np.lexsort((ids[order], np.arange(len(order)) // BLOCK_ROWS))]


def _by_broadcast(instances: DataFrame, catalog: StoredCatalog, schema: str, start: Callable) -> DataFrame:
    """Every batch of instances walks through the whole broadcast catalog."""
    shared = catalog.shared(_in_blocks)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, (vectors,) = shared.value
        blocks = [_Block(ids[i : i + BLOCK_ROWS], vectors[i : i + BLOCK_ROWS]) for i in range(0, len(ids), BLOCK_ROWS)]
        for batch in batches:
            if batch.num_rows:
                walk = start(pa.Table.from_batches([batch]), (ids, vectors))
                if walk is not None:
                    for block in blocks:
                        walk.visit(block)
                    yield from walk.result().to_batches()

    return instances.mapInArrow(stream, schema)


def _by_slices(instances: DataFrame, catalog: StoredCatalog, schema: str, start: Callable, least: Column, tile_rows: int) -> DataFrame:
    """Instances in slices by ``least``, the norm an item needs to matter to them; blocks go to the slices they can change."""
    kept = with_global_position(instances.withColumn("_least", least), ["_least", "instance_id"], "rank-instances")
    # Blocks travel once a slice: every core gets one, and with many instances a whole number of slices of at most WIDER tiles' rows.
    n, cores = max(1, kept.count()), kept.sparkSession.sparkContext.defaultParallelism
    rows = max(ceil(n / (cores * ceil(n / (cores * WIDER * tile_rows)))), min(tile_rows, NARROW))
    left = materialise(kept.withColumn("slice", F.floor(F.col("position") / rows)).drop("position"), "rank-slices")
    norm = vx.norm(F.col("vec"))
    placed = with_global_position(catalog.table.withColumn("_norm", norm), [F.col("_norm").desc(), "iid"], "rank-items")
    right = materialise(placed.withColumn("tile", F.floor(F.col("position") / BLOCK_ROWS)).drop("position"), "rank-blocks")
    # One row per slice and per block: slices in order of their least norm, and for every block how many come before it.
    slices = left.groupBy("slice").agg(F.min("_least").alias("level")).select("level", F.lit(1).alias("n"), F.lit(None).cast("bigint").alias("tile"))
    blocks = right.groupBy("tile").agg(F.max("_norm").alias("level")).select("level", F.lit(0).alias("n"), "tile")
    before = Window.orderBy("level", F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    reach = slices.union(blocks).withColumn("reached", F.sum("n").over(before)).where(F.col("tile").isNotNull() & (F.col("reached") > 0))
    reach = F.broadcast(materialise(reach.select("tile", "reached"), "rank-reach"))
    right = right.join(reach, "tile").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("reached") - 1)))
    item, row = F.struct("iid", "vec"), F.struct(*instances.columns)
    none = lambda df, c: F.lit(None).cast(df.select(c.alias("x")).schema["x"].dataType)
    both = left.select("slice", F.lit(-1).cast("bigint").alias("tile"), none(right, item).alias("item"), row.alias("row")).union(
        right.select("slice", "tile", item.alias("item"), none(left, row).alias("row"))
    )

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, walk = None, [], None
        for (part, tile), batch in runs(batches, "slice", "tile"):
            if now != part:
                if parts:
                    walk = start(pa.Table.from_batches(parts), None)
                if walk is not None:
                    yield from walk.result().to_batches()
                now, parts, walk = part, [], None
            if tile < 0:
                parts.append(unpacked(batch, "row"))
                continue
            if parts:
                walk, parts = start(pa.Table.from_batches(parts), None), []
            items = unpacked(batch, "item")
            walk.visit(_Block(items.column("iid").to_numpy(), vx.matrix(items.column("vec"))))
        if parts:
            walk = start(pa.Table.from_batches(parts), None)
        if walk is not None:
            yield from walk.result().to_batches()

    # A partition each: by a hash of so few numbers some tasks would get several slices and others none.
    return both.repartitionById(ceil(n / rows), F.col("slice").cast("int")).sortWithinPartitions("slice", "tile").mapInArrow(stream, schema)


def target_ranks(
    instances: DataFrame, instance_vectors: DataFrame, catalog: DataFrame,
    broadcast_bytes: int = BROADCAST_BYTES, tile_rows: int = TILE_ROWS, report: bool = False,
) -> DataFrame:
    """``instance_id, target_iid, rank`` of each target among all catalog items.

    ``instances`` is ``instance_id, target_iid, history_iids``; items of the (truncated) history
    are masked unless they are the target. Equal scores rank the lower id first. Instances without a
    vector or with a target outside the catalog are left out. ``report`` adds ``n_blocks``, the
    blocks of items that were multiplied with the instance's vector.
    """
    base = instances.select("instance_id", "target_iid", F.col("history_iids").alias("seen_iids"))
    ready = base.join(instance_vectors.select("instance_id", "vec"), "instance_id")
    stored = store(catalog, "vec")
    if stored.fits(broadcast_bytes):

        def start(part: pa.Table, items: tuple) -> _Counting | None:
            ids, vectors = items
            order = np.argsort(ids, kind="stable")
            place = np.searchsorted(ids, part["target_iid"].to_numpy(), sorter=order)
            known = place < len(ids)
            place = order[np.where(known, place, 0)] if len(ids) else place
            known &= (ids[place] == part["target_iid"].to_numpy()) if len(ids) else False
            part, place = part.filter(pa.array(known)), place[known]
            if not part.num_rows:
                return None
            return _Counting(part, np.round(np.einsum("ij,ij->i", vx.matrix(part["vec"]), vectors[place]), DIGITS))

        counts = _by_broadcast(ready, stored, _Counting.schema, start)
    else:
        goals = stored.table.select(F.col("iid").alias("target_iid"), F.col("vec").alias("_goal"))
        ready = ready.join(goals, "target_iid").select(
            "instance_id", "target_iid", "seen_iids", "vec", F.round(vx.dot("vec", "_goal"), DIGITS).alias("target_score")
        )
        own = vx.norm(F.col("vec"))
        least = F.when(F.col("target_score") <= _SLACK, 0.0).when(own > 0, (F.col("target_score") - _SLACK) / own * (1 - 1e-12)).otherwise(F.lit(float("inf")))
        start = lambda part, _: _Counting(part, part["target_score"].to_numpy())
        counts = _by_slices(ready, stored, _Counting.schema, start, least, tile_rows)
    return counts.select("instance_id", "target_iid", (F.col("n_better") + 1).alias("rank"), *(["n_blocks"] if report else []))


def top_items(
    instances: DataFrame, instance_vectors: DataFrame, catalog: DataFrame, k: int,
    broadcast_bytes: int = BROADCAST_BYTES, tile_rows: int = TILE_ROWS, report: bool = False,
) -> DataFrame:
    """``instance_id, place, iid, score``: the first ``k`` items of each instance's ranking.

    ``report`` adds ``n_blocks`` as in :func:`target_ranks`.
    """
    base = instances.select("instance_id", "target_iid", F.col("history_iids").alias("seen_iids"))
    ready = base.join(instance_vectors.select("instance_id", "vec"), "instance_id")
    stored = store(catalog, "vec")
    start = lambda part, _: _Best(part, k)
    if stored.fits(broadcast_bytes):
        best = _by_broadcast(ready, stored, _Best.schema, start)
    else:
        best = _by_slices(ready, stored, _Best.schema, start, F.lit(0.0), tile_rows)
    ranked = top_n(best, ["instance_id"], [F.col("score").desc(), F.col("iid").asc()], k, rank="place")
    return ranked if report else ranked.drop("n_blocks")
