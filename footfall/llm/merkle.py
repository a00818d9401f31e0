"""Merkle manifest of a dataset: a tree of digests per group of rows, and one tree over the groups.

Rows of a group are leaves in the order of their key; every ``ARITY`` consecutive nodes become the
digest of their joined hex digests until one is left. Only every ``STRIDE``-th level is stored, as
blocks of the nodes below one stored node. Proofs are taken from the top down: a block is read with the
proof of the node above it, the levels between are computed again inside the row, the siblings of
each node are emitted, and the computed nodes are gone when the row is. A block has at most
``ARITY ** STRIDE`` nodes, so a group of any size is spread over tasks, and there are as many rounds as
stored levels.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.llm.small import checked_broadcast
from footfall.plans.positions import with_global_position
from footfall.plans.scratch import materialise

#: Nodes of a run, and levels from one stored level to the next.
ARITY, STRIDE = 16, 2
BLOCK = ARITY**STRIDE
#: A tree is named by whether its group is known, and the group; null comes first and neither is null.
TREE = ["tree_known", "tree_name"]
PROOF = "array<struct<left:string,right:string>>"


def digest_of(*inputs: Column) -> Column:
    """Lowercase hex SHA-256 of the inputs one after another."""
    return F.sha2(F.concat(*inputs), 256)


def leaf_of(*columns: Column) -> Column:
    """The leaf of a row: each value as byte count, colon and value, ``-`` for null."""
    text = [c.cast("string") for c in columns]
    return digest_of(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in text])


def folded(leaf: Column, proof: Column) -> Column:
    """The root that follows from a leaf and the siblings of its proof."""
    return F.aggregate(proof, leaf, lambda node, step: digest_of(step["left"], node, step["right"]))


def proof_digest(proof: Column) -> Column:
    """Digest of all siblings of a proof in their order."""
    return F.sha2(F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def _runs(nodes: Column) -> Column:
    """The digest of each run of ``ARITY`` consecutive digests."""
    starts = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / ARITY).cast("int"))
    return F.transform(starts, lambda i: F.sha2(F.array_join(F.slice(nodes, i * ARITY + 1, F.lit(ARITY)), ""), 256))


def _blocks(nodes: DataFrame) -> DataFrame:
    """Nodes ``TREE, place, size, digest, row`` in blocks ``TREE, block, size, nodes`` of at most ``BLOCK``."""
    block = F.floor(F.col("place") / BLOCK).alias("block")
    return nodes.groupBy(*TREE, block, "size").agg(F.array_sort(F.collect_list(F.struct("place", "digest", "row"))).alias("nodes"))


def _with_levels(blocks: DataFrame) -> DataFrame:
    """Adds ``level_0`` to ``level_STRIDE``: the digests of a block, computed up to the next stored level or the tree's top."""
    out = blocks.withColumn("level_0", F.col("nodes.digest"))
    for k in range(STRIDE):
        below = F.col(f"level_{k}")
        out = out.withColumn(f"level_{k + 1}", F.when(F.col("size") > ARITY**k, _runs(below)).otherwise(below))
    return out


def _climb(nodes: DataFrame, tag: str) -> tuple[list[DataFrame], DataFrame]:
    """The stored levels of the trees, from the leaves up, and ``TREE, digest`` of every tree's root."""
    levels, roots = [], None
    while True:
        blocks = materialise(_blocks(nodes), f"merkle-{tag}")
        levels.append(blocks)
        above = _with_levels(blocks).withColumn("digest", F.element_at(f"level_{STRIDE}", 1))
        done = above.where(F.col("size") <= BLOCK).select(*TREE, "digest")
        roots = done if roots is None else roots.union(done)
        if (blocks.agg(F.max("size").alias("n")).first()["n"] or 0) <= BLOCK:
            return levels, materialise(roots, f"merkle-{tag}-roots")
        row = F.lit(None).cast("struct<none:int>").alias("row")
        nodes = above.where(F.col("size") > BLOCK).select(
            *TREE, F.col("block").alias("place"), F.ceil(F.col("size") / BLOCK).alias("size"), "digest", row
        )


def _descend(levels: list[DataFrame], tops: DataFrame, tag: str) -> DataFrame:
    """``TREE, place, digest, row, subroot, root, proof`` of the lowest level.

    ``tops`` holds ``TREE, subroot, root, proof`` of the trees' roots.
    """
    found = None
    for k in reversed(range(len(levels))):
        blocks = levels[k]
        with_top = blocks.where(F.col("size") <= BLOCK).join(tops, TREE)
        if found is not None:
            parents = found.select(*TREE, F.col("place").alias("block"), "subroot", "root", "proof")
            with_top = with_top.unionByName(blocks.where(F.col("size") > BLOCK).join(parents, [*TREE, "block"]))
        with_levels = _with_levels(with_top)

        def step(k: int, at: Column) -> Column:
            node = F.floor(at / ARITY**k).cast("int")
            first = F.floor(node / ARITY).cast("int") * ARITY
            level = F.col(f"level_{k}")  # noqa: B023
            return F.when(F.col("size") > ARITY**k, F.struct(
                F.array_join(F.slice(level, first + 1, node - first), "").alias("left"),
                F.array_join(F.slice(level, node + 2, first + (ARITY - 1) - node), "").alias("right"),
            ))

        def proved(node: Column, at: Column) -> Column:
            own = F.array_compact(F.array(*[step(k, at) for k in range(STRIDE)]))
            return F.struct(node["place"].alias("place"), node["digest"].alias("digest"), node["row"].alias("row"), own.alias("own"))

        each = with_levels.select(*TREE, "subroot", "root", "proof", F.inline(F.transform("nodes", proved)))
        found = each.withColumn("proof", F.concat("own", "proof")).drop("own")
        if k:
            found = materialise(found, f"merkle-{tag}-proofs")
    return found


@dataclass(frozen=True)
class Manifest:
    """Stored levels of the groups' trees and of the tree over the groups, and the roots of the groups."""

    levels: list[DataFrame]
    roots: DataFrame
    top_levels: list[DataFrame]
    top_root: DataFrame


def build(docs: DataFrame, key: str, group: str, leaf: Column, carried: Sequence[Column] = ()) -> Manifest:
    """The manifest of all rows; ``carried`` columns stay beside the leaves.

    Leaves of a group ascend by key, null first; rows that share a key go by their leaves and rows alike
    in both are leaves of their own. A null group is a group, the first one. An empty table has no root.
    """
    rows = docs.select(
        F.col(group).isNotNull().alias(TREE[0]), F.coalesce(F.col(group).cast("string"), F.lit("")).alias(TREE[1]),
        leaf.alias("digest"), F.struct(F.col(key).alias("key"), F.col(group).alias("group"), *carried).alias("row"),
    )
    order = [F.col("row.key"), F.col("digest"), F.col("row")]
    placed = with_global_position(rows, [*TREE, *order], "merkle-leaves")
    heads = placed.groupBy(*TREE).agg(F.min("position").alias("head"), F.count(F.lit(1)).alias("size"))
    # One row per group; broadcast while few, so that the leaves of a hot group stay where they are.
    nodes = placed.join(checked_broadcast(materialise(heads, "merkle-heads")), TREE).withColumn("place", F.col("position") - F.col("head"))
    levels, roots = _climb(nodes, "groups")
    # The roots become the leaves of one more tree; their own tree's name travels in the row.
    over = with_global_position(roots, TREE, "merkle-roots").select(
        F.lit(True).alias(TREE[0]), F.lit("").alias(TREE[1]), F.col("position").alias("place"), F.lit(roots.count()).cast("bigint").alias("size"),
        "digest", F.struct(*TREE).alias("row"),
    )
    top_levels, top_root = _climb(over, "top")
    return Manifest(levels, roots, top_levels, top_root)


def proofs(manifest: Manifest) -> DataFrame:
    """``key, group``, the carried columns, ``leaf``, ``subroot``, ``root`` and ``proof`` of every row.

    A proof holds for each level, from the leaf to the root, the joined digests left and right of the
    node on the way; a node without siblings gives a step with two empty texts.
    """
    start = manifest.top_root.select(*TREE, F.lit("").alias("subroot"), F.col("digest").alias("root"), F.array().cast(PROOF).alias("proof"))
    top = _descend(manifest.top_levels, start, "top")
    tops = materialise(top.select("row.*", F.col("digest").alias("subroot"), "root", "proof"), "merkle-tops")
    found = _descend(manifest.levels, tops, "groups")
    return found.select("row.*", F.col("digest").alias("leaf"), "subroot", "root", "proof")
