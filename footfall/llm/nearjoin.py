"""Near-duplicate texts by a chosen-path set similarity join.

A text is its set of word shingles; equal sets are collapsed first. In each of several independent
trees a set walks from the root by minwise tokens: the node picks one of the set's minwise values,
and sets with the same value go on together. Two sets of similarity s stay together at a step with
probability s, so most unlike sets part within two steps, where the trees begin. Nodes of a few sets
give pairs, which a bit sketch and the set sizes filter and the full sets confirm. Nodes of bounded
size are compared exhaustively inside a task on their full sets, and return no more than one link per
set. Larger nodes first compare all sets with a pivot; those that still hold several components
branch on. So a group of near copies of any size costs little more than linear work.

At similarity s a tree keeps a pair with probability s**2 at depth two. From there on a set goes to
several children of a node: to three at the first step, then to 1.2 / threshold on average, as many for
all sets of the node. So a pair at the threshold shares 1.2 children per shared node, and its shared
nodes do not die out with depth. With twelve trees a pair at 0.85 is missed with 2e-7 at depth two,
3e-7 at four, 1.2e-6 at ten, 1.9e-6 at 24, if all steps are independent. They are not quite, as all
trees take from the same 128 values: with the spread of the share that agrees, the figures are 1.3e-6,
2.5e-6, 2.6e-5 and 1.3e-4.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.llm.components import components
from footfall.llm.small import checked_broadcast
from footfall.llm.wordhash import WordHashes, grams, mixed, raw_texts
from footfall.llm.workers import tidy
from footfall.plans.scratch import materialise

#: Minwise values of a set and independent trees.
VALUES, TREES = 128, 12
#: Sets of a node that gives pairs; sets and shingles of a node that one task compares; the depth at
#: which what is left gives pairs too.
LEAF, NODE, NODE_SHINGLES, DEEPEST = 12, 2048, 3_000_000, 24
#: Children of a node that each of its sets goes to: at the first step below the roots, and at later
#: ones in hundredths of what a pair at the threshold needs to share one child on average.
FIRST_PICKS, LATER_PICKS = 3, 120


def shingle_set(raw: bytes, n: int, words: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of a text's word n-grams; of the whole sequence if it is shorter."""
    tokens = raw.lower().split()  # bytes: A-Z only, and ASCII white space only
    if not tokens:
        return np.zeros(0, "uint64")
    if len(tokens) < n:
        return np.array([xxhash.xxh64_intdigest(b" ".join(tokens), 1)], "uint64")
    return np.unique(grams(words.of(tokens), n))


_SEEDS = mixed(np.arange(1, VALUES + 1, dtype="uint64"))


def minwise(shingles: np.ndarray) -> np.ndarray:
    """The upper halves of the smallest values under VALUES hash functions."""
    best = np.full(VALUES, np.iinfo("uint64").max, "uint64")
    for part in np.array_split(shingles, len(shingles) // 2048 + 1):
        if len(part):
            np.minimum(best, ((part[:, None] ^ _SEEDS) * np.uint64(0x9E3779B97F4A7C15)).min(axis=0), out=best)
    return (mixed(best) >> np.uint64(32)).astype("uint32")


def signatures(docs: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """``id, n`` (set size), two hashes of the whole set, its minwise values and a bit sketch of those."""
    kind = docs.schema[key].dataType.simpleString()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            sizes, whole, values = [], [], []
            for raw in raw_texts(batch.column(1)):
                s = shingle_set(raw, n, words)
                sizes.append(len(s))
                whole.append(xxhash.xxh3_128_digest(s.tobytes()))
                values.append(minwise(s))
            block = np.array(values, "uint32").reshape(-1, VALUES)
            bits = np.packbits((block & 1).astype("uint8"), axis=1).view("int64")
            names = np.frombuffer(b"".join(whole), "int64").reshape(-1, 2)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(sizes) + 1) * VALUES, pa.int32()), pa.array(block.ravel().view("int32"))
            )
            columns = [batch.column(0), pa.array(sizes, pa.int32()), *map(pa.array, (names[:, 0], names[:, 1])), lists]
            columns += [pa.array(bits[:, 0]), pa.array(bits[:, 1])]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "s1", "s2", "values", "b1", "b2"])

    schema = f"id {kind}, n int, s1 bigint, s2 bigint, `values` array<int>, b1 bigint, b2 bigint"
    return docs.select(key, text).mapInArrow(run, schema)


def _step(path: Column, values: str) -> Column:
    """The next node of a set: the path picks one of its minwise values."""
    return F.xxhash64(path, F.get(F.col(values), F.pmod(path, F.lit(VALUES)).cast("int")))


def trees_for(percent: int) -> int:
    """As many trees as keep the rate of missed pairs at depth three at that of TREES at 85."""
    one, at_85 = (math.log1p(-min(p / 100, 0.99) ** 3) for p in (percent, 85))
    return max(TREES, math.ceil(TREES * at_85 / one - 1e-9))


def _children(path: Column, values: str, first: bool, percent: int) -> Column:
    """The next nodes of a set in a node that walks on. How many is up to the node, not to the set."""
    whole, rest = divmod(LATER_PICKS, percent)
    more = F.pmod(F.xxhash64(path, F.lit("picks")), F.lit(percent)) < rest
    picks = F.lit(FIRST_PICKS) if first else F.lit(whole) + more.cast("int")
    return F.transform(F.sequence(F.lit(1), picks), lambda j: _step(F.xxhash64(path, j), values))


def _alike(a: Column, b: Column, percent: int) -> Column:
    """Whether sizes and sketches allow the similarity; wrong for one pair in some 300,000 at the threshold."""
    agree = (1 + percent / 100) / 2
    most = int(VALUES * (1 - agree) + 4.5 * (VALUES * agree * (1 - agree)) ** 0.5)
    differ = F.bit_count(a["b1"].bitwiseXOR(b["b1"])) + F.bit_count(a["b2"].bitwiseXOR(b["b2"]))
    return (F.least(a["n"], b["n"]) * 100 >= F.greatest(a["n"], b["n"]) * percent) & (differ <= most)


def confirmed(docs: DataFrame, key: str, text: str, pairs: DataFrame, percent: int, n: int) -> DataFrame:
    """The pairs ``a, b`` whose full shingle sets reach the similarity."""
    pairs = materialise(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-pairs")
    ends = materialise(pairs.select(F.col("a").alias("_end")).union(pairs.select("b")).distinct(), "near-ends")
    wide = docs.select(F.col(key).alias("id"), F.col(text).alias("t")).join(checked_broadcast(ends), F.col("id") == F.col("_end"))
    texts = materialise(wide.select("id", "t").dropDuplicates(["id"]), "near-texts")

    @tidy
    def similar(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        words = WordHashes()
        for left, right in batches:
            out = []
            for x, y in zip(raw_texts(left), raw_texts(right), strict=True):
                x, y = shingle_set(x, n, words), shingle_set(y, n, words)
                both = len(np.intersect1d(x, y, assume_unique=True))
                out.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield pa.array(out, pa.bool_())

    full = pairs.join(texts.select(F.col("id").alias("b"), F.col("t").alias("y")), "b")
    full = full.join(texts.select(F.col("id").alias("a"), F.col("t").alias("x")), "a")
    return materialise(full.where(F.arrow_udf(similar, "boolean")("x", "y")).select("a", "b"), "near-links")


def _nodes(rows: DataFrame) -> DataFrame:
    """Rows ``path, x`` (a set's id, size and sketch) of nodes with two sets or more, with ``size``, ``weight`` and a pivot."""
    order = F.xxhash64("path", "x.id")
    sized = rows.groupBy("path").agg(
        F.count(F.lit(1)).alias("size"), F.sum("x.n").alias("weight"), F.min(F.struct(order.alias("o"), "x")).alias("p")
    )
    sized = sized.where(F.col("size") > 1).select("path", "size", "weight", F.col("p.x").alias("pivot"))
    return materialise(rows.join(sized, "path"), "near-nodes")


def linked_in_node(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs that connect the components of a node's sets: each later member with the first one."""
    m, sizes = len(sets), np.array([len(s) for s in sets])
    shingle, owner = np.concatenate(sets), np.repeat(np.arange(m), sizes)
    order = np.argsort(shingle, kind="stable")
    edges = np.append(np.flatnonzero(np.append(True, np.diff(shingle[order]) != 0)), len(order))
    shared = np.zeros((m, m), "int32")
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b - a > 1:
            own = owner[order[a:b]]
            shared[np.ix_(own, own)] += 1
    linked = 100 * shared.astype("int64") >= percent * (sizes[:, None] + sizes[None, :] - shared)
    linked &= shared > 0
    first = np.full(m, -1)
    for start in range(m):
        if first[start] < 0:
            front = np.array([start])
            while len(front):
                first[front] = start
                front = np.flatnonzero(linked[front].any(axis=0) & (first < 0))
    return [(int(f), i) for i, f in enumerate(first) if f != i]


def exhaustive(docs: DataFrame, key: str, text: str, nodes: DataFrame, percent: int, n: int) -> DataFrame:
    """Links ``a, b`` that connect what is similar within each node of ``path, x``; a node is one task's work."""
    kind = docs.schema[key].dataType.simpleString()
    nodes = nodes.select("path", F.col("x.id").alias("_id"))
    ends = materialise(nodes.select(F.col("_id").alias("_end")).distinct(), "near-ends")
    wide = docs.select(F.col(key).alias("id"), F.col(text).alias("t")).join(checked_broadcast(ends), F.col("id") == F.col("_end"))

    @tidy
    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            sets = [shingle_set(raw, n, words).view("int64") for raw in raw_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "s"])

    sets = materialise(wide.select("id", "t").dropDuplicates(["id"]).mapInArrow(shingles, f"id {kind}, s array<bigint>"), "near-full")

    @tidy
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, ids, members = None, [], []

        def solved() -> pa.RecordBatch:
            found = linked_in_node(members, percent) if len(members) > 1 else []
            columns = [pa.array([ids[p[k]] for p in found], ends_type) for k in (0, 1)]
            return pa.RecordBatch.from_arrays(columns, names=["a", "b"])

        for batch in batches:
            ends_type, column = batch.schema.field("id").type, batch.column(2)
            for i, at in enumerate(batch.column(0).to_pylist()):
                if at != path:
                    if ids:
                        yield solved()
                    path, ids, members = at, [], []
                ids.append(batch.column(1)[i].as_py())
                members.append(column[i].values.to_numpy(zero_copy_only=False))
        if ids:
            yield solved()

    full = nodes.join(sets, F.col("_id") == F.col("id")).select("path", "id", "s")
    found = full.repartition("path").sortWithinPartitions("path", "id").mapInArrow(compare, f"a {kind}, b {kind}")
    return materialise(found.distinct(), "near-links")


def near_links(docs: DataFrame, key: str, text: str, sets: DataFrame, percent: int, n: int) -> DataFrame:
    """Links ``a, b`` between distinct sets (``id, n, values, b1, b2``) that connect each component."""
    x = F.struct("id", "n", "b1", "b2").alias("x")
    root = F.transform(F.sequence(F.lit(1), F.lit(trees_for(percent))), lambda t: _step(_step(F.xxhash64(t), "values"), "values"))
    nodes = _nodes(sets.select(x, F.explode(root).alias("path")))
    a, b, pivot = F.col("x"), F.col("y"), F.col("pivot")
    fits = (F.col("size") <= NODE) & (F.col("weight") <= NODE_SHINGLES)
    links, pairs, whole, depth = None, None, None, 2

    def more(old: DataFrame | None, new: DataFrame) -> DataFrame:
        return new if old is None else old.union(new)

    while True:
        small = nodes.where(F.col("size") <= LEAF)
        if depth >= DEEPEST:
            small = small.union(nodes.where(~fits))
        met = small.select("path", "x").join(small.select("path", F.col("x").alias("y")), "path").where(a["id"] < b["id"])
        pairs = more(pairs, met.where(_alike(a, b, percent)).select(a["id"].alias("a"), b["id"].alias("b")))
        whole = more(whole, nodes.where(fits & (F.col("size") > LEAF)).select("path", "x"))
        large = nodes.where(~fits & (F.col("size") > LEAF))
        if depth >= DEEPEST or not large.limit(1).count():
            break
        stars = large.where((a["id"] != pivot["id"]) & _alike(a, pivot, percent))
        links = more(links, confirmed(docs, key, text, stars.select(a["id"].alias("a"), pivot["id"].alias("b")), percent, n))
        known = components(links).select(F.col("id").alias("_i"), F.col("component").alias("_c"))
        large = large.join(known, F.col("x.id") == F.col("_i"), "left").withColumn("c", F.coalesce("_c", "x.id"))
        several = large.groupBy("path").agg(F.min("c").alias("low"), F.max("c").alias("high")).where(F.col("low") != F.col("high"))
        walking = large.join(several.select("path"), "path", "left_semi").select(F.col("x.id").alias("_id"), "x", "path")
        steps = sets.select("id", "values").join(walking, F.col("id") == F.col("_id"))
        children = _children(F.col("path"), "values", depth == 2, percent)
        nodes = _nodes(steps.select("x", F.explode(children).alias("path")))
        depth += 1
    links = more(links, exhaustive(docs, key, text, whole, percent, n))
    return more(links, confirmed(docs, key, text, pairs, percent, n))


def near_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85, shingle: int = 5
) -> DataFrame:
    """``key, n_shingles, component_id, kept, text_hash`` (xxhash64) of every row.

    Texts are linked if the Jaccard similarity of their shingle sets is at least ``percent`` / 100;
    a component is named by its smallest key, whose row is kept. Null, empty and blank texts have an
    empty set and are linked with nothing. Rows with a null key are never linked and always kept
    (their component is null). Rows that share a key are told apart by a hash of their text and linked by their
    own texts; all rows of a component's smallest key are kept.
    """
    docs = docs.select(F.struct(F.col(key).alias("key"), F.xxhash64(text).alias("hash")).alias("id"), F.col(text).alias("t"))
    found = materialise(signatures(docs, "id", "t", shingle), "near-sets")
    able = (F.col("n") > 0) & F.col("id.key").isNotNull()
    whole = found.where(able)
    sets = whole.groupBy("s1", "s2").agg(F.min(F.struct("id", "n", "values", "b1", "b2")).alias("r"))
    sets = materialise(sets, "near-distinct")
    links = near_links(docs, "id", "t", sets.select("r.*"), percent, shingle)
    named = components(links).select(F.col("id").alias("_r"), "component")
    classes = sets.select("s1", "s2", F.col("r.id").alias("rep")).join(named, F.col("rep") == F.col("_r"), "left")
    classes = classes.select(F.col("s1").alias("_s1"), F.col("s2").alias("_s2"), F.coalesce("component", "rep").alias("component"))
    out = found.select("id", "n", "s1", "s2").join(
        classes, (F.col("s1") == F.col("_s1")) & (F.col("s2") == F.col("_s2")) & able, "left"
    )
    own, component = F.col("id.key"), F.coalesce("component", "id")["key"]
    return out.select(
        own.alias(key), F.col("n").cast("bigint").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(component == own, F.lit(True)).alias("kept"), F.col("id.hash").alias("text_hash"),
    )
