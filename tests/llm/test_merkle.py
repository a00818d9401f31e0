"""Manifest, proofs and folded roots against plain trees."""

import hashlib
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from footfall.llm import merkle
from footfall.llm.queries import op12_merkle_manifest, table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def plain_tree(leaves):
    """The top of a tree and, for every leaf, the siblings left and right of it on each level."""
    nodes, spots, paths = leaves, list(range(len(leaves))), [[] for _ in leaves]
    while len(nodes) > 1:
        for path, at in zip(paths, spots, strict=True):
            first = at - at % 16
            path.append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + 16])))
        nodes = [sha(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
        spots = [at // 16 for at in spots]
    return nodes[0], paths


def plain_manifest(rows):
    """``(key, leaf, subroot, root, path)`` of ``(key, group, leaf)`` rows."""
    groups = defaultdict(list)
    for key, group, digest in rows:
        groups[group].append((key is not None, key, digest))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([d for _, _, d in sorted(groups[g])]) for g in order}
    root, over = plain_tree([trees[g][0] for g in order])
    for g, above in zip(order, over, strict=True):
        for (_, key, digest), path in zip(sorted(groups[g]), trees[g][1], strict=True):
            yield key, digest, trees[g][0], root, path + above


def fold(node, path):
    for left, right in path:
        node = sha(left, node, right)
    return node


def proved(docs, names):
    found = merkle.proofs(merkle.build(docs, "doc_id", "source", merkle.leaf_of(*map(F.col, names))))
    return sorted(
        ((r.key, r.leaf, r.subroot, r.root, [tuple(s) for s in r.proof if s.left or s.right]) for r in found.collect()), key=repr
    )


def wanted(rows, names):
    plain = plain_manifest([(r["doc_id"], r["source"], leaf(*[r[n] for n in names])) for r in rows])
    return sorted(((k, d, s, t, [step for step in path if any(step)]) for k, d, s, t, path in plain), key=repr)


def test_query_on_whole_table(spark, sf):
    rows = table(spark, sf, "documents").collect()
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    texts = {leaf(*[r[f] for f in fields]): r for r in rows}
    want = {}
    for key, digest, subroot, root, path in plain_manifest([(r.doc_id, r.source, leaf(*[r[f] for f in fields])) for r in rows]):
        r = texts[digest]
        other = digest
        if zlib.crc32(str(key).encode()) % 5 == 0:
            other = leaf(r.doc_id, r.source, r.lang, r.n_chars, None if r.text is None else r.text.translate(LOWER))
        last = fold(other, path)
        want[key] = (digest, subroot, root, sha(*[side for step in path for side in step]), last, last == root)
    got = {r.doc_id: (r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in op12_merkle_manifest(spark, sf).collect()}
    assert got == want
    assert {v[-1] for v in got.values()} == {True, False}


def test_groups_of_all_heights(spark):
    sizes = {None: 3, "": 1, "a": 15, "b": 16, "c": 17, "d": 256, "e": 257, "é": 272, "f": 4097, "\U0001f600": 2, "～": 1}
    rows = [{"doc_id": 7 * i - 50, "source": g, "text": f"{g} {i}"} for g, n in sizes.items() for i in range(n)]
    rows += [{"doc_id": 10**6 + i, "source": f"s{i:03}", "text": "x"} for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    assert proved(docs, ["doc_id", "text"]) == wanted(rows, ["doc_id", "text"])


def test_odd_rows(spark):
    long = "é " * 200_000
    rows = [(1, "a", None), (1, "a", None), (1, "a", "other text"), (None, "a", ""), (None, None, None), (2, "a", long), (3, "a", "-"), (4, "a", "0:")]
    rows = [dict(zip(("doc_id", "source", "text"), r, strict=True)) for r in rows]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    clash = docs.withColumns({n: F.lit(9) for n in ("tree_known", "tree_name", "place", "size", "digest", "row", "proof", "key", "block", "level_0")})
    assert proved(clash, ["doc_id", "source", "text"]) == wanted(rows, ["doc_id", "source", "text"])
    assert proved(docs.limit(0), ["text"]) == []
    assert len(proved(docs.where("text = '-'"), ["text"])) == 1


def test_a_changed_sibling_is_noticed(spark):
    docs = spark.range(600).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("string").alias("source"))
    found = merkle.proofs(merkle.build(docs, "doc_id", "source", merkle.leaf_of(F.col("doc_id")))).where("key in (5, 100, 599)")
    swapped = F.transform("proof", lambda s: F.struct(s["right"].alias("left"), s["left"].alias("right")))
    rows = found.select("root", merkle.folded(F.col("leaf"), F.col("proof")).alias("ok"), merkle.folded(F.col("leaf"), swapped).alias("bad")).collect()
    assert len(rows) == 3 and all(r.ok == r.root != r.bad for r in rows)
