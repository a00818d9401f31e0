"""Near-duplicate components against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from footfall.llm import nearjoin
from footfall.llm.queries import op8_near_dedup, table
from tests.llm import brute


def components(docs):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in nearjoin.near_components(docs).collect()}


def edited(rnd, words, n):
    words = list(words)
    for _ in range(n):
        words[rnd.randrange(len(words))] = f"e{rnd.randrange(10**6)}"
    return " ".join(words)


def test_query_on_whole_table(spark, sf):
    docs = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in op8_near_dedup(spark, sf).collect()}
    assert got == brute.near_components(docs)


@pytest.mark.parametrize(("leaf", "node", "deepest"), [(12, 2048, 24), (1, 2048, 24), (1, 30, 24), (2, 3, 4)])
def test_groups_of_near_copies(spark, monkeypatch, leaf, node, deepest):
    for name, value in (("LEAF", leaf), ("NODE", node), ("DEEPEST", deepest)):
        monkeypatch.setattr(nearjoin, name, value)
    rnd = random.Random(leaf + node)
    docs, passage = {}, [f"p{i}" for i in range(40)]
    for group in range(12):
        base = [f"w{group}x{i}" for i in range(rnd.choice([8, 60, 150]))]
        for _ in range(rnd.choice([1, 2, 8, 60])):
            docs[rnd.randrange(10**9)] = edited(rnd, base, rnd.choice([0, 0, 1, 1, 2, 5]))
    for i in range(30):
        docs[10**9 + i] = " ".join([f"u{i}y{k}" for k in range(80)] + passage)
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(6)
    assert components(frame) == brute.near_components(docs)


def test_nulls_short_texts_case_and_copies(spark):
    rows = [
        (7, "One Two three", 1), (3, "one two THREE", 2), (9, None, 3), (8, "", 4), (5, " \n", 5), (4, "ÉTÉ un deux trois quatre", 6),
        (6, "été un deux trois quatre", 7), (None, "one two three", 8), (10, "x " * 30_000, 9), (11, "X " * 30_000, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = components(docs)
    assert got[3] == (1, 3, True) and got[7] == (1, 3, False)
    assert got[9] == (0, 9, True) and got[8] == (0, 8, True) and got[5] == (0, 5, True)
    assert got[4] == (1, 4, True) and got[6] == (1, 6, True)  # only A-Z are lower-cased
    assert got[None] == (1, None, True) and got[11] == (1, 10, False)
    assert components(docs.limit(0)) == {}


def test_comparison_inside_a_node():
    sets = [np.array(x, "int64") for x in ([1, 2, 3, 4], [1, 2, 3, 4], [5, 6], [1, 2, 3, 4, 9], [5, 6, 7])]
    assert nearjoin.linked_in_node(sets, 80) == [(0, 1), (0, 3)]
    assert nearjoin.linked_in_node(sets, 60) == [(0, 1), (0, 3), (2, 4)]


def test_pairs_at_the_threshold_stay_together_in_deep_nodes(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(400):  # as in a template group: 109 of 128 values agree
        a = [rnd.randrange(2**31) for _ in range(nearjoin.VALUES)]
        differ = set(rnd.sample(range(nearjoin.VALUES), 19))
        rows.append((i, a, [rnd.randrange(2**31) if k in differ else x for k, x in enumerate(a)]))
    pairs = spark.createDataFrame(rows, "id int, a array<int>, b array<int>").repartition(8)

    def apart(walk):
        """Walked to depth ten in all trees, how many pairs share no node."""
        def leaves(values):
            at = F.transform(F.sequence(F.lit(1), F.lit(nearjoin.TREES)), lambda t: nearjoin._step(nearjoin._step(F.xxhash64(t), values), values))
            for first in [True] + 7 * [False]:
                at = F.flatten(F.transform(at, lambda path: walk(values, first, path)))
            return at

        return pairs.where(~F.arrays_overlap(leaves("a"), leaves("b"))).count()

    assert apart(lambda values, first, path: F.array(nearjoin._step(path, values))) > 10
    assert apart(lambda values, first, path: nearjoin._children(path, values, first, 85)) == 0


def test_rows_that_share_a_key_are_linked_by_their_own_texts(spark):
    base = [f"w{i}" for i in range(120)]
    near, far = " ".join([*base, "x"]), " ".join(f"v{i}" for i in range(80))
    rows = [(5, " ".join(base)), (7, near), (7, far), (9, far + " y"), (5, "a b c d e f"), (5, "a b c d e f"), (None, near), (None, far), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in nearjoin.near_components(docs).collect())
    assert got == sorted([
        ("5", 116, "5", True), ("7", 117, "5", False), ("7", 76, "7", True), ("9", 77, "7", False), ("5", 2, "5", True), ("5", 2, "5", True),
        ("None", 117, "None", True), ("None", 76, "None", True), ("7", 0, "7", True),
    ])
