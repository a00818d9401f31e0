"""Repeated windows against counts of all windows."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from footfall.llm import substrings
from footfall.llm.queries import op4_substring_dedup, table
from tests.llm import brute


def test_query_on_whole_table(spark, sf):
    rows = table(spark, sf, "documents").orderBy("doc_id").collect()
    want = {
        r.doc_id: (n, gone, hashlib.sha256(" ".join(kept).encode()).hexdigest())
        for r, (n, gone, kept) in zip(rows, brute.without_repeats([r.text for r in rows]), strict=True)
    }
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op4_substring_dedup(spark, sf).collect()} == want


@pytest.mark.parametrize(("window", "crowded", "shard"), [(35, 1000, 30_000), (10, 2, 30_000), (12, 1000, 10), (100, 1000, 30_000), (3, 5, 50)])
def test_planted_passages(spark, monkeypatch, window, crowded, shard):
    monkeypatch.setattr(substrings, "CROWDED", crowded)
    monkeypatch.setattr(substrings, "SHARD_WORDS", shard)
    rnd = random.Random(window)
    passages = [[f"p{k}w{i}" for i in range(rnd.randint(window - 1, 3 * window))] for k in range(6)]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rnd.randint(0, 5)):
            p = rnd.choice(passages)
            cut = rnd.randrange(max(1, len(p) // 3))
            parts += p[cut:] if rnd.random() < 0.5 else [f"u{rnd.randrange(300)}" for _ in range(rnd.randint(1, 60))]
        texts.append("  ".join(parts) if rnd.random() < 0.8 else "\n".join(parts))
    texts += ["same " * 300, texts[0], texts[1]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substrings.remove_repeats(docs, window=window).collect()}
    assert got == {i: (n, g, " ".join(k)) for i, (n, g, k) in enumerate(brute.without_repeats(texts, window))}


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(40_000))
    rows = [(1, None, 0), (2, "", 1), (3, "a b", 2), (4, long, 3), (5, long + " end", None), (6, "a b", 4), (6, "a b", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int").withColumns({"_id": F.lit(1), "spans": F.lit("x"), "id": F.lit(2)})
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substrings.remove_repeats(docs).collect())
    assert got == [
        (1, 0, 0, ""), (2, 0, 0, ""), (3, 2, 0, "a b"), (4, 40_000, 40_000, ""), (5, 40_001, 40_000, "end"), (6, 2, 0, "a b"), (6, 2, 0, "a b"),
    ]
    assert substrings.remove_repeats(docs.limit(0)).count() == 0


def test_rows_that_share_a_key(spark):
    once, twice = (" ".join(f"{x}{i}" for i in range(50)) for x in "ab")
    rows = [(1, once), (1, twice), (2, twice + " end"), (None, once + " x y"), (None, "c d"), (3, "c d"), (1, None), (4, "e " * 60), (4, "f g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in substrings.remove_repeats(docs).collect())
    plain = brute.without_repeats([t or "" for _, t in rows], 35)
    assert got == sorted((str(k), n, g, " ".join(left)) for (k, _), (n, g, left) in zip(rows, plain, strict=True))
    assert {(k, g) for k, _, g, _ in got} >= {("1", 50), ("None", 50), ("None", 0)}


def test_every_window_is_in_one_segment():
    rnd = np.random.default_rng(3)
    for size, window in ((34, 35), (35, 35), (500, 35), (300, 100), (50, 2)):
        start, count, place, anchor, content = substrings.segments_of(rnd.integers(0, 5, size).astype("uint64"), window)
        at = [s + i for s, n in zip(start, count, strict=True) for i in range(n)]
        assert at == list(range(max(0, size - window + 1))) and len(anchor) == len(content) == len(place) == len(start)


def test_automaton_counts_all_substrings():
    rnd = random.Random(4)
    for _ in range(40):
        sequences = [[rnd.randrange(3) for _ in range(rnd.randint(1, 12))] for _ in range(4)]
        automaton = substrings.Automaton()
        for s in sequences:
            automaton.add(s, 1)
        automaton.close()
        for n in (1, 2, 4):
            grams = [tuple(s[i : i + n]) for s in sequences for i in range(len(s) - n + 1)]
            for s in sequences:
                want = sum(1 << i for i in range(len(s) - n + 1) if grams.count(tuple(s[i : i + n])) > 1)
                assert automaton.repeats(s, n) == want
