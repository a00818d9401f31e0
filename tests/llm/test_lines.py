"""Line dedup against a comparison of all lines; its query also has SQL."""

import os
import random

import pytest
from pyspark.sql import functions as F

from footfall.llm import lines
from footfall.plans import scratch
from tests.llm import brute


def kept(docs):
    return {r.id.key: r.kept for r in lines.kept_lines(docs).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_edited_lines(spark, seed):
    rnd = random.Random(seed)
    common = [f"w{i}" for i in range(40)]
    base = [[rnd.choice(common) if rnd.random() < 0.5 else f"r{rnd.randrange(900)}" for _ in range(rnd.randint(1, 40))] for _ in range(25)]

    def line():
        w = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 4])):
            place = rnd.randrange(len(w) + 1)
            w[place : place + rnd.randint(0, 1)] = [f"r{rnd.randrange(900)}"] * rnd.randint(0, 1)
        return " ".join(w)

    docs = {k: "\n".join(line() for _ in range(rnd.randint(1, 12))) for k in range(40)}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    want = brute.kept_lines(docs)
    assert kept(frame) == {k: v for k, v in want.items() if v}


def test_order_ties_blank_lines_and_nulls(spark):
    rows = [
        (1, "a b c\n\n  \na c b\nx", "p"), (2, None, "q"), (3, "", "r"), (4, "x\nx", None), (5, "y\n\nz", "s"), (None, "z\ny", "t"), (6, "\n \n", "u"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string").withColumn("_id", F.lit(1)).withColumn("id", F.lit(2))
    found = lines.kept_lines(docs)
    assert {r.id.key: r.kept for r in found.collect()} == {None: [0, 1], 1: [0, 4]}
    left = {r.doc_id: (r.text, r.kept) for r in lines.remove_lines(docs, "doc_id", "text", found).collect()}
    assert left == {1: ("a b c\n\n  \nx", "p"), 2: (None, "q"), 3: ("", "r"), None: ("z\ny", "t"), 6: ("\n \n", "u")}
    counted = {r.doc_id: (r.n_lines, r.n_removed, r.kept_lines) for r in lines.count_lines(docs, "doc_id", "text", found).collect()}
    assert counted[1] == (3, 1, "0,4") and counted[2] == (0, 0, "") and counted[4] == (2, 2, "") and counted[5] == (2, 2, "")


def test_many_near_copies_and_a_very_long_line(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(w if k != i % 60 else f"edit{i}" for k, w in enumerate(words))) for i in range(300)]
    rows += [(1000, " ".join(f"v{i}" for i in range(50_000))), (1001, " ".join(f"v{i}" for i in range(50_000))), (1002, "alone")]
    got = kept(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == {0: [0], 1000: [0], 1002: [0]}


def test_rows_that_share_a_key(spark):
    rows = [(1, "a b\nc d"), (1, "c d\ne f\ng"), (2, "e f\nh"), (2, "i\nj k"), (2, "i\nj k"), (None, "l"), (None, "a b\nm")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = lines.kept_lines(docs)
    counted = sorted((str(r.doc_id), r.n_lines, r.n_removed) for r in lines.count_lines(docs, "doc_id", "text", found).collect())
    left = [line for r in lines.remove_lines(docs, "doc_id", "text", found).collect() for line in r.text.split("\n")]
    assert sorted(left) == sorted([*"gh", "l", "m", "i", "i", "j k", "j k", "a b", "c d", "e f"])
    assert sum(n for *_, n in counted) == 3 and min(n for *_, n in counted) == 0


def test_no_rows(spark):
    assert kept(spark.createDataFrame([], "doc_id long, text string")) == {}


@pytest.mark.parametrize("percent", [60, 90, 100])
def test_words_of_many_lines(spark, monkeypatch, percent):
    monkeypatch.setattr(lines, "HOT", 5)
    monkeypatch.setattr(lines, "SALT", 16)
    rnd = random.Random(percent)
    template = [f"t{i}" for i in range(20)]

    def line():
        w = template[: rnd.randint(4, 20)]
        for _ in range(rnd.choice([0, 1, 2, 3])):
            w[rnd.randrange(len(w))] = f"r{rnd.randrange(400)}"
        return "\t ".join(w)

    docs = {k: "\n".join(line() for _ in range(rnd.randint(1, 8))) for k in range(60)}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    want = brute.kept_lines(docs, percent)
    assert {r.id.key: r.kept for r in lines.kept_lines(frame, percent=percent).collect()} == {k: v for k, v in want.items() if v}


def test_only_the_result_stays_on_disk(spark):
    docs = spark.createDataFrame([(k, f"a b c d e f g h i j k{k % 9}\nx{k} y") for k in range(60)], "doc_id long, text string")
    folder = scratch.new_path(spark, "any").rsplit("/", 1)[0].removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    found = lines.kept_lines(docs)
    assert [x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before] == ["line-kept"]
    assert found.count() == 60


def test_first_lines_of_words_take_one_shuffle(spark, monkeypatch):
    plans, store = {}, scratch.Passing.store

    def stored(self, df, tag):
        plans.setdefault(tag, []).append(df._jdf.queryExecution().executedPlan().toString())
        return store(self, df, tag)

    monkeypatch.setattr(scratch.Passing, "store", stored)
    lines.kept_lines(spark.createDataFrame([(k, f"a b c d e f g h i j k{k % 9}\nx{k} y") for k in range(60)], "doc_id long, text string"))
    assert plans["line-shared"][0].count("Exchange hashpartitioning(word") == 1
