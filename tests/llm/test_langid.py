"""Language identification: held-out accuracy, rejection, and odd inputs."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from footfall.llm import langid
from footfall.llm.queries import language_model, op5_language_id, table


def test_subwords_against_plain_slices():
    s = langid.Settings()
    tokens = ["Été,".encode(), b"42", b"", "ab".encode(), "don't".encode()]
    buckets, owner = langid.subwords(tokens, s)
    for i, want in enumerate(["<été>", "", "", "<ab>", "<dont>"]):
        raw = want.encode()
        assert (owner == i).sum() == sum(max(0, len(raw) - n + 1) for n in range(s.shortest, s.longest + 1))
    assert sorted(buckets[owner == 3]) == sorted(langid.subwords([b"AB"], s)[0])


def test_numeric_signs_are_no_letters(spark):
    signs = ["½ ² ①", "Ⅳ 12_3", "́", "", None]
    buckets, _ = langid.subwords(["½".encode(), "²①Ⅳ_7".encode()], langid.Settings())
    assert len(buckets) == 0
    rows = [(i, t) for i, t in enumerate(signs)] + [(9, "a²"), (10, "ª"), (11, "語")]
    rows = spark.createDataFrame(rows, "doc_id long, text string")
    model = langid.Model(["x", "y"], np.zeros((1 << 15, 16), "float32"), np.zeros((16, 2)), np.array([0.0, 1.0]), 1.0, 0.0, langid.Settings())
    got = {r.doc_id: r.lang_pred for r in langid.predict(rows, "text", model).collect()}
    assert got == {0: "und", 1: "und", 2: "und", 3: "und", 4: "und", 9: "y", 10: "y", 11: "y"}


def test_descent_against_plain_steps_and_every_row_is_met():
    s = langid.Settings(buckets=6, dims=3, steps=7, passes=2, rate=0.3)
    rnd = np.random.default_rng(1)
    rows = [(np.array(b), rnd.dirichlet(np.ones(len(b))), k) for b, k in (([0, 2], 0), ([1, 3, 4], 1), ([5], 2), ([0, 5], 1), ([2, 3], 0))]
    got = langid.descend(rows, 3, s)
    rnd = np.random.default_rng(7)
    e, w, b = rnd.normal(0, 0.1, (6, 3)).tolist(), [[0.0] * 3 for _ in range(3)], [0.0] * 3
    order = [*rnd.permutation(5).tolist(), *rnd.permutation(5).tolist()]
    for t, k in enumerate(order):
        buckets, share, label = rows[k]
        rate = 0.3 * (1 - t / 10)
        mean = [sum(x * e[i][d] for i, x in zip(buckets, share, strict=True)) for d in range(3)]
        z = [sum(mean[d] * w[d][c] for d in range(3)) + b[c] for c in range(3)]
        total = sum(np.exp(x) for x in z)
        slope = [np.exp(x) / total - (c == label) for c, x in enumerate(z)]
        back = [sum(w[d][c] * slope[c] for c in range(3)) for d in range(3)]
        for c in range(3):
            b[c] -= 0.1 * rate * slope[c]
            for d in range(3):
                w[d][c] -= rate * mean[d] * slope[c]
        for i, x in zip(buckets, share, strict=True):
            for d in range(3):
                e[i][d] -= rate * len(buckets) ** 0.5 * x * back[d]
    assert len(order) == 10 and all(np.allclose(x, y) for x, y in zip(got, (e, w, b), strict=True))


def test_held_out_accuracy(spark, sf):
    docs = {r.doc_id: r for r in table(spark, sf, "documents").collect()}
    rows = op5_language_id(spark, sf).collect()
    assert {r.doc_id for r in rows} == set(docs) and len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    right = sum(r.lang_pred == docs[r.doc_id].lang for r in held)
    assert right >= 0.95 * len(held)
    lettered = [r for r in rows if any(c.isalpha() for c in docs[r.doc_id].text or "")]
    assert sum(r.rejected for r in lettered) <= 0.02 * len(lettered)


def test_predictions_do_not_depend_on_partitions(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = language_model(table(spark, sf, "documents"))
    one = {(r.doc_id, r.lang_pred, r.score) for r in langid.predict(docs.coalesce(1), "text", model).collect()}
    many = {(r.doc_id, r.lang_pred, r.score) for r in langid.predict(docs.repartition(7), "text", model).collect()}
    assert one == many


def test_odd_rows(spark, sf):
    model = language_model(table(spark, sf, "documents"))
    rows = [(1, None, "x"), (2, "", None), (3, "123 ... $$", "x"), (4, "the and of with " * 20_000, None), (4, "the and of with", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string")
    got = [(r.doc_id, r.lang_pred, r.rejected) for r in langid.predict(docs, "text", model).collect()]
    assert got[:3] == [(1, "und", True), (2, "und", True), (3, "und", True)]
    assert [g[1:] for g in got[3:]] == [("en", False)] * 2
    assert all(r.lang_pred == "und" and r.score == 0 for r in langid.predict(docs, "text", None).collect())
    empty = docs.limit(0).withColumn("lang", docs.lang_pred)
    assert langid.train(empty, "doc_id", "text", "lang") is None
    assert langid.predict(empty, "text", model).count() == 0


def test_descent_separates_two_labels():
    s = langid.Settings(buckets=8, dims=2, steps=400)
    rows = [(np.array([k]), np.array([1.0]), k % 2) for k in range(4)]
    table_, weights, bias = langid.descend(rows, 2, s)
    assert all(np.argmax(table_[b[0]] @ weights + bias) == label for b, _, label in rows)


def test_rows_that_are_learned_from(spark):
    rows = [(k, "x" if k % 3 else "y") for k in range(3000)] + [(k, f"z{k}") for k in range(5000, 5003)]
    known = spark.createDataFrame(rows, "_key long, _label string").repartition(7)
    hashed = {r._key: r.h for r in known.select("_key", F.xxhash64("_key").alias("h")).collect()}

    def first(n):
        out = set()
        for label in {x for _, x in rows}:
            out |= set(sorted((k for k, x in rows if x == label), key=lambda k: (hashed[k], k))[:n])
        return out

    # The lowest hashes as unsigned numbers, which is how their slots are ordered.
    hashed = {k: h % (1 << 64) for k, h in hashed.items()}
    for s, n in ((langid.Settings(per_label=40), 40), (langid.Settings(per_label=40, rows=50), 10), (langid.Settings(rows=2), 1)):
        assert {r._key for r in langid._lowest_hashed(known, s).collect()} == first(n)
