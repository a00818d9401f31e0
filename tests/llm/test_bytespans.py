"""Removed bytes against a count of all windows."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from footfall.llm import bytespans
from footfall.llm.queries import op11_suffix_dedup, table


def plain(texts, window=200):
    """``(n_bytes, runs, kept)`` of each text."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + window] for r in raws for i in range(len(r) - window + 1))
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - window + 1):
            if seen[r[i : i + window]] > 1:
                gone[i : i + window] = b"\x01" * window
        edges = [i for i in range(len(r) + 1) if (gone[i] if i < len(r) else 0) != (gone[i - 1] if i else 0)]
        yield len(r), list(zip(edges[::2], edges[1::2], strict=True)), bytes(b for b, g in zip(r, gone, strict=True) if not g)


def rows_of(found):
    return {r.doc_id: (r.n_bytes, [(x.start, x.end) for x in r.removed], bytes(r.kept_bytes)) for r in found.collect()}


def test_query_on_whole_table(spark, sf):
    rows = table(spark, sf, "documents").orderBy("doc_id").collect()
    want = {
        r.doc_id: (n, sum(y - x for x, y in runs), len(runs), hashlib.sha256(kept).hexdigest())
        for r, (n, runs, kept) in zip(rows, plain([r.text for r in rows]), strict=True)
    }
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op11_suffix_dedup(spark, sf).collect()} == want
    assert any(gone for _, gone, _, _ in want.values())


@pytest.mark.parametrize(
    ("window", "crowded", "shard", "block"), [(200, 2000, 3 << 20, 1 << 20), (200, 3, 500, 70), (60, 1, 1, 1000), (30, 2, 3000, 64), (5, 2, 200, 50)]
)
def test_planted_passages(spark, monkeypatch, window, crowded, shard, block):
    for name, value in (("CROWDED", crowded), ("SHARD", shard), ("BLOCK", block)):
        monkeypatch.setattr(bytespans, name, value)
    rnd = random.Random(window + crowded)
    letters = "abcdefghijé \n中"
    some = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    passages = [some(rnd.randint(window // 2, 3 * window)) for _ in range(6)]
    texts = []
    for _ in range(50):
        parts = []
        for _ in range(rnd.randint(0, 4)):
            p = rnd.choice(passages)
            cut = rnd.randrange(max(1, len(p) // 3))
            parts.append(p[cut:] if rnd.random() < 0.6 else some(rnd.randint(1, window)))
        text = "".join(parts)
        if text and rnd.random() < 0.4:  # a near copy: one letter changed
            at = rnd.randrange(len(text))
            text = text[:at] + "X" + text[at + 1 :]
        texts.append(text)
    texts += ["z" * 3 * window, texts[0], texts[1], passages[0], "ab" * window]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    assert rows_of(bytespans.remove_repeats(docs, window=window)) == dict(enumerate(plain(texts, window)))


def test_template_with_a_number_is_split(spark, monkeypatch):
    monkeypatch.setattr(bytespans, "CROWDED", 20)
    rnd = random.Random(3)
    frame = ["".join(rnd.choice("abcdef ") for _ in range(150)) for _ in range(4)]
    texts = [f"{frame[0]}{i % 90:04}{frame[1]}{i:06}{frame[2]}{i % 7}{frame[3]}" for i in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert rows_of(bytespans.remove_repeats(docs)) == dict(enumerate(plain(texts)))


def test_odd_rows(spark):
    rnd = random.Random(8)
    long = "".join(rnd.choice("abcdefghij é") for _ in range(250_000))
    rows = [(1, None), (2, ""), (3, "ab"), (4, long), (5, long + "end"), (6, "y" * 199), (6, "q" * 300), (6, "q" * 300), (None, "x" * 200), (7, "other" + long[:250])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit(1) for n in ("n_bytes", "id", "th", "spans", "_id", "k")})
    found = bytespans.remove_repeats(docs).collect()
    got = sorted((r.doc_id or 0, r.n_bytes, len(r.removed), bytes(r.kept_bytes)) for r in found)
    size = len(long.encode())
    want = [
        (0, 200, 0, b"x" * 200), (1, 0, 0, b""), (2, 0, 0, b""), (3, 2, 0, b"ab"), (4, size, 1, b""), (5, size + 3, 1, b"end"),
        (6, 199, 0, b"y" * 199), (6, 300, 1, b""), (6, 300, 1, b""), (7, 5 + len(long[:250].encode()), 1, b"other"),
    ]
    assert got == want and all(r.id == r.k == 1 for r in found)
    assert bytespans.remove_repeats(docs.limit(0)).count() == 0


def test_one_key_with_two_texts(spark):
    rnd = random.Random(2)
    a, b = ("".join(rnd.choice("abcdef") for _ in range(400)) for _ in range(2))
    docs = spark.createDataFrame([(1, a), (1, b), (2, a)], "doc_id long, text string")
    assert sorted((r.doc_id, bytes(r.kept_bytes).decode()) for r in bytespans.remove_repeats(docs).collect()) == sorted([(1, ""), (1, b), (2, "")])
