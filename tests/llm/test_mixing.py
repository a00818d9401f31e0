"""Mixing weights against plain bisection, and passes against the plan."""

import math
from collections import Counter, defaultdict

from footfall.llm import mixing
from footfall.llm.queries import op10_source_mixing, table
from tests.llm import brute


def entropy(tokens, tau):
    w = [t**tau for t in tokens]
    return -sum(x / sum(w) * math.log(x / sum(w)) for x in w)


def bisected(tokens, share):
    target = share * math.log(len(tokens))
    if entropy(tokens, 1) >= target:
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if entropy(tokens, mid) >= target else (low, mid)
    return low


def test_exponent(spark):
    tokens = [900, 100, 50, 5]
    sources = spark.createDataFrame([(str(i), 1, t) for i, t in enumerate([*tokens, 0])], "_source string, n_docs long, tokens long")
    for share in (0.6, 0.9, 0.99):
        # a source without tokens counts for nothing
        assert abs(mixing.exponent(sources, entropy_share=share) - bisected(tokens, share)) < 1e-6
    assert mixing.exponent(sources, entropy_share=0.1) == 1.0
    limited = mixing.exponent(sources, most_passes=4.0)
    assert abs((900 / 5) ** (1 - limited) - 4) < 1e-4
    assert mixing.exponent(sources, most_passes=1e9) == 0.0
    assert abs(mixing.exponent(sources, 0.99, 4.0) - limited) < 1e-9
    assert mixing.exponent(sources.limit(0), 0.9) == 1.0 and mixing.exponent(sources) == 1.0


def check(docs, rows, share, most):
    """Every source is read as often as its weight asks, up to one document of its last pass."""
    size = {k: len(brute.words(t)) for k, s, t in docs}
    by = defaultdict(list)
    for k, s, _ in docs:
        by[s].append(k)
    total = {s: sum(size[k] for k in keys) for s, keys in by.items()}
    worded = [t for t in total.values() if t]
    tau = max(bisected(worded, share), 1 - math.log(most) / math.log(max(worded) / min(worded)) if max(worded) > min(worded) else 0)
    read = Counter(k for k, _ in rows)
    for s, keys in by.items():
        if not total[s]:
            assert all(read[k] == 1 for k in keys)
            continue
        passes = (max(worded) / total[s]) ** (1 - tau)
        got = sum(read[k] * size[k] for k in keys)
        assert passes * total[s] - max(size[k] for k in keys) - 2 <= got <= passes * total[s] + 2
        assert {read[k] for k in keys} <= {math.floor(passes + 1e-6), math.floor(passes - 1e-6), math.floor(passes) + 1}
        assert min(read[k] for k in keys) >= 1
    for (k, p), n in Counter(rows).items():
        assert n == 1 and p < read[k]


def test_query_on_whole_table(spark, sf):
    docs = [(r.doc_id, r.source, r.text) for r in table(spark, sf, "documents").collect()]
    check(docs, [(r.doc_id, r["pass"]) for r in op10_source_mixing(spark, sf).collect()], 0.95, 4.0)


def test_blocks_nulls_and_empty_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 7)
    rows = [(i, "hot", "word " * (i % 9 + 1)) for i in range(400)] + [(1000 + i, None, "word " * (i % 4 + 1)) for i in range(60)]
    rows += [(2000 + i, "small", "word word") for i in range(30)] + [(3000, "silent", None), (3001, "silent", "")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, text string, pass string").repartition(6)
    out = mixing.mix(frame, "doc_id", "source", "text", 0.9, 3.0).collect()
    check(rows, [(r.doc_id, r["pass"]) for r in out], 0.9, 3.0)
    again = mixing.mix(frame.coalesce(1), "doc_id", "source", "text", 0.9, 3.0).collect()
    assert Counter(map(tuple, out)) == Counter(map(tuple, again))
    assert mixing.mix(frame.limit(0), "doc_id", "source", "text").count() == 0
    half = mixing.mix(frame, "doc_id", "source", "text", None, None, budget=1000.0).collect()
    assert 900 <= sum(len(brute.words(r.text)) for r in half) <= 1001 and all(r["pass"] == 0 for r in half)
