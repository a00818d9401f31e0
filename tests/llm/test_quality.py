"""Text statistics against plain code, and the host verdicts; the query also has SQL."""

import random
from collections import Counter

from footfall.llm import quality
from tests.llm import brute


def plain(text):
    w = brute.words(text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen, inside = Counter(grams), set()
    for i, g in enumerate(grams):
        if seen[g] > 1:
            inside.update(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if brute.words(x)]
    return (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside))


def test_statistics(spark):
    rnd = random.Random(5)
    signs = ["a", "b", "a", "é", "#", "|x", "\n", "\n\n", "\t", "  ", "😀"]
    texts = [None, "", " \n ", "a b c d e", "a b c d e a b c d e", "x " * 20_000]
    texts += [" ".join(rnd.choice(signs) for _ in range(rnd.randint(1, 80))) for _ in range(150)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.text_statistics(frame).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}


def test_hosts(spark):
    good, bad = "one two three four five six seven eight nine ten", "too short"
    rows = [(f"g{i}", "good.org", good, True) for i in range(200)] + [(f"b{i}", "bad.net", bad, True) for i in range(150)]
    rows += [("b-ok", "bad.net", good, False), ("g-no", "good.org", bad, None), ("lone", "lone.com", bad, None), ("none", None, good, None), ("null", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id string, source string, text string, kept boolean")
    out = {r.doc_id: r for r in quality.judge(docs, "doc_id", "source", quality.base_rules).collect()}
    assert len(out) == len(rows)
    assert out["g0"].kept and not out["b0"].kept and not out["g-no"].kept and out["g-no"].base_failed
    assert not out["b-ok"].base_failed and not out["b-ok"].kept and out["b-ok"].host_rate > 0.5
    assert not out["null"].kept and out["null"].n_words == 0 and out["none"].host_rate == out["null"].host_rate
    assert 0 < out["lone"].host_rate < 1  # one document does not decide
    assert quality.judge(docs.limit(0), "doc_id", "source", quality.base_rules).count() == 0


def test_clean_hosts_keep_everything(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = quality.judge(docs, "doc_id", "source", quality.base_rules).collect()
    assert all(r.kept != r.base_failed for r in out)
