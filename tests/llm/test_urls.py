"""URL rules against plain string code, and the trees on held-out URLs."""

import random

from pyspark.sql import functions as F

from footfall.llm import urls
from footfall.llm.queries import RULES, op7_url_filters, table


def plain(url):
    head, mark, rest = (url or "").partition("://")
    if not mark:
        return "", "", None, None
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    best = None
    for rule in RULES:
        if (host == rule.host or host.endswith("." + rule.host)) and path.startswith(rule.path):
            if best is None or len(str(rule)) > len(str(best)):
                best = rule
    return host, path, best and str(best), best and best.verdict


ODD = [
    None, "", "no scheme", "http://", "http://net", "http://net/", "HTTP://A.NET/x?y#z", "http://xnet/", "http://example.net/en/",
    "http://www.example.net/en", "http://example.com/de/1", "http://b.example.com/DE/1", "ftp://org/fr/", "http://org?/fr/", "x://y://net/",
    "http://a.org#/fr/", "http://ÄB.org/fr/é\n", "http://example.net/en/?a=1&b=2", "://net/",
]


def test_rules(spark):
    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate(ODD)], "page_id long, url string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, "page_id", "url", RULES).collect()}
    for i, u in enumerate(ODD):
        host, path, rule, verdict = plain(u)
        assert got[i][:3] == (host, path, rule)
        assert got[i][3] == verdict if rule else got[i][3] in ("allow", "block")


def test_query_on_whole_table(spark, sf):
    pages = {r.page_id: r.url for r in table(spark, sf, "pages").select("page_id", "url").collect()}
    rows = op7_url_filters(spark, sf).collect()
    assert {r.page_id for r in rows} == set(pages) and len(rows) == len(pages)
    for r in rows:
        host, path, rule, verdict = plain(pages[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block")
        assert rule is None or r.verdict == verdict


def test_trees_on_held_out_urls(spark):
    rnd = random.Random(6)
    rows = []
    for i in range(1200):
        bad = i % 3 == 0
        host = f"{'x' if bad else 'y'}{rnd.randrange(40)}.{rnd.choice(['biz', 'info']) if bad else rnd.choice(['org', 'edu', 'biz'])}"
        tail = "".join(rnd.choice("0123456789abcdef") for _ in range(24)) if bad else rnd.choice(["about", "news/today", "help"])
        rows.append((i, f"http://{host}/{tail}" + ("?a=1&b=2&c=3" if bad and rnd.random() < 0.7 else ""), int(bad)))
    frame = spark.createDataFrame(rows, "_id long, _url string, _label int")
    frame = frame.select("*", urls.host_of(F.col("_url")).alias("_host"), urls.path_of(F.col("_url")).alias("_path"))
    model = urls.train(frame.where("_id % 4 > 0"))
    held = urls.score(frame.where("_id % 4 = 0"), model).collect()
    assert sum((r.blocked_score >= 0.5) == bool(r._label) for r in held) >= 0.97 * len(held)


def test_suffixes_are_counted_over_all_labelled_urls(spark):
    rows = [(i, f"http://a{i % 7}.s{i % 30}.{'biz' if i % 3 else 'org'}/{i}", int(i % 4 == 0)) for i in range(600)]
    frame = spark.createDataFrame(rows, "_id long, _url string, _label int")
    frame = frame.select("*", urls.host_of(F.col("_url")).alias("_host"), urls.path_of(F.col("_url")).alias("_path"))
    model = urls.train(frame, urls.Settings(rows=40))
    want = {}
    for _, url, label in rows:
        parts = url.split("/")[2].split(".")
        for n in (1, 2):
            at = want.setdefault((n, ".".join(parts[-n:])), [0, 0])
            at[0], at[1] = at[0] + 1, at[1] + label
    assert {(r["labels"], r["suffix"]): [r["n"], r["k"]] for r in model.suffixes.collect()} == want
    assert model.rate == 0.25 and model.trees is not None


def test_without_labels_or_with_one_kind(spark):
    pages = spark.createDataFrame([(1, "http://a.com/"), (1, "http://a.com/")], "page_id long, url string")
    assert [r.verdict for r in urls.judge(pages, "page_id", "url", RULES).collect()] == ["allow", "allow"]
    only = spark.createDataFrame([(1, "http://a.net/"), (2, "http://b.com/")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in urls.judge(only, "page_id", "url", RULES).collect()} == {1: "block", 2: "block"}
    assert urls.judge(pages.limit(0), "page_id", "url", RULES).count() == 0
    assert urls.judge(pages, "page_id", "url", []).count() == 2
