"""Review pools, leakage, enrichment, resuming."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from footfall.operators import enrich, pools
from footfall.streaming import incremental as inc

POOL = "item_id string, helpful_vote int, timestamp long, review_id long"


def pick(n_rows, n):
    """The selection rule on row numbers: half from the top, half strided over the rest."""
    top = list(range(n_rows))[: max(1, n // 2)]
    rest = list(range(n_rows))[len(top):]
    step = max(1, len(rest) // max(1, n - len(top)))
    return top + rest[::step][: n - len(top)]


@pytest.mark.parametrize("n", [1, 2, 3, 8])
def test_select_reviews(spark, n):
    sizes = [0, 1, 2, 3, 7, 8, 9, 12, 13, 50]
    rows = [(f"i{s}", 100 - r, 0, s * 1000 + r) for s in sizes for r in range(s)]
    pool = pools.review_pool(spark.createDataFrame(rows, POOL), "review_id")
    got = {}
    for r in pools.select_reviews(pool, n).collect():
        got.setdefault(r["item_id"], []).append(r["pool_rank"] - 1)
    assert {k: sorted(x) for k, x in got.items()} == {f"i{s}": sorted(pick(s, n)) for s in sizes if s}


def test_pool_order_and_cap(spark):
    rows = [("i", 1, 5, 1), ("i", 9, 1, 2), ("i", 9, 2, 3), ("i", 9, 2, 4)]
    pool = pools.review_pool(spark.createDataFrame(rows, POOL), "review_id", cap=3)
    assert [r["review_id"] for r in pool.orderBy("pool_rank").collect()] == [3, 4, 2]


def test_would_be_selected_with_many_held_out_rows(spark):
    rng = random.Random(1)
    kept = [("hot", rng.randrange(4), t, t) for t in range(200)] + [("cold", 9, t, 1000 + t) for t in range(40)]
    held = [("hot", rng.randrange(4), t, 5000 + t) for t in range(600)] + [("cold", 0, 0, 9000)]
    frames = [spark.createDataFrame(rows, POOL) for rows in (kept, held)]
    pool = pools.review_pool(frames[0], "review_id", cap=150)
    got = {r["item_id"]: r["would_be_selected"] for r in pools.would_be_selected(pool, frames[1], "review_id").collect()}
    want = {}
    for item in ("hot", "cold"):
        pooled = sorted((r for r in kept if r[0] == item), key=lambda r: (-r[1], -r[2], r[3]))[:150]
        every = [(*r, 0) for r in pooled] + [(*r, 1) for r in held if r[0] == item]
        every.sort(key=lambda r: (-r[1], r[4], -r[2], r[3]))
        want[item] = any(every[i][4] for i in pick(len(every), 8))
    assert got == want


def test_held_out_flags(spark):
    shape = "item_id string, user_id string, timestamp long, review_hash string"
    keys = spark.createDataFrame([("i", "a", 1, "h1")], shape)
    rows = [("i", "a", 1, "other"), ("i", "b", 7, "h1"), ("j", "a", 1, "h1"), ("i", "b", 1, "h2")]
    flagged = pools.flag_held_out(spark.createDataFrame(rows, shape), keys)
    got = {(r["item_id"], r["user_id"], r["review_hash"]): r["held_out"] for r in flagged.collect()}
    assert got == {("i", "a", "other"): True, ("i", "b", "h1"): True, ("j", "a", "h1"): False, ("i", "b", "h2"): False}


def test_planted_leak(spark):
    keys = spark.createDataFrame([("i", "a", 1, "h1")], "item_id string, user_id string, timestamp long, review_hash string")
    clean = spark.createDataFrame([("i", "h2"), ("j", "h1")], "item_id string, review_hash string")
    assert pools.leak_check(clean, keys).first().asDict() == {"n_eval_ids": 1, "n_card_ids": 2, "n_leaked": 0}
    assert pools.require_no_leak(clean, keys) is clean
    with pytest.raises(ValueError, match="1 held-out"):
        pools.require_no_leak(clean.union(spark.createDataFrame([("i", "h1")], clean.schema)), keys)


def test_leak_key_kinds(spark):
    manifest = spark.createDataFrame([("valid", "i", "a", 1, "h"), ("train", "i", "b", 2, "g")], "split string, item_id string, user_id string, timestamp long, review_hash string")
    assert pools.leak_keys(manifest).count() == pools.leak_keys(manifest, "valid_test").count() == 1
    assert pools.leak_keys(manifest, "none").count() == 0


def test_card_prompt_defaults(spark):
    items = spark.createDataFrame([("known",), ("bare",)], "item_id string")
    meta = spark.createDataFrame([("known", "Ann", 4.0, 7)], "item_id string, author string, average_rating double, rating_number int")
    selected = spark.createDataFrame([("known", 2, 5.0, "T", "x" * 500), ("known", 1, 1.0, None, None)], "item_id string, rank int, rating double, title string, text string")
    prompts = enrich.card_prompts(items, meta, selected, "{meta}|{reviews}", "rank", ("author", "title"))
    got = {r["item_id"]: r["prompt"] for r in prompts.collect()}
    assert got["known"] == "Author: Ann\nAvgRating: 4.0 (7 ratings)|(1.0/5)  — \n(5.0/5) T — " + "x" * 400
    assert got["bare"] == "Title: bare|(no reviews)"


def test_row_pool_takes_the_first_pieces_with_content(spark):
    rows = [(1, 1, "", " "), (1, 2, "t2", None), (1, 3, None, "x3"), (1, 4, "t4", "x4")]
    df = spark.createDataFrame(rows, "iid long, seq int, review_title string, review_text string")
    row = enrich.row_pool(df, [F.col("seq").asc()], reviews=2).first()
    assert (row["review_titles"], row["review_texts"]) == (["t2", None], [None, "x3"])


def test_item_texts_prefer_cards(spark):
    catalog = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "iid long, item_id string")
    pool = spark.createDataFrame([(1, ["t"], ["x"]), (2, ["t"], ["y"])], "iid long, review_titles array<string>, review_texts array<string>")
    cards = spark.createDataFrame([("a", " card "), ("b", "  "), ("zz", "other")], "item_id string, card string")
    texts = enrich.item_texts(catalog, pool, cards, "Do.", "book")
    got = {r["iid"]: r["item_text"] for r in texts.collect()}
    assert got == {1: "Do.\n\ncard", 2: "Do.\n\nReview title: t\nReview text: y", 3: "general book recommendation"}
    assert enrich.card_coverage(texts).first().asDict() == {"n_items": 3, "n_card": 1, "n_pool": 2, "n_pool_fallback": 1, "n_no_text": 1}


def test_generation_retries_and_cleans(spark):
    df = spark.createDataFrame([(i, "T", f"text {i}") for i in range(10)], "k int, title string, text string")

    def flaky(prompts):
        import random as r

        if r.random() < 0.3:
            raise RuntimeError("temporary")
        return [f'Query: "{p[-6:]}"\nmore' if not p.endswith("3") else "" for p in prompts]

    prompts = enrich.query_prompts(df, "[REVIEW]\n{review}")
    raw = enrich.map_texts(prompts, "prompt", "_raw", StringType(), flaky, batch_rows=3, retries=30, pause=0.001)
    assert raw.where("_raw is not null").count() == 10
    wide = spark.createDataFrame([(2**53 + 1, "a"), (None, "b")], "id long, prompt string")
    kept = enrich.map_texts(wide, "prompt", "_raw", StringType(), lambda texts: texts)
    assert {(r["id"], r["_raw"]) for r in kept.collect()} == {(2**53 + 1, "a"), (None, "b")}
    out = enrich.generate_queries(prompts, lambda ps: [f"Query: {p[-6:]}\nmore" if not p.endswith("3") else "" for p in ps], "book")
    got = {r["k"]: (r["query"], r["is_fallback"]) for r in out.collect()}
    assert got[3] == ("general book recommendation", True) and got[4] == ("text 4", False)
    assert enrich.fallback_rate(out).first().asDict() == {"n_rows": 10, "n_fallback": 1, "fallback_rate": 0.1}


def test_generator_must_answer_every_prompt(spark):
    df = spark.createDataFrame([("a",), ("b",)], "prompt string").coalesce(1)
    with pytest.raises(Exception, match="2 texts in, 1 results out"):
        enrich.generate_cards(df, lambda ps: ps[:1], "none").collect()


KEYS = ("user_id", "item_id", "timestamp")
OUT = "user_id string, item_id string, timestamp long, query string, is_fallback boolean"


def test_resume_and_merge(spark):
    old = spark.createDataFrame([("a", "i", 1, "old", False), ("b", "i", 1, "stays", False)], OUT)
    new = spark.createDataFrame([("a", "i", 1, "new", True), ("c", "i", 1, "added", False)], OUT)
    merged = inc.merge_latest([old, new.withColumn("note", F.lit("n"))], KEYS, [*KEYS, "query", "is_fallback"])
    assert {r["user_id"]: (r["query"], r["note"]) for r in merged.collect()} == {"a": ("new", "n"), "b": ("stays", None), "c": ("added", "n")}
    rows = spark.createDataFrame([("a", "i", 1), ("a", "i", 2)], "user_id string, item_id string, timestamp long")
    assert [r["timestamp"] for r in inc.todo(rows, inc.done_keys([old, new], KEYS), KEYS).collect()] == [2]
    twice = spark.createDataFrame([("a", "i", 1, "q2", False, "f:2"), ("a", "i", 1, "q3", False, "f:3")], f"{OUT}, row_id string")
    last = inc.merge_latest([old.withColumn("row_id", F.lit("f:0")), twice], KEYS, [*KEYS, "query"], order="row_id", sort=KEYS)
    assert [(r["user_id"], r["query"]) for r in last.collect()] == [("a", "q3"), ("b", "stays")] and "row_id" not in last.columns
    with pytest.raises(ValueError, match="missing"):
        inc.merge_latest([old.drop("query")], KEYS, ["query"])


def test_versions_switch_when_committed(spark, tmp_path):
    base = str(tmp_path / "table")
    assert inc.newest_version(spark, base) == (0, None)
    with pytest.raises(FileNotFoundError):
        inc.read_latest(spark, base)
    inc.commit_version(spark, base, 1, inc.write_version(spark.range(1), base))
    later = inc.write_version(spark.range(5), base)
    assert inc.read_latest(spark, base).count() == 1
    inc.commit_version(spark, base, 2, later)
    assert inc.read_latest(spark, base).count() == 5
    with pytest.raises(inc.VersionTaken):
        inc.commit_version(spark, base, 4, later)


def test_of_two_writers_one_commits(spark, tmp_path, monkeypatch):
    base = str(tmp_path / "table")
    inc.commit_version(spark, base, 1, inc.write_version(spark.range(1), base))
    mine, other = inc.write_version(spark.range(2), base), inc.write_version(spark.range(3), base)
    seen = inc.newest_version(spark, base)
    monkeypatch.setattr(inc, "newest_version", lambda *_: seen)  # both have looked before either commits
    inc.commit_version(spark, base, 2, other)
    with pytest.raises(inc.VersionTaken):
        inc.commit_version(spark, base, 2, mine)
    monkeypatch.undo()
    assert inc.newest_version(spark, base)[0] == 2 and inc.read_latest(spark, base).count() == 3
    inc.commit_version(spark, base, 3, mine)
    (tmp_path / "table" / "versions" / "000000000004").touch()  # a commit under way
    assert inc.read_latest(spark, base).count() == 2


def test_pools_of_single_texts(spark):
    pool = spark.createDataFrame([(1, "t", "some text"), (2, " ", None), (3, None, "x")], "iid long, review_titles string, review_texts string")
    catalog = spark.createDataFrame([(i, f"i{i}") for i in (1, 2, 3)], "iid long, item_id string")
    cards = spark.createDataFrame([], "item_id string, card string")
    got = {r["iid"]: r["item_text"] for r in enrich.item_texts(catalog, pool, cards, "Do.", "book").collect()}
    assert got == {1: "Do.\n\nReview title: t\nReview text: some text", 2: "general book recommendation", 3: "Do.\n\nReview text: x"}
