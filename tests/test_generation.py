"""Generation runs that are cut short and started again."""

from collections import Counter

import pytest
from pyspark.sql import types as T

from footfall.operators import enrich
from footfall.streaming import generation, incremental
from registry import text_queries, views


def asked(folder):
    return Counter(line for log in folder.iterdir() for line in log.read_text().splitlines())


def generator(log, fail_on=None):
    """Answers in upper case, and notes every prompt that it answered."""

    def answer(prompts):
        import os
        import uuid

        if fail_on in prompts:
            raise ValueError("no more calls")
        with open(os.path.join(log, uuid.uuid4().hex), "w") as f:
            f.write("\n".join(prompts))
        return [p.upper() for p in prompts]

    return answer


@pytest.fixture
def prompts(spark):
    return spark.createDataFrame([(i, f"p{i}") for i in range(57)], "id long, prompt string")


def test_a_killed_run_asks_only_for_the_rest(spark, prompts, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()
    run = lambda fail_on: generation.generate_durably(
        prompts, "prompt", "answer", T.StringType(), generator(str(log), fail_on), str(tmp_path / "run"), chunk_rows=5, step_chunks=2, retries=0
    )
    with pytest.raises(Exception, match="no more calls"):
        run("p31")
    answers = next(p for p in (tmp_path / "run").iterdir() if p.name.endswith("-answers"))
    kept = {r["id"] for r in spark.read.parquet(str(answers)).collect()}
    before = asked(log)
    assert 0 < len(kept) < 57 and 31 not in kept
    out = run(None)
    again = asked(log)
    assert sorted((r["id"], r["answer"]) for r in out.collect()) == [(i, f"P{i}") for i in range(57)]
    assert all(again[f"p{i}"] == before[f"p{i}"] == 1 for i in kept)  # committed chunks are not asked for again
    assert sum(again.values()) <= 57 + 10
    assert run(None).count() == 57 and asked(log) == again  # a finished run asks for nothing


def test_more_prompts_later(spark, prompts, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()
    run = lambda df, name: generation.generate_durably(
        df, "prompt", "answer", T.StringType(), generator(str(log)), str(tmp_path / "run"), name, chunk_rows=20
    )
    first = run(prompts.where("id < 30"), "first")
    rest = run(incremental.todo(prompts, first.select("id"), ["id"]), "second")
    assert sorted(r["id"] for r in first.union(rest).collect()) == list(range(57))
    assert set(asked(log).values()) == {1}
    assert run(prompts.limit(0), "none").count() == 0


def test_same_answers_as_in_one_run(spark, sf, tmp_path):
    prompts = enrich.query_prompts(views.reviews(spark, sf), text_queries.QUERY_TEMPLATE)
    once = enrich.map_texts(prompts, "prompt", "_raw", T.StringType(), text_queries.echo_review)
    kept = generation.generate_durably(prompts, "prompt", "_raw", T.StringType(), text_queries.echo_review, str(tmp_path / "run"))
    rows = lambda df: sorted((r["review_id"], r["_raw"]) for r in df.collect())
    assert rows(once) == rows(kept)
