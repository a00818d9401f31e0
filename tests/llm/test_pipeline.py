"""The pipeline's stages against plain code on the smallest documents."""

import hashlib

import tiktoken

import corpus_pipeline
from footfall.llm import bpe
from footfall.llm.queries import PATTERN, RANKS, table
from tests.llm import brute


def test_stages(spark, sf, tmp_path):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "near_dedup", "source_mixing", "byte_bpe"]
    docs = table(spark, sf, "documents")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.collect()
        assert docs.columns == columns or name == "byte_bpe"
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    spoken = {r.doc_id: r.text for r in kept["language_id"]}
    assert spoken.items() <= texts.items()
    lines = brute.kept_lines(spoken)
    cut = {
        k: "\n".join(x for i, x in enumerate(t.split("\n")) if i in lines[k] or not brute.words(x)) for k, t in spoken.items() if lines[k]
    }
    assert {r.doc_id: r.text for r in kept["line_dedup"]} == cut
    assert all(r.n_chars == len(r.text) for r in kept["line_dedup"])
    first = {k for k, (_, _, stays) in brute.near_components(cut).items() if stays}
    assert {r.doc_id for r in kept["near_dedup"]} == first
    assert {r.doc_id for r in kept["source_mixing"]} == first and len(kept["source_mixing"]) >= len(first)
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    assert len(kept["byte_bpe"]) == len(kept["source_mixing"])
    for r in kept["byte_bpe"]:
        ids = library.encode_ordinary(cut[r.doc_id])
        assert list(r.ids) == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(cut[r.doc_id].encode()).hexdigest()


def test_near_copies_of_a_similarity_above_four_fifths(spark, sf):
    words = [f"w{i}" for i in range(200)]
    other = [f"e{i}" if i in (20, 70, 120, 170) else w for i, w in enumerate(words)]
    texts = {1: " ".join(words), 2: " ".join(other)}
    assert all(stays for _, _, stays in brute.near_components(texts, 85).values())
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    left = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()}
    assert left == {k for k, (_, _, stays) in brute.near_components(texts, 80).items() if stays} == {1}


def test_run_and_odd_documents(spark, tmp_path):
    rows = [(1, None, "en", "a", 0), (2, "", "en", None, 0), (3, "123 456", None, "a", 7), (4, "the and of with this", "en", "a", 20)]
    rows += [(5, "the and of with this", "en", None, 20), (5, "the and of with this", "en", None, 20), (6, "by for not all\n\nthe and", None, "b", 9)]
    for name, part in (("some", rows), ("none", [])):
        frame = spark.createDataFrame(part, "doc_id long, text string, lang string, source string, n_chars long")
        frame.write.parquet(str(tmp_path / name / "documents.parquet"))
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path / "some")).collect()} == {4, 6}
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
