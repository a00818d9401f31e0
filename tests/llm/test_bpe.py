"""Byte-level BPE against the tokenizer library, piece by piece and through Spark."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from footfall.llm import bpe
from footfall.llm.queries import PATTERN, RANKS, op2_byte_bpe, table, token_digests


def library(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(encoder, texts):
    out = []
    for ids, counts in encoder.encode(iter(texts)):
        at = 0
        for n in counts.tolist():
            out.append(ids[at : at + n].tolist())
            at += n
    return out


def test_random_texts():
    rnd = random.Random(1)
    ranks = bpe.read_ranks(RANKS)
    signs = "aab bc'sdl\n\t  .,!1279éèñ中文 \x1c\x85᠎'ll're😀\r\n"
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    texts += ["", "a" * 3000, "ab" * 1500, " " * 900 + "x", "\n" * 900, " ", "<|endoftext|>"]
    assert encoded(bpe.Encoder(ranks, PATTERN), texts) == [library(ranks).encode_ordinary(t) for t in texts]


def test_vocabularies_whose_merges_bring_up_lower_ranks():
    rnd = random.Random(2)
    for _ in range(60):
        tokens = list({bytes(rnd.choice(b"abc") for _ in range(rnd.randint(2, 6))) for _ in range(40)})
        rnd.shuffle(tokens)
        ranks = {t: r for r, t in enumerate([*(bytes([b]) for b in range(256)), *tokens])}
        texts = ["".join(rnd.choice("abc ") for _ in range(rnd.randint(1, 25))) for _ in range(40)]
        assert encoded(bpe.Encoder(ranks, PATTERN), texts) == [library(ranks).encode_ordinary(t) for t in texts]


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    encoder = bpe.Encoder(ranks := bpe.read_ranks(RANKS), PATTERN)
    for text in ("one two three four", "two five", "six seven one", ""):
        assert encoded(encoder, [text, text]) == [library(ranks).encode_ordinary(text)] * 2


@pytest.mark.parametrize("rows", [0, 1])
def test_query_on_whole_table(spark, sf, rows):
    docs = table(spark, sf, "documents")
    if not rows:
        assert token_digests(docs.limit(0)).count() == 0
        return
    whole = library(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    want = {}
    for r in docs.select("doc_id", "text").collect():
        ids = whole.encode_ordinary(r.text or "")
        digest = lambda b: hashlib.sha256(b).hexdigest()
        want[r.doc_id] = (len(ids), digest(" ".join(map(str, ids)).encode()), digest((r.text or "").encode()))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op2_byte_bpe(spark, sf).collect()}
    assert got == want


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, None, 5), (2, "", 6), (2, "", 6), (None, "same text", 7), (4, "same text", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens_in int")
    got = {(r.doc_id, r.n_tokens, r.n_tokens_in) for r in token_digests(docs).collect()}
    assert got == {(1, 0, 5), (2, 0, 6), (None, 2, 7), (4, 2, None)}
    ids = docs.select(bpe.encode(spark, docs.text, RANKS, PATTERN).alias("ids"))
    assert [r.ids for r in ids.collect()][:2] == [None, []]
    odd = spark.createDataFrame([(None,), ([],), ([None],), ([-1],), ([10**9],)], "ids array<int>")
    assert [r.b for r in odd.select(bpe.decode(spark, odd.ids, RANKS).alias("b")).collect()] == [None, b"", None, None, None]


def test_ids_and_bytes_come_from_one_worker(spark):
    docs = spark.createDataFrame([(k, "one two\n" * k if k % 7 else None) for k in range(1203)], "doc_id long, text string").coalesce(1)
    found = token_digests(docs)
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    both = docs.select("text", bpe.round_trip(spark, docs.text, RANKS, PATTERN).alias("x"), bpe.encode(spark, docs.text, RANKS, PATTERN).alias("ids"))
    for r in both.select("text", "x.*", F.col("ids").alias("alone")).collect():
        assert r.ids == r.alone and r.bytes == (None if r.text is None else r.text.encode())
