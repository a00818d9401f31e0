"""Aligned tokens against a plain walk over the ends of both tokenizers' tokens."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer, decoders

from footfall.llm import align
from footfall.llm.queries import TOKENIZER_A, TOKENIZER_B, op13_tokenizer_alignment, table

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
LEVEL = {c: bytes([b]) for c, b in align._byte_of().items()}


def a_bytes(i):
    return b"".join(LEVEL[c] for c in A.id_to_token(i))


def b_bytes(i):
    piece = B.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if B.is_byte(i) else piece.replace("▁", " ").encode()


def plain(texts):
    """``(n_a, n_b, n_groups, n_links, n_best, count_sum, groups)`` of each text."""
    linked, out = [], []
    for text in texts:
        groups, links = [], []
        if text:
            a, b, want = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text), (" " + text).encode()
            if b"".join(map(a_bytes, a)) == want == b"".join(map(b_bytes, b)):
                a_end = {int(e): k for k, e in enumerate(np.cumsum([len(a_bytes(i)) for i in a]))}
                b_end = {int(e): k for k, e in enumerate(np.cumsum([len(b_bytes(i)) for i in b]))}
                links = [(a[a_end[e]], b[b_end[e]]) for e in a_end if e in b_end]
                x = y = 0
                for e in sorted(set(a_end) & set(b_end)):
                    groups.append((a[x : a_end[e] + 1], b[y : b_end[e] + 1]))
                    x, y = a_end[e] + 1, b_end[e] + 1
        linked.append(links)
        out.append(groups)
    counts, most = Counter(x for links in linked for x in links), defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    for links, groups in zip(linked, out, strict=True):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        yield (
            sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links),
            sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links),
            hashlib.sha256(text.encode()).hexdigest() if text else "",
        )


def numbers(rows):
    return [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows]


def counted(docs):
    found = align.align(docs, ["doc_id"], "text", TOKENIZER_A, TOKENIZER_B)
    return align.with_link_counts(found.withColumn("groups_sha256", F.when(F.col("n_a") > 0, F.sha2("groups_text", 256)).otherwise("")))


def test_level_bytes_are_the_decoders():
    for i in (0, 220, 262, 1000, 49999):
        assert decoders.ByteLevel().decode([A.id_to_token(i)]) == a_bytes(i).decode(errors="replace")


def test_query_on_whole_table(spark, sf):
    rows = table(spark, sf, "documents").orderBy("doc_id").collect()
    got = sorted(op13_tokenizer_alignment(spark, sf).collect(), key=lambda r: r.doc_id)
    assert numbers(got) == list(plain([r.text for r in rows]))
    assert sum(r.n_a > 0 for r in got) > 0.9 * len(rows)


ODD = [
    None, "", " ", "  ", "a", " a", "a ", "\n", "a\n\n b\t c", "<|endoftext|> <s> </s> <unk> <0x0A>", "▁ under", "éé 中文 \U0001f600\U0001f600",
    "\x00 \x1c", " x y", "same text", "same text", "ﬁ ① Ａ", "x" * 5000, " ".join(f"w{i}" for i in range(60_000)), "a  b   c" * 300, "İß",
]


@pytest.mark.parametrize(("lane", "together", "long"), [(1024, 1 << 20, 1 << 18), (7, 50, 40), (1, 1, 1)])
def test_odd_texts(spark, monkeypatch, lane, together, long):
    own = align.Aligner(open(TOKENIZER_A, "rb").read(), open(TOKENIZER_B, "rb").read())
    for name, value in (("LANE", lane), ("TOGETHER", together), ("LONG", long)):
        monkeypatch.setattr(align, name, value)
    texts = [t for t in ODD if t and (long > 1 or len(t) < 10_000)]
    found = own.align([t.encode() for t in texts])
    want = [x for x, t in zip(plain(texts), texts, strict=True)]
    digests = [hashlib.sha256(t).hexdigest() if t else "" for t in found.group_texts()]
    assert list(zip(found.n_a, found.n_b, found.n_links, digests, strict=True)) == [(x[0], x[1], x[2], x[6]) for x in want]


def test_odd_rows(spark):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    clash = docs.withColumns({n: F.lit(9) for n in ("n_a", "links", "a", "b", "n", "_row", "count")})
    got = sorted(counted(clash).collect(), key=lambda r: r.doc_id)
    assert numbers(got) == list(plain(ODD))
    assert counted(docs.limit(0)).count() == 0
    twice = counted(spark.createDataFrame([(1, "same id"), (1, "other words"), (1, "same id"), (None, "no id")], docs.schema))
    assert sorted(numbers(twice.collect())) == sorted(plain(["same id", "other words", "same id", "no id"]))


def test_lanes_change_nothing(monkeypatch):
    rnd = random.Random(1)
    for _ in range(50):
        total = rnd.randint(1, 400)
        a, b = (np.array(sorted({*rnd.sample(range(1, total + 1), rnd.randint(0, total)), total})) for _ in range(2))
        cuts = sorted(rnd.sample(sorted(set(a.tolist()) & set(b.tolist())), 1))
        bounds = np.array(sorted({0, *cuts, total}))
        monkeypatch.setattr(align, "LANE", rnd.choice([1, 3, 50, 1000]))
        i, j = align.lockstep(a, b, bounds)
        assert a[i].tolist() == b[j].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


@pytest.mark.parametrize("known", [0, 1 << 22])
def test_words_are_encoded_once_and_as_in_the_whole_text(monkeypatch, known):
    rng = random.Random(5)
    # Not U+2581: B gives it back as a space, so that such a text has no tokens in any case.
    signs = [" ", " ", "  ", "\n", "\t", "\x1c", " ", "　", "́", "'s", "'ll", "don't", "a", "Wort", "12", "3.5", "...", "<s>", "<|endoftext|>", "語", "\U0001f600", "#", "x_y"]
    texts = ["one two one two", "two one  one", *("".join(rng.choices(signs, k=rng.randint(1, 60))) for _ in range(300))]
    monkeypatch.setattr(align, "KNOWN", known)
    own = align.Aligner(*(open(public_tokenizers.path(f), "rb").read() for f in ("byte_bpe_50k.json", "piece_bpe_32k.model")))
    learned, learn = [], own._learn
    monkeypatch.setattr(own, "_learn", lambda words: (learned.extend(words), learn(words)))
    for some in (texts[:200], texts[200:], texts[:200]):
        a, n_a, b, n_b = own._encoded(some)
        each = [A.encode(" " + t, add_special_tokens=False).ids for t in some], [B.encode(t) for t in some]
        assert a.tolist() == sum(each[0], []) and n_a.tolist() == list(map(len, each[0]))
        assert b.tolist() == sum(each[1], []) and n_b.tolist() == list(map(len, each[1]))
    assert learned.count("two") == (1 if known else 2)
