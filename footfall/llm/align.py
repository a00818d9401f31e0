"""Alignment of two tokenizers' tokens over the same texts.

Both tokenizers cut the same bytes (a space and the text). Where a token of A and a token of B end
at the same byte, the two are linked and the text is cut; the tokens between two cuts form a group.
All documents of a batch are merged in lockstep: one NumPy state vector holds the A and B pointers
of every lane, a step compares the ends under all pointers, emits links and cuts where they agree and
advances the pointer that is behind; finished lanes are compacted away. A long document takes
several lanes, cut at fixed byte offsets, which changes nothing since a link only needs equal ends.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.bpe import gather
from footfall.llm.small import checked_broadcast
from footfall.llm.wordhash import raw_texts
from footfall.plans.scratch import materialise

#: Bytes of a lane, of the texts merged at once (about), characters encoded at once, and those of the words that a worker remembers.
LANE, TOGETHER, LONG, KNOWN = 1024, 1 << 20, 1 << 18, 1 << 22

# A place where neither tokenizer can join what stands before with what follows.
_CUT = re.compile(r"(?<=\S) (?=\S)")


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible ones stand for themselves."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class _Table:
    """Byte strings by number, ready to be gathered."""

    def __init__(self, entries: Sequence[bytes]):
        self.size = np.fromiter(map(len, entries), "int64", len(entries))
        self.ends = np.append(0, np.cumsum(self.size))
        self.flat = np.frombuffer(b"".join(entries), "uint8")

    def join(self, rows: np.ndarray) -> np.ndarray:
        return gather(self.flat, self.ends, rows)


class Aligner:
    """Both tokenizers of a worker. A is a byte-level BPE of ``tokenizers``, B a ``sentencepiece`` model that adds a space."""

    def __init__(self, a_json: bytes, b_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_buffer(a_json), sentencepiece.SentencePieceProcessor(model_proto=b_model)
        self.a.encode_special_tokens = True
        byte_of, names = _byte_of(), {i: t for t, i in self.a.get_vocab().items()}
        self.a_bytes = _Table([bytes(map(byte_of.__getitem__, names.get(i, ""))) for i in range(max(names) + 1)])
        pieces = range(self.b.vocab_size())
        as_bytes = lambda i, p: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
        self.b_bytes = _Table([as_bytes(i, self.b.id_to_piece(i)) for i in pieces])
        # B's pieces hold a space only at their start, or the places of _CUT would not be safe.
        self.cuts = not any(" " in self.b.id_to_piece(i).replace("▁", " ").lstrip(" ") for i in pieces)
        self.decimals = _Table([b"%d," % i for i in range(max(len(self.a_bytes.size), len(pieces)))])
        self._forget()

    def _forget(self) -> None:
        """No word is known: ``known`` is the place of each in the sizes, and ``ids`` of A and B follow each other."""
        self.known: dict[str, int] = {}
        self.letters, self.ids, self.sizes = 0, (array("i"), array("i")), (array("i"), array("i"))

    def _learn(self, words: list[str]) -> None:
        """Encodes words that are not known."""
        start = 0
        while start < len(words):  # what the encoders hold is many times a text's size
            stop, size = start + 1, len(words[start])
            while stop < len(words) and size + len(words[stop]) <= LONG:
                size += len(words[stop])
                stop += 1
            part = words[start:stop]
            found = (e.ids for e in self.a.encode_batch_fast([" " + w for w in part], add_special_tokens=False))
            for ids, sizes, each in zip(self.ids, self.sizes, (found, self.b.encode(part, num_threads=1)), strict=True):
                for own in each:
                    ids.extend(own)
                    sizes.append(len(own))
            self.letters += size
            start = stop
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All ids of A and the number of each text's, and the same of B."""
        parts = [_CUT.split(t) if self.cuts else [t] for t in texts]
        flat = [w for own in parts for w in own]
        if self.letters > KNOWN:
            self._forget()
        self._learn([w for w in dict.fromkeys(flat) if w not in self.known])
        places = np.fromiter(map(self.known.__getitem__, flat), "int64", len(flat))
        first = np.append(0, np.cumsum([len(own) for own in parts])[:-1])
        out = []
        for ids, sizes in zip(self.ids, self.sizes, strict=True):
            ids, sizes = np.array(ids, "int32"), np.array(sizes, "int64")
            out += [gather(ids, np.append(0, np.cumsum(sizes)), places), np.add.reduceat(sizes[places], first)]
        return tuple(out)

    def align(self, texts: list[bytes]) -> Aligned:
        """``texts`` are not empty."""
        a, n_a, b, n_b = self._encoded([t.decode() for t in texts])
        want = [b" " + t for t in texts]

        def agree(table: _Table, ids: np.ndarray, counts: np.ndarray) -> list[bool]:
            joined = table.join(ids).tobytes()
            ends = np.append(0, np.cumsum(table.size[ids]))[np.append(0, np.cumsum(counts))].tolist()
            return [joined[x:y] == t for x, y, t in zip(ends[:-1], ends[1:], want, strict=True)]

        ok = np.array(agree(self.a_bytes, a, n_a)) & np.array(agree(self.b_bytes, b, n_b))
        a, b = a[np.repeat(ok, n_a)], b[np.repeat(ok, n_b)]
        n_a, n_b = np.where(ok, n_a, 0), np.where(ok, n_b, 0)
        bounds = np.append(0, np.cumsum(np.where(ok, [len(t) for t in want], 0)))
        a_ends, b_ends = np.cumsum(self.a_bytes.size[a]), np.cumsum(self.b_bytes.size[b])
        return Aligned(self, a, n_a, b, n_b, *lockstep(a_ends, b_ends, bounds))


def lockstep(a_ends: np.ndarray, b_ends: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the A and B tokens that end together; ``bounds`` are the byte offsets between documents."""
    lanes = np.maximum(-(-np.diff(bounds) // LANE), 0)
    within = np.arange(int(lanes.sum())) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    low = np.repeat(bounds[:-1], lanes) + within * LANE
    high = np.minimum(low + LANE, np.repeat(bounds[1:], lanes))
    i, i_end = np.searchsorted(a_ends, low, "right"), np.searchsorted(a_ends, high, "right")
    j, j_end = np.searchsorted(b_ends, low, "right"), np.searchsorted(b_ends, high, "right")
    a_links, b_links = [np.zeros(0, "int64")], [np.zeros(0, "int64")]
    while True:
        live = (i < i_end) & (j < j_end)
        if not live.all():
            i, j, i_end, j_end = i[live], j[live], i_end[live], j_end[live]
        if not len(i):
            return np.sort(np.concatenate(a_links)), np.sort(np.concatenate(b_links))
        x, y = a_ends[i], b_ends[j]
        same = x == y
        a_links.append(i[same])
        b_links.append(j[same])
        i, j = i + (x <= y), j + (y <= x)


class Aligned:
    """Tokens, links and cuts of several documents; the k-th links of A and B belong together, and end the k-th group."""

    def __init__(self, own: Aligner, a, n_a, b, n_b, a_links, b_links):  # noqa: ANN001
        self.own, self.a, self.n_a, self.b, self.n_b, self.a_links, self.b_links = own, a, n_a, b, n_b, a_links, b_links
        self.n_links = np.diff(np.searchsorted(a_links, np.append(0, np.cumsum(n_a))))

    def group_texts(self) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each document: decimal ids of A and of B, group by group."""
        a_cut, b_cut = np.zeros(len(self.a), bool), np.zeros(len(self.b), bool)
        a_cut[self.a_links] = b_cut[self.b_links] = True
        a_group, b_group = np.cumsum(a_cut) - a_cut, np.cumsum(b_cut) - b_cut
        # An A token stands behind the B tokens of earlier groups, a B token behind the A tokens up to its own group.
        a_at = np.arange(len(self.a)) + np.append(0, self.b_links + 1)[a_group]
        b_at = np.arange(len(self.b)) + (self.a_links + 1)[b_group]
        ids, mark = np.empty(len(self.a) + len(self.b), "int32"), np.full(len(self.a) + len(self.b), ord(","), "uint8")
        ids[a_at], ids[b_at] = self.a, self.b
        mark[a_at[a_cut]], mark[b_at[b_cut]] = ord("|"), ord(";")
        joined, ends = self.own.decimals.join(ids), np.cumsum(self.own.decimals.size[ids])
        joined[ends - 1] = mark
        bounds = np.append(0, ends)[np.append(0, np.cumsum(self.n_a + self.n_b))].tolist()
        whole = joined.tobytes()
        return [whole[x : max(x, y - 1)] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A id, B id and number of links of each document's distinct pairs, and how many pairs each document has."""
        wide = len(self.own.b_bytes.size)
        span = wide * len(self.own.a_bytes.size)
        doc = np.repeat(np.arange(len(self.n_links)), self.n_links)
        key = doc * span + self.a[self.a_links].astype("int64") * wide + self.b[self.b_links]
        key, n = np.unique(key, return_counts=True)
        each = np.bincount(key // span, minlength=len(self.n_links))
        return key % span // wide, key % wide, n, each


_aligners: dict[tuple, Aligner] = {}


def align(docs: DataFrame, keys: Sequence[str], text: str, a_path: str, b_path: str) -> DataFrame:
    """The keys, ``n_a, n_b, n_groups, n_links, groups_text, links`` of every row.

    ``groups_text`` holds the ids of both tokenizers group by group, ``links`` the distinct pairs of linked
    ids ``a, b`` with their number ``n``. Null and empty texts, and those that one of the tokenizers
    does not give back byte by byte, have no tokens: zeros, an empty text and no links. Rows may repeat.
    A text of any length is taken whole; one that is long is encoded in parts where neither tokenizer can tell.
    """
    shared = docs.sparkSession.sparkContext.broadcast((Path(a_path).read_bytes(), Path(b_path).read_bytes()))  # two vocabularies
    rows = docs.select(*keys, text)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    schema = f"{fields}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_text binary, links array<struct<a:int,b:int,n:int>>"
    names = [*keys, "n_a", "n_b", "n_groups", "n_links", "groups_text", "links"]

    def solved(part: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        key = (a_path, b_path)
        if key not in _aligners:
            _aligners.clear()
            _aligners[key] = Aligner(*shared.value)
        full = np.array([bool(t) for t in texts])
        counts = np.zeros((3, len(texts)), "int64")
        groups, pairs, each = [b""] * len(texts), [np.zeros(0, "int64")] * 3, np.zeros(len(texts), "int64")
        if full.any():
            found = _aligners[key].align([t for t in texts if t])
            counts[:, full] = found.n_a, found.n_b, found.n_links
            rest = iter(found.group_texts())
            groups = [next(rest) if t else b"" for t in texts]
            *pairs, each[full] = found.pairs()
        links = pa.StructArray.from_arrays([pa.array(p, pa.int32()) for p in pairs], ["a", "b", "n"])
        ends = pa.array(np.append(0, np.cumsum(each)), pa.int32())
        n_a, n_b, n_links = map(pa.array, counts)
        own = [part.column(i) for i in range(len(keys))]
        found = [n_a, n_b, n_links, n_links, pa.array(groups, pa.binary()), pa.ListArray.from_arrays(ends, links)]
        return pa.RecordBatch.from_arrays([*own, *found], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, held, size = 0, [], 0
            for raw in raw_texts(batch.column(len(keys))):
                held.append(raw)
                size += len(raw)
                if size >= TOGETHER:
                    yield solved(batch.slice(start, len(held)), held)
                    start, held, size = start + len(held), [], 0
            if held:
                yield solved(batch.slice(start), held)

    return rows.mapInArrow(run, schema)


def with_link_counts(aligned: DataFrame) -> DataFrame:
    """Adds ``n_best`` and ``count_sum`` to a table with ``links``; the links go.

    An id pair's count is the number of its links in the whole table. ``n_best`` counts a row's links whose
    count is the highest that their B id has (ties included), ``count_sum`` sums the counts of its links.
    """
    stored = materialise(aligned.withColumn("_row", F.monotonically_increasing_id()), "aligned")
    each = stored.select("_row", F.explode("links").alias("x")).select("_row", "x.*")
    pairs = materialise(each.groupBy("a", "b").agg(F.sum("n").alias("count")), "link-pairs")
    most = pairs.groupBy("b").agg(F.max("count").alias("most"))
    judged = materialise(pairs.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best")), "link-counts")
    best = F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best")
    sums = each.join(checked_broadcast(judged), ["a", "b"]).groupBy("_row").agg(best, F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    return stored.drop("links").join(sums, "_row", "left").drop("_row").fillna(0, ["n_best", "count_sum"])
