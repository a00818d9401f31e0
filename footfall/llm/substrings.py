"""Substring dedup: word windows that occur more than once, found with suffix automata of shards.

Every window of ``window`` words has one anchor, the smallest hash among its word n-grams, so equal
windows have equal anchors at equal places. Consecutive windows with the same anchor form a segment;
each window is in exactly one. Segments are narrow rows of hashes. Those whose anchor is found
nowhere else are dropped; those with equal contents are collapsed to one reference with its number
of occurrences. Where an anchor has several contents, the references' words are fetched and dealt by
anchor into shards of bounded size. A shard's suffix automaton counts the occurrences of all its
word sequences; the segments stream through it for their matching statistics, and the spans where a
sequence of ``window`` words is met twice or more are removed.

The automata are built where their shard's segments meet and not broadcast to all texts: together
they are as large as the repeated part of the corpus, which has no bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.llm.quality import words_of
from footfall.llm.small import checked_broadcast
from footfall.llm.wordhash import WordHashes, grams, mixed, raw_texts
from footfall.plans.scratch import materialise

#: Words of an anchor, windows of a segment at most, words of an automaton (about), and contents of an
#: anchor from which it is split by what stands beside it, and then counted window by window.
ANCHOR, RUN, SHARD_WORDS, CROWDED = 8, 60, 30_000, 3000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _leftmost_minima(values: np.ndarray, n: int) -> np.ndarray:
    """Place of the first smallest of each n consecutive values."""
    low, at, size = values, np.arange(len(values)), 1
    while size < n:
        step = min(size, n - size)
        right = low[step:] < low[:-step]
        at = np.where(right, at[step:], at[:-step])
        low = np.where(right, low[step:], low[:-step])
        size += step
    return at


def segments_of(hashes: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Start, number of windows, place of the anchor from the start, anchor and content of a text's segments."""
    if len(hashes) < window:
        return (np.zeros(0, "int32"),) * 3 + (np.zeros(0, "int64"),) * 2
    k = min(ANCHOR, window)
    g = grams(hashes, k)
    at = _leftmost_minima(g, window - k + 1)
    away = (at - np.arange(len(at))) // RUN
    start = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 0) | (np.diff(away) != 0)]))
    count = np.diff(np.append(start, len(at)))
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(hashes), _BASE)]))
    back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(hashes), _BACK)]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(hashes) * powers[:-1])])
    content = mixed((sums[start + count + window - 1] - sums[start]) * back[start] + count.astype("uint64"))
    place = (at[start] - start).astype("int32")
    return start.astype("int32"), count.astype("int32"), place, g[at[start]].view("int64"), content.view("int64")


def segments(docs: DataFrame, window: int) -> DataFrame:
    """``id, th, start, n, at, anchor, content`` of every segment of the whole texts of ``id, th, t``."""
    kind = docs.schema["id"].dataType.simpleString()
    names = ["id", "th", "start", "n", "at", "anchor", "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                found = [segments_of(words.of(raw.split()), window) for raw in raw_texts(part.column(2))]
                row = np.repeat(np.arange(len(found)), [len(x[0]) for x in found])
                columns = [pa.array(np.concatenate(x)) for x in zip(*found, strict=True)]
                own = [part.column(i).take(pa.array(row)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, *columns], names=names)

    return docs.select("id", "th", "t").mapInArrow(run, f"id {kind}, th bigint, start int, n int, at int, anchor bigint, content bigint")


def with_shared_anchor(found: DataFrame) -> DataFrame:
    """The segments whose anchor is found twice or more, and a few others.

    Rows are dealt by ranges of anchor, content and place, so an anchor of any frequency is spread;
    in a range a row is kept if a neighbour has its anchor, and at the ends because one may.
    """
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before, first = None, None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            anchor = batch.column("anchor").to_numpy()
            same = anchor[1:] == anchor[:-1]
            keep = np.append(False, same) | np.append(same, False)
            keep[0] |= first or before == anchor[0]
            before, first = (anchor[-2] if len(anchor) > 1 else before), False if len(anchor) > 1 else first
            held = batch.slice(batch.num_rows - 1)
            yield batch.slice(0, batch.num_rows - 1).filter(pa.array(keep[:-1]))
        if held is not None:
            yield held

    dealt = found.repartitionByRange(parts, "anchor", "content", "id", "th", "start")
    return dealt.sortWithinPartitions("anchor", "content", "id", "th", "start").mapInArrow(run, found.schema)


class Automaton:
    """A suffix automaton of several word sequences, with the number of occurrences of each state."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _state(self, following: dict[int, int], link: int, length: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.count.append(0)
        return len(self.link) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """The state reached from p by the word, if it is no longer than p and the word."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1)
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, words: list[int], times: int) -> None:
        last = 0
        for word in words:
            known = self.next[last].get(word)
            if known is not None:
                last = self._split(last, word, known)
            else:
                new, p = self._state({}, 0, self.length[last] + 1), last
                while p >= 0 and word not in self.next[p]:
                    self.next[p][word] = new
                    p = self.link[p]
                if p >= 0:
                    self.link[new] = self._split(p, word, self.next[p][word])
                last = new
            self.count[last] += times

    def close(self) -> None:
        """Count the occurrences of shorter sequences too; nothing may be added afterwards."""
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[state]] += self.count[state]

    def repeats(self, words: list[int], window: int) -> int:
        """A bit for each window of the sequence that occurs twice or more."""
        state, matched, mask = 0, 0, 0
        for i, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            state = self.next[state].get(word, 0)
            matched = matched + 1 if state else 0
            while state and self.length[self.link[state]] >= window:
                state = self.link[state]
                matched = self.length[state]
            if matched >= window and self.count[state] >= 2:
                mask |= 1 << (i - window + 1)
        return mask


def _shard_masks(rows: DataFrame, window: int) -> DataFrame:
    """``anchor, content, mask`` of the references ``shard, anchor, content, first, times, body``, shard by shard.

    ``first`` is the place of the body's first window in the reference.
    """
    names = ["anchor", "content", "mask"]

    def solve(part: list[tuple]) -> pa.RecordBatch:
        numbers: dict[bytes, int] = {}
        automaton = Automaton()
        coded = [[numbers.setdefault(w, len(numbers)) for w in row[5].split(b" ")] for row in part]
        for row, words in zip(part, coded, strict=True):
            automaton.add(words, row[4])
        automaton.close()
        masks = [automaton.repeats(words, window) << row[3] for row, words in zip(part, coded, strict=True)]
        columns = [pa.array([row[i] for row in part], pa.int64()) for i in (1, 2)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(masks, pa.int64())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, size = [], 0
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[:5]]
            for row in zip(*columns, raw_texts(batch.column(5)), strict=True):
                if size >= SHARD_WORDS and row[0] != part[-1][0]:
                    yield solve(part)
                    part, size = [], 0
                part.append(row)
                size += row[5].count(b" ") + 1
        if part:
            yield solve(part)

    dealt = rows.select("shard", "anchor", "content", "first", F.least("times", F.lit(2)).alias("times"), "body").repartition("shard")
    return dealt.sortWithinPartitions("shard", "anchor", "content").mapInArrow(run, "anchor bigint, content bigint, mask bigint")


def _halves(crowded: DataFrame, window: int) -> DataFrame:
    """References of crowded anchors in two parts, each dealt by the anchor and what all its windows hold beside it.

    A window has more words either before or behind its anchor, and so holds at least the nearer half
    of what can stand there. Equal windows are in parts of the same shard.
    """
    k = min(ANCHOR, window)
    half = (window - k) // 2 + 1
    w, n, at = F.col("w"), F.col("n"), F.col("at")

    def part(first: Column, last: Column, start: Column, words: int) -> Column:
        beside = F.array_join(F.slice(w, start + 1, F.lit(words)), " ")
        return F.when(last >= first, F.struct(
            first.alias("first"),
            F.xxhash64("anchor", F.lit(words), beside).alias("shard"),
            F.array_join(F.slice(w, first + 1, last - first + window), " ").alias("body"),
        ))

    before = part(F.lit(0), F.least(n - 1, at - half), at - half, half)
    behind = part(F.greatest(F.lit(0), at - half + 1), n - 1, at + k, window - k - half + 1)
    rows = crowded.withColumn("w", F.split("body", " ")).select("anchor", "content", "times", F.explode(F.array_compact(F.array(before, behind))).alias("p"))
    return rows.select("p.shard", "anchor", "content", "p.first", "times", "p.body")


def repeated_windows(docs: DataFrame, key: str, text: str, window: int = 35) -> DataFrame:
    """``id, th, spans``: for each text with repeated windows, structs of ``start`` and a bit mask of windows from there.

    ``th`` is a hash of the text, which tells rows apart that share a key.
    """
    docs = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("t"))
    found = materialise(segments(docs, window), "segments")
    shared = materialise(with_shared_anchor(found), "segments-shared")
    contents = shared.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("id", "th", "start", "n", "at")).alias("r"))
    contents = materialise(contents, "segment-contents")
    copies = contents.where(F.col("times") > 1).select("anchor", "content", F.expr("shiftleft(1L, r.n) - 1").alias("mask"))

    many = contents.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > 1)
    refs = contents.join(many, "anchor").select("anchor", "content", "times", "k", "r.*")
    wanted = refs.groupBy("id", "th").agg(F.collect_list(F.struct("anchor", "content", "times", "k", "start", "n", "at")).alias("refs"))
    wanted = materialise(wanted, "segment-wanted").withColumnsRenamed({"id": "_id", "th": "_th"})
    wide = docs.join(checked_broadcast(wanted, "refs"), F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")))
    wide = wide.select(words_of(F.col("t")).alias("w"), "refs")
    cut = F.transform("refs", lambda r: F.struct(
        r["anchor"].alias("anchor"), r["content"].alias("content"), r["times"].alias("times"), r["k"].alias("k"), r["n"].alias("n"), r["at"].alias("at"),
        F.array_join(F.slice(F.col("w"), r["start"] + 1, r["n"] + (window - 1)), " ").alias("body"),
    ))
    bodies = wide.select(F.explode(cut).alias("r")).select("r.*").dropDuplicates(["anchor", "content"])
    bodies = materialise(bodies, "segment-bodies")
    plain = bodies.where(F.col("k") <= CROWDED).select(F.col("anchor").alias("shard"), "anchor", "content", F.lit(0).alias("first"), "times", "body")
    halves = materialise(_halves(bodies.where(F.col("k") > CROWDED), window), "segment-halves")
    busy = halves.groupBy("shard").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > CROWDED).select("shard")
    masks = _shard_masks(plain.union(halves.join(busy, "shard", "left_anti")), window)

    busy = halves.join(busy, "shard", "left_semi").withColumn("w", F.split("body", " "))
    at = F.sequence(F.lit(0), F.size("w") - window)
    each = F.transform(at, lambda i: F.struct((F.col("first") + i).alias("i"), F.array_join(F.slice("w", i + 1, F.lit(window)), " ").alias("v")))
    crowded = busy.select("anchor", "content", "times", F.explode(each).alias("x")).select("anchor", "content", "times", "x.i", "x.v")
    twice = crowded.groupBy("v").agg(F.sum("times").alias("s")).where(F.col("s") > 1).select("v")
    alone = crowded.join(twice, "v", "left_semi").groupBy("anchor", "content").agg(F.expr("bit_or(shiftleft(1L, i))").alias("mask"))

    masks = copies.union(masks).union(alone).groupBy("anchor", "content").agg(F.expr("bit_or(mask)").alias("mask")).where(F.col("mask") != 0)
    hits = shared.join(materialise(masks, "segment-masks"), ["anchor", "content"]).select("id", "th", F.struct("start", "mask").alias("s"))
    return materialise(hits.groupBy("id", "th").agg(F.collect_list("s").alias("spans")), "repeated")


def covered(n: int, spans: list[tuple[int, int]], window: int) -> np.ndarray:
    """Which of n words a repeated window covers."""
    edge = np.zeros(n + 1, "int64")
    for start, mask in spans:
        at = start + np.array([i for i in range(mask.bit_length()) if mask >> i & 1], "int64")
        at = at[at + window <= n]
        np.add.at(edge, at, 1)
        np.subtract.at(edge, at + window, 1)
    return np.cumsum(edge)[:-1] > 0


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 35) -> DataFrame:
    """Adds ``n_words``, ``n_removed`` and ``kept_text``: the words outside repeated windows, joined by a space.

    A window is a run of ``window`` words (separated by ASCII white space) of one text; it is repeated
    if the same words start at any other place of any text. Null and empty texts have no words and an
    empty kept text. Every row stays, repeated rows too (their texts repeat each other). Rows that
    share a key, null included, are told apart by a hash of their text.
    """
    spans = repeated_windows(docs, key, text, window).withColumnsRenamed({"id": "_span_id", "th": "_span_th", "spans": "_spans"})
    same = F.col(key).eqNullSafe(F.col("_span_id")) & (F.xxhash64(text) == F.col("_span_th"))
    wide = docs.join(spans, same, "left").drop("_span_id", "_span_th")

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, spans in batches:
            total, removed, kept = [], [], []
            for raw, found in zip(raw_texts(texts), spans, strict=True):
                words, found = raw.split(), found.as_py()
                gone = 0
                total.append(len(words))
                if found:
                    mask = covered(len(words), [(s["start"], s["mask"]) for s in found], window)
                    gone = int(mask.sum())
                    words = [w for w, m in zip(words, mask.tolist(), strict=True) if not m]
                removed.append(gone)
                kept.append(b" ".join(words).decode())
            yield pa.StructArray.from_arrays(
                [pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                ["n_words", "n_removed", "kept_text"],
            )

    out = wide.withColumn("_span_r", F.arrow_udf(run, "n_words bigint, n_removed bigint, kept_text string")(text, "_spans"))
    own = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept_text")]
    return out.select(*own, "_span_r.n_words", "_span_r.n_removed", "_span_r.kept_text")
