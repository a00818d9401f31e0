"""Byte-level BPE by replaying the merges over all words of a slice of the corpus at once.

A text is cut into pieces by the tokenizer's pattern. The distinct new pieces of a slice of the texts are
laid out side by side, and an inverted index leads from each mergeable token pair (named by the
token it makes) to its positions in them. Merges are taken in rank order from a heap; each is
applied at all its positions in one vectorised step, and only the pairs with the two touched
neighbours are indexed anew. Nothing is shuffled, and what a worker remembers is bounded.
"""

from __future__ import annotations

import base64
import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from footfall.llm.workers import tidy

#: Chunks that a worker remembers; chunks of a slice of texts, and new ones among them.
REMEMBERED, SLICE, NEW = 220_000, 200_000, 60_000
#: Rows decoded at once.
DECODED = 500
#: A merge with fewer positions than this is applied one by one.
FEW = 48

# The characters of the Unicode property White_Space.
WHITE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# A run of white space and what follows it: a piece never reaches from a letter into white space
# and looks ahead only inside the white space, so a text may be cut here.
_CHUNK = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")


def read_ranks(path: str) -> dict[bytes, int]:
    """The token bytes and ranks of a rank file (base64 token and rank on each line)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class _Codes(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = code = len(self)
        return code


class Encoder:
    """Texts to token ids for one vocabulary; lives in a Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pieces = ranks, regex.compile(pattern)
        self.base = max(ranks.values(), default=0) + 1
        pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.base + right] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs) or [-1], "int64")
        self.values = np.array([pairs.get(k, -1) for k in self.keys.tolist()], "int64")
        self.bytes = np.array([ranks.get(bytes([b]), -2) for b in range(256)], "int64")
        self.forget()

    def forget(self) -> None:
        self.codes, self.done = _Codes(), 0
        self.ids, self.ends = np.zeros(0, "int32"), np.zeros(1, "int64")

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where there is none."""
        key = left.astype("int64") * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.values[at], -1)

    def replay(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All tokens of the pieces one after another, and the number of tokens of each piece."""
        sizes = np.fromiter(map(len, pieces), "int64", len(pieces))
        starts = np.cumsum(sizes + 1) - sizes  # a separator before each piece and one at the end
        size = int(sizes.sum()) + len(pieces) + 1
        # Each array twice: as numpy for merges with many positions, as an array for those with few.
        tokens, afters, befores = array("i", [-1]) * size, array("i", range(1, size + 1)), array("i", range(-1, size - 1))
        token, after, before = (np.frombuffer(x, "int32") for x in (tokens, afters, befores))
        inside = np.ones(size, bool)
        inside[starts - 1] = inside[-1] = False
        token[inside] = self.bytes[np.frombuffer(b"".join(pieces), "uint8")]
        ranks = array("i", np.append(self._rank(token[:-1], token[1:]), -1).astype("int32").tobytes())
        pair = np.frombuffer(ranks, "int32")  # the rank of the pair that begins at a position
        index: dict[int, list[int]] = {}
        order = np.argsort(pair, kind="stable")
        order = order[np.searchsorted(pair[order], 0) :]
        for same in np.split(order, np.flatnonzero(np.diff(pair[order])) + 1) if len(order) else []:
            index[int(pair[same[0]])] = same.tolist()
        heap = list(index)
        heapq.heapify(heap)
        odd: set[int] = set()

        def found(new: int, place: int) -> None:
            if new in index:
                index[new].append(place)
            else:
                index[new] = [place]
                heapq.heappush(heap, new)

        lookup, base = self.pairs.get, self.base
        while heap:
            rank = heapq.heappop(heap)
            places = sorted(set(index.pop(rank)))
            if len(places) < FEW:
                for i in places:
                    if ranks[i] != rank:
                        continue
                    gone, left = afters[i], befores[i]
                    right = afters[gone]
                    tokens[i], tokens[gone], ranks[gone], afters[i], befores[right] = rank, -2, -1, right, i
                    new = lookup(tokens[left] * base + rank, -1) if tokens[left] >= 0 else -1
                    ranks[left] = new
                    if new >= 0:
                        found(new, left)
                        if new < rank:
                            odd.add(i)
                    new = lookup(rank * base + tokens[right], -1) if tokens[right] >= 0 else -1
                    ranks[i] = new
                    if new >= 0:
                        found(new, i)
                        if new < rank:
                            odd.add(i)
                continue
            at = np.array(places)
            at = at[pair[at] == rank]
            if len(at) > 1:  # of overlapping pairs, every other one from the left
                step = np.arange(len(at))
                first = np.append(True, after[at[:-1]] != at[1:])
                at = at[(step - np.maximum.accumulate(np.where(first, step, 0))) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            right = after[gone]
            was = token[right]
            token[at], token[gone], pair[gone] = rank, -2, -1
            after[at], before[right] = right, at
            left = before[at]
            made = np.full(len(at), rank)
            pair[left], pair[at] = self._rank(token[left], made), self._rank(made, token[right])
            low = (pair[left] >= 0) & (pair[left] < rank)
            passing = self._rank(made, was) if (was == rank).any() or (token[right] != was).any() else pair[at]
            low |= (passing >= 0) & (passing < rank)
            odd.update(at[low].tolist())
            spot = np.concatenate([left, at])
            made = pair[spot]
            spot = spot[np.argsort(made, kind="stable")][np.count_nonzero(made < 0) :]
            made = pair[spot]
            for same in np.split(spot, np.flatnonzero(np.diff(made)) + 1) if len(spot) else []:
                new = ranks[same[0]]
                if new in index:
                    index[new].extend(same.tolist())
                else:
                    index[new] = same.tolist()
                    heapq.heappush(heap, new)
        kept = token >= 0
        counts = np.add.reduceat(kept, starts - 1) if len(pieces) else np.zeros(0, "int64")
        ids = token[kept]
        if odd:  # a merge brought up a pair of lower rank, which goes before the rest of its piece
            again = np.unique(np.searchsorted(starts, sorted(odd), "right") - 1)
            rows = np.split(ids, np.cumsum(counts)[:-1])
            for k in again.tolist():
                rows[k] = np.array(self.replay_alone(pieces[k]), "int64")
            ids, counts = np.concatenate(rows), np.fromiter(map(len, rows), "int64", len(rows))
        return ids.astype("int32"), counts

    def replay_alone(self, piece: bytes) -> list[int]:
        """One merge at a time: the pair of lowest rank, the leftmost of equal ones."""
        token = [*self.bytes[np.frombuffer(piece, "uint8")].tolist(), -1]
        after, before = array("q", range(1, len(token) + 1)), array("q", range(-1, len(token) - 1))
        rank_at = lambda i: self.pairs.get(token[i] * self.base + token[after[i]]) if i >= 0 <= token[after[i]] else None
        heap = [(r, i) for i in range(len(token) - 1) if (r := rank_at(i)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            if token[i] < 0 or rank_at(i) != rank:
                continue
            gone = after[i]
            token[i], token[gone], after[i], before[after[gone]] = rank, -2, after[gone], i
            for spot in (before[i], i):
                if (new := rank_at(spot)) is not None:
                    heapq.heappush(heap, (new, spot))
        return [t for t in token if t >= 0]

    def learn(self) -> None:
        """Tokens of the chunks that were numbered since the last call."""
        chunks = list(self.codes)[self.done :] if self.done else list(self.codes)
        numbers, own, lengths = _Codes(), array("q"), array("q")
        for chunk in chunks:
            pieces = self.pieces.findall(chunk)
            own.extend([numbers[p] for p in pieces])
            lengths.append(len(pieces))
        pieces = [p.encode() for p in numbers]
        whole = [self.ranks.get(p, -1) for p in pieces]
        ids, counts = self.replay([p for p, w in zip(pieces, whole, strict=True) if w < 0])
        known = np.array(whole, "int64")
        size = np.ones(len(pieces), "int64")
        size[known < 0] = counts
        ends = np.cumsum(size)
        flat = np.zeros(int(size.sum()), "int32")
        merged = np.repeat(known < 0, size)
        flat[merged], flat[~merged] = ids, known[known >= 0]
        own = np.frombuffer(own, "int64")
        tokens = gather(flat, np.append(0, ends), own)
        per_chunk = np.add.reduceat(size[own], np.cumsum(np.append(0, lengths[:-1]))) if len(own) else np.zeros(0, "int64")
        self.ids = np.concatenate([self.ids, tokens])
        self.ends = np.append(self.ends, self.ends[-1] + np.cumsum(per_chunk))
        self.done = len(self.codes)

    def encode(self, texts: Iterator[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For one slice of the texts after another: all ids in a row, and the number of ids of each text."""
        codes, counts = array("i"), array("q")
        for text in texts:
            before = len(codes)
            codes.extend(map(self.codes.__getitem__, _CHUNK.findall(text)))
            counts.append(len(codes) - before)
            if len(codes) >= SLICE or len(self.codes) - self.done >= NEW:
                yield self._ids(codes, counts)
                codes, counts = array("i"), array("q")
        yield self._ids(codes, counts)

    def _ids(self, codes: array, counts: array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.codes) > self.done:
            self.learn()
        rows = np.frombuffer(codes, "int32")
        sizes = np.append(0, np.cumsum(np.diff(self.ends)[rows]))
        ends = sizes[np.cumsum(np.append(0, counts)).astype("int64")]
        out = gather(self.ids, self.ends, rows), np.diff(ends)
        if len(self.codes) > REMEMBERED:
            self.forget()
        return out


def gather(values: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The values of the given rows one after another; row r is ``values[ends[r]:ends[r + 1]]``."""
    size = np.diff(ends)[rows]
    shift = ends[rows] - (np.cumsum(size) - size)
    return values[np.repeat(shift, size) + np.arange(int(size.sum()))]


def encode(spark: SparkSession, text: Column, ranks_path: str, pattern: str) -> Column:
    """The token ids (``array<int>``) of a text column; no special tokens.

    Null gives null and the empty text no ids. A text of any length is taken whole; repeated texts
    and other columns do not matter, since only this column goes to Python.
    """
    shared = spark.sparkContext.broadcast(read_ranks(ranks_path))  # a vocabulary file: bounded

    @tidy
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _encoded(batches, shared.value, pattern)

    return F.arrow_udf(run, "array<int>")(text)


def _encoded(batches: Iterator[pa.Array], ranks: dict[bytes, int], pattern: str) -> Iterator[pa.Array]:
    """The ids of each text of the batches, for one slice of a batch after another."""
    encoder = Encoder(ranks, pattern)  # of this task: a worker that goes on to other work keeps nothing of it
    for batch in batches:
        none, done = batch.is_null(), 0
        for ids, counts in encoder.encode(x.as_py() or "" for x in batch):
            ends = pa.array(np.append(0, np.cumsum(counts)), pa.int32())
            yield pa.ListArray.from_arrays(ends, pa.array(ids), mask=none[done : done + len(counts)])
            done += len(counts)


def decode(spark: SparkSession, ids: Column, ranks_path: str) -> Column:
    """The bytes (``binary``) that token ids stand for; null for null, for a null id and for an unknown id."""
    shared = spark.sparkContext.broadcast(_entries(read_ranks(ranks_path)))

    @tidy
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _decoded(batches, *shared.value)

    return F.arrow_udf(run, "binary")(ids)


def _entries(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all ids in their order, and the length of each; -1 where there is no such id."""
    by_id: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        by_id[rank] = token
    return np.frombuffer(b"".join(t or b"" for t in by_id), "uint8"), np.array([-1 if t is None else len(t) for t in by_id] or [-1], "int32")


def _decoded(batches: Iterator[pa.Array], flat: np.ndarray, size: np.ndarray) -> Iterator[pa.Array]:
    starts = np.append(0, np.cumsum(np.maximum(size, 0)))
    for batch in batches:
        for rows in (batch.slice(i, DECODED) for i in range(0, len(batch), DECODED)):
            own = rows.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
            counts = rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            known = (own >= 0) & (own < len(size))
            known[known] = size[own[known]] >= 0
            bad = np.add.reduceat(np.append(~known, False), np.cumsum(counts) - counts) > 0 if len(rows) else np.zeros(0, bool)
            own = np.where(known, own, 0)
            bounds = np.append(0, np.cumsum(np.maximum(size, 0)[own]))[np.append(0, np.cumsum(counts))]
            joined = pa.py_buffer(gather(flat, starts, own))
            whole = pa.BinaryArray.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(bounds.astype("int64")), joined]).cast(pa.binary())
            none = rows.is_null().to_numpy(zero_copy_only=False) | (bad & (counts > 0))
            yield pa.compute.if_else(pa.array(none), pa.scalar(None, pa.binary()), whole)


def round_trip(spark: SparkSession, text: Column, ranks_path: str, pattern: str) -> Column:
    """``ids, bytes`` (a struct): what :func:`encode` gives for a text, and what :func:`decode` gives for those ids.

    Both run in one worker, a slice of texts at a time: chained columns hold two workers a task, and whole batches of ids between them.
    """
    shared = spark.sparkContext.broadcast(read_ranks(ranks_path))

    @tidy
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        entries = _entries(shared.value)
        for ids in _encoded(batches, shared.value, pattern):
            for k, found in enumerate(_decoded([ids], *entries)):
                yield pa.StructArray.from_arrays([ids.slice(k * DECODED, DECODED), found], ["ids", "bytes"])

    return F.arrow_udf(run, "ids array<int>, bytes binary")(text)
