"""Substring dedup of bytes: strings that start more than once, found in suffix arrays of shards.

Every window of ``window`` bytes has one anchor, the smallest hash among its byte n-grams, so equal
windows have equal anchors at equal places. Consecutive windows with the same anchor form a segment;
each window is in exactly one. Segments are narrow rows of hashes. Those whose anchor is found nowhere
else go, equal ones become one reference with its number of occurrences. All windows of a reference
that occurs more than once are repeated; where an anchor has several references, their bytes are
fetched and dealt by anchor into shards of bounded size. The suffix array of a shard's bytes is made by
induced sorting (:mod:`footfall.llm.suffixes`), and its permuted common prefixes tell which windows start elsewhere too.

An anchor with more than ``CROWDED`` references is split: its windows are dealt by the bytes that all
windows with a similar place of the anchor hold (all but ``WIDTHS[0]`` bytes of the window), and where
that is still crowded by the whole window, after which equal windows are one reference.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.llm.small import bounded_broadcast
from footfall.llm.substrings import with_shared_anchor
from footfall.llm.suffixes import repeated_starts
from footfall.llm.wordhash import mixed, raw_texts
from footfall.plans.scratch import materialise

#: Bytes of an anchor; windows that are cut into segments at once; bytes of a suffix array (about);
#: references of an anchor from which it is split, and the places of an anchor that are dealt together then.
ANCHOR, BLOCK, SHARD, CROWDED, WIDTHS = 48, 1 << 20, 3 << 20, 2000, (24, 1)
#: Fields of a reference whose bytes are fetched.
REFERENCE = ("shard", "content", "times", "crowded", "start", "n", "at")
#: Stands between references; not found in UTF-8.
SEPARATOR = b"\xff"

_BASE = np.uint64(0x9E3779B97F4A7C15)


def byte_grams(raw: bytes, n: int) -> np.ndarray:
    """A 64-bit number for each run of n bytes."""
    if len(raw) < n:
        return np.zeros(0, "uint64")
    if n < 8:
        found, size = mixed(np.frombuffer(raw, "uint8").astype("uint64")), 1
    else:
        found, size = mixed(np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))), 8
    while size < n:
        step = min(size, n - size)
        found, size = mixed(found[:-step] * _BASE ^ found[step:]), size + step
    return found


def _leftmost_minima(values: np.ndarray, n: int) -> np.ndarray:
    """Place of the first smallest of each n consecutive values, by their upper 32 bits; less than 2 ** 32 values."""
    low = (values & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(values), dtype="uint64")
    size = 1
    while size < n:
        step = min(size, n - size)
        low, size = np.minimum(low[step:], low[:-step]), size + step
    return (low & np.uint64(0xFFFFFFFF)).astype("int64")


def segments_of(raw: bytes, window: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Start, number of windows, place of the anchor from the start, anchor and content of a text's segments, block by block."""
    k = min(ANCHOR, window)
    for base in range(0, len(raw) - window + 1, BLOCK):
        part = raw[base : base + BLOCK + window - 1]
        g = byte_grams(part, k)
        at = _leftmost_minima(g, window - k + 1)
        start = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        count = np.diff(np.append(start, len(at)))
        ends = (start + count + window - 1).tolist()
        content = np.fromiter((xxhash.xxh3_64_intdigest(part[x:y]) for x, y in zip(start.tolist(), ends, strict=True)), "uint64", len(ends))
        place = at[start]
        yield start + base, count.astype("int32"), (place - start).astype("int32"), g[place].view("int64"), content.view("int64")


def segments(docs: DataFrame, window: int) -> DataFrame:
    """``id, th, start, n, at, anchor, content`` of every segment of the whole texts of ``id, th, t``."""
    kind = docs.schema["id"].dataType.simpleString()
    names = ["id", "th", "start", "n", "at", "anchor", "content"]
    kinds = ["int32", "int32", "int32", "int64", "int64"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                found, row = [], []
                for k, raw in enumerate(raw_texts(part.column(2))):
                    for own in segments_of(raw, window):
                        found.append(own)
                        row.append(np.full(len(own[0]), k))
                if found:
                    columns = [pa.array(np.concatenate(x).astype(kind)) for x, kind in zip(zip(*found, strict=True), kinds, strict=True)]
                    row = pa.array(np.concatenate(row))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(row), part.column(1).take(row), *columns], names=names)

    return docs.mapInArrow(run, f"id {kind}, th bigint, start int, n int, at int, anchor bigint, content bigint")


def _ranges(mask: np.ndarray) -> np.ndarray:
    """Starts and ends of the runs of true, in turn."""
    return np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype("int8")))


def _shard_ranges(references: DataFrame, window: int) -> DataFrame:
    """``shard, content, ranges`` of the references ``shard, content, times, body``, shard by shard.

    ``ranges`` lists from and to of the runs of repeated windows, counted from the body's first window.
    """
    names = ["shard", "content", "ranges"]

    def solve(part: list[tuple]) -> pa.RecordBatch:
        bodies = [row[3] for row in part]
        found = repeated_starts(np.frombuffer(SEPARATOR.join(bodies), "uint8"), window)
        start, ranges = 0, []
        for shard, content, times, body in part:
            windows = len(body) - window + 1
            mask = found[start : start + windows] if times < 2 else np.ones(windows, bool)
            ranges.append(_ranges(mask).tolist())
            start += len(body) + 1
        columns = [pa.array([row[i] for row in part], pa.int64()) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(ranges, pa.list_(pa.int32()))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= SHARD and row[0] != part[-1][0]:
                    yield solve(part)
                    part, size = [], 0
                part.append(row)
                size += len(row[3])
        if part:
            yield solve(part)

    dealt = references.select("shard", "content", F.least("times", F.lit(2)).cast("int").alias("times"), "body").repartition("shard")
    return dealt.sortWithinPartitions("shard", "content").mapInArrow(run, "shard bigint, content bigint, ranges array<int>")


def _split(pieces: DataFrame, window: int, width: int) -> DataFrame:
    """Pieces cut into those whose anchors stand at ``width`` consecutive places of the window, dealt by what all these windows hold.

    Pieces are ``anchor, whole, first, n, at, times, body``: ``n`` windows of the content ``whole``, from its window
    ``first`` on, with the anchor ``at`` bytes behind the body's start. Adds ``shard`` and ``content``.
    """
    last = window - min(ANCHOR, window)  # the last place of an anchor in a window
    block = F.sequence(F.floor((F.col("at") - F.col("n") + 1) / width).cast("int"), F.floor(F.col("at") / width).cast("int"))
    rows = pieces.withColumn("block", F.explode(block))
    start = F.greatest(F.lit(0), F.col("at") - (F.col("block") + 1) * width + 1)
    stop = F.least(F.col("n") - 1, F.col("at") - F.col("block") * width)
    body = lambda x, y: F.substring("body", x + 1, y - x)
    held = body(F.col("at") - F.col("block") * width, F.col("at") - F.least(F.col("block") * width + width - 1, F.lit(last)) + window)
    cut = rows.select(
        "anchor", "whole", (F.col("first") + start).alias("first"), (stop - start + 1).alias("n"), (F.col("at") - start).alias("at"), "times",
        body(start, stop + window).alias("body"), F.xxhash64("anchor", "block", F.lit(width), held).alias("shard"),
    )
    return cut.withColumn("content", F.xxhash64("body"))


def _with_holders(references: DataFrame) -> DataFrame:
    """References ``shard, content, ...`` with ``k``, the number of references of their shard; lone ones that occur once go."""
    many = references.groupBy("shard").agg(F.count(F.lit(1)).alias("k"))
    return references.join(many, "shard").where((F.col("k") > 1) | (F.col("times") > 1))


def repeated_runs(docs: DataFrame, window: int = 200) -> DataFrame:
    """``id, th, runs``: starts and ends, in turn, of the runs of bytes under repeated windows of each text ``id, th, t`` that has any."""
    found = materialise(segments(docs, window), "byte-segments")
    shared = materialise(with_shared_anchor(found), "byte-segments-shared")
    row = F.struct("id", "th", "start", "n", "at")
    contents = shared.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("times"), F.min(row).alias("r"))
    references = materialise(_with_holders(contents.withColumnRenamed("anchor", "shard")), "byte-references")
    copies = references.where(F.col("times") > 1).select(
        F.col("shard").alias("anchor"), F.col("content").alias("whole"), F.array(F.lit(0), F.col("r.n")).alias("ranges")
    )

    few = F.least("times", F.lit(2)).cast("tinyint").alias("times")
    each = F.struct("shard", "content", few, (F.col("k") > CROWDED).alias("crowded"), "r.start", "r.n", "r.at")
    wanted = references.where(F.col("k") > 1).groupBy("r.id", "r.th").agg(F.collect_list(each).alias("refs"))
    # One array a field instead of structs: less than half the bytes.
    fields = [F.col(f"refs.{f}").alias(f) for f in REFERENCE]
    wanted = materialise(wanted.select(F.col("id").alias("_id"), F.col("th").alias("_th"), *fields), "byte-wanted")
    wide = docs.join(
        bounded_broadcast(wanted, 96 + 30 * F.size("shard")), F.col("id").eqNullSafe(F.col("_id")) & F.col("th").eqNullSafe(F.col("_th"))
    )
    wide = wide.dropDuplicates(["id", "th"]).select(F.col("t").cast("binary").alias("t"), F.explode(F.arrays_zip(*REFERENCE)).alias("r"))
    body = F.substring("t", F.col("r.start") + 1, F.col("r.n") + (window - 1)).alias("body")
    bodies = materialise(wide.select("r.shard", "r.content", "r.times", "r.crowded", "r.n", "r.at", body), "byte-bodies")
    solved = _shard_ranges(bodies.where(~F.col("crowded")), window)
    parts = [copies, solved.select(F.col("shard").alias("anchor"), F.col("content").alias("whole"), "ranges")]

    crowded = bodies.where("crowded")
    if not crowded.isEmpty():
        pieces = crowded.select(F.col("shard").alias("anchor"), F.col("content").alias("whole"), F.lit(0).alias("first"), "n", "at", "times", "body")
        for width in WIDTHS:
            pieces = materialise(_split(pieces, window, width), "byte-pieces")
            joint = pieces.groupBy("shard", "content").agg(F.sum("times").alias("times"), F.first("body").alias("body"))
            joint = materialise(_with_holders(joint), "byte-joint")
            solved = materialise(_shard_ranges(joint.where(F.col("k") <= CROWDED), window), "byte-solved")
            moved = F.transform("ranges", lambda x: x + F.col("first")).alias("ranges")
            parts.append(pieces.join(solved, ["shard", "content"]).select("anchor", "whole", moved))
            busy = joint.where(F.col("k") > CROWDED).select("shard").distinct()
            pieces = pieces.join(busy, "shard", "left_semi").drop("shard", "content")

    ranges = parts[0]
    for part in parts[1:]:
        ranges = ranges.union(part)
    ranges = ranges.where(F.size("ranges") > 0).groupBy("anchor", "whole").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))
    ranges = materialise(ranges.withColumnRenamed("whole", "content"), "byte-ranges")
    hits = shared.join(ranges, ["anchor", "content"]).select("id", "th", F.transform("ranges", lambda x: x + F.col("start")).alias("ranges"))
    return materialise(_merged(hits.groupBy("id", "th").agg(F.flatten(F.collect_list("ranges")).alias("spans")), window), "byte-runs")


def removed_runs(spans: list[int], window: int) -> np.ndarray:
    """Starts and ends, in turn, of the maximal runs of bytes under the windows of the given ranges."""
    both = np.array(spans, "int32").reshape(-1, 2)
    both = both[np.argsort(both[:, 0], kind="stable")]
    start, end = both[:, 0], np.maximum.accumulate(both[:, 1] + np.int32(window - 1))
    fresh = np.append(True, start[1:] > end[:-1])
    ends = end[np.append(np.flatnonzero(fresh)[1:] - 1, len(end) - 1)]
    return np.stack([start[fresh], ends], 1).ravel()


def _merged(spans: DataFrame, window: int) -> DataFrame:
    """``id, th, runs`` from ``id, th, spans``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = [removed_runs(x.values.to_numpy(), window) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(runs, pa.list_(pa.int32()))], names=["id", "th", "runs"])

    return spans.mapInArrow(run, f"id {spans.schema['id'].dataType.simpleString()}, th bigint, runs array<int>")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 200) -> DataFrame:
    """Adds ``n_bytes``, ``removed`` (structs ``start, end`` of the maximal removed runs) and ``kept_bytes``.

    Removed is every byte under a string of ``window`` UTF-8 bytes of one text that also starts at any other
    place of any text; strings are judged on the input. Null and empty texts have no bytes. Every row stays;
    rows alike in key and text repeat each other, rows that share only the key are told apart by a hash of
    their texts. Texts of any length are taken whole, in blocks. Added columns replace those of the same name.
    """
    names = ("n_bytes", "removed", "kept_bytes")
    base = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("t"))
    runs = repeated_runs(base, window).withColumnsRenamed({"id": "_run_id", "th": "_run_th", "runs": "_runs"})
    near = bounded_broadcast(runs, 64 + 4 * F.size("_runs"))
    wide = docs.join(near, F.col(key).eqNullSafe(F.col("_run_id")) & F.xxhash64(text).eqNullSafe(F.col("_run_th")), "left")

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        run_type = pa.struct([("start", pa.int32()), ("end", pa.int32())])
        for texts, found in batches:
            total, removed, kept = [], [], []
            for raw, edges in zip(raw_texts(texts), found, strict=True):
                edges = edges.as_py()
                runs: list[dict] = []
                total.append(len(raw))
                if edges:
                    starts, ends = edges[::2], edges[1::2]
                    runs = [{"start": x, "end": y} for x, y in zip(starts, ends, strict=True)]
                    raw = b"".join(raw[x:y] for x, y in zip([0, *ends], [*starts, len(raw)], strict=True))
                removed.append(runs)
                kept.append(raw)
            yield pa.StructArray.from_arrays([pa.array(total, pa.int64()), pa.array(removed, pa.list_(run_type)), pa.array(kept, pa.binary())], list(names))

    kind = "n_bytes bigint, removed array<struct<start:int,end:int>>, kept_bytes binary"
    out = wide.withColumn("_run_r", F.arrow_udf(run, kind)(text, "_runs"))
    return out.select(*[c for c in docs.columns if c not in names], *[f"_run_r.{n}" for n in names])


def removed_bytes(removed: Column) -> Column:
    """The number of bytes in removed runs."""
    return F.aggregate(removed, F.lit(0).cast("bigint"), lambda n, r: n + (r["end"] - r["start"]))
