"""Language identification: averaged hashed subword embeddings under a linear softmax.

A word's features are the byte n-grams of its marked letters, hashed into a fixed number of rows of
an embedding table. A text is the mean of the rows of all its subwords, classified by a linear
softmax. Embeddings and classifier are trained together by stochastic gradient descent in numpy on
a bounded number of labelled texts per language; the features of those are counted on the executors,
so a text of any length reaches the driver as at most ``buckets`` counts. A temperature and a
rejection threshold are fitted on labelled texts that took no part in training.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from footfall.llm.small import bounded_broadcast
from footfall.llm.wordhash import mixed, raw_texts
from footfall.llm.workers import tidy
from footfall.plans.scratch import materialise

UNKNOWN = "und"
_OTHER = regex.compile(r"[^\p{L}\n]+")  # all but letters and the ends of tokens


@dataclass(frozen=True)
class Settings:
    """``per_label`` bounds the labelled texts of a language that are learned from, ``rows`` those of all; each is met ``passes`` times or more."""

    buckets: int = 1 << 15
    dims: int = 16
    shortest: int = 1
    longest: int = 5
    per_label: int = 400
    rows: int = 8_000  # every language gives the same number, one at least
    calibration: float = 0.25
    steps: int = 12_000  # at least
    passes: int = 10
    rate: float = 0.4
    lost: float = 0.001  # share of right answers that the rejection may cost
    surely: float = 0.5  # an answer of this probability is never rejected


@dataclass(frozen=True)
class Model:
    labels: list[str]
    embeddings: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float
    settings: Settings


def subwords(tokens: list[bytes], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the subwords of all tokens, and the place of the token that each belongs to.

    A token's letters are lower-cased and put between marks; its subwords are the runs of
    ``shortest`` to ``longest`` bytes of that. A token without letters has none.
    """
    text = _OTHER.sub("", b"\n".join(tokens).decode().lower())
    raw = np.frombuffer(("<" + text.replace("\n", ">\n<") + ">").encode(), "uint8").astype("uint64")
    ends = raw == 10
    token = np.cumsum(ends)
    lengths = np.bincount(token, minlength=len(tokens)) - np.append(0, np.ones(len(tokens) - 1, "int64"))
    usable = ~ends & (lengths[token] > 2)
    buckets, owners, h = [], [], np.zeros(len(raw), "uint64")
    for n in range(1, s.longest + 1):
        size = len(raw) - n + 1
        if size <= 0:
            break
        h = h[:size] * np.uint64(0x9E3779B97F4A7C15) + raw[n - 1 :] + np.uint64(1)
        if n >= s.shortest:
            inside = usable[:size] & (token[:size] == token[n - 1 :]) & usable[n - 1 :]
            buckets.append((mixed(h[inside] + np.uint64(n)) % np.uint64(s.buckets)).astype("int64"))
            owners.append(token[:size][inside])
    return np.concatenate(buckets), np.concatenate(owners)


def _parts(tokens: list[bytes], most: int = 1 << 17) -> Iterator[slice]:
    """Slices of the tokens of some ``most`` bytes, as the arrays of their subwords take some hundred times that."""
    first = size = 0
    for i, token in enumerate(tokens):
        size += len(token)
        if size > most:
            yield slice(first, i + 1)
            first, size = i + 1, 0
    if first < len(tokens):
        yield slice(first, len(tokens))


def feature_counts(docs: DataFrame, text: str, keep: list[str], s: Settings) -> DataFrame:
    """``keep`` columns, and the buckets of each whole text with their counts."""
    fields = [f for f in docs.schema.fields if f.name in keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "buckets array<int>, counts array<int>"])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets, counts = [], []
            for raw in raw_texts(batch.column(0)):
                words = Counter(raw.split()) or Counter({b"": 1})
                tokens, times = list(words), np.fromiter(words.values(), "float64", len(words))
                seen = np.zeros(s.buckets)
                for part in _parts(tokens):
                    own, owner = subwords(tokens[part], s)
                    seen += np.bincount(own, weights=times[part][owner], minlength=s.buckets)
                seen = seen.astype("int32")
                buckets.append(np.flatnonzero(seen))
                counts.append(seen[buckets[-1]])
            arrays = [batch.column(i + 1) for i in range(len(fields))]
            arrays += [pa.array(buckets, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*(f.name for f in fields), "buckets", "counts"])

    return docs.select(F.col(text).alias("_text"), *[f.name for f in fields]).mapInArrow(run, schema)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def descend(rows: list[tuple[np.ndarray, np.ndarray, int]], n_labels: int, s: Settings) -> tuple[np.ndarray, ...]:
    """Embeddings, weights and bias by stochastic gradient descent, one text at a time."""
    rnd = np.random.default_rng(7)
    table = rnd.normal(0, 0.1, (s.buckets, s.dims))
    weights, bias = np.zeros((s.dims, n_labels)), np.zeros(n_labels)
    total, done = max(s.steps, s.passes * len(rows)), 0
    while rows and done < total:
        for k in rnd.permutation(len(rows))[: total - done]:
            buckets, share, label = rows[k]
            rate = s.rate * (1 - done / total)
            done += 1
            mean = share @ table[buckets]
            slope = _softmax(mean @ weights + bias)
            slope[label] -= 1
            back = weights @ slope
            weights -= rate * np.outer(mean, slope)
            bias -= 0.1 * rate * slope
            table[buckets] -= (rate * len(buckets) ** 0.5) * np.outer(share, back)
    return table, weights, bias


def _lowest_hashed(known: DataFrame, s: Settings) -> DataFrame:
    """``_key`` of the rows of each ``_label`` whose keys have the lowest hashes, ``per_label`` or fewer, as a written table.

    Rows are counted per label and slot of the hash; only those up to the slot where a label's number is
    reached are put in order, so that no task meets all rows of a label or some of every other task.
    """
    narrow = known.select("_key", "_label", F.shiftrightunsigned(F.xxhash64("_key"), 48).alias("_slot"))
    counts = materialise(narrow.groupBy("_label", "_slot").agg(F.count(F.lit(1)).alias("_size")), "language-slots")
    most = max(1, min(s.per_label, s.rows // max(1, counts.select("_label").distinct().count())))
    before = Window.partitionBy("_label").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    reached = counts.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).where(F.col("_before") < most)
    last = materialise(reached.groupBy("_label").agg(F.max("_slot").alias("_last")), "language-limits")
    near = narrow.join(bounded_broadcast(last, F.octet_length("_label") + 16), "_label").where(F.col("_slot") <= F.col("_last"))
    order = Window.partitionBy("_label").orderBy("_slot", F.xxhash64("_key").bitwiseAND((1 << 48) - 1), "_key")  # unsigned
    ranked = near.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most)
    return materialise(ranked.select("_key").distinct(), "language-rows")


def train(labelled: DataFrame, key: str, text: str, label: str, s: Settings | None = None) -> Model | None:
    """Fit on at most ``per_label`` texts of each label and ``rows`` of all, taken in the order of a hash of the key.

    Rows with a null text or label and texts without letters teach nothing; None if nothing is left.
    The result does not depend on how the rows are partitioned.
    """
    s = s or Settings()
    known = labelled.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(
        F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(label).alias("_label")
    )
    keys = _lowest_hashed(known, s)
    chosen = known.join(bounded_broadcast(keys, F.octet_length(F.col("_key").cast("string")) + 16), "_key", "left_semi")
    found = feature_counts(chosen, "_text", ["_key", "_label"], s).toArrow()  # bounded; compact beside rows of Python lists
    keys, names = found["_key"].to_pylist(), found["_label"].to_pylist()
    labels, data = sorted(set(names)), []
    for i in sorted(range(len(keys)), key=lambda i: (names[i], zlib.crc32(str(keys[i]).encode()), str(keys[i]))):
        counts = found["counts"][i].values.to_numpy(zero_copy_only=False).astype("float32")
        if len(counts):
            buckets = found["buckets"][i].values.to_numpy(zero_copy_only=False)
            data.append((buckets, counts / counts.sum(), labels.index(names[i])))
    if not data:
        return None
    held = np.arange(len(data)) % round(1 / s.calibration) == 0
    table, weights, bias = descend([d for d, h in zip(data, held, strict=True) if not h], len(labels), s)
    check = [d for d, h in zip(data, held, strict=True) if h] or data
    logits = np.array([share @ table[buckets] @ weights + bias for buckets, share, _ in check])
    truth = np.array([d[2] for d in check])
    pick = np.arange(len(truth))
    loss = lambda t: -np.log(_softmax(logits / t)[pick, truth] + 1e-12).mean()
    temperature = float(min(np.geomspace(0.2, 5, 41), key=loss))
    best = _softmax(logits / temperature)
    right = best.max(axis=1)[best.argmax(axis=1) == truth]
    threshold = min(s.surely, float(np.quantile(right, s.lost))) if len(right) else 0.0
    return Model(labels, table.astype("float32"), weights, bias, temperature, threshold, s)


class _Words:
    """Sums of class scores and numbers of subwords of the tokens a worker has met; bounded."""

    most = 150_000

    def __init__(self, model: Model):
        self.model, self.scores = model, model.embeddings.astype("float64") @ model.weights
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.rows = np.zeros((0, len(self.model.labels) + 1))

    def learn(self, tokens: list[bytes]) -> None:
        learned = [self.rows]
        for part in _parts(tokens):
            own = tokens[part]
            buckets, owner = subwords(own, self.model.settings)
            columns = [np.bincount(owner, weights=x[buckets], minlength=len(own)) for x in self.scores.T]
            columns.append(np.bincount(owner, minlength=len(own)))
            learned.append(np.column_stack(columns))
        self.rows = np.concatenate(learned)

    def of(self, texts: list[bytes]) -> list[np.ndarray]:
        """For each text, class scores summed over the subwords of its tokens, and their number."""
        if len(self.place) > self.most:
            self.clear()
        counted = [Counter(raw.split()) for raw in texts]
        known = len(self.place)
        for words in counted:
            for token in words:
                if token not in self.place:
                    self.place[token] = len(self.place)
        if len(self.place) > known:
            self.learn(list(self.place)[known:])
        out = []
        for words in counted:
            at = np.fromiter(map(self.place.__getitem__, words), "int64", len(words))
            out.append(np.fromiter(words.values(), "float64", len(words)) @ self.rows[at] if words else np.zeros(self.rows.shape[1]))
        return out


def _sums(batch: pa.Array, words: _Words | None) -> Iterator[np.ndarray]:
    """The sums of each text; texts are taken some 2 MB at a time."""
    part, size = [], 0
    for raw in raw_texts(batch):
        part.append(raw)
        size += len(raw)
        if size > 2_000_000:
            yield from words.of(part) if words else [np.zeros(1)] * len(part)
            part, size = [], 0
    yield from words.of(part) if words else [np.zeros(1)] * len(part)


def predict(docs: DataFrame, text: str, model: Model | None, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """Adds the language of each whole text, its calibrated probability and whether it is rejected.

    Null texts, texts without letters and everything in the absence of a model are ``und`` with
    score 0 and rejected. Only the text goes to Python; columns of the same name are replaced.
    """
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # buckets x dims numbers

    @tidy
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        words = _Words(model) if model else None
        for batch in batches:
            langs, scores = [], []
            for sums in _sums(batch, words):
                if sums[-1]:
                    p = _softmax((sums[:-1] / sums[-1] + model.bias) / model.temperature)
                    langs.append(model.labels[int(p.argmax())])
                    scores.append(float(p.max()))
                else:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    found = docs.withColumn("_found", F.arrow_udf(run, "lang string, score double")(F.col(text)))
    least = model.threshold if model else 1.0
    return (
        found.withColumn(lang, F.col("_found.lang"))
        .withColumn(score, F.col("_found.score"))
        .withColumn("rejected", (F.col("_found.lang") == UNKNOWN) | (F.col("_found.score") < least))
        .drop("_found")
    )


def held_out(key: str = "doc_id"):
    """Whether a document's label may not be learned: crc32 of the key's text is a multiple of 5 (or the key is null)."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(True))
