"""Host-level quality rules: failures of documents by host, shrunk rates, verdicts joined back.

Everything is built-in column functions. The text is read once; its statistics are computed inside
the row and written as a narrow table, from which both the hosts and the result are made.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.plans.scratch import materialise

# The white space between words, and the signs that count as symbols.
SPACE = "[\\x20\\x09-\\x0D]"
_BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

Rules = Mapping[str, Column]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def repeated_words(words: Column, n: int) -> Column:
    """Words covered by n-word windows that occur twice or more in the list, the first occurrence included."""

    def covered(keys: Column) -> Column:
        order = F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))

        def starts(s: Column) -> Column:
            same = lambda x, j: (F.get(s, j - 1)["k"] == x["k"]) | (F.get(s, j + 1)["k"] == x["k"])
            hits = F.filter(s, lambda x, j: F.coalesce(same(x, j), F.lit(False)))
            return F.array_sort(F.transform(hits, lambda x: x["i"]))

        def total(p: Column) -> Column:
            gaps = F.transform(p, lambda x, j: F.least(F.lit(n), F.coalesce(F.get(p, j + 1) - x, F.lit(n))))
            return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda a, x: a + x)

        return let(let(order, starts), total)

    def windows(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - n)
        keys = F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(n)]))
        # Most texts repeat nothing; only the others are sorted with positions.
        return let(keys, lambda k: F.when(F.size(F.array_distinct(k)) < F.size(k), covered(k)).otherwise(F.lit(0).cast("bigint")))

    return let(words, lambda w: F.when(F.size(w) > n, windows(w)).otherwise(F.lit(0).cast("bigint")))


def text_statistics(docs: DataFrame, text: str = "text", window: int = 5) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of whole texts; null counts as empty."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.translate(x, _BLANKS, "") != "")
    words = words_of(F.col(text))
    return docs.select(
        "*",
        F.size(words).cast("bigint").alias("n_words"),
        F.length(F.translate(whole, _BLANKS, "")).cast("bigint").alias("word_chars"),
        (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        repeated_words(words, window).alias("n_repeat_words"),
    )


def host_rates(docs: DataFrame, host: str, failed: str) -> DataFrame:
    """Per host: documents, failures, and the failure rate shrunk by a beta prior fitted to all hosts.

    The prior's mean is the overall rate; its strength comes from the variance of the host rates
    beyond what chance alone gives (method of moments, weighted by documents). With one host, no
    spread or no failures the prior has the weight of all documents of a mean host.
    A null host is a host of its own.
    """
    hosts = docs.groupBy(host).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(failed).cast("bigint")).alias("k"))
    spread = hosts.agg(
        F.count(F.lit(1)).alias("h"),
        F.sum("n").alias("n_all"),
        (F.sum("k") / F.sum("n")).alias("mean"),
        F.sum(F.col("k") * F.col("k") / F.col("n")).alias("kk"),
        F.sum(F.col("n") * F.col("n")).alias("nn"),
    ).first()
    n_all, mean, h = int(spread["n_all"] or 0), float(spread["mean"] or 0.0), int(spread["h"])
    between = float(spread["kk"] or 0.0) - n_all * mean * mean  # weighted squares of the host rates about the mean
    chance = mean * (1 - mean)
    room = n_all - float(spread["nn"] or 0) / n_all if n_all else 0.0
    extra = (between - (h - 1) * chance) / room if room > 0 else 0.0
    strength = max(1.0, chance / extra - 1) if extra > 0 else float(max(1, n_all)) / max(1, h)
    a, b = mean * strength, (1 - mean) * strength
    return hosts.withColumn("rate", (F.col("k") + F.lit(a)) / (F.col("n") + F.lit(a + b)))


def host_verdicts(docs: DataFrame, host: str, failed: str, worst: float = 0.5) -> DataFrame:
    """Adds ``host_rate`` and ``kept``: the document passed, and its host's shrunk failure rate is at most ``worst``.

    ``docs`` is used twice and should be a stored table. The hosts are few beside the documents, but
    their number is not bounded: Spark broadcasts them if they are small and splits skewed hosts if not.
    """
    rates = host_rates(docs, host, failed).select(F.col(host).alias("_host"), F.col("rate").alias("host_rate"))
    return docs.join(rates, F.col(host).eqNullSafe(F.col("_host"))).select(
        *docs.columns, "host_rate", (~F.col(failed) & (F.col("host_rate") <= worst)).alias("kept")
    )


def judge(docs: DataFrame, key: str, host: str, rules: Callable[[], Rules], text: str = "text", worst: float = 0.5) -> DataFrame:
    """Statistics, base verdict and final verdict of every document: one row per input row.

    A document fails if any of ``rules`` (conditions on the statistics) holds. Null and empty texts
    have no words. Returns the key, the host, the statistics, each rule, ``base_failed``,
    ``host_rate`` and ``kept``.
    """
    own = docs.select(F.col(key).alias("_key"), F.col(host).alias("_source"), F.col(text).alias("_text"))
    named = rules()
    counted = text_statistics(own, "_text").drop("_text").withColumns({f"failed_{k}": c for k, c in named.items()})
    failed = F.greatest(*[F.col(f"failed_{k}") for k in named], F.lit(False))
    stored = materialise(counted.withColumn("base_failed", failed), "quality")
    return host_verdicts(stored, "_source", "base_failed", worst).withColumnsRenamed({"_key": key, "_source": host})


def base_rules() -> Rules:
    """Too short, or too much of the text in repeated windows."""
    return {
        "short": F.col("n_words") < 10,
        "repeats": 100 * F.col("n_repeat_words") > 20 * F.col("n_words"),
    }
