"""URL verdicts: host and path rules, and gradient-boosted trees on lexical features for the rest.

The trees are Spark ML's. They learn from labelled URLs, at most ``Settings.rows`` of them in the
order of a hash, and see length, depth, digit ratio, entropy, parameters and what share of the
labelled URLs under the same host suffixes is blocked. Those shares are counted over all labelled URLs.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.llm.small import checked_broadcast
from footfall.plans.scratch import materialise

FEATURES = (
    "f_length", "f_host_length", "f_labels", "f_depth", "f_digits", "f_host_digits", "f_entropy", "f_hyphens",
    "f_params", "f_query_length", "f_fragment", "f_secure", "f_last1", "f_last2",
)


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains and the paths that begin with ``path``."""

    verdict: str
    host: str
    path: str

    def __str__(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Settings:
    """``rows`` bounds the labelled URLs that the trees are fitted to, not those that are counted."""

    rows: int = 20_000
    trees: int = 12
    depth: int = 4
    smoothing: float = 20.0
    blocked: float = 0.5


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/ ? #``, A-Z lower-cased; empty for null and where there is no ``://``."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?`` or ``#``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as a struct of its text and verdict; null if none does.

    Of equally long ones, the first given. Each suffix of the host is tried at a label boundary.
    """
    fits = None
    for rule in sorted(rules, key=lambda r: -len(str(r))):
        hit = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        value = F.struct(F.lit(str(rule)).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        fits = F.when(hit, value) if fits is None else fits.when(hit, value)
    return fits if fits is not None else F.lit(None).cast("struct<rule: string, verdict: string>")


def suffix(host: Column, labels: int) -> Column:
    return F.substring_index(host, ".", -labels)


def _count(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.translate(text, sign, ""))


def _entropy(text: Column) -> Column:
    """Bits per character."""
    signs = F.array_distinct(F.split(text, ""))
    share = F.transform(signs, lambda c: F.lit(1.0) - F.length(F.replace(text, c, F.lit(""))) / F.length(text))
    return F.when(F.length(text) > 0, -F.aggregate(share, F.lit(0.0), lambda a, p: a + F.when(p > 0, p * F.log2(p)).otherwise(0.0))).otherwise(0.0)


def lexical_features(urls: DataFrame) -> DataFrame:
    """Adds all features but the suffix statistics to rows with ``_url, _host, _path``."""
    url, host = F.coalesce("_url", F.lit("")), F.col("_host")
    query = F.regexp_extract(url, "(?s)\\?([^#]*)", 1)
    digits = lambda x: F.length(x) - F.length(F.translate(x, "0123456789", ""))
    number = {
        "f_length": F.length(url),
        "f_host_length": F.length(host),
        "f_labels": _count(host, ".") + 1,
        "f_depth": F.size(F.filter(F.split("_path", "/"), lambda x: x != "")),
        "f_digits": digits(url) / F.greatest(F.lit(1), F.length(url)),
        "f_host_digits": digits(host),
        "f_entropy": _entropy(F.substring_index(url, "://", -1)),
        "f_hyphens": _count(url, "-"),
        "f_params": F.when(query == "", 0).otherwise(_count(query, "&") + 1),
        "f_query_length": F.length(query),
        "f_fragment": _count(url, "#"),
        "f_secure": F.lower(url).startswith("https://").cast("int"),
    }
    return urls.withColumns({k: v.cast("double") for k, v in number.items()})


@dataclass
class UrlModel:
    trees: GBTClassificationModel | None
    suffixes: DataFrame
    rate: float
    settings: Settings


def _with_suffixes(rows: DataFrame, suffixes: DataFrame, rate: float, own: bool, s: Settings) -> DataFrame:
    """Smoothed blocked share under the last one and two labels of the host; ``own`` leaves the row's label out."""
    for labels in (1, 2):
        part = suffixes.where(F.col("labels") == labels).select(F.col("suffix").alias("_s"), "n", "k")
        rows = rows.join(checked_broadcast(part), suffix(F.col("_host"), labels) == F.col("_s"), "left")
        n, k = F.coalesce("n", F.lit(0)), F.coalesce("k", F.lit(0))
        if own:
            n, k = n - 1, k - F.col("_label")
        share = (k + F.lit(rate * s.smoothing)) / (n + F.lit(s.smoothing))
        rows = rows.withColumn(f"f_last{labels}", share.cast("double")).drop("_s", "n", "k")
    return rows


def train(labelled: DataFrame, settings: Settings | None = None) -> UrlModel:
    """Fit to rows with ``_id, _url, _host, _path, _label`` (1: blocked).

    Without rows, or with labels of one kind only among those fitted to, there are no trees:
    everything then gets the share of blocked labels (0 without rows).
    """
    s = settings or Settings()
    sample = labelled.orderBy(F.xxhash64("_url", "_id"), "_id", "_url").limit(s.rows)
    sample = materialise(lexical_features(sample), "url-sample")
    counts = [
        labelled.groupBy(F.lit(n).alias("labels"), suffix(F.col("_host"), n).alias("suffix"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("_label").alias("k"))
        for n in (1, 2)
    ]
    suffixes = materialise(counts[0].union(counts[1]), "url-suffixes")
    seen = suffixes.where("labels = 1").agg((F.sum("k") / F.sum("n")).alias("rate")).first()
    rate = float(seen["rate"] or 0.0)
    trees = None
    if sample.select("_label").distinct().count() == 2:
        ready = _with_suffixes(sample, suffixes, rate, True, s)
        ready = VectorAssembler(inputCols=list(FEATURES), outputCol="_x").transform(ready).select("_x", "_label")
        ready = materialise(ready.withColumn("_label", F.col("_label").cast("double")), "url-features")
        trees = GBTClassifier(
            featuresCol="_x", labelCol="_label", maxIter=s.trees, maxDepth=s.depth, stepSize=0.3, seed=7
        ).fit(ready)
    return UrlModel(trees, suffixes, rate, s)


def score(rows: DataFrame, model: UrlModel) -> DataFrame:
    """Adds ``blocked_score`` (0 to 1) to rows with ``_url, _host, _path``."""
    if model.trees is None:
        return rows.withColumn("blocked_score", F.lit(model.rate))
    ready = _with_suffixes(lexical_features(rows), model.suffixes, model.rate, False, model.settings)
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="_x").transform(ready)
    trees = model.trees.setProbabilityCol("_p").setRawPredictionCol("_raw").setPredictionCol("_pred")
    scored = trees.transform(ready).withColumn("blocked_score", F.get(vector_to_array("_p"), F.lit(1)))
    return scored.drop("_x", "_p", "_raw", "_pred", *FEATURES)


def judge(pages: DataFrame, key: str, url: str, rules: Sequence[Rule], settings: Settings | None = None) -> DataFrame:
    """``key, host, path, rule, verdict, blocked_score`` of every row; ``rule`` is null where the trees decided.

    The URLs that a rule decides are the labelled ones. Null URLs and URLs without ``://`` have an
    empty host and path, and so no rule; repeated rows are judged alike.
    """
    rows = pages.select(F.col(key).alias("_id"), F.col(url).alias("_url"))
    rows = rows.select("*", host_of(F.col("_url")).alias("_host"), path_of(F.col("_url")).alias("_path"))
    rows = rows.withColumn("_rule", rule_of(F.col("_host"), F.col("_path"), rules))
    rows = materialise(rows, "urls")
    labelled = rows.where(F.col("_rule").isNotNull()).withColumn("_label", (F.col("_rule.verdict") == "block").cast("int"))
    model = train(labelled.drop("_rule"), settings)
    own = F.when(F.col("blocked_score") >= model.settings.blocked, "block").otherwise("allow")
    return score(rows, model).select(
        F.col("_id").alias(key), F.col("_host").alias("host"), F.col("_path").alias("path"),
        F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", own).alias("verdict"), "blocked_score",
    )
