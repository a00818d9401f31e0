"""k-core filtering and user sampling."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from footfall.plans.scratch import materialise, new_path
from footfall.plans.selection import keep_one, lowest_hashed

# Edges of an adjacency bucket (about); a round reads only buckets with dropped keys.
BUCKET_EDGES = 4_000_000
# Most buckets, each a folder a side.
MOST_BUCKETS = 4096
# Files that the keys of a bucket are dealt to.
FILES = 8
# Rounds that read all pairs, narrow and unmoved; only a longer peeling has its edges stored by key.
SCAN_ROUNDS = 10
# Surviving users and items up to which wide rows are filtered by two broadcast lists instead of by pairs.
SHORT_LIST = 500_000


@dataclass(frozen=True)
class Core:
    """Surviving (user, item) pairs of a k-core, and per round the keys dropped and the edges read for it."""

    pairs: DataFrame
    user: str
    item: str
    dropped: tuple[int, ...]
    edges_read: tuple[int, ...]

    @property
    def rounds(self) -> int:
        """Rounds, with the last one, which drops nothing."""
        return len(self.dropped)

    def users(self) -> DataFrame:
        return self.pairs.select(self.user).distinct()

    def restrict(self, df: DataFrame) -> DataFrame:
        """Rows of ``df`` between surviving users and items, with all their columns.

        ``df`` has no pairs but those the core was made from. Wide rows stay where they are while the
        lists of survivors are short (their length is checked); beyond that they meet the pairs.
        """
        columns, ends = df.columns, [self.user, self.item]
        ones = self.pairs.groupingSets([[c] for c in ends], *ends).agg(F.count(F.lit(1)).alias("_n"))
        keys, facts = _written(ones, "core-keys", keys=F.count(F.lit(1)))
        if facts["keys"] > SHORT_LIST:
            return df.join(self.pairs.select(*ends), ends, "left_semi").select(*columns)
        for key in ends:
            df = df.join(F.broadcast(keys.select(key).where(F.col(key).isNotNull())), key, "left_semi")
        return df.select(*columns)


def _written(df: DataFrame, tag: str, *partitions: str, **facts: Column) -> tuple[DataFrame, dict]:
    """``df`` as a written table and facts about its rows, observed while it is written."""
    seen, path = Observation(), new_path(df.sparkSession, tag)
    observed = df.observe(seen, *[fact.alias(name) for name, fact in facts.items()])
    observed.write.partitionBy(*partitions).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get


def kcore(
    df: DataFrame, ku: int, ki: int, user: str = "user_id", item: str = "item_id", bucket_edges: int = BUCKET_EDGES, scan_rounds: int = SCAN_ROUNDS
) -> Core:
    """Drop users below ``ku`` rows and items below ``ki`` rows until nothing changes.

    Degrees are counted once. A round takes the keys dropped by the round before (the frontier) and
    subtracts their edges from the degrees of the other ends; a key's degree is the smallest one written
    for it so far. The keys that fall below their limit are the next frontier, and a round writes a row per
    touched key. All keys of a round are dropped at once, as if both degrees came from the same snapshot.

    The first ``scan_rounds`` rounds find the frontier's edges in one pass over the stored pairs, which stay
    where they are. A longer peeling then stores the pairs still alive twice, by user and by item, in hash buckets
    and sorted by key, so that a late round that drops few keys reads the few buckets that hold them.
    """
    columns = (user, item)
    present = df.where(F.col(user).isNotNull() & F.col(item).isNotNull())
    counted = present.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    pairs, facts = _written(counted, "core-pairs", edges=F.count(F.lit(1)))
    buckets = min(MOST_BUCKETS, max(1, ceil(facts["edges"] / bucket_edges)))
    is_user = F.col(user).isNotNull()
    limit = F.when(F.col("_side") == 0, ku).otherwise(ki)

    def bucket(side: Column, key: Column) -> Column:
        return F.pmod(F.xxhash64(side, key), F.lit(buckets)).cast("int").alias("_bucket")

    # A node is its side (0: user, 1: item) and its key as text, so that both sides take one join.
    sums = pairs.groupingSets([[user], [item]], user, item).agg(F.sum("_n").alias("_d"))
    key = F.when(is_user, F.col(user).cast("string")).otherwise(F.col(item).cast("string")).alias("_key")
    nodes = sums.select(F.when(is_user, 0).otherwise(1).alias("_side"), key, "_d")
    nodes = nodes.select("*", bucket(F.col("_side"), F.col("_key")))
    low = F.col("_d") < limit
    # Facts of a frontier: its size, and the buckets that hold it (at most two times MOST_BUCKETS numbers).
    of_frontier = {"low": F.count_if(low), "buckets": F.collect_set(F.when(low, F.col("_side") * buckets + F.col("_bucket")))}
    degrees, facts = _written(nodes, "core-degrees", **of_frontier)
    dropped, edges_read = [facts["low"]], [0]
    if not dropped[0]:
        return Core(pairs, user, item, (0,), (0,))

    def either(df: DataFrame, one: Column, other: Column) -> DataFrame:
        return df.select(F.inline(F.array(one, other)))

    def narrow(alive: DataFrame) -> DataFrame:
        return alive.select(F.col(user).cast("string").alias("_u"), F.col(item).cast("string").alias("_i"), "_n")

    def end(side: int, near: str, far: str) -> Column:
        return F.struct(F.lit(side).alias("_side"), F.col(near).alias("_key"), F.col(far).alias("_far"), F.col("_n"))

    def stored(alive: DataFrame) -> DataFrame:
        both = narrow(alive)
        for side, name in enumerate(("_u", "_i")):
            own = degrees.where(F.col("_side") == side).select(F.col("_key").alias(name), F.col("_d").alias(f"_d{name}"))
            both = both.join(own, name)

        def directed(side: int, near: str, far: str) -> Column:
            # The edges of a key of very high degree are dealt to several tasks.
            parts = F.ceil(F.col(f"_d{near}") / bucket_edges)
            return F.struct(
                F.lit(side).alias("_side"), bucket(F.lit(side), F.col(near)),
                F.struct(F.pmod(F.xxhash64(near), F.lit(FILES)), F.pmod(F.xxhash64(far), parts)).alias("_part"),
                F.col(near).alias("_key"), F.col(far).alias("_far"), F.col("_n"), F.col(f"_d{far}").alias("_end"),
            )

        edges = either(both, directed(0, "_u", "_i"), directed(1, "_i", "_u"))
        edges = edges.repartition("_side", "_bucket", "_part").sortWithinPartitions("_side", "_bucket", "_key").drop("_part")
        return _written(edges, "core-edges", "_side", "_bucket", edges=F.count(F.lit(1)))[0]

    def without_dropped(lists: DataFrame) -> DataFrame:
        alive = pairs
        for side, name in enumerate(columns):
            keys = lists.where(F.col("_side") == side).select(F.col("_key").cast(df.schema[name].dataType).alias(name))
            alive = alive.join(keys, name, "left_anti")
        return alive

    tables: list[DataFrame] = []
    frontier = degrees.where(low).select("_side", "_bucket", "_key")
    gone = [frontier]
    edges = None
    other = (1 - F.col("_side")).alias("_side"), F.col("_far").alias("_key")
    sums = [F.sum("_n").alias("_lost"), F.count(F.lit(1)).alias("_edges")]
    while True:
        if len(dropped) > scan_rounds:
            if edges is None:  # the edges of this round's frontier are still needed
                edges = stored(without_dropped(reduce(DataFrame.union, gone[:-1])) if gone[:-1] else pairs)
            held = [[b % buckets for b in facts["buckets"] if b // buckets == side] for side in (0, 1)]
            pruned = edges.where(" or ".join(f"_side = {side} and _bucket in ({', '.join(map(str, bs))})" for side, bs in enumerate(held) if bs))
            lost = pruned.join(frontier, ["_side", "_bucket", "_key"]).groupBy(*other).agg(*sums, F.max("_end").alias("_end"))
        else:
            keys = frontier.select("_side", "_key")
            if dropped[-1] <= SHORT_LIST:
                keys = F.broadcast(keys)
            met = either(narrow(pairs), end(0, "_u", "_i"), end(1, "_i", "_u")).join(keys, ["_side", "_key"])
            lost = met.groupBy(*other).agg(*sums).join(degrees.select("_side", "_key", F.col("_d").alias("_end")), ["_side", "_key"])
        if tables:
            earlier = reduce(DataFrame.union, tables)
            lost = lost.join(earlier.groupBy("_side", "_key").agg(F.min("_d").alias("_least")), ["_side", "_key"], "left")
            lost = lost.withColumn("_end", F.coalesce("_least", "_end"))
        alive = lost.where((F.col("_end") >= limit) & (F.col("_end") > F.col("_lost")))  # a key without edges is gone already
        now = alive.select(
            "_side", "_key", bucket(F.col("_side"), F.col("_key")), F.col("_end").alias("_before"), (F.col("_end") - F.col("_lost")).alias("_d"), "_edges"
        )
        touched, facts = _written(now, "core-touched", **of_frontier, edges=F.coalesce(F.sum("_edges"), F.lit(0)))
        tables.append(touched)
        dropped.append(facts["low"])
        edges_read.append(facts["edges"])
        if not dropped[-1]:
            break
        frontier = touched.where(low).select("_side", "_bucket", "_key")
        gone.append(frontier)
    lists = materialise(reduce(DataFrame.union, gone).select("_side", "_key"), "core-dropped")
    return Core(without_dropped(lists).select(*columns, "_n"), user, item, tuple(dropped), tuple(edges_read))


def priority_users(df: DataFrame, predicate: Column, ku: int, ki: int, user: str = "user_id", item: str = "item_id") -> DataFrame:
    """Users that survive the k-core built from the rows meeting ``predicate`` only."""
    return kcore(df.where(predicate).select(user, item), ku, ki, user, item).users()


def sample_users(users: DataFrame, n: int, seed: int = 42, user: str = "user_id") -> DataFrame:
    """Exactly ``n`` of the distinct users by seeded hash; all of them when ``n`` <= 0 or too large."""
    return users if n <= 0 else lowest_hashed(users, user, n, seed)


def sample_users_priority_first(
    users: DataFrame, priority: DataFrame, n: int, seed: int = 42, user: str = "user_id"
) -> DataFrame:
    """``n`` users, those in ``priority`` before the others. Priority users outside the pool are ignored."""
    marked = users.join(priority.select(user).distinct().withColumn("_p", F.lit(True)), user, "left")
    return lowest_hashed(marked, user, n, seed, priority=F.coalesce(F.col("_p"), F.lit(False)))


def rows_of(df: DataFrame, users: DataFrame, user: str = "user_id") -> DataFrame:
    """All rows of the given users."""
    return df.join(users.select(user), user, "left_semi")


def without(df: DataFrame, excluded: DataFrame, key: str = "user_id") -> DataFrame:
    """Rows whose key is not in ``excluded``."""
    return df.join(excluded.select(key), key, "left_anti")


def resampled_core(
    df: DataFrame, users: DataFrame, ku: int, ki: int, user: str = "user_id", item: str = "item_id"
) -> tuple[DataFrame, int]:
    """All rows of the sampled users, brought back to the k-core; the rows and the rounds."""
    rows = rows_of(df, users, user)
    core = kcore(rows.select(user, item), ku, ki, user, item)
    return core.restrict(rows), core.rounds


def surviving_rows(wide: DataFrame, keys: DataFrame, columns: tuple[str, ...], row_id: str = "row_id") -> DataFrame:
    """Wide rows whose key is among the light pass's survivors, of each key the one with the lowest ``row_id``."""
    return keep_one(wide.join(keys.select(*columns).distinct(), list(columns), "left_semi"), columns, [row_id])
