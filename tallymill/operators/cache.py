"""Prefix grouping and hit analysis for prompt caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.functions.money import ratio
from tallymill.functions.text import short_hash
from tallymill.plans.ordered import OrderedRows, global_number
from tallymill.plans.pointers import reachable
from tallymill.session import checkpointed

PREFIX = 50
ELIGIBLE = 100


def prefix(text: Column, n: int = PREFIX) -> Column:
    return F.substring(text, 1, n)


def prefix_hash(text: Column, n: int = PREFIX) -> Column:
    return short_hash(prefix(text, n))


def cluster_by_prefix(items: DataFrame, order: str, text: str = "text", n: int = PREFIX) -> DataFrame:
    """Items laid out so that equal prefixes follow one another. Rows are ranged by prefix and order
    together: a prefix shared by a third of the items fills several partitions, not one."""
    return (items.withColumn("_prefix", prefix(F.col(text), n)).repartitionByRange("_prefix", order)
            .sortWithinPartitions("_prefix", order).drop("_prefix"))


def cluster_places(items: DataFrame, order: str, text: str = "text", n: int = PREFIX) -> DataFrame:
    """The place of every item in prefix order, input order on ties."""
    rows = items.select(order, prefix(F.col(text), n).alias("_prefix"))
    return global_number(rows, ["_prefix", order], "place").drop("_prefix")


def eligible(text: Column, minimum: int = ELIGIBLE) -> Column:
    return F.length(text) >= minimum


def prefix_report(items: DataFrame, text: str = "text", n: int = PREFIX) -> DataFrame:
    """Items per prefix, how many are long enough to cache, and how many could reuse a cached prefix."""
    return (items.groupBy(prefix_hash(F.col(text), n).alias("prefix_hash"))
            .agg(F.count("*").alias("n_items"), F.count_if(eligible(F.col(text))).alias("n_eligible"))
            .withColumn("n_reusable", F.greatest(F.col("n_eligible") - 1, F.lit(0)).cast("bigint")))


# Distinct request times at the beginning of one burst that are folded inside a single row.
FOLD_LIMIT = 5_000


def stores(times: DataFrame, key: str, at: str, ttl: int, fold_limit: int = FOLD_LIMIT, **ordered) -> DataFrame:
    """The requests that store an entry, given distinct (key, at): each is the first one later than
    ``ttl`` after the store before it.

    A pause longer than the ttl always ends in a store, so a key's requests fall into independent
    bursts. The first ``fold_limit`` requests of a burst are folded in one row. After them every request,
    and the last store of the fold, points to the first request after its expiry; the stores are what
    is met from there.
    """
    if ttl <= 0:
        return times.groupBy(key).agg(F.min(at).alias(at))
    rows = OrderedRows(times, [key], [at], **ordered).scan(
        exclusive=True, _before=("sum", F.lit(1).cast("bigint")), _prev=("last", F.struct(F.col(at).alias("v"))))
    starts = F.col("_prev").isNull() | (F.col(at) - F.col("_prev.v") > ttl)
    before = F.coalesce("_before", F.lit(0))
    rows = rows.scan(_burst=("sum", starts.cast("bigint")), _first=("max", F.when(starts, before)))
    bursts = checkpointed(rows.df.select(key, "_burst", at, (before - F.col("_first")).alias("_position")))
    late = F.col("_position") >= fold_limit

    def step(acc: Column, t: Column) -> Column:
        fresh = F.size(acc) == 0
        return F.when(fresh | (t - F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) > ttl),
                      F.concat(acc, F.array(t))).otherwise(acc)

    heads = (bursts.groupBy(key, "_burst").agg(F.sort_array(F.collect_list(F.when(~late, F.col(at)))).alias("_times"), F.bool_or(late).alias("_long"))
             .withColumn("_stores", F.aggregate("_times", F.array().cast("array<bigint>"), step)))
    tails = bursts.filter(late).select(key, "_burst", at)
    if tails.isEmpty():
        return heads.select(key, F.explode("_stores").alias(at))
    folded = heads.select(key, F.explode(F.when(F.col("_long"), F.slice("_stores", 1, F.size("_stores") - 1)).otherwise(F.col("_stores"))).alias(at))
    last = heads.filter("_long").select(key, "_burst", F.element_at("_stores", -1).alias(at))
    # Descending in time, the latest request seen before an expiry is the first one after it.
    events = tails.select(key, "_burst", (-F.col(at)).alias("_back"), F.lit(1).alias("_kind"), F.col(at).alias("_t"))
    expiries = tails.unionByName(last).select(key, "_burst", (-F.col(at) - ttl).alias("_back"), F.lit(0).alias("_kind"), F.col(at).alias("_t"))
    seen = OrderedRows(events.unionByName(expiries), [key, "_burst"], ["_back", "_kind"], **ordered).scan(
        _next=("min", F.when(F.col("_kind") == 1, F.col("_t"))))
    edges = seen.df.filter(F.col("_kind") == 0).select(key, "_burst", F.col("_t").alias(at), "_next")
    return folded.unionByName(reachable(edges, last, [key, "_burst"], at, "_next").select(key, at))


def hit_report(requests: DataFrame, key: str, at: str, ttl: int, fold_limit: int = FOLD_LIMIT, **ordered) -> DataFrame:
    """Requests, hits, misses and hit rate per key of a cache whose entries live ``ttl`` after being
    stored; a hit does not extend an entry's life. ``at`` is a whole number."""
    times = requests.groupBy(key, at).agg(F.count("*").alias("_n"))
    misses = stores(times.select(key, at), key, at, ttl, fold_limit, **ordered)
    counts = times.select(key, "_n", F.lit(0).alias("_store")).unionByName(misses.select(key, F.lit(0).cast("bigint").alias("_n"), F.lit(1).alias("_store")))
    return (counts.groupBy(key).agg(F.sum("_n").alias("requests"), F.sum("_store").alias("misses"))
            .withColumn("hits", F.col("requests") - F.col("misses"))
            .withColumn("hit_rate", ratio(F.col("hits").cast("double"), F.col("requests"), F.lit(0.0))))
