"""Joins that keep one hot key from landing in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.session import MAX_BROADCAST_ROWS, checkpointed, limit_of

HOT_SHARES = 200
SALTS = 64
#: Text and numbers of a side that may be broadcast, beside its number of rows.
BROADCAST_BYTES = 64 << 20


def is_small(df: DataFrame, limit: int | None = None) -> bool:
    """Whether ``df`` has at most ``limit`` rows (default: the session's limit for broadcasts) and BROADCAST_BYTES
    of content; reads no more than ``limit + 1`` of them."""
    if limit is None:
        limit = limit_of(df.sparkSession, MAX_BROADCAST_ROWS)
    content = F.octet_length(F.to_json(F.struct(*df.columns)))
    seen = df.limit(limit + 1).agg(F.count("*").alias("rows"), F.sum(content).alias("bytes")).first()
    return seen["rows"] <= limit and (seen["bytes"] or 0) <= BROADCAST_BYTES


def lookup_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", *,
                stored: bool = False, limit: int | None = None) -> DataFrame:
    """Join many rows with a table that has one row per key; ``how`` is left or inner.

    A small right side is broadcast after its rows and bytes were checked. Otherwise the keys that each
    hold at least 1/HOT_SHARES of the left rows (so at most HOT_SHARES keys) are salted: their left rows,
    and those with a null key, are spread over SALTS, and the right rows of those keys are repeated once
    per salt. The left side is read once for the counts of its keys and once for the join. A right side
    that still has to be computed is computed once; ``stored`` says that it is a table.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"lookup_join is a left or an inner join, not {how}")
    if not stored:
        right = checkpointed(right)
    if is_small(right, limit):
        return left.join(F.broadcast(right), on, how)
    counts = checkpointed(left.groupBy(*on).count())
    total = counts.agg(F.sum("count")).first()[0] or 0
    hot = F.broadcast(checkpointed(counts.filter(F.col("count") >= max(1, total / HOT_SHARES)).select(*on, F.lit(True).alias("_hot"))))
    missing = F.lit(False)
    for key in on:
        missing = missing | F.col(key).isNull()
    hashable = [f.name for f in left.schema.fields if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    spread = F.pmod(F.xxhash64(*hashable), F.lit(SALTS)).cast("int")
    salted = left.join(hot, on, "left").withColumn("_salt", F.when(F.coalesce("_hot", missing), spread).otherwise(0)).drop("_hot")
    copies = right.join(hot, on, "left").withColumn("_salt", F.explode(
        F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def salted_pairs(left: DataFrame, right: DataFrame, on: list[str], salt: Column, parts: int) -> DataFrame:
    """Inner equi-join in which each key's left rows are spread over ``parts`` salts and the right
    rows are repeated once per salt. For fan-outs whose key may be hot on the left."""
    spread = left.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(parts)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return spread.join(copies, [*on, "_salt"]).drop("_salt")
