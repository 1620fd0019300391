"""Distinct counts that can be stored and added up: HyperLogLog sketches per group."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sketches of 2**LOG_SIZE buckets.
LOG_SIZE = 12


def error_bound(log_size: int = LOG_SIZE) -> float:
    """Relative error that an estimate keeps with more than 99.9 % certainty: four standard errors."""
    return 4 * 1.04 / math.sqrt(2 ** log_size)


def sketches(rows: DataFrame, by: list[str], value: str, log_size: int = LOG_SIZE) -> DataFrame:
    """One sketch of the values per group, a few KB however many rows the group has. Nulls are not counted; a
    group of nulls alone has an empty sketch."""
    return rows.groupBy(*by).agg(F.hll_sketch_agg(F.col(value), F.lit(log_size)).alias("sketch"))


def merged(stored: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of coarser groups from stored ones; the rows are not read again. The
    estimate of a union may differ a little with the order of merging; each keeps the error bound."""
    union = F.hll_union_agg("sketch", F.lit(False))
    return (stored.groupBy(*by) if by else stored.groupBy()).agg(union.alias("sketch"))


def counted(stored: DataFrame) -> DataFrame:
    """``n_distinct``, the estimate of each sketch, in place of the sketch."""
    return stored.withColumn("n_distinct", F.hll_sketch_estimate("sketch")).drop("sketch")
