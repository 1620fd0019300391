"""Joins on time: the row in force at a moment, and moments inside spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.plans.ordered import OrderedRows
from tallymill.plans.skew import salted_pairs

_KIND, _CARRIED = "_kind", "_carried"


def asof_join(moments: DataFrame, states: DataFrame, by: list[str], at: str, since: str, seq: list[str], into: str = "in_force", **ordered) -> DataFrame:
    """Every row of ``moments`` with the state in force at its time: of the states of its key with ``since`` not
    later than ``at`` the latest, by ``since`` and then ``seq``, as struct ``into`` (null before the first).

    Both tables are put in one order per key and the last state is carried forward, so neither is joined to the
    other, a key with very many rows is spread over many tasks, and a state that starts at the very time counts.
    Rows of ``moments`` without a time or a key have no state. Columns of ``moments`` are kept;
    ``seq`` must make a key's states unique.
    """
    rest = [c for c in states.columns if c not in by]
    own = F.struct(*moments.columns)
    left = moments.select(*by, F.col(at).alias("_at"), F.lit(1).alias(_KIND), own.alias("_row"))
    keyed = F.lit(True)
    for key in by:
        keyed = keyed & F.col(key).isNotNull()
    right = states.filter(F.col(since).isNotNull() & keyed).select(
        *by, F.col(since).alias("_at"), F.lit(0).alias(_KIND), F.struct(*rest).alias("_state"), *[F.col(c).alias(f"_seq{i}") for i, c in enumerate(seq)])
    both = left.filter(F.col("_at").isNotNull()).unionByName(right, allowMissingColumns=True)
    carried = OrderedRows(both, by, ["_at", _KIND, *[f"_seq{i}" for i in range(len(seq))]], **ordered).scan(**{_CARRIED: ("last", F.col("_state"))}).df
    found = carried.filter(F.col(_KIND) == 1).select("_row.*", F.col(_CARRIED).alias(into))
    untimed = moments.filter(F.col(at).isNull()).withColumn(into, F.lit(None).cast(found.schema[into].dataType))
    return found.unionByName(untimed)


#: A bin of one level holds this many of the level below, and there are this many levels.
FAN, LEVELS = 16, 5


def interval_join(moments: DataFrame, spans: DataFrame, by: list[str], at: str, start: str, end: str, width: int, salts: int = 8) -> DataFrame:
    """Pairs of a moment and a span of its key that holds it: start <= at < end. Times are whole numbers (bigint).

    A span is cut into time bins of ``width``; where it holds a whole bin of the next level (FAN times as wide) it
    takes that one instead, so even a span over all of the time is a few dozen bins, and no two bins of a span
    share a moment: each pair comes out once. A moment stands in one bin per level. The join is on key, level
    and bin, and a bin with very many moments is spread over ``salts`` tasks. Empty spans, and rows with a null in
    key or times, pair with nothing. Column names of the two tables must differ, but for the key.
    """
    low, high = F.col(start), F.col(end) - 1
    width_of = [width * FAN ** level for level in range(LEVELS)]
    valid = spans.filter(F.col(start) < F.col(end))

    def floor_div(value, by_width):
        return F.call_function("div", value - F.pmod(value, F.lit(by_width)), F.lit(by_width))

    # Bins touched at the lowest level; above it only bins that lie wholly inside those of the level below.
    touched = [(floor_div(low, width), floor_div(high, width) + 1)]
    for _ in range(1, LEVELS):
        before, after = touched[-1]
        touched.append((-floor_div(-before, FAN), floor_div(after, FAN)))
    pieces = []
    for level, (first, stop) in enumerate(touched):
        if level + 1 < LEVELS:
            upper_first, upper_stop = touched[level + 1]
            inner_first, inner_stop = upper_first * FAN, upper_stop * FAN
            has_inner = inner_first < inner_stop
            left = _bins(first, F.when(has_inner, inner_first).otherwise(stop))
            right = F.when(has_inner, _bins(inner_stop, stop)).otherwise(F.array().cast("array<bigint>"))
            bins = F.concat(left, right)
        else:
            bins = _bins(first, stop)
        pieces.append(_at_level(bins, level))
    cut = valid.withColumn("_piece", F.explode(F.flatten(F.array(*pieces)))).select(*spans.columns, "_piece._level", "_piece._bin")
    places = F.array(*[F.struct(F.lit(level).alias("_level"), floor_div(F.col(at), w).alias("_bin")) for level, w in enumerate(width_of)])
    used = moments.filter(F.col(at).isNotNull()).withColumn("_place", F.explode(places)).select(*moments.columns, "_place._level", "_place._bin")
    pairs = salted_pairs(used, cut, [*by, "_level", "_bin"], F.col(at), salts)
    return pairs.filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_level", "_bin")


def _at_level(bins, level: int):
    return F.transform(bins, lambda b: F.struct(F.lit(level).alias("_level"), b.alias("_bin")))


def _bins(first, stop):
    return F.when(first < stop, F.sequence(first, stop - 1)).otherwise(F.array().cast("array<bigint>"))
