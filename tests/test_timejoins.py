"""Joins on time and stored distinct counts next to plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tallymill.operators import distinct
from tallymill.plans import timejoins

STATES, MOMENTS = "k string, since long, no long, template string", "k string, at long, id long"


@pytest.mark.parametrize("options", [{}, {"max_group_rows": 0, "buckets": 5}])
def test_asof_join_like_a_plain_search(spark, options):
    rng = random.Random(1)
    states = [(rng.choice(["hot", "a", None]), rng.choice([None, *range(0, 100, 5)]), i, f"t{i}") for i in range(60)]
    moments = [(rng.choice(["hot", "hot", "a", "b", None]), rng.choice([None, *range(-5, 110)]), i) for i in range(300)] + [("hot", 50, 7), ("hot", 50, 7)]
    found = timejoins.asof_join(spark.createDataFrame(moments, MOMENTS).withColumn("_x", F.lit(1)), spark.createDataFrame(states, STATES), ["k"], "at", "since", ["no"], **options)
    assert found.columns == ["k", "at", "id", "_x", "in_force"]

    def plain(k, at):
        known = [(since, no) for key, since, no, _ in states if key == k and None not in (key, since, at) and since <= at]
        return max(known)[1] if known else None

    got = sorted(((r.k, r.at, r.id, r.in_force and r.in_force.no) for r in found.collect()), key=repr)
    assert got == sorted(((k, at, i, plain(k, at)) for k, at, i in moments), key=repr)
    assert timejoins.asof_join(spark.createDataFrame([], MOMENTS), spark.createDataFrame(states, STATES), ["k"], "at", "since", ["no"]).count() == 0
    assert [r.in_force for r in timejoins.asof_join(spark.createDataFrame(moments[:3], MOMENTS), spark.createDataFrame([], STATES), ["k"], "at", "since", ["no"]).collect()] == [None] * 3


def test_interval_join_like_a_plain_range_join(spark):
    rng = random.Random(2)
    moments = [(rng.choice(["hot", "hot", "a", None]), rng.choice([None, *range(-3000, 3000)]), i) for i in range(400)] + [("hot", 5, 1000)] * 3
    spans = []
    for i in range(80):
        begin = rng.randrange(-3000, 3000)
        spans.append((rng.choice(["hot", "a", "b", None]), begin, begin + rng.choice([-3, 0, 1, 2, 15, 16, 17, 160, 2000, 4000]), i))
    spans += [("hot", -100_000, 100_000_000, 900), ("a", None, 5, 901), ("a", 5, None, 902)]
    pairs = timejoins.interval_join(spark.createDataFrame(moments, MOMENTS), spark.createDataFrame(spans, "k string, a long, b long, span long"), ["k"], "at", "a", "b", 2)
    assert set(pairs.columns) == {"k", "at", "id", "a", "b", "span"}
    want = sorted((k, at, i, s) for k, at, i in moments for key, a, b, s in spans if None not in (k, at, a, b) and key == k and a <= at < b)
    assert sorted((r.k, r.at, r.id, r.span) for r in pairs.collect()) == want
    empty = spark.createDataFrame([], "k string, a long, b long, span long")
    assert timejoins.interval_join(spark.createDataFrame(moments, MOMENTS), empty, ["k"], "at", "a", "b", 2).count() == 0


def test_a_long_span_is_few_bins(spark):
    spans = spark.createDataFrame([("k", 3, 9_000_001, 1)], "k string, a long, b long, span long")
    moments = spark.createDataFrame([("k", 5, 1)], MOMENTS)
    plan = timejoins.interval_join(moments, spans, ["k"], "at", "a", "b", 1, salts=1)
    assert plan.count() == 1 and "NestedLoop" not in plan._jdf.queryExecution().executedPlan().toString()


def test_stored_sketches_add_up(spark):
    rows = spark.range(30_000).select((F.col("id") % 7).alias("day"), F.pmod(F.xxhash64("id"), F.lit(9000)).alias("v")).unionByName(
        spark.createDataFrame([(8, None), (9, 1)], "day long, v long"))
    stored = distinct.sketches(rows, ["day"], "v")
    per_day = {r.day: r.n_distinct for r in distinct.counted(stored).collect()}
    exact = {r.day: r.n for r in rows.groupBy("day").agg(F.count_distinct("v").alias("n")).collect()}
    assert per_day[8] == 0 and per_day[9] == 1
    assert all(abs(per_day[d] - n) <= max(1, distinct.error_bound() * n) for d, n in exact.items())
    halves = [distinct.merged(stored.filter(c), []) for c in ("day < 3", "day >= 3")]
    n = rows.select("v").distinct().count()
    for whole in (distinct.merged(stored, []), distinct.merged(halves[0].unionByName(halves[1]), []), distinct.sketches(rows, [], "v")):
        assert abs(distinct.counted(whole).first().n_distinct - n) <= distinct.error_bound() * n
    assert distinct.sketches(rows.limit(0), ["day"], "v").count() == 0
