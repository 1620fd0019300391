"""Running aggregates must not depend on how rows are cut into buckets."""

import random

import pytest
from pyspark.sql import functions as F

from tallymill.plans.ordered import OrderedRows, first_rows, global_number
from tallymill.plans.pointers import reachable
from tallymill.plans.skew import lookup_join, salted_pairs


def sample(n=400, seed=1):
    """Half of the rows belong to one key; some values are missing."""
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.5 else f"k{rng.randrange(20)}", i, rng.choice([None, *range(-9, 10)])) for i in range(n)]


def expected(rows):
    state, out = {}, {}
    for key, at, v in sorted(rows, key=lambda r: r[1]):
        total, top, low, last, prev, n = state.get(key, (None, None, None, None, None, 0))
        before = (total, prev)
        if v is not None:
            total = v if total is None else total + v
            top = v if top is None else max(top, v)
            low = v if low is None else min(low, v)
            last = v
        out[(key, at)] = (total, top, low, last, before[0], before[1], n + 1)
        state[key] = (total, top, low, last, v, n + 1)
    return out


@pytest.mark.parametrize("options", [{}, {"max_group_rows": 0, "buckets": 1}, {"max_group_rows": 0, "buckets": 7},
                                     {"max_group_rows": 50, "buckets": 60}])
def test_scan_kinds(spark, options):
    rows = sample()
    df = spark.createDataFrame(rows, "k string, at long, v long").repartition(5)
    v = F.col("v")
    ordered = OrderedRows(df, ["k"], ["at"], **options)
    assert ordered.bucketed == bool(options)
    got = (ordered.scan(total=("sum", v), top=("max", v), low=("min", v), last=("last", v))
           .scan(exclusive=True, before=("sum", v)).previous(prev=v).number("n").df)
    assert {(r.k, r.at): (r.total, r.top, r.low, r.last, r.before, r.prev, r.n) for r in got.collect()} == expected(rows)


def test_null_keys_form_one_group(spark):
    df = spark.createDataFrame([(None, i) for i in range(30)] + [("a", 1)], "k string, at long")
    got = OrderedRows(df, ["k"], ["at"], max_group_rows=0, buckets=6).number("n").df
    assert sorted(r.n for r in got.filter("k IS NULL").collect()) == list(range(1, 31))


def test_unknown_kind(spark):
    with pytest.raises(ValueError):
        OrderedRows(spark.range(3), [], ["id"], buckets=2).scan(x=("median", F.col("id")))


@pytest.mark.parametrize("buckets", [1, 4, 50])
def test_global_number(spark, buckets):
    df = spark.createDataFrame([(i * 37 % 101,) for i in range(101)], "v long")
    assert all(r.n == r.v + 1 for r in global_number(df, ["v"], "n", buckets=buckets).collect())


def test_first_rows_limits_before_the_shuffle(spark):
    df = spark.createDataFrame(sample(), "k string, at long, v long")
    got = first_rows(df, ["k"], [F.desc("at")], 2)
    assert got.groupBy("k").count().filter("count > 2").isEmpty()
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("limit", [0, 1000])
def test_lookup_join_with_hot_keys(spark, limit):
    rows = sample() + [(None, 1000, 5)]
    left = spark.createDataFrame(rows, "k string, at long, v long")
    right = spark.createDataFrame([("hot", "H"), ("k1", "one")], "k string, name string")
    names = {"hot": "H", "k1": "one"}
    got = lookup_join(left, right, ["k"], "left", limit=limit).collect()
    assert sorted((r.at, r.name) for r in got) == sorted((at, names.get(k)) for k, at, _ in rows)
    inner = lookup_join(left, right, ["k"], "inner", limit=limit)
    assert inner.count() == sum(k in names for k, _, _ in rows)


def test_salted_pairs_is_an_inner_join(spark):
    left = spark.createDataFrame(sample(), "k string, at long, v long")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3)], "k string, s int")
    got = salted_pairs(left, right, ["k"], F.col("at"), 5).select("at", "s")
    want = left.join(right, "k").select("at", "s")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_reachable_follows_long_chains(spark):
    edges = spark.createDataFrame([("a", i, i + 3) for i in range(0, 300)] + [("b", 1, 2)], "k string, n long, s long")
    starts = spark.createDataFrame([("a", 1), ("b", 1)], "k string, n long")
    got = {(r.k, r.n) for r in reachable(edges, starts, ["k"], "n", "s").collect()}
    assert got == {("a", i) for i in range(1, 303, 3)} | {("b", 1), ("b", 2)}
