import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallymill.functions.vectors import cosine
from tallymill.operators import cache, cost, monitor
from tallymill.streaming import jobs, stateful

BUCKETED = {"max_group_rows": 0, "buckets": 6}


def gate_fold(scores, threshold, window, recovery):
    recent, halted, good, out = [], False, 0, []
    for s in scores:
        recent = (recent + [s])[-window:]
        if halted:
            good = good + 1 if s >= threshold else 0
            if recovery > 0 and good >= recovery:
                halted, good = False, 0
        elif len(recent) >= window and all(r < threshold for r in recent):
            halted, good = True, 0
        out.append(halted)
    return out


@pytest.mark.parametrize("options", [{}, BUCKETED])
@pytest.mark.parametrize("window, recovery", [(3, 0), (2, 2), (3, 4), (1, 1)])
def test_gate_like_the_plain_fold(spark, options, window, recovery):
    rng = random.Random(window * 10 + recovery)
    series = {m: [rng.choice([0.3, 0.59, 0.6, 0.9]) for _ in range(120 if m == 0 else 15)] for m in range(6)}
    rows = [(m, i, s) for m, scores in series.items() for i, s in enumerate(scores)]
    df = spark.createDataFrame(rows, "m long, ord long, score double").repartition(5)
    got = monitor.quality_gate(df, ["m"], ["ord"], threshold=0.6, window=window, recovery=recovery, **options)
    halted = {(r.m, r.ord): r.halted for r in got.collect()}
    for m, scores in series.items():
        assert [halted[(m, i)] for i in range(len(scores))] == gate_fold(scores, 0.6, window, recovery)


def test_gate_ignores_missing_scores(spark):
    df = spark.createDataFrame([(1, 1, 0.1), (1, 2, None), (1, 3, 0.1)], "m long, ord long, score double")
    assert [r.halted for r in monitor.quality_gate(df, ["m"], ["ord"], window=2).orderBy("ord").collect()] == [False, True]


@pytest.mark.parametrize("waves", [1, 3])
def test_stream_gate_equals_batch_gate(spark, tmp_path, waves):
    rng = random.Random(5)
    rows = [(rng.randrange(3) or None, i, rng.choice([0.2, 0.8, 0.8, None])) for i in range(160)]
    schema = "m long, ord long, score double"
    want = monitor.quality_gate(spark.createDataFrame(rows, schema), ["m"], ["ord"], threshold=0.5, window=3, recovery=2)
    for w in range(waves):
        part = rows[w * 160 // waves:(w + 1) * 160 // waves]
        spark.createDataFrame(part, schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = jobs.read_folder(spark, str(tmp_path / "in"), schema)
        jobs.drain(stateful.quality_gate(stream, ["m"], ["ord"], threshold=0.5, window=3, recovery=2), str(tmp_path / "job"))
    got = jobs.output(spark, str(tmp_path / "job"))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(got.columns).collect()))


def state_rows(spark, path, variable):
    """Rows of one state variable of a stopped stream."""
    return (spark.read.format("statestore").option("path", f"{path}/checkpoint").option("stateVarName", variable).load())


def stores_fold(times, ttl):
    kept = []
    for t in sorted(times):
        if not kept or (ttl > 0 and t - kept[-1] > ttl):
            kept.append(t)
    return kept


@pytest.mark.parametrize("fold_limit", [10_000, 3])
@pytest.mark.parametrize("options", [{}, BUCKETED])
@pytest.mark.parametrize("ttl", [0, 1, 10, 60])
def test_cache_hits_like_the_plain_fold(spark, ttl, fold_limit, options):
    rng = random.Random(ttl)
    requests = [("hot" if rng.random() < 0.4 else rng.choice("abc"), rng.randrange(1000)) for _ in range(400)]
    df = spark.createDataFrame(requests, "k string, at long")
    got = {r.k: (r.requests, r.misses) for r in cache.hit_report(df, "k", "at", ttl, fold_limit, **options).collect()}
    for key in {k for k, _ in requests}:
        times = [t for k, t in requests if k == key]
        assert got[key] == (len(times), len(stores_fold(set(times), ttl)))


def test_cache_hits_need_no_join(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (None, 20), ("a", 1), ("a", 1)], "k string, at long")
    report = cache.hit_report(df, "k", "at", 5)
    assert "Join" not in report._jdf.queryExecution().optimizedPlan().toString()
    assert {r.k: (r.requests, r.misses) for r in report.collect()} == {None: (3, 2), "a": (2, 1)}
    assert cache.hit_report(df.limit(0), "k", "at", 5).count() == 0


def test_stream_first_seen_equals_batch_and_forgets(spark, tmp_path):
    """A new key every second or so besides a busy one: state holds the keys of the last ttl, not all of them."""
    rng = random.Random(3)
    requests = sorted([("busy", rng.randrange(400)) for _ in range(60)] + [(f"once {i}", 4 * i) for i in range(100)], key=lambda r: r[1])
    requests += requests[-1:]
    for w in range(4):
        part = requests[w * len(requests) // 4:(w + 1) * len(requests) // 4]
        spark.createDataFrame(part, "k string, at long").write.mode("append").parquet(str(tmp_path / "in"))
        stream = jobs.read_folder(spark, str(tmp_path / "in"), "k string, at long").withColumn("ts", F.timestamp_seconds(F.col("at") + 1_000_000_000))
        jobs.drain(stateful.first_seen(stream, ["k"], "ts", 25_000_000, delay="5 seconds"), str(tmp_path / "job"))
    got = sorted((r.k, r.at) for r in jobs.output(spark, str(tmp_path / "job")).collect())
    assert got == sorted((k, t) for k in {k for k, _ in requests} for t in stores_fold({t for kk, t in requests if kk == k}, 25))
    held = {r.key.k for r in state_rows(spark, tmp_path / "job", "stored").collect()}
    newest = max(t for _, t in requests)
    assert held and held <= {k for k, t in requests if t >= newest - 25 - 5 - 1}


def test_stream_fuse_trips_at_the_very_call(spark, tmp_path):
    """Calls shuffled by up to half an hour, equal times, free calls; a key that never trips."""
    rng = random.Random(4)
    calls = [(rng.choice("aab"), i, 1_700_000_000 + i // 2 * 60, Decimal(rng.randrange(0, 50)) / 1000) for i in range(300)] + [("c", 999, 1_700_000_000, Decimal(0))]
    schema = "m string, id long, sec long, cost decimal(18,12)"

    def timed(df):
        return df.withColumn("ts", F.timestamp_seconds("sec"))

    want = cost.budget_fuse(timed(spark.createDataFrame(calls, schema)), ["m"], ["ts", "id"], Decimal("1.5"))
    arriving = sorted(calls, key=lambda c: c[2] + rng.randrange(0, 1700))
    for w in range(3):
        spark.createDataFrame(arriving[w * 101:(w + 1) * 101], schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = timed(jobs.read_folder(spark, str(tmp_path / "in"), schema))
        jobs.drain(stateful.budget_fuse(stream, ["m"], ["ts", "id"], "ts", Decimal("1.5"), delay="30 minutes"), str(tmp_path / "job"))
    got = {(r.m, r.id): (r.fuse, r.cumulative_cost) for r in jobs.output(spark, str(tmp_path / "job")).collect()}
    passed = max(c[2] for c in calls) - 1800
    assert got == {(r.m, r.id): (r.fuse, r.cumulative_cost) for r in want.collect() if r.sec < passed}
    assert {f for f, _ in got.values()} == {"before", "trip", "after"} and got["c", 999][0] == "before"
    waiting = state_rows(spark, tmp_path / "job", "waiting").count()
    assert waiting <= sum(c[2] >= passed for c in calls)


def test_stream_fuse_takes_the_keys_of_a_shard_together(spark, tmp_path):
    """300 keys wait in a few entries of the state, not in one per call; ids beyond 2**53 beside nulls stay exact."""
    calls = [(m if m else None, 2 ** 60 + i if i else None, i * 60, Decimal(m % 3)) for m in range(300) for i in range(4)]
    schema = "m long, id long, sec long, cost decimal(18,12)"
    spark.createDataFrame(calls, schema).write.parquet(str(tmp_path / "in"))
    stream = jobs.read_folder(spark, str(tmp_path / "in"), schema).withColumn("ts", F.timestamp_seconds(F.col("sec") + 1_000_000_000))
    fused = stateful.budget_fuse(stream, ["m"], ["ts", "id"], "ts", Decimal(3), delay="1 minute", shards=8)
    assert fused.columns == [*stream.columns, "cumulative_cost", "fuse"] and fused.schema["id"].dataType.simpleString() == "bigint"
    jobs.drain(fused, str(tmp_path / "job"))
    got = {(r.m, r.id): (r.cumulative_cost, r.fuse) for r in jobs.output(spark, str(tmp_path / "job")).collect()}
    want = {}
    for m, i, sec, cost in calls:
        if sec < 120:
            total = cost * (1 + sec // 60)
            want[m, i] = (total, "before" if total < 3 else "trip")
    assert got == want
    assert 0 < state_rows(spark, tmp_path / "job", "waiting").count() <= 8


def test_cosine(spark):
    rows = [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([1.0, 0.0], [-1.0, 0.0], -1.0), ([0.0, 0.0], [1.0, 1.0], 0.0)]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>, want double")
    assert all(abs(r.got - r.want) < 1e-12 for r in df.select(cosine(F.col("a"), F.col("b")).alias("got"), "want").collect())
    with pytest.raises(Exception, match="differ in size"):
        spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>").select(cosine(F.col("a"), F.col("b"))).collect()


def test_embedding_drift_without_golden_or_output(spark):
    df = spark.createDataFrame([(1, None, [1.0]), (1, [1.0], None), (1, [1.0], [1.0])], "c long, g array<double>, v array<double>")
    rows = monitor.embedding_drift_rows(df, "g", "v")
    assert sorted((r.passed for r in rows.collect())) == [False, True, True]
    assert monitor.embedding_drift(rows, ["c"]).first().mean_similarity == 1.0
    only = monitor.embedding_drift_rows(df.filter("g IS NULL"), "g", "v")
    assert monitor.embedding_drift(only, ["c"]).first().asDict() == {"c": 1, "n": 1, "mean_similarity": 1.0, "n_failed": 0, "alert": False}


def test_samples_have_exact_sizes(spark):
    df = spark.range(5000)
    assert monitor.spot_check(df, "id", 0.05, "a").count() == 250
    first, again = ({r.id for r in monitor.spot_check(df.repartition(n), "id", 0.05, "a").collect()} for n in (1, 7))
    assert first == again != {r.id for r in monitor.spot_check(df, "id", 0.05, "b").collect()}
    assert monitor.spot_check(spark.range(3), "id", 0.05).count() == 1
    assert [r.id for r in monitor.head_sample(df, "id", share=0.001).orderBy("id").collect()] == list(range(5))
    assert monitor.head_sample(df, "id", count=0).count() == 1
    assert sorted(r.id for r in monitor.head_sample(df.repartition(4), "id", count=1234, top_k=9).collect()) == list(range(1234))
    large = {r.id for r in monitor.spot_check(df, "id", 0.05, "a", top_k=9).collect()}
    assert large == first


@pytest.mark.parametrize("options", [{}, BUCKETED])
@pytest.mark.parametrize("budget", ["0", "0.002", "0.05", "9"])
def test_budget_fuse_like_the_plain_fold(spark, options, budget):
    from decimal import Decimal
    rng = random.Random(9)
    calls = [(rng.randrange(3), i, "actor", rng.choice(["gpt-4o", "new"]), rng.randrange(900), rng.randrange(50)) for i in range(90)]
    df = spark.createDataFrame(calls, "m long, call_id long, role string, model string, prompt_tokens long, completion_tokens long")
    got = {(r.m, r.call_id): r.fuse for r in cost.budget_fuse(cost.price_calls(df), ["m"], ["call_id"], Decimal(budget), **options).collect()}
    prices = {"gpt-4o": (Decimal("0.0025"), Decimal("0.01")), "new": (Decimal("0.01"), Decimal("0.03"))}
    spent, blown = {}, set()
    for m, i, _, model, p, c in calls:
        spent[m] = spent.get(m, Decimal(0)) + (p * prices[model][0] + c * prices[model][1]) / 1000
        want = "after" if m in blown else "trip" if spent[m] >= Decimal(budget) else "before"
        blown |= {m} if want == "trip" else set()
        assert got[(m, i)] == want


def test_ledger_expectations(spark):
    pricing = {"m": ("0.01", "0.03")}
    df = spark.createDataFrame([("m", "actor", 1000, 1000)], "model string, role string, prompt_tokens long, completion_tokens long")
    assert float(cost.price_calls(df, pricing).first().cost) == 0.04
    same = spark.createDataFrame([("a", "critic", 100, 100)] * 5, df.schema)
    total = cost.price_calls(same, {"a": ("0.001", "0.001")}).agg(F.sum("cost")).first()[0]
    assert float(total) == 0.001


def test_estimate_splits_seventy_thirty(spark):
    got = spark.range(1).select(cost.estimated_cost(F.lit("m"), F.lit(1000), {"m": ("1", "10")})).first()[0]
    assert float(got) == 0.7 + 3.0
