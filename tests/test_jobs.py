"""Sources, sinks, batch files, state, streams, refinement and workflows."""

from graphlib import CycleError

import pytest
from pyspark.sql import functions as F

from tallymill.operators import attempts as at, cache, cost, distill, prompts as pr, state as st, telemetry as te, versions as ve
from tallymill.operators.rules import Rule
from tallymill.plans.refine import refine
from tallymill.plans.workflow import Node, numbered, run_order, run_workflow
from tallymill.session import checkpointed, shared_folder, spread
from tallymill.sources import items as it, sinks, tables
from tallymill.streaming import jobs, stateful


def test_corpus(spark, tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "b.txt").write_bytes(b"line\r\nnext\rlast")
    (tmp_path / "deep" / "er" / "a.md").write_text("naïve")
    (tmp_path / "deep" / "bad.bin").write_bytes(b"\xff\xfe\x00")
    (tmp_path / "noext").write_text("x")
    rows = {r.relative_path: r for r in it.read_corpus(spark, str(tmp_path)).collect()}
    assert rows.keys() == {"b.txt", "deep/er/a.md", "deep/bad.bin"}
    assert rows["b.txt"].content == "line\nnext\nlast" and rows["b.txt"].size == 15 and rows["deep/er/a.md"].name == "a.md"
    assert (rows["deep/bad.bin"].content, rows["deep/bad.bin"].error) == (None, it.NOT_TEXT)
    assert it.read_corpus(spark, "file://" + str(tmp_path), "*.txt").first().relative_path == "b.txt"
    assert [r.relative_path for r in it.read_corpus(spark, str(tmp_path), limit=1).collect()] == ["b.txt"]
    items = it.corpus_items(it.read_corpus(spark, str(tmp_path))).orderBy("ord").collect()
    assert [(r.ord, r.item_id) for r in items] == [(1, "b.txt"), (2, "deep/er/a.md")]


def test_load_items(spark, tmp_path):
    (tmp_path / "rows.csv").write_text("a,b\n1,x\n2,y\n")
    (tmp_path / "empty").mkdir()
    found = it.load_items(spark, [it.Resource("csv", str(tmp_path / "missing.csv")), it.Resource("files", str(tmp_path / "empty")),
                                  it.Resource("csv", str(tmp_path / "rows.csv"), ["a"])])
    assert [r.text for r in found.orderBy("ord").collect()] == ['{"a":"1","b":"x"}', '{"a":"2","b":"y"}']
    with pytest.raises(ValueError):
        it.load_items(spark, [it.Resource("csv", str(tmp_path / "missing.csv"))])
    with pytest.raises(ValueError):
        it.load_items(spark, [it.Resource("ftp", "x")])


def test_tables(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,name\n1,x\n2,y\n")
    tables.register_csv(spark, "t_csv", str(tmp_path / "t.csv"))
    assert tables.table_columns(spark, "t_csv") == [("id", "int"), ("name", "string")]
    assert tables.run_sql(spark, "SELECT name FROM t_csv WHERE id = ?", [2]).first().name == "y"
    assert tables.run_sql(spark, "SELECT name FROM t_csv WHERE id = :i", {"i": 1}).first().name == "x"
    assert tables.run_sql(spark, "SELECT * FROM t_csv", limit=1).count() == 1
    with pytest.raises(ValueError):
        tables.register_csv(spark, "t; drop", str(tmp_path / "t.csv"))


def test_jdbc_options():
    plain = tables.jdbc_options("jdbc:x", "select 1", "drv")
    assert plain == {"url": "jdbc:x", "query": "select 1", "driver": "drv", "fetchsize": "10000"}
    split = tables.jdbc_options("jdbc:x", "select 1", partition_column="id", lower=0, upper=9, partitions=3)
    assert split["dbtable"] == "(select 1) q" and split["numPartitions"] == "3"
    with pytest.raises(ValueError):
        tables.jdbc_options("jdbc:x", "q", partition_column="id")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "success", "out", "", [1, 2]), (2, "success", "", "con", []), (3, "failed", "x", "y", [])],
                               "id long, status string, output string, content string, tags array<int>")
    for _ in range(2):
        sinks.create_sink("jsonl", str(tmp_path / "j"))(df)
    assert spark.read.json(str(tmp_path / "j")).count() == 4
    sinks.create_sink("table", str(tmp_path / "t"))(df)
    assert {(r.id, r.tags) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {("1", "[1,2]"), ("2", "[]")}
    sinks.create_sink("vector", str(tmp_path / "v"), ["id"])(df)
    vectors = spark.read.parquet(str(tmp_path / "v")).collect()
    assert {r.document: r.metadata for r in vectors} == {"out": {"id": "1", "status": "success"}, "con": {"id": "2", "status": "success"}}
    bare = sinks.vector_documents(spark.createDataFrame([(5, "")], "id long, output string"), ["id"]).first()
    assert bare.document == '{"id":5,"output":""}'
    with pytest.raises(ValueError):
        sinks.create_sink("ftp", "x")


def test_templates():
    assert pr.normal_template("a {{data}} b {{  data  }}") == "a {{ data }} b {{ data }}"
    for bad in ("{{ name }}", "{% if x %}", "{# c #}", "{{ data | upper }}", "{{ data"):
        with pytest.raises(ValueError):
            pr.normal_template(bad)


def test_batch_files_and_results(spark, tmp_path):
    chat = pr.messages(F.lit("hé \"q\""))
    lines = spark.range(25).select(pr.batch_line(F.col("id"), F.lit("m"), chat).alias("line"))
    pr.write_batch_files(lines.coalesce(1), str(tmp_path / "b"), per_file=10)
    assert len(list((tmp_path / "b").glob("part-*"))) == 3
    assert pr.read_batch_lines(spark, str(tmp_path / "b")).count() == 25
    raw = ['{"custom_id":"a","response":{"body":{"choices":[{"message":{"content":"ok"}}],"usage":{"prompt_tokens":3,"completion_tokens":2}}}}',
           '{"custom_id":"b","error":{"code":"x"}}', '{"custom_id":"c","response":null}', '{"custom_id":"d"} junk', "", " \t ", "{" + "x" * 200]
    rows = pr.parse_batch_results(spark.createDataFrame([(r,) for r in raw], "line string")).collect()
    assert [(r.custom_id, r.status) for r in rows] == [("a", "ok"), ("b", "error"), ("c", "empty"), ("unknown", "unparsed"), ("unknown", "unparsed")]
    assert (rows[0].content, rows[0].prompt_tokens) == ("ok", 3) and rows[1].error == '{"code":"x"}'
    assert rows[4].error == "not JSON: {" + "x" * 99


def test_snapshots_replace_a_repeated_version(spark, tmp_path):
    snaps = st.Snapshots(spark, str(tmp_path / "s"))
    assert snaps.read() is None
    rows = "id string, v long"
    snaps.write(spark.createDataFrame([("a", 1), ("b", 1)], rows), 0)
    for _ in range(2):
        snaps.write(spark.createDataFrame([("a", 3), ("b", 1)], rows), 1)
    assert {(r.id, r.v) for r in snaps.read().collect()} == {("a", 3), ("b", 1)}
    assert snaps.newest(before=1) == 0 and snaps.newest() == 1
    spark.createDataFrame([("z", 9)], rows).write.parquet(str(tmp_path / "s" / "data" / "version=2"))
    assert snaps.read().count() == 2


def test_upsert_rewrites_touched_parts_only(spark, tmp_path):
    rows = "id string, v long, note string"
    table = st.KeyedTable(spark, str(tmp_path / "s"), ["id"], ["v"], parts=4)

    def files():
        return {f: f.stat().st_mtime_ns for f in (tmp_path / "s").rglob("part-*.parquet")}

    assert table.read() is None
    table.upsert(spark.createDataFrame([], rows))
    assert table.read() is None
    table.upsert(spark.createDataFrame([(f"k{i}", 1, None) for i in range(40)] + [(None, 1, "none"), ("k0", 0, "old")], rows))
    before = files()
    change = spark.createDataFrame([("k1", 3, "new"), ("k1", 2, "older"), ("k2", 0, "too old")], rows)
    for _ in range(2):
        table.upsert(change)
    assert {(r.id, r.v, r.note) for r in table.read().collect()} == {(f"k{i}", 1, None) for i in range(40) if i != 1} | {(None, 1, "none"), ("k1", 3, "new")}
    after = files()
    touched = {r[0] for r in change.select(F.pmod(F.xxhash64("id"), F.lit(4))).collect()}
    kept = {f for f in before if int(f.parent.name.removeprefix("part=")) not in touched}
    assert kept and all(after.get(f) == before[f] for f in kept) and not any(f in after for f in before.keys() - kept)
    table.upsert(spark.createDataFrame([("fresh", 1, None)], rows))
    assert table.read().count() == 42 and table.read().columns == ["id", "v", "note"]


def test_pending_keeps_duplicates(spark):
    ids = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "id string")
    state = spark.createDataFrame([("a", "completed"), ("c", "running")], "id string, status string")
    assert sorted(r.id for r in st.pending(ids, state).collect()) == ["b", "b", "c"]
    assert st.pending(ids.limit(0), state).count() == 0


def test_stream_upsert_and_repeats(spark, tmp_path):
    schema = "id string, v long, ts timestamp"
    for part in ([("a", 1), ("b", 1)], [("a", 5), ("a", 4)]):
        df = spark.createDataFrame(part, "id string, v long").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
        df.write.mode("append").parquet(str(tmp_path / "in"))
        jobs.upserts(jobs.read_folder(spark, str(tmp_path / "in"), schema), str(tmp_path / "job"), ["id"], ["v"])
        jobs.drain(jobs.drop_repeats(jobs.read_folder(spark, str(tmp_path / "in"), schema), ["id"], "ts", "1 hour"), str(tmp_path / "dedup"))
        jobs.drain(jobs.session_counts(jobs.read_folder(spark, str(tmp_path / "in"), schema), ["id"], "1 minute", "1 minute"), str(tmp_path / "sess"))
    rows = jobs.upserted(spark, str(tmp_path / "job"), ["id"], ["v"]).collect()
    assert {(r.id, r.v) for r in rows} == {("a", 5), ("b", 1)}
    assert sorted(r.id for r in jobs.output(spark, str(tmp_path / "dedup")).collect()) == ["a", "b"]
    assert spark.read.schema("id string, n long").parquet(str(tmp_path / "sess" / "out")).count() == 0


def test_stream_phases_equal_batch_phases(spark, tmp_path):
    rows = [(k, i, phase, status) for k in "ab" for i, (phase, status) in enumerate(
        [("x", "run"), ("x", "run"), ("y", "run"), (None, "run"), (None, "run"), ("x", "run"), ("z", "failed" if k == "a" else "run"), ("w", "run")])]
    schema = "k string, i long, phase string, status string"
    want = te.phase_changes(spark.createDataFrame(rows, schema), ["k"], ["i"])
    assert [(r.k, r.i) for r in want.orderBy("k", "i").collect()] == [
        ("a", 0), ("a", 2), ("a", 3), ("a", 5), ("a", 6), ("b", 0), ("b", 2), ("b", 3), ("b", 5), ("b", 6), ("b", 7)]
    for low in (0, 3, 4, 7):
        part = [r for r in rows if low <= r[1] < {0: 3, 3: 4, 4: 7, 7: 8}[low]]
        spark.createDataFrame(part, schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = jobs.read_folder(spark, str(tmp_path / "in"), schema).withColumn("ts", F.timestamp_seconds(F.col("i") + 1_000_000_000))
        jobs.drain(stateful.phase_changes(stream, ["k"], ["i"], "ts", delay="1 second"), str(tmp_path / "job"))
    got = jobs.output(spark, str(tmp_path / "job"))
    assert sorted((r.k, r.i) for r in got.collect()) == sorted((r.k, r.i) for r in want.collect())


def test_stream_phases_forget_keys_that_ended(spark, tmp_path):
    schema = "k string, i long, phase string, status string"
    for wave in ([(f"k{n}", n, "x", "completed" if n % 2 else "failed") for n in range(20)], [("k0", 25, "late", "run"), ("last", 500, "x", "completed")],
                 [("last", 2000, "y", "run"), ("end", 9000, "x", "failed")], [("end", 20_000, "x", "run")]):
        spark.createDataFrame(wave, schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = jobs.read_folder(spark, str(tmp_path / "in"), schema).withColumn("ts", F.timestamp_seconds(F.col("i") + 1_000_000_000))
        jobs.drain(stateful.phase_changes(stream, ["k"], ["i"], "ts", delay="1 second", keep_ms=60_000), str(tmp_path / "job"))
    state = spark.read.format("statestore").option("path", f"{tmp_path}/job/checkpoint").option("stateVarName", "phase").load()
    assert {r.key.k for r in state.collect()} <= {"end"}
    got = {(r.k, r.i) for r in jobs.output(spark, str(tmp_path / "job")).collect()}
    assert {(f"k{n}", n) for n in range(20)} <= got and ("k0", 25) not in got and ("last", 500) in got


def test_late_rows_are_dropped_by_the_watermark(spark, tmp_path):
    schema = "k string, at long, value double"
    waves = [[("a", 0, 1.0), ("a", 10, 1.0), ("a", 10_000, 1.0)], [("a", 20, 99.0), ("a", 9_990, 2.0), ("a", 30_000, 1.0)]]
    for wave in waves:
        spark.createDataFrame(wave, schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = jobs.read_folder(spark, str(tmp_path / "in"), schema).withColumn("ts", F.timestamp_seconds("at"))
        jobs.drain(jobs.window_counts(stream, ["k"], "1 hour", "1 hour"), str(tmp_path / "windows"))
        jobs.drain(jobs.session_counts(stream, ["k"], "1 minute", "1 hour"), str(tmp_path / "sessions"))
    windows = {(r.start.timestamp(), r.n, r.total) for r in jobs.output(spark, str(tmp_path / "windows")).collect()}
    assert windows == {(0.0, 2, 2.0), (7200.0, 2, 3.0)}
    assert sorted(r.n for r in jobs.output(spark, str(tmp_path / "sessions")).collect()) == [2, 2]


def test_refine_goes_on_after_a_stop(spark, tmp_path):
    items = spark.createDataFrame([(i, "x" * i) for i in range(1, 8)], "item_id long, prompt string")
    rules = [Rule("expression", "length(output) % 4 = 0", name="four")]

    def call(batch):
        return batch["prompt"] + batch["attempt"].map(lambda k: "#" * k)

    short = refine(items, call, rules, str(tmp_path / "r"), max_attempts=1)
    assert short.count() == 7

    def later(batch):
        assert (batch["attempt"] > 1).all() and (batch["feedback"] == "failed: four").all()
        return call(batch)

    whole = refine(items, later, rules, str(tmp_path / "r"), max_attempts=3, callers=2)
    outcome = at.outcome_until_pass(whole, ["item_id"], 3)
    got = {r.item_id: (r.status, r.iterations) for r in outcome.collect()}
    assert got == {i: next((("success", k) for k in (1, 2, 3) if (i + k) % 4 == 0), ("exhausted", 3)) for i in range(1, 8)}


def test_refine_hands_long_prompts_out_in_small_parts(spark, tmp_path):
    """Sixty prompts of 300 000 characters in one task: no call, and so no worker, holds them all; ids stay as they are."""
    items = spark.range(60).coalesce(1).select(F.when(F.col("id") > 0, F.col("id") + 2 ** 60).alias("item_id"),
                                               F.when(F.col("id") != 7, F.repeat(F.lit("x"), 300_000)).alias("prompt"))

    def call(batch):
        assert batch["prompt"].str.len().sum() < 2_000_000
        return batch["prompt"].fillna("none")

    made = refine(items, call, [Rule("expression", "length(output) > 4", name="long")], str(tmp_path / "r"), max_attempts=2)
    got = {(r.item_id, r.attempt): r.n for r in made.select("item_id", "attempt", F.length("output").alias("n")).collect()}
    lengths = {i: 4 if i == 7 else 300_000 for i in range(60)}
    assert got == {(2 ** 60 + i if i else None, k): n for i, n in lengths.items() for k in ((1, 2) if i == 7 else (1,))}


def test_refine_keeps_equal_ids_apart(spark, tmp_path):
    items = spark.createDataFrame([(1, "a"), (1, "bb"), (2, "a")], "item_id long, prompt string")
    made = refine(items, lambda batch: batch["prompt"], [Rule("expression", "length(output) > 5", name="long")], str(tmp_path / "r"), max_attempts=3)
    assert made.count() == 9 and made.filter("attempt = 3").count() == 3


def test_workflow(spark):
    def stage(condition, output):
        return lambda df: df.select("ord", F.when(F.expr(condition), "success").otherwise("exhausted").alias("status"), F.expr(output).alias("final_output"))

    items = spark.createDataFrame([(i, f"t{i}") for i in range(4)], "ord long, text string")
    nodes = [Node("a", stage("ord < 3", "concat('a', text)")), Node("none", stage("FALSE", "text")),
             Node("b", stage("TRUE", "concat('b', text)"), ("a", "none")), Node("dead", stage("TRUE", "text"), ("none",)),
             Node("c", stage("TRUE", "text"), ("b", "a"))]
    with pytest.warns(UserWarning):
        results = run_workflow(nodes, items)
    assert "dead" not in results
    assert [r.final_output for r in results["c"].orderBy("ord").collect()] == ["bat0", "bat1", "bat2", "at0", "at1", "at2"]
    dense = numbered(results["c"].select("ord", F.length("final_output").alias("n")))
    assert dense.columns == ["ord", "n"] and [tuple(r) for r in dense.orderBy("ord").collect()] == [(1, 4), (2, 4), (3, 4), (4, 3), (5, 3), (6, 3)]
    with pytest.raises(CycleError):
        run_order([Node("x", None, ("y",)), Node("y", None, ("x",))])
    with pytest.raises(ValueError):
        run_order([Node("x", None, ("nowhere",))])


def test_workflow_moves_no_texts_and_keeps_repeats(spark, monkeypatch):
    """Null and repeated ords, a source listed after a longer chain, and no items at all."""
    plans = []
    monkeypatch.setattr("tallymill.plans.workflow.checkpointed", lambda df: plans.append(df._jdf.queryExecution().toString()) or checkpointed(df))
    echo = lambda df: df.select("ord", F.lit("success").alias("status"), F.col("text").alias("final_output"))
    nodes = [Node("a", echo), Node("b", echo, ("a",)), Node("c", echo, ("b", "a"))]
    items = spark.createDataFrame([(2, "y"), (1, "x"), (1, "x"), (None, None)], "ord long, text string")
    found = [r.final_output for r in run_workflow(nodes, items)["c"].orderBy("ord").collect()]
    assert found == [None, "x", "x", "y"] * 2 and len(plans) == 3 and not any("Exchange" in p for p in plans)
    assert list(run_workflow(nodes, items.limit(0))) == ["a"]


def test_tiers(spark):
    tiers = [at.ModelTier("s", 1), at.ModelTier("m", 2), at.ModelTier("l", 1)]
    df = spark.range(1, 7).withColumnRenamed("id", "attempt")
    assert [r.model for r in at.route_tiers(df, tiers).orderBy("attempt").collect()] == ["s", "m", "m", "l", "l", "l"]
    assert [r.model for r in at.route_tiers(df, tiers, {"m", "l"}).orderBy("attempt").collect()] == ["m", "m", "m", "l", "l", "l"]
    assert [r.model for r in at.route_tiers(df, tiers, {"s"}).orderBy("attempt").collect()] == ["s"] + [None] * 5


def test_history_pages(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(1, 8)], "item string, attempt long, score double")
    nested = at.nest_history(df, ["item"], ["score"], page=3)
    assert {r.history_page: [h.attempt for h in r.history] for r in nested.collect()} == {0: [1, 2, 3], 1: [4, 5, 6], 2: [7]}
    assert at.unnest_history(nested, ["item"]).count() == 7


def test_critique_patterns_first_seen_wins_ties(spark):
    rows = [(1, 1, " too long "), (1, 2, "tone"), (1, 3, "tone"), (1, 4, "too l"), (1, 5, "  "), (2, 1, "x")]
    df = spark.createDataFrame(rows, "m long, ord long, critique string")
    assert [tuple(r) for r in ve.critique_patterns(df, ["m"], "ord", minimum=2).collect()] == [(1, "too l", 2, 0.2)]


def test_merge_stats_new_values_win(spark):
    log = ve.append_versions(None, spark.createDataFrame([("n", 1, "t", "c", {"a": 1.0, "b": 1.0})], "node_id string, at long, template string, change_log string, stats map<string,double>"), "at")
    merged = ve.merge_stats(log, spark.createDataFrame([("n", "v1.0", {"b": 2.0})], "node_id string, version_id string, stats map<string,double>")).first()
    assert merged.stats == {"a": 1.0, "b": 2.0} and merged.parent_id is None


def test_export_needs_something_to_export(spark, tmp_path):
    df = spark.createDataFrame([(0, 0.9, "i", "o"), (1, 0.7, "i", "o")], "success int, last_score double, input string, output string")
    with pytest.raises(ValueError):
        distill.write_training_records(distill.training_records(df), str(tmp_path / "x"))
    distill.write_training_records(distill.training_records(df, "instruction", 0.7), str(tmp_path / "x"))
    assert spark.read.text(str(tmp_path / "x")).first().value == '{"instruction":"i","input":"","output":"o"}'
    with pytest.raises(ValueError):
        distill.training_records(df, "other")


def test_shared_folder_comes_from_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert checkpointed(spark.range(3)).count() == 3


def test_spread_leaves_wide_scans_alone(spark, tmp_path):
    spark.range(100).repartition(9).write.parquet(str(tmp_path / "wide"))
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))
    try:
        wide = spark.read.parquet(str(tmp_path / "wide"))
        assert spread(wide, "id") is wide
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "narrow"))
    assert spread(spark.read.parquet(str(tmp_path / "narrow")), "id").rdd.getNumPartitions() == 8


@pytest.mark.parametrize("options", [{}, {"max_group_rows": 0, "buckets": 4}])
def test_sessions_like_the_built_in_window(spark, options):
    rows = [("hot" if i % 3 else "b", (i * i * 7) % 5000) for i in range(200)]
    df = (spark.createDataFrame(rows, "k string, s long")
          .select("k", F.timestamp_seconds("s").alias("ts"), F.col("s").cast("double").alias("value")))
    want = df.groupBy(F.session_window("ts", "60 seconds"), "k").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        "k", "session_window.start", "session_window.end", "n", "total")
    got = te.session_counts(df, ["k"], "60 seconds", **options).select("k", "start", "end", "n", "total")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_clusters_keep_equal_prefixes_together(spark):
    rows = [(i, ("shared prefix " * 5 if i % 3 else f"other {i % 7} ") + str(i)) for i in range(300)]
    laid = cache.cluster_by_prefix(spark.createDataFrame(rows, "ord long, text string"), "ord").collect()
    assert [(r.text[:50], r.ord) for r in laid] == sorted((t[:50], i) for i, t in rows)


def test_cost_plans(spark):
    df = spark.createDataFrame([("HIGH", 1000), ("NORMAL", 1000), ("LOW", 1000)], "priority string, tokens long")
    models = F.array(F.lit("gpt-4o"), F.lit("gpt-4o-mini"))
    plan = {r.priority: (r.strategy, r.model, float(r.estimated_cost)) for r in cost.plan_execution(df, "priority", "tokens", models).collect()}
    full = 0.7 * 0.00015 + 0.3 * 0.0006
    assert plan == {"HIGH": ("sync", "gpt-4o-mini", pytest.approx(full)), "NORMAL": ("queue", "gpt-4o-mini", pytest.approx(full)),
                    "LOW": ("batch", "gpt-4o-mini", pytest.approx(full / 2))}
    without = cost.plan_execution(df, "priority", "tokens", models, batch_available=False)
    assert without.filter("strategy = 'queue'").count() == 2
    none = spark.range(1).select(cost.cheapest_model(F.array().cast("array<string>"))).first()[0]
    assert none == "gpt-4o-mini"


def test_telemetry_levels(spark):
    df = spark.createDataFrame([("ERROR", None), ("TRACE_EVENT", None), ("SPOT_CHECK", None), ("ERROR", 3)], "t string, l int")
    assert [r[0] for r in df.select(te.event_level(F.col("t"), F.col("l"))).collect()] == [1, 3, 2, 3]
    events = df.select(te.event_level(F.col("t"), F.col("l")).alias("level"), F.repeat(F.lit("x"), F.lit(300)).alias("p"))
    assert te.emitted(events, 9).count() == 4 and te.emitted(events, 0).count() == 1
    assert te.emitted(events, 3, "p").filter("length(p) <> 200").isEmpty()
