"""Registered queries of the streaming, refinement and workflow families and their SQL twins.

The streams read the events in three waves of files that arrive one after the other, so every
query here also stops and restarts twice.
"""

from decimal import Decimal

from pyspark.sql import functions as F

from tallymill.functions.money import call_cost
from tallymill.operators.rules import Rule
from tallymill.operators.state import latest
from tallymill.plans.refine import refine
from tallymill.plans.workflow import Node, node_stats, numbered, run_workflow
from tallymill.session import fresh_path, load
from tallymill.streaming import jobs, stateful
from tallymill.suite import monitor, telemetry
from tallymill.suite.cost import BUDGET, FUSED
from tallymill.suite.state import MICROS, STATE, TTL, _hits
from tallymill.suite.telemetry import PHASES, _named

def _on_time(of: str, end: str) -> str:
    """Which events of the late delivery still count in a window ending at ``end``: the first two waves came in
    time, the third is held against the watermark that the second left."""
    return f"({LATE_WAVE} < 3 OR {end} > (SELECT date_trunc('milliseconds', max(ts)) FROM events WHERE {LATE_WAVE} < 3) - INTERVAL {of})"


# Deliveries out of order: some events of the last hour before a wave ends come with the next one, and some of
# the first ten days come with the last one, long after their windows are closed.
LATE_WAVE = """(CASE WHEN ts < TIMESTAMP '2024-01-11' AND event_id % 20 = 0 THEN 3
 WHEN ts < TIMESTAMP '2024-01-11' THEN CASE WHEN event_id % 20 = 1 AND ts >= TIMESTAMP '2024-01-10 23:00:00' THEN 2 ELSE 1 END
 WHEN ts < TIMESTAMP '2024-01-21' THEN CASE WHEN event_id % 20 = 1 AND ts >= TIMESTAMP '2024-01-20 23:00:00' THEN 3 ELSE 2 END
 ELSE 3 END)"""
LATE_WAVES = tuple(f"{LATE_WAVE.replace('TIMESTAMP ', 'TIMESTAMP_NTZ ')} = {n}" for n in (1, 2, 3))
WAVES = ("ts < TIMESTAMP_NTZ'2024-01-11'", "ts >= TIMESTAMP_NTZ'2024-01-11' AND ts < TIMESTAMP_NTZ'2024-01-21'",
         "ts >= TIMESTAMP_NTZ'2024-01-21'")


def in_waves(spark, d, run, waves=WAVES):
    """Events arrive wave by wave; ``run(stream, path)`` drains each. Returns the job's folder."""
    events = load(spark, d, "events")
    inbox, path = fresh_path(spark, "inbox"), fresh_path(spark, "job")
    for wave in waves:
        events.filter(wave).write.mode("append").parquet(inbox)
        run(jobs.read_folder(spark, inbox, events.schema), path)
    return path


CALL_MODEL = """CASE event_type WHEN 'click' THEN 'gpt-4o-mini' WHEN 'view' THEN 'claude-3-haiku' WHEN 'purchase' THEN 'gpt-4o'
 WHEN 'signup' THEN 'claude-3-5-sonnet' ELSE 'unlisted-model' END"""


def _score(events):
    return events.select(F.col("user_id").alias("mission_id"), F.col("event_id").alias("ord"),
                         (F.col("value") / (F.col("value") + F.lit(20.0))).alias("score"))


def stream_quality_gate(spark, d):
    def run(stream, path):
        jobs.drain(stateful.quality_gate(_score(stream), ["mission_id"], ["ord"], threshold=0.8, window=3, recovery=4), path)

    return jobs.output(spark, in_waves(spark, d, run))


def _phase(events):
    return events.select(
        "user_id", "ts", "event_id", F.when(F.col("value") >= 100.0, "production").when(F.col("value") >= 40.0, "sampling")
        .otherwise("idle").alias("phase"), F.when(F.col("value") >= 400.0, "completed").otherwise("running").alias("status"))


def _instants(stream):
    """Watermarks need instants: the events' clock is read as UTC, whatever the session's time zone."""
    return stream.withColumn("ts", F.timestamp_micros(F.expr(MICROS)))


def stream_phase_changes(spark, d):
    """Keys are remembered for 60 days after their end, longer than the events go on."""
    def run(stream, path):
        updates = _instants(_phase(stream))
        jobs.drain(stateful.phase_changes(updates, ["user_id"], ["ts", "event_id"], "ts", keep_ms=60 * 86_400_000), path)

    return jobs.output(spark, in_waves(spark, d, run)).select("user_id", "event_id", "phase")


def stream_first_seen(spark, d):
    def run(stream, path):
        requests = _instants(stream.select("user_id", F.expr(MICROS).alias("at"), "ts"))
        jobs.drain(stateful.first_seen(requests, ["user_id"], "ts", TTL), path)

    return jobs.output(spark, in_waves(spark, d, run)).select("user_id", "at")


def stream_single_deliveries(spark, d):
    """Every event is delivered twice, the second time beside it or with the next wave's first hours."""
    def run(stream, path):
        twice = _instants(stream.unionByName(stream)).select("event_id", "event_type", "ts")
        jobs.drain(jobs.drop_repeats(twice, ["event_id"], "ts", "1 hour"), path)

    return jobs.output(spark, in_waves(spark, d, run)).select("event_id", "event_type")


def stream_budget_fuse(spark, d):
    """Calls of the last hour of a wave arrive with the next one; the fuse trips at the very call all the same."""
    def run(stream, path):
        model = F.expr(CALL_MODEL)
        tokens = F.floor(F.col("value") * 10).cast("bigint"), F.regexp_extract("props", "([0-9]+)", 1).cast("bigint")
        calls = _instants(stream).select(F.col("user_id").alias("mission_id"), F.col("event_id").alias("call_id"), "ts", call_cost(model, *tokens).alias("cost"))
        jobs.drain(stateful.budget_fuse(calls, ["mission_id"], ["ts", "call_id"], "ts", BUDGET, delay="2 hours"), path)

    shuffled = tuple(w.replace("event_id % 20 = 0", "FALSE").replace("event_id % 20 = 1", "event_id % 2 = 1") for w in LATE_WAVES)
    rows = jobs.output(spark, in_waves(spark, d, run, shuffled))
    return rows.select("mission_id", "call_id", "fuse", F.col("cumulative_cost").cast("double").alias("cumulative_cost"))


CLOCK = "timestampadd(SECOND, unix_seconds(start), TIMESTAMP_NTZ'1970-01-01 00:00:00')"


def stream_window_counts(spark, d):
    """Events come out of order; those whose window the watermark has passed are dropped."""
    def run(stream, path):
        jobs.drain(jobs.window_counts(_instants(stream), ["event_type"], "1 hour", "2 hours"), path)

    counts = jobs.output(spark, in_waves(spark, d, run, LATE_WAVES))
    return _named(counts.withColumn("start", F.expr(CLOCK)), "event_type")


def stream_sliding_counts(spark, d):
    def run(stream, path):
        jobs.drain(jobs.window_counts(_instants(stream), ["event_type"], "1 hour", "2 hours", slide="30 minutes"), path)

    counts = jobs.output(spark, in_waves(spark, d, run, LATE_WAVES))
    return _named(counts.withColumn("start", F.expr(CLOCK)), "event_type")


def stream_session_counts(spark, d):
    def run(stream, path):
        jobs.drain(jobs.session_counts(_instants(stream), ["user_id"], "2 hours", "1 hour"), path)

    counts = jobs.output(spark, in_waves(spark, d, run, LATE_WAVES)).withColumn("start", F.expr(CLOCK))
    return counts.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def stream_progress(spark, d):
    def run(stream, path):
        model = F.expr(CALL_MODEL)
        tokens = F.floor(F.col("value") * 10).cast("bigint"), F.regexp_extract("props", "([0-9]+)", 1).cast("bigint")
        priced = stream.select(F.col("user_id").alias("mission_id"), call_cost(model, *tokens).alias("cost"))
        jobs.progress(priced, ["mission_id"], F.lit(BUDGET), path)

    rows = jobs.output(spark, in_waves(spark, d, run))
    return latest(rows, ["mission_id"], ["calls"]).select(
        "mission_id", "calls", F.col("total_cost").cast("double").alias("total_cost"), "fused")


def stream_upserts(spark, d):
    def run(stream, path):
        log = stream.select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("id"),
                            F.when(F.col("value") >= 30.0, "completed").otherwise("pending").alias("status"),
                            F.col("event_id").alias("updated_at"))
        jobs.upserts(log, path, ["id"], ["updated_at"])

    return jobs.upserted(spark, in_waves(spark, d, run), ["id"], ["updated_at"])


def refine_items(spark, d):
    """The stand-in model adds a mark per attempt; outputs must have a length divisible by three."""
    items = load(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("prompt"))
    rules = [Rule("expression", "length(output) % 3 = 0", name="length")]

    def call(batch):
        return batch["prompt"] + batch["attempt"].map(lambda k: "#" * k)

    attempts = refine(items, call, rules, fresh_path(spark, "refine"), max_attempts=2)
    return attempts.select("item_id", "attempt", F.sha2("output", 256).alias("output_hash"), "passed", "score", "critique")


def _stage(condition, output):
    def run(items):
        return items.select("ord", F.when(F.expr(condition), "success").otherwise("exhausted").alias("status"),
                            F.expr(output).alias("final_output"))
    return run


NODES = [Node("merge", _stage("TRUE", "concat(text, '.')"), ("short", "long")),
         Node("clean", _stage("length(text) > 60", "trim(text)")),
         Node("short", _stage("length(text) < 900", "concat('short: ', text)"), ("clean",)),
         Node("long", _stage("length(text) >= 900", "concat('long: ', text)"), ("clean",))]


def _workflow(spark, d):
    items = load(spark, d, "documents").select(F.col("doc_id").alias("ord"), "text")
    return run_workflow(NODES, items)


def staged_workflow(spark, d):
    return numbered(_workflow(spark, d)["merge"].select("ord", "status", F.sha2("final_output", 256).alias("output_hash")))


def workflow_node_stats(spark, d):
    return node_stats(_workflow(spark, d))


QUERIES = {
    "stream_quality_gate": stream_quality_gate, "stream_phase_changes": stream_phase_changes,
    "stream_first_seen": stream_first_seen, "stream_window_counts": stream_window_counts,
    "stream_sliding_counts": stream_sliding_counts, "stream_session_counts": stream_session_counts,
    "stream_single_deliveries": stream_single_deliveries, "stream_budget_fuse": stream_budget_fuse,
    "stream_progress": stream_progress, "stream_upserts": stream_upserts, "refine_items": refine_items,
    "staged_workflow": staged_workflow, "workflow_node_stats": workflow_node_stats,
}

CLEAN = """clean AS (SELECT doc_id, trim(text, ' ') AS text, length(text) > 60 AS ok FROM documents),
 second AS (SELECT row_number() OVER (ORDER BY doc_id) AS ord, text FROM clean WHERE ok),
 merged AS (SELECT 0 AS src, ord, 'short: ' || text AS text FROM second WHERE length(text) < 900
  UNION ALL SELECT 1, ord, 'long: ' || text FROM second WHERE length(text) >= 900)"""

ORACLES = {
    "stream_quality_gate": monitor.ORACLES["quality_gate_recovering"],
    "stream_phase_changes": telemetry.ORACLES["phase_changes"],
    "stream_first_seen": _hits("user_id").split(" m AS (")[0].rstrip().rstrip(",") + ' SELECT user_id, at_us AS "at" FROM a',
    "stream_window_counts": """SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n,
 round(sum(value), 4) AS total FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <=
 (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 2 HOURS FROM events) AND """ + _on_time("2 HOURS", "date_trunc('hour', ts) + INTERVAL 1 HOUR") + " GROUP BY 1, 2",
    "stream_sliding_counts": """SELECT event_type, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(sum(value), 4) AS total
 FROM (SELECT event_id, ts, event_type, value, time_bucket(INTERVAL 30 MINUTES, ts) - k * INTERVAL 30 MINUTES AS start FROM events, (VALUES (0), (1)) w(k))
 WHERE start + INTERVAL 1 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 2 HOURS FROM events) AND """ + _on_time("2 HOURS", "start + INTERVAL 1 HOUR") + " GROUP BY 1, 2",
    "stream_session_counts": "WITH e AS (SELECT * FROM events WHERE " + _on_time("1 HOUR", "ts + INTERVAL 2 HOURS") + """), g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOURS THEN 0 ELSE 1 END AS fresh FROM e),
 s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, sid
HAVING max(ts) + INTERVAL 2 HOURS <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM events)""",
    "stream_single_deliveries": "SELECT event_id, event_type FROM events",
    "stream_budget_fuse": f"""WITH {FUSED} SELECT s.mission_id, s.call_id, CAST(cum AS DOUBLE) AS cumulative_cost,
 CASE WHEN t.trip_call IS NULL OR cum < 0.12 THEN 'before' WHEN s.call_id = t.trip_call THEN 'trip' ELSE 'after' END AS fuse
 FROM summed s LEFT JOIN trips t ON t.mission_id = s.mission_id JOIN events e ON e.event_id = s.call_id
 WHERE date_trunc('milliseconds', e.ts) < (SELECT date_trunc('milliseconds', max(ts)) FROM events) - INTERVAL 2 HOURS""",
    "stream_progress": f"""WITH {FUSED} SELECT mission_id, count(*) AS calls, CAST(sum(cost) AS DOUBLE) AS total_cost,
 sum(cost) >= 0.12 AS fused FROM priced GROUP BY mission_id""",
    "stream_upserts": f"WITH {STATE} SELECT id, status, updated_at FROM state",
    "refine_items": """WITH a AS (SELECT doc_id AS item_id, k AS attempt, text || repeat('#', k) AS output, (length(text) + k) % 3 = 0 AS passed,
  (length(text) + 1) % 3 = 0 AS early FROM documents, (VALUES (1), (2)) t(k))
SELECT item_id, attempt, sha256(output) AS output_hash, passed, CAST(CAST(passed AS INTEGER) AS DOUBLE) AS score,
 CASE WHEN NOT passed THEN 'failed: length' END AS critique FROM a WHERE attempt = 1 OR NOT early""",
    "staged_workflow": f"""WITH {CLEAN} SELECT row_number() OVER (ORDER BY src, ord) AS ord, 'success' AS status, sha256(text || '.') AS output_hash FROM merged""",
    "workflow_node_stats": f"""WITH {CLEAN} SELECT 'clean' AS node_id, avg(CAST(ok AS INTEGER)) AS pass_rate, count(*) AS total_processed FROM clean
 UNION ALL SELECT 'short', avg(CAST(length(text) < 900 AS INTEGER)), count(*) FROM second
 UNION ALL SELECT 'long', avg(CAST(length(text) >= 900 AS INTEGER)), count(*) FROM second
 UNION ALL SELECT 'merge', 1.0, count(*) FROM merged""",
}
