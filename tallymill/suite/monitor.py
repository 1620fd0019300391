"""Registered queries of the monitoring family and their SQL twins."""

from pyspark.sql import functions as F

from tallymill.functions.text import short_hash
from tallymill.operators import monitor
from tallymill.session import load
from tallymill.suite import views
from tallymill.suite.cost import PRICED, priced
from tallymill.suite.views import ATTEMPTS, DRIFT_PAIRS, TRACES


def head_sample(spark, d):
    return monitor.head_sample(load(spark, d, "documents").select("doc_id", "text"), "doc_id", share=0.01)


def spot_check(spark, d):
    return monitor.spot_check(load(spark, d, "events").select("event_id", "event_type"), "event_id", 0.05)


def sampling_report(spark, d):
    spent = priced(spark, d).groupBy("mission_id").agg(
        F.sum("cost").alias("sampling_cost"), F.count("*").alias("total_count"))
    return monitor.sampling_report(views.traces(spark, d), spent, ["mission_id"])


def sampling_previews(spark, d):
    return monitor.sampling_previews(views.traces(spark, d), ["mission_id"], "ord").select("mission_id", "item_id", "last_score")


def gated(spark, d, recovery=0, **ordered):
    return monitor.quality_gate(views.attempts(spark, d), ["mission_id"], ["ord"], threshold=0.8, window=3,
                                recovery=recovery, **ordered)


def quality_gate(spark, d):
    return gated(spark, d).select("mission_id", "ord", "score", "halted")


def quality_gate_recovering(spark, d):
    return gated(spark, d, 4).select("mission_id", "ord", "score", "halted")


def gate_report(spark, d):
    report = monitor.gate_report(gated(spark, d, 4), ["mission_id"], ["ord"], window=3)
    return report.select("mission_id", F.size("recent_scores").alias("n"), F.get("recent_scores", F.lit(0)).alias("oldest"),
                         F.element_at("recent_scores", -1).alias("newest"), "average", "halted")


def hash_drift(spark, d):
    """Golden: benchmark passages. Current: the same passages, changed or lost for some items; one check per ten items."""
    bench = load(spark, d, "benchmark").withColumn("check_no", F.floor(F.col("item_id") / 10).cast("bigint"))
    golden = bench.select("check_no", "item_id", F.when(F.col("item_id") % 7 != 0, short_hash(F.col("text"))).alias("expected_hash"))
    current = bench.select("check_no", "item_id", F.expr(
        "CASE item_id % 4 WHEN 1 THEN concat(text, '.') WHEN 2 THEN NULL ELSE text END").alias("output"))
    rows = monitor.hash_drift_rows(golden, current, ["check_no", "item_id"])
    return monitor.hash_drift(rows, ["check_no"], 0.6)


def embedding_drift_pairs(spark, d):
    rows = monitor.embedding_drift_rows(views.drift_pairs(spark, d), "golden_vec", "current_vec", 0.85)
    return rows.select("vec_id", "golden_id", "similarity", "passed")


def embedding_drift(spark, d):
    rows = monitor.embedding_drift_rows(views.drift_pairs(spark, d), "golden_vec", "current_vec", 0.85)
    return monitor.embedding_drift(rows, ["label"], 0.85)


def cadence(spark, d):
    items = load(spark, d, "events").select(F.col("user_id").alias("mission_id"), "ts", "event_id", "event_type")
    return monitor.check_cadence(items, ["mission_id"], ["ts", "event_id"], 10)


def check_cadence(spark, d):
    return cadence(spark, d).select("event_id", "item_no", "check_no", "check_due")


def _drift(spark, d, action):
    """A check alerts when more than a third of its items are errors."""
    items = cadence(spark, d).withColumn("status", F.when(F.col("event_type") == "error", "exhausted").otherwise("success"))
    checks = items.groupBy("mission_id", "check_no").agg(
        (F.avg((F.col("event_type") == "error").cast("double")) > 0.34).alias("alert"))
    return monitor.drift_action(items, checks, ["mission_id"], action).select("event_id", "status")


def drift_actions(spark, d):
    return _drift(spark, d, "halt")


def drift_warnings(spark, d):
    return _drift(spark, d, "warn")


def drift_resamples(spark, d):
    return _drift(spark, d, "resample")


QUERIES = {
    "head_sample": head_sample, "spot_check": spot_check, "sampling_report": sampling_report,
    "sampling_previews": sampling_previews, "quality_gate": quality_gate,
    "quality_gate_recovering": quality_gate_recovering, "gate_report": gate_report, "hash_drift": hash_drift,
    "embedding_drift_pairs": embedding_drift_pairs, "embedding_drift": embedding_drift,
    "check_cadence": check_cadence, "drift_actions": drift_actions,
    "drift_warnings": drift_warnings, "drift_resamples": drift_resamples,
}

RUNS = ATTEMPTS + """, g AS (SELECT mission_id, ord, score, score >= 0.8 AS good,
  row_number() OVER (PARTITION BY mission_id ORDER BY ord) AS n FROM attempts),
 r AS (SELECT *, n - coalesce(max(CASE WHEN good THEN n END) OVER w, 0) AS low_run,
  n - coalesce(max(CASE WHEN NOT good THEN n END) OVER w, 0) AS good_run FROM g
  WINDOW w AS (PARTITION BY mission_id ORDER BY ord ROWS UNBOUNDED PRECEDING))"""


def _gate(recovery: int) -> str:
    resume = f"WHEN good_run >= {recovery} THEN FALSE" if recovery else ""
    return f"""{RUNS}, gate AS (SELECT mission_id, ord, score, coalesce(last_value(event IGNORE NULLS) OVER
  (PARTITION BY mission_id ORDER BY ord ROWS UNBOUNDED PRECEDING), FALSE) AS halted FROM
  (SELECT *, CASE WHEN low_run >= 3 THEN TRUE {resume} END AS event FROM r))"""


CADENCE = """c AS (SELECT *, (item_no - 1) // 10 + 1 AS check_no, item_no % 10 = 0 AS check_due FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS item_no FROM events))"""

ORACLES = {
    "head_sample": "SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT (SELECT greatest(1, count(*) // 100) FROM documents)",
    "spot_check": """SELECT event_id, event_type, TRUE AS spot_check FROM events ORDER BY sha256(CAST(event_id AS VARCHAR))
 LIMIT (SELECT greatest(1, CAST(trunc(count(*) * 0.05) AS BIGINT)) FROM events)""",
    "sampling_report": f"""WITH {PRICED}, {TRACES}, spent AS (SELECT mission_id, count(*) AS total_count, CAST(sum(cost) AS DOUBLE) AS sampling_cost
  FROM priced GROUP BY mission_id), s AS (SELECT mission_id, count(*) AS sample_count, count(*) FILTER (success = 1) AS success_count,
  coalesce(avg(last_score) FILTER (success = 1), 0.0) AS mean_score, coalesce(avg(iterations) FILTER (success = 1), 0.0) AS mean_retries
  FROM traces GROUP BY mission_id), t AS (SELECT s.*, total_count, sampling_cost,
  CAST(success_count AS DOUBLE) / sample_count AS success_rate, sampling_cost / sample_count AS cost_per_sample FROM s JOIN spent USING (mission_id))
SELECT *, cost_per_sample * total_count AS estimated_cost, CAST(trunc(total_count * success_rate) AS BIGINT) AS estimated_success,
 CASE WHEN trunc(total_count * success_rate) > 0 THEN cost_per_sample * total_count / trunc(total_count * success_rate) ELSE 0.0 END AS cost_per_success FROM t""",
    "sampling_previews": f"""WITH {TRACES} SELECT mission_id, item_id, last_score FROM (SELECT *,
 row_number() OVER (PARTITION BY mission_id ORDER BY ord) AS k FROM traces WHERE success = 1) WHERE k <= 3""",
    "quality_gate": f"WITH {_gate(0)} SELECT * FROM gate",
    "quality_gate_recovering": f"WITH {_gate(4)} SELECT * FROM gate",
    "gate_report": f"""WITH {_gate(4)}, k AS (SELECT *, row_number() OVER (PARTITION BY mission_id ORDER BY ord DESC) AS k FROM gate)
SELECT mission_id, CAST(count(*) AS INTEGER) AS n, arg_min(score, ord) AS oldest, arg_max(score, ord) AS newest, avg(score) AS average,
 arg_max(halted, ord) AS halted FROM k WHERE k <= 3 GROUP BY mission_id""",
    "hash_drift": """WITH m AS (SELECT item_id // 10 AS check_no, CASE WHEN item_id % 4 = 2 THEN 0.0::DOUBLE WHEN item_id % 7 = 0 THEN 1.0::DOUBLE
  WHEN item_id % 4 = 1 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS hit FROM benchmark)
SELECT check_no, count(*) AS n, avg(hit) AS match_rate, avg(hit) < 0.6 AS alert FROM m GROUP BY check_no""",
    "embedding_drift_pairs": f"""WITH {DRIFT_PAIRS}, s AS (SELECT *, list_cosine_similarity(golden_vec, current_vec) AS similarity FROM drift_pairs)
SELECT vec_id, golden_id, similarity, similarity >= 0.85 AS passed FROM s""",
    "embedding_drift": f"""WITH {DRIFT_PAIRS}, s AS (SELECT *, list_cosine_similarity(golden_vec, current_vec) AS similarity FROM drift_pairs)
SELECT label, count(*) AS n, avg(similarity) AS mean_similarity, count(*) FILTER (similarity < 0.85) AS n_failed,
 avg(similarity) < 0.85 AS alert FROM s GROUP BY label""",
    "check_cadence": f"WITH {CADENCE} SELECT event_id, item_no, check_no, check_due FROM c",
    **{name: f"""WITH {CADENCE}, a AS (SELECT user_id, min(check_no) AS first FROM (SELECT user_id, check_no,
  avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) > 0.34 AS alert FROM c GROUP BY user_id, check_no) WHERE alert GROUP BY user_id)
SELECT event_id, CASE WHEN c.check_no > a.first THEN '{status}' WHEN event_type = 'error' THEN 'exhausted' ELSE 'success' END AS status
 FROM c LEFT JOIN a ON a.user_id = c.user_id""" for name, status in (
        ("drift_actions", "drift_halted"), ("drift_warnings", "drift_warning"), ("drift_resamples", "drift_resample"))},
}
