"""Registered queries of the attempts family and their SQL twins."""

from pyspark.sql import functions as F

from tallymill.operators import attempts as at
from tallymill.session import load
from tallymill.suite import views
from tallymill.suite.views import ATTEMPTS, TRACES, VERSIONS

BY = ["mission_id", "item_id"]
PAGE = 4
TIERS = [at.ModelTier("small", 2), at.ModelTier("medium", 1), at.ModelTier("large", 3)]


def outcome_until_pass(spark, d):
    return at.outcome_until_pass(views.attempts(spark, d), BY, 3)


def outcome_best(spark, d):
    return at.outcome_best(views.attempts(spark, d), BY, 5)


def outcome_once(spark, d):
    return at.outcome_once(views.attempts(spark, d), BY)


def tier_routing(spark, d):
    return at.route_tiers(views.attempts(spark, d), TIERS).select("item_id", "attempt", "model")


def tier_routing_unavailable(spark, d):
    return (at.route_tiers(views.attempts(spark, d), TIERS, {"small", "medium"})
            .select("item_id", "attempt", "model"))


def attempt_history(spark, d):
    nested = at.nest_history(views.attempts(spark, d), BY, ["score", "passed"], PAGE)
    return nested.select(*BY, "history_page", F.to_json("history.attempt").alias("attempts"),
                         F.size("history").alias("n"), F.element_at("history.score", -1).alias("last_score"))


def attempt_history_unnested(spark, d):
    nested = at.nest_history(views.attempts(spark, d), BY, ["score", "passed"], PAGE)
    return at.unnest_history(nested, BY)


def loop_cap(spark, d):
    capped = at.loop_cap(views.traces(spark, d), ["mission_id"], ["ord"], 40)
    return capped.select("mission_id", "item_id", "used_before", "status")


def status_rollup(spark, d):
    return at.status_rollup(at.loop_cap(views.traces(spark, d), ["mission_id"], ["ord"], 40), ["mission_id"])


def as_of_attempt(spark, d):
    return at.as_of_attempt(views.attempts(spark, d), BY, 2, ["score", "passed", "output"])


def as_of_time(spark, d):
    moment = F.expr("TIMESTAMP_NTZ'2024-01-15 12:00:00'")
    return at.as_of_time(views.attempts(spark, d), BY, moment, ["score", "passed"])


def _pinned(df, key, prompt, sample):
    return at.fingerprint(df, F.lit("gpt-4o-mini"), prompt, F.lit(0.1), F.lit(7), F.lit(None), sample)


def fingerprints(spark, d):
    docs = _pinned(load(spark, d, "documents"), "doc_id", F.col("source"), F.col("text"))
    return docs.select("doc_id", "fingerprint.model_id", "fingerprint.prompt_hash", "fingerprint.temperature",
                       "fingerprint.seed", "fingerprint.snapshot")


def fingerprint_mismatches(spark, d):
    """Locked: each version's own template. Current: the template of the version before it."""
    rows = views.versions(spark, d)
    locked = _pinned(rows, "version_no", F.col("template"), F.lit(""))
    earlier = rows.select(F.col("version_no").alias("parent_no"), F.col("template").alias("old"))
    now = rows.join(earlier, "parent_no", "left").withColumn("old", F.coalesce("old", "template"))
    current = _pinned(now, "version_no", F.col("old"), F.lit(""))
    return (at.fingerprint_mismatches(locked, current, "version_no")
            .select("version_no", F.array_join("differs", ",").alias("differs")))


QUERIES = {
    "outcome_until_pass": outcome_until_pass,
    "outcome_best": outcome_best,
    "outcome_once": outcome_once,
    "tier_routing": tier_routing,
    "tier_routing_unavailable": tier_routing_unavailable,
    "attempt_history": attempt_history,
    "attempt_history_unnested": attempt_history_unnested,
    "loop_cap": loop_cap,
    "status_rollup": status_rollup,
    "as_of_attempt": as_of_attempt,
    "as_of_time": as_of_time,
    "fingerprints": fingerprints,
    "fingerprint_mismatches": fingerprint_mismatches,
}

LOOP_CAP = """SELECT mission_id, item_id, used_before, CASE WHEN used_before >= 40 THEN 'governance_limit'
  WHEN success = 1 THEN 'success' ELSE 'exhausted' END AS status FROM (
  SELECT *, CAST(coalesce(sum(iterations) OVER (PARTITION BY mission_id ORDER BY ord
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS used_before FROM traces)"""

ORACLES = {
    "outcome_until_pass": f"""WITH {ATTEMPTS}, within AS (SELECT * FROM attempts WHERE attempt <= 3),
 first_pass AS (SELECT item_id, min(attempt) AS hit FROM within WHERE passed GROUP BY item_id),
 ranked AS (SELECT w.*, f.hit, row_number() OVER (PARTITION BY w.item_id ORDER BY w.attempt DESC) AS k
  FROM within w LEFT JOIN first_pass f ON f.item_id = w.item_id WHERE f.hit IS NULL OR w.attempt <= f.hit)
SELECT mission_id, item_id, CASE WHEN hit IS NULL THEN 'exhausted' ELSE 'success' END AS status,
 attempt AS iterations, score, output FROM ranked WHERE k = 1""",
    "outcome_best": f"""WITH {ATTEMPTS} SELECT mission_id, item_id,
 CASE WHEN passed THEN 'success' ELSE 'exhausted' END AS status, n AS iterations, attempt AS best_attempt,
 score, output FROM (SELECT *, count(*) OVER (PARTITION BY item_id) AS n,
  row_number() OVER (PARTITION BY item_id ORDER BY score DESC, attempt) AS k FROM attempts WHERE attempt <= 5)
WHERE k = 1""",
    "outcome_once": f"""WITH {ATTEMPTS} SELECT mission_id, item_id,
 CASE WHEN passed THEN 'success' ELSE 'exhausted' END AS status, score, output FROM attempts WHERE attempt = 1""",
    "tier_routing": f"""WITH {ATTEMPTS}, tiers(tier_no, model, upto) AS
 (VALUES (1, 'small', 2), (2, 'medium', 3), (3, 'large', 6))
SELECT a.item_id, a.attempt, coalesce(min_by(t.model, t.tier_no), 'large') AS model
 FROM attempts a LEFT JOIN tiers t ON a.attempt <= t.upto GROUP BY a.item_id, a.attempt""",
    "tier_routing_unavailable": f"""WITH {ATTEMPTS}, tiers(tier_no, model, upto) AS
 (VALUES (1, 'small', 2), (2, 'medium', 3))
SELECT a.item_id, a.attempt, min_by(t.model, t.tier_no) AS model
 FROM attempts a LEFT JOIN tiers t ON a.attempt <= t.upto GROUP BY a.item_id, a.attempt""",
    "attempt_history": f"""WITH {ATTEMPTS} SELECT mission_id, item_id,
 CAST((attempt - 1) // {PAGE} AS INTEGER) AS history_page,
 '[' || string_agg(CAST(attempt AS VARCHAR), ',' ORDER BY attempt) || ']' AS attempts,
 CAST(count(*) AS INTEGER) AS n, arg_max(score, attempt) AS last_score
 FROM attempts GROUP BY mission_id, item_id, (attempt - 1) // {PAGE}""",
    "attempt_history_unnested": f"WITH {ATTEMPTS} SELECT mission_id, item_id, attempt, score, passed FROM attempts",
    "loop_cap": f"WITH {TRACES} {LOOP_CAP}",
    "status_rollup": f"WITH {TRACES} SELECT mission_id, status, count(*) AS n_items FROM ({LOOP_CAP}) "
                     "GROUP BY mission_id, status",
    "as_of_attempt": f"""WITH {ATTEMPTS} SELECT mission_id, item_id, attempt, score, passed, output FROM (
 SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY attempt DESC) AS k FROM attempts WHERE attempt <= 2)
WHERE k = 1""",
    "as_of_time": f"""WITH {ATTEMPTS} SELECT mission_id, item_id, attempt, score, passed FROM (
 SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY attempt DESC) AS k FROM attempts
 WHERE ts <= TIMESTAMP '2024-01-15 12:00:00') WHERE k = 1""",
    "fingerprints": """SELECT doc_id, 'gpt-4o-mini' AS model_id, substr(sha256(source), 1, 16) AS prompt_hash,
 CAST(0.1 AS DOUBLE) AS temperature, CAST(7 AS BIGINT) AS seed, substr(sha256(text), 1, 16) AS snapshot
 FROM documents""",
    "fingerprint_mismatches": f"""WITH {VERSIONS} SELECT v.version_no, 'prompt_hash' AS differs FROM versions v
 JOIN versions p ON p.version_no = v.parent_no WHERE p.template <> v.template""",
}
