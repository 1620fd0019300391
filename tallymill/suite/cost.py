"""Registered queries of the cost family and their SQL twins."""

from decimal import Decimal

from pyspark.sql import functions as F

from tallymill.operators import attempts as at
from tallymill.operators import cost
from tallymill.session import load
from tallymill.suite import views
from tallymill.suite.views import ATTEMPTS, CALLS, TRACES

BUDGET = Decimal("0.12")


def priced(spark, d):
    return cost.price_calls(views.calls(spark, d))


def price_calls(spark, d):
    return priced(spark, d).select("call_id", "model", F.col("cost").cast("double").alias("cost"))


def usage_report(spark, d):
    return cost.usage_report(priced(spark, d), ["mission_id"]).withColumn("total_cost", F.col("total_cost").cast("double"))


def fused(spark, d, **ordered):
    return cost.budget_fuse(priced(spark, d), ["mission_id"], ["ts", "call_id"], BUDGET, **ordered)


def budget_fuse(spark, d):
    return fused(spark, d).select("mission_id", "call_id", "fuse", F.col("cumulative_cost").cast("double").alias("cumulative_cost"))


def fuse_trips(spark, d):
    return (cost.fuse_trips(fused(spark, d), ["mission_id"], "call_id")
            .withColumn("cumulative_cost", F.col("cumulative_cost").cast("double")))


def budget_effects(spark, d):
    items = views.traces(spark, d).select(
        "mission_id", "item_id", "ord", F.when(F.col("success") == 1, "success").otherwise("exhausted").alias("status"))
    trips = cost.fuse_trips(fused(spark, d), ["mission_id"], "call_id")
    return cost.budget_effects(items, trips, ["mission_id"], "ord")


def roi(spark, d):
    return cost.roi_report(priced(spark, d), views.traces(spark, d), ["mission_id"])


def roi_report(spark, d):
    return roi(spark, d).withColumn("total_cost", F.col("total_cost").cast("double"))


def value_metrics(spark, d):
    items = at.outcome_until_pass(views.attempts(spark, d), ["mission_id", "item_id"], 10)
    items = items.withColumn("words", F.size(F.split(F.trim("output"), r"\s+")).cast("bigint"))
    return cost.value_metrics(items, priced(spark, d), ["mission_id"])


MODELS = ["gpt-4o", "gpt-4o-mini", "claude-3-5-sonnet", "claude-3-haiku"]


def tasks(spark, d):
    """Orders as tasks; the models an order may use depend on its status."""
    return load(spark, d, "orders").select(
        "o_orderkey", F.expr("""CASE o_orderpriority WHEN '1-URGENT' THEN 'HIGH' WHEN '2-HIGH' THEN 'HIGH'
          WHEN '5-LOW' THEN 'LOW' ELSE 'NORMAL' END""").alias("priority"),
        F.col("o_totalprice").cast("bigint").alias("tokens"),
        F.expr("""CASE o_orderstatus WHEN 'O' THEN array('claude-3-5-sonnet', 'unlisted-model')
          WHEN 'F' THEN array('claude-3-haiku', 'gpt-4o', 'gpt-4o-mini')
          ELSE array('claude-3-haiku', 'gpt-4o') END""").alias("models"))


def cost_estimates(spark, d):
    cols = [cost.estimated_cost(F.lit(m), F.col("tokens")).cast("double").alias(m.replace("-", "_")) for m in MODELS]
    return tasks(spark, d).select("o_orderkey", *cols)


def cheapest_model(spark, d):
    return tasks(spark, d).select("o_orderkey", cost.cheapest_model(F.col("models")).alias("model"))


def cheapest_provider(spark, d):
    return tasks(spark, d).select("o_orderkey", cost.cheapest_provider(F.col("models"), F.col("tokens")).alias("model"))


def execution_plans(spark, d):
    planned = cost.plan_execution(tasks(spark, d), "priority", "tokens", F.col("models"))
    return planned.select("o_orderkey", "strategy", "model", F.col("estimated_cost").cast("double").alias("estimated_cost"))


def execution_plan_summary(spark, d):
    summary = cost.plan_summary(cost.plan_execution(tasks(spark, d), "priority", "tokens", F.col("models")))
    return summary.select("strategy", "tasks", *[
        F.col(c).cast("double").alias(c) for c in ("full_cost", "estimated_cost", "saved")])


PRIORITY = "CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 WHEN 'click' THEN 1 ELSE 2 END"
NOW = "2024-01-20 00:00:00"


def backlog(spark, d):
    placed = cost.backlog(load(spark, d, "events"), F.expr(PRIORITY), F.col("ts"), F.expr(f"TIMESTAMP_NTZ'{NOW}'"), "event_id")
    return placed.select("event_id", "effective", "place")


def backlog_by_priority(spark, d):
    return cost.backlog_by_priority(load(spark, d, "events"), F.expr(PRIORITY), F.col("ts"), F.expr(f"TIMESTAMP_NTZ'{NOW}'"))


def mission_totals(spark, d):
    return cost.mission_totals(roi(spark, d))


def roi_curve(spark, d):
    items = views.traces(spark, d).withColumn("day", F.substring_index("item_id", ":", -1))
    return cost.roi_curve(priced(spark, d), items, F.col("ts").cast("date").cast("string"), F.col("day"), 20)


QUERIES = {
    "price_calls": price_calls, "usage_report": usage_report, "budget_fuse": budget_fuse,
    "fuse_trips": fuse_trips, "budget_effects": budget_effects, "roi_report": roi_report,
    "value_metrics": value_metrics, "cost_estimates": cost_estimates, "cheapest_model": cheapest_model,
    "cheapest_provider": cheapest_provider, "execution_plans": execution_plans,
    "execution_plan_summary": execution_plan_summary, "backlog": backlog,
    "backlog_by_priority": backlog_by_priority, "mission_totals": mission_totals, "roi_curve": roi_curve,
}

PRICING = """pricing(model, p, c) AS (VALUES ('gpt-4o', 0.0000025::DECIMAL(18,12), 0.00001::DECIMAL(18,12)),
 ('gpt-4o-mini', 0.00000015, 0.0000006), ('claude-3-5-sonnet', 0.000003, 0.000015),
 ('claude-3-haiku', 0.00000025, 0.00000125))"""

PRICED = f"""{CALLS}, {PRICING}, priced AS (SELECT calls.*,
  prompt_tokens::DECIMAL(18,0) * coalesce(p, 0.00001::DECIMAL(18,12))
  + completion_tokens::DECIMAL(18,0) * coalesce(c, 0.00003::DECIMAL(18,12)) AS cost
  FROM calls LEFT JOIN pricing USING (model))"""

FUSED = PRICED + """, summed AS (SELECT *, sum(cost) OVER (PARTITION BY mission_id ORDER BY ts, call_id) AS cum FROM priced),
 trips AS (SELECT mission_id, arg_min(call_id, cum) AS trip_call, min(cum) AS cumulative_cost,
   arg_min(ts, cum) AS trip_ts FROM summed WHERE cum >= 0.12 GROUP BY mission_id)"""

TASKS = """tasks AS (SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'HIGH'
  WHEN o_orderpriority = '5-LOW' THEN 'LOW' ELSE 'NORMAL' END AS priority,
  CAST(trunc(o_totalprice) AS BIGINT) AS tokens, unnest(range(len(models))) AS pos, unnest(models) AS model FROM (
   SELECT *, CASE o_orderstatus WHEN 'O' THEN ['claude-3-5-sonnet', 'unlisted-model']
    WHEN 'F' THEN ['claude-3-haiku', 'gpt-4o', 'gpt-4o-mini'] ELSE ['claude-3-haiku', 'gpt-4o'] END AS models
   FROM orders))"""

OFFERS = f"""{TASKS}, {PRICING}, offers AS (SELECT o_orderkey, priority, tokens, pos, model,
  coalesce(c, 0.00003::DECIMAL(18,12)) AS completion,
  CAST(trunc(tokens * 0.7::DOUBLE) AS BIGINT)::DECIMAL(18,0) * coalesce(p, 0.00001::DECIMAL(18,12))
  + CAST(trunc(tokens * 0.3::DOUBLE) AS BIGINT)::DECIMAL(18,0) * coalesce(c, 0.00003::DECIMAL(18,12)) AS estimate
  FROM tasks LEFT JOIN pricing USING (model))"""

BEST = "SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY completion, pos) AS k FROM offers"

PLANS = f"""{OFFERS}, plans AS (SELECT o_orderkey, model, estimate AS full_cost,
  CASE priority WHEN 'HIGH' THEN 'sync' WHEN 'LOW' THEN 'batch' ELSE 'queue' END AS strategy,
  CASE priority WHEN 'LOW' THEN estimate * 0.5 ELSE estimate * 1.0 END AS estimated_cost FROM ({BEST}) WHERE k = 1)"""

ROI = f"""{PRICED}, {TRACES}, roi AS (SELECT mission_id, tokens, total_cost, n_calls AS calls,
  coalesce(items, 0) AS items, coalesce(successes, 0) AS successes FROM
  (SELECT mission_id, CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS tokens, sum(cost) AS total_cost,
    count(*) AS n_calls FROM priced GROUP BY mission_id)
  LEFT JOIN (SELECT mission_id, count(*) AS items, CAST(sum(success) AS BIGINT) AS successes
    FROM traces GROUP BY mission_id) USING (mission_id))"""


def _estimate(model: str, p: str, c: str) -> str:
    return (f"CAST(CAST(trunc(tokens * 0.7::DOUBLE) AS BIGINT)::DECIMAL(18,0) * {p}::DECIMAL(18,12) + "
            f"CAST(trunc(tokens * 0.3::DOUBLE) AS BIGINT)::DECIMAL(18,0) * {c}::DECIMAL(18,12) AS DOUBLE) AS {model}")


ORACLES = {
    "price_calls": f"WITH {PRICED} SELECT call_id, model, CAST(cost AS DOUBLE) AS cost FROM priced",
    "usage_report": f"""WITH {PRICED}, report AS (SELECT mission_id,
 CAST(coalesce(sum(prompt_tokens) FILTER (role = 'actor'), 0) AS BIGINT) AS actor_prompt_tokens,
 CAST(coalesce(sum(completion_tokens) FILTER (role = 'actor'), 0) AS BIGINT) AS actor_completion_tokens,
 CAST(coalesce(sum(prompt_tokens) FILTER (role <> 'actor'), 0) AS BIGINT) AS critic_prompt_tokens,
 CAST(coalesce(sum(completion_tokens) FILTER (role <> 'actor'), 0) AS BIGINT) AS critic_completion_tokens,
 CAST(sum(cost) AS DOUBLE) AS total_cost, count(*) AS calls, epoch_us(max(ts)) - epoch_us(min(ts)) AS elapsed_us
 FROM priced GROUP BY mission_id)
SELECT *, CASE WHEN critic_prompt_tokens + critic_completion_tokens > 0 THEN
 CAST(actor_prompt_tokens + actor_completion_tokens AS DOUBLE) / (critic_prompt_tokens + critic_completion_tokens)
 END AS actor_critic_ratio FROM report""",
    "budget_fuse": f"""WITH {FUSED} SELECT s.mission_id, s.call_id, CAST(cum AS DOUBLE) AS cumulative_cost,
 CASE WHEN t.trip_call IS NULL OR cum < 0.12 THEN 'before' WHEN s.call_id = t.trip_call THEN 'trip' ELSE 'after' END AS fuse
 FROM summed s LEFT JOIN trips t ON t.mission_id = s.mission_id""",
    "fuse_trips": f"WITH {FUSED} SELECT mission_id, trip_call, CAST(cumulative_cost AS DOUBLE) AS cumulative_cost FROM trips",
    "budget_effects": f"""WITH {FUSED}, {TRACES} SELECT i.mission_id, i.item_id, i.ord, CASE
 WHEN i.ord > t.trip_call THEN 'quality_halted'
 WHEN i.ord <= t.trip_call AND (i.next_ord IS NULL OR i.next_ord > t.trip_call) THEN 'budget_exceeded'
 WHEN i.success = 1 THEN 'success' ELSE 'exhausted' END AS status
 FROM (SELECT *, lead(ord) OVER (PARTITION BY mission_id ORDER BY ord) AS next_ord FROM traces) i
 LEFT JOIN trips t ON t.mission_id = i.mission_id""",
    "roi_report": f"""WITH {ROI} SELECT mission_id, tokens, CAST(total_cost AS DOUBLE) AS total_cost, calls, items, successes,
 CASE WHEN successes > 0 THEN CAST(total_cost AS DOUBLE) / successes END AS cost_per_success FROM roi""",
    "value_metrics": f"""WITH {PRICED}, {ATTEMPTS}, within AS (SELECT *, min(attempt) FILTER (passed)
  OVER (PARTITION BY item_id) AS hit FROM attempts WHERE attempt <= 10),
 items AS (SELECT mission_id, item_id, arg_max(output, attempt) AS output, max(attempt) AS iterations,
  arg_max(score, attempt) AS score, bool_or(hit IS NOT NULL) AS ok
  FROM within WHERE hit IS NULL OR attempt <= hit GROUP BY mission_id, item_id),
 made AS (SELECT mission_id, count(*) AS items_processed, count(*) FILTER (ok) AS items_succeeded,
  count(*) FILTER (NOT ok) AS items_failed,
  CAST(sum(len(string_split(trim(output), ' '))) AS BIGINT) AS words_processed,
  CAST(sum(iterations) AS BIGINT) AS total_iterations, coalesce(avg(score) FILTER (score > 0), 0.0) AS avg_score
  FROM items GROUP BY mission_id),
 spent AS (SELECT mission_id, CAST(sum(cost) AS DOUBLE) AS total_cost FROM priced GROUP BY mission_id)
SELECT made.*, total_cost, CASE WHEN items_succeeded > 0 THEN total_cost / items_succeeded ELSE 0.0 END AS cost_per_item
 FROM made JOIN spent USING (mission_id)""",
    "cost_estimates": f"""WITH {TASKS}, one AS (SELECT DISTINCT o_orderkey, tokens FROM tasks) SELECT o_orderkey,
 {_estimate('gpt_4o', '0.0000025', '0.00001')}, {_estimate('gpt_4o_mini', '0.00000015', '0.0000006')},
 {_estimate('claude_3_5_sonnet', '0.000003', '0.000015')}, {_estimate('claude_3_haiku', '0.00000025', '0.00000125')}
 FROM one""",
    "cheapest_model": f"WITH {OFFERS} SELECT o_orderkey, model FROM ({BEST}) WHERE k = 1",
    "cheapest_provider": f"""WITH {OFFERS} SELECT o_orderkey, model FROM (SELECT *,
 row_number() OVER (PARTITION BY o_orderkey ORDER BY estimate, pos) AS k FROM offers) WHERE k = 1""",
    "execution_plans": f"WITH {PLANS} SELECT o_orderkey, strategy, model, CAST(estimated_cost AS DOUBLE) AS estimated_cost FROM plans",
    "execution_plan_summary": f"""WITH {PLANS} SELECT strategy, count(*) AS tasks, CAST(sum(full_cost) AS DOUBLE) AS full_cost,
 CAST(sum(estimated_cost) AS DOUBLE) AS estimated_cost, CAST(sum(full_cost - estimated_cost) AS DOUBLE) AS saved
 FROM plans GROUP BY strategy""",
    "backlog": f"""SELECT event_id, effective, row_number() OVER (ORDER BY effective, ts, event_id) AS place FROM (
 SELECT event_id, ts, greatest(0.0::DOUBLE, CAST({PRIORITY} AS DOUBLE) - least(
  (epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 60000000.0::DOUBLE, 1.0::DOUBLE)) AS effective
 FROM events WHERE ts <= TIMESTAMP '{NOW}')""",
    "backlog_by_priority": f"""SELECT {PRIORITY} AS priority, count(*) AS pending FROM events
 WHERE ts <= TIMESTAMP '{NOW}' GROUP BY 1""",
    "mission_totals": f"""WITH {ROI}, t AS (SELECT CAST(sum(total_cost) AS DOUBLE) AS total_cost,
 CAST(sum(items) AS BIGINT) AS total_items, CAST(sum(successes) AS BIGINT) AS total_success FROM roi)
SELECT *, CAST(total_success AS DOUBLE) / total_items AS success_rate, total_cost / total_success AS cost_per_success FROM t""",
    "roi_curve": f"""WITH {PRICED}, {TRACES}, days AS (
 SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS bucket, sum(cost) AS cost FROM priced GROUP BY 1),
 made AS (SELECT split_part(item_id, ':', 2) AS bucket, count(*) AS items, sum(success) AS successes FROM traces GROUP BY 1),
 run AS (SELECT bucket, CAST(sum(cost) OVER (ORDER BY bucket) AS DOUBLE) AS cost,
  CAST(sum(items) OVER (ORDER BY bucket) AS BIGINT) AS items, sum(successes) OVER (ORDER BY bucket) AS s
  FROM days JOIN made USING (bucket))
SELECT bucket, cost, items, CAST(s AS DOUBLE) / items AS success_rate FROM run ORDER BY bucket DESC LIMIT 20""",
}
