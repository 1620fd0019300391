"""Cost ledger: prices, usage, the budget fuse, value reports and execution plans."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymill.functions.basic import zero
from tallymill.functions.money import (
    PRICING, Pricing, call_cost, completion_price, ratio)
from tallymill.plans.ordered import OrderedRows, first_rows, global_number
from tallymill.plans.skew import lookup_join

def price_calls(calls: DataFrame, pricing: Pricing = PRICING) -> DataFrame:
    return calls.withColumn("cost", call_cost(
        F.col("model"), F.col("prompt_tokens"), F.col("completion_tokens"), pricing))


def usage_report(priced: DataFrame, by: list[str]) -> DataFrame:
    """Token totals by role (every role but ``actor`` is audit work), cost, calls and elapsed time."""
    actor = F.col("role") == "actor"

    def total(column: str, mine: Column) -> Column:
        return F.coalesce(F.sum(F.when(mine, F.col(column))), F.lit(0))

    first, last = F.min("ts"), F.max("ts")
    report = priced.groupBy(*by).agg(
        total("prompt_tokens", actor).alias("actor_prompt_tokens"),
        total("completion_tokens", actor).alias("actor_completion_tokens"),
        total("prompt_tokens", ~actor).alias("critic_prompt_tokens"),
        total("completion_tokens", ~actor).alias("critic_completion_tokens"),
        F.sum("cost").alias("total_cost"), F.count("*").alias("calls"),
        F.timestamp_diff("MICROSECOND", first, last).alias("elapsed_us"))
    work = F.col("actor_prompt_tokens") + F.col("actor_completion_tokens")
    audit = F.col("critic_prompt_tokens") + F.col("critic_completion_tokens")
    return report.withColumn("actor_critic_ratio", ratio(work.cast("double"), audit, F.lit(None).cast("double")))


def budget_fuse(priced: DataFrame, by: list[str], order: list[str], budget: Decimal, **ordered) -> DataFrame:
    """Cumulative cost of every call and whether it came before the fuse, tripped it, or came after.
    All calls stay booked; the fuse trips once."""
    rows = (OrderedRows(priced, by, order, **ordered)
            .scan(cumulative_cost=("sum", F.col("cost")), _calls=("sum", F.lit(1))).df)
    limit = F.lit(Decimal(budget))
    reached = F.col("cumulative_cost") >= limit
    before = F.col("cumulative_cost") - F.coalesce("cost", F.lit(0))
    first = (before < limit) | (F.col("_calls") == 1)
    return rows.withColumn("fuse", F.when(~reached, "before").when(first, "trip").otherwise("after")).drop("_calls")


def fuse_trips(fused: DataFrame, by: list[str], call: str) -> DataFrame:
    """The tripping call of every key that has one."""
    return fused.filter(F.col("fuse") == "trip").select(*by, F.col(call).alias("trip_call"), "cumulative_cost")


def budget_effects(items: DataFrame, trips: DataFrame, by: list[str], order: str) -> DataFrame:
    """Effect of the fuse on items: the item being worked on when it trips is ``budget_exceeded``,
    all later ones are ``quality_halted``, earlier ones keep their status. ``order`` holds the first
    call of an item, on the scale of ``trip_call``."""
    tripped = lookup_join(items, trips.select(*by, "trip_call"), by, "left")
    started = F.when(F.col(order) <= F.col("trip_call"), F.col(order))
    hit = tripped.groupBy(*by).agg(F.max(started).alias("hit"))
    return (lookup_join(tripped, hit, by, "left")
            .withColumn("status", F.when(F.col(order) > F.col("trip_call"), "quality_halted")
                        .when(F.col(order) == F.col("hit"), "budget_exceeded").otherwise(F.col("status")))
            .drop("trip_call", "hit"))


def roi_report(priced: DataFrame, items: DataFrame, by: list[str]) -> DataFrame:
    """Tokens, cost and cost per success, one row per key."""
    spent = priced.groupBy(*by).agg(
        F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"),
        F.sum("cost").alias("total_cost"), F.count("*").alias("calls"))
    made = items.groupBy(*by).agg(
        F.count("*").alias("items"), F.sum(F.col("success").cast("bigint")).alias("successes"))
    joined = spent.join(made, by, "full")
    return (joined.fillna(0, ["tokens", "calls", "items", "successes"])
            .withColumn("total_cost", F.coalesce("total_cost", F.lit(0)))
            .withColumn("cost_per_success", ratio(
                F.col("total_cost").cast("double"), F.col("successes"), F.lit(None).cast("double"))))


def value_metrics(items: DataFrame, priced: DataFrame, by: list[str]) -> DataFrame:
    """What a mission produced: items, words, iterations, mean of the positive scores, cost per success."""
    made = items.groupBy(*by).agg(
        F.count("*").alias("items_processed"),
        F.count_if(F.col("status") == "success").alias("items_succeeded"),
        F.count_if(F.col("status") != "success").alias("items_failed"),
        F.sum("words").alias("words_processed"), F.sum("iterations").alias("total_iterations"),
        F.coalesce(F.avg(F.when(F.col("score") > 0, F.col("score"))), zero()).alias("avg_score"))
    spent = priced.groupBy(*by).agg(F.sum("cost").cast("double").alias("total_cost"))
    return (made.join(spent, by, "left").fillna(0.0, ["total_cost"])
            .withColumn("cost_per_item", ratio(F.col("total_cost"), F.col("items_succeeded"), zero())))


def estimated_cost(model: Column, tokens: Column, pricing: Pricing = PRICING) -> Column:
    """Cost of ``tokens`` split 70/30 into prompt and completion, both parts truncated."""
    prompt = (tokens.cast("double") * 0.7).cast("bigint")
    completion = (tokens.cast("double") * 0.3).cast("bigint")
    return call_cost(model, prompt, completion, pricing)


def _least(available: Column, cost_of) -> Column:
    """The model with the least cost; the first listed wins ties."""
    ranked = F.transform(available, lambda m, i: F.struct(cost_of(m).alias("cost"), i.alias("at"), m.alias("model")))
    return F.array_min(ranked)["model"]


def cheapest_model(available: Column, pricing: Pricing = PRICING, default: str = "gpt-4o-mini") -> Column:
    """By completion price alone; ``default`` where no model is available."""
    return F.coalesce(_least(available, lambda m: completion_price(m, pricing)), F.lit(default))


def cheapest_provider(available: Column, tokens: Column, pricing: Pricing = PRICING) -> Column:
    """By the estimated total for ``tokens``; null where no provider is available."""
    return _least(available, lambda m: estimated_cost(m, tokens, pricing))


def plan_execution(tasks: DataFrame, priority: str, tokens: str, available: Column,
                   batch_available: bool = True, pricing: Pricing = PRICING) -> DataFrame:
    """Adds strategy, model and estimated cost: HIGH runs at once, LOW goes to the half-price batch
    service where there is one, the rest is queued."""
    level = F.col(priority)
    strategy = F.when(level == "HIGH", "sync")
    if batch_available:
        strategy = strategy.when(level == "LOW", "batch")
    planned = (tasks.withColumn("strategy", strategy.otherwise("queue"))
               .withColumn("model", cheapest_model(available, pricing)))
    full = estimated_cost(F.col("model"), F.col(tokens), pricing)
    discount = F.when(F.col("strategy") == "batch", F.lit(Decimal("0.5"))).otherwise(F.lit(Decimal("1.0")))
    return (planned.withColumn("full_cost", full)
            .withColumn("estimated_cost", F.col("full_cost") * discount))


def plan_summary(planned: DataFrame) -> DataFrame:
    return (planned.groupBy("strategy")
            .agg(F.count("*").alias("tasks"), F.sum("full_cost").alias("full_cost"),
                 F.sum("estimated_cost").alias("estimated_cost"))
            .withColumn("saved", F.col("full_cost") - F.col("estimated_cost")))


def backlog(tasks: DataFrame, priority: Column, created: Column, now: Column, key: str) -> DataFrame:
    """Waiting tasks in service order: a task gains up to one priority level in its first minute."""
    age = F.timestamp_diff("MICROSECOND", created, now) / F.lit(60_000_000.0)
    effective = F.greatest(F.lit(0.0), priority.cast("double") - F.least(age, F.lit(1.0)))
    waiting = tasks.filter(created <= now).withColumns({"effective": effective, "_created": created})
    return global_number(waiting, ["effective", "_created", key], "place").drop("_created")


def backlog_by_priority(tasks: DataFrame, priority: Column, created: Column, now: Column) -> DataFrame:
    return tasks.filter(created <= now).groupBy(priority.alias("priority")).agg(F.count("*").alias("pending"))


def mission_totals(report: DataFrame) -> DataFrame:
    """Dashboard figures over all missions of an ROI report."""
    totals = report.agg(F.sum("total_cost").cast("double").alias("total_cost"),
                        F.sum("items").alias("total_items"), F.sum("successes").alias("total_success"))
    return (totals.withColumn("success_rate", ratio(F.col("total_success").cast("double"), F.col("total_items"), zero()))
            .withColumn("cost_per_success", ratio(F.col("total_cost"), F.col("total_success"), zero())))


def roi_curve(priced: DataFrame, items: DataFrame, bucket_of_call: Column, bucket_of_item: Column,
              points: int = 30) -> DataFrame:
    """Cumulative cost, items and success rate at the end of each of the last ``points`` time buckets."""
    spent = priced.groupBy(bucket_of_call.alias("bucket")).agg(F.sum("cost").alias("cost"))
    made = items.groupBy(bucket_of_item.alias("bucket")).agg(
        F.count("*").alias("items"), F.sum(F.col("success").cast("bigint")).alias("successes"))
    joined = spent.join(made, "bucket", "full")
    # One row per time bucket is left here, so a single ordered window is small by construction.
    upto = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = joined.select(
        "bucket", F.sum("cost").over(upto).cast("double").alias("cost"),
        F.coalesce(F.sum("items").over(upto), F.lit(0)).alias("items"),
        F.coalesce(F.sum("successes").over(upto), F.lit(0)).alias("successes"))
    rate = ratio(F.col("successes").cast("double"), F.col("items"), zero())
    return (running.withColumn("success_rate", rate).drop("successes")
            .orderBy(F.desc("bucket")).limit(points))


def recent_rows(df: DataFrame, by: list[str], newest_first: list[str], n: int) -> DataFrame:
    return first_rows(df, by, [F.desc(c) for c in newest_first], n)
