"""Outcomes of retried attempts, model tiers, run status and configuration fingerprints.

All outcomes are plain aggregates with map-side combining, so an item with very many attempts
never gathers in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.functions.text import short_hash
from tallymill.plans.ordered import OrderedRows

SUCCESS, EXHAUSTED = "success", "exhausted"


def _status(passed: Column) -> Column:
    return F.when(passed, SUCCESS).otherwise(EXHAUSTED)


def outcome_until_pass(attempts: DataFrame, by: list[str], max_attempts: int) -> DataFrame:
    """Feedback-driven runs: the first passing attempt up to ``max_attempts`` wins and ends the item;
    without one the item is exhausted and keeps its last output."""
    row = F.struct("attempt", "score", "output")
    hit = F.when(F.col("passed"), F.col("attempt"))
    return (attempts.filter(F.col("attempt") <= max_attempts).groupBy(*by)
            .agg(F.min_by(row, hit).alias("first_pass"), F.max_by(row, "attempt").alias("last"))
            .withColumn("kept", F.coalesce("first_pass", "last"))
            .select(*by, _status(F.col("first_pass").isNotNull()).alias("status"),
                    F.col("kept.attempt").alias("iterations"), "kept.score", "kept.output"))


def outcome_best(attempts: DataFrame, by: list[str], max_attempts: int) -> DataFrame:
    """Exhaustive runs: every attempt is made, the highest score wins, the earliest on ties."""
    row = F.struct("attempt", "passed", "score", "output")
    return (attempts.filter(F.col("attempt") <= max_attempts).groupBy(*by)
            .agg(F.max_by(row, F.struct("score", -F.col("attempt"))).alias("best"),
                 F.count("*").alias("iterations"))
            .select(*by, _status(F.col("best.passed")).alias("status"), "iterations",
                    F.col("best.attempt").alias("best_attempt"), "best.score", "best.output"))


def outcome_once(attempts: DataFrame, by: list[str]) -> DataFrame:
    """Single-shot runs: the first attempt decides."""
    return attempts.filter(F.col("attempt") == 1).select(
        *by, _status(F.col("passed")).alias("status"), "score", "output")


@dataclass(frozen=True)
class ModelTier:
    model: str
    escalate_after: int


def tier_model(attempt: Column, tiers: list[ModelTier], available: set[str] | None = None) -> Column:
    """The model an attempt goes to: the first available tier whose cumulative allowance covers it,
    else the last tier; null when that one is not available."""
    usable = [t.model for t in tiers] if available is None else available
    allowance, choice = 0, None
    for tier in tiers:
        allowance += tier.escalate_after
        if tier.model in usable:
            covered = attempt <= allowance
            choice = F.when(covered, tier.model) if choice is None else choice.when(covered, tier.model)
    last = F.lit(tiers[-1].model if tiers[-1].model in usable else None).cast("string")
    return last if choice is None else choice.otherwise(last)


def route_tiers(attempts: DataFrame, tiers: list[ModelTier], available: set[str] | None = None) -> DataFrame:
    return attempts.withColumn("model", tier_model(F.col("attempt"), tiers, available))


def nest_history(attempts: DataFrame, by: list[str], fields: list[str], page: int) -> DataFrame:
    """Attempts of an item as ordered arrays of at most ``page``: one row per item and page, whatever
    the item's length. ``history_page`` counts from 0; the arrays are bounded by the page."""
    return (attempts.withColumn("history_page", F.floor((F.col("attempt") - 1) / page).cast("int"))
            .groupBy(*by, "history_page")
            .agg(F.sort_array(F.collect_list(F.struct("attempt", *fields))).alias("history")))


def unnest_history(nested: DataFrame, by: list[str]) -> DataFrame:
    return nested.select(*by, F.explode("history").alias("h")).select(*by, "h.*")


def loop_cap(traces: DataFrame, by: list[str], order: list[str], cap: int, **ordered) -> DataFrame:
    """Items that start once the iterations before them reach ``cap`` are not run."""
    rows = OrderedRows(traces, by, order, **ordered).scan(
        exclusive=True, used_before=("sum", F.col("iterations"))).df
    used = F.coalesce("used_before", F.lit(0))
    return (rows.withColumn("used_before", used)
            .withColumn("status", F.when(used >= cap, "governance_limit")
                        .when(F.col("success") == 1, SUCCESS).otherwise(EXHAUSTED)))


def status_rollup(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by, "status").agg(F.count("*").alias("n_items"))


def as_of_attempt(attempts: DataFrame, by: list[str], k: int, fields: list[str]) -> DataFrame:
    """State of every item after attempt ``k``: its latest attempt up to there."""
    return (attempts.filter(F.col("attempt") <= k).groupBy(*by)
            .agg(F.max_by(F.struct("attempt", *fields), "attempt").alias("at")).select(*by, "at.*"))


def as_of_time(attempts: DataFrame, by: list[str], moment: Column, fields: list[str]) -> DataFrame:
    """State of every item at a point in time."""
    return (attempts.filter(F.col("ts") <= moment).groupBy(*by)
            .agg(F.max_by(F.struct("attempt", *fields), "attempt").alias("at")).select(*by, "at.*"))


def fingerprint(df: DataFrame, model: Column, prompt: Column, temperature: Column, seed: Column,
                top_p: Column, sample_output: Column) -> DataFrame:
    """Adds the struct that pins down a run configuration; no sample output, no snapshot."""
    snapshot = F.when(F.coalesce(F.length(sample_output), F.lit(0)) > 0, short_hash(sample_output))
    return df.withColumn("fingerprint", F.struct(
        model.alias("model_id"), short_hash(prompt).alias("prompt_hash"),
        temperature.cast("double").alias("temperature"), seed.cast("bigint").alias("seed"),
        top_p.cast("double").alias("top_p"), snapshot.alias("snapshot")))


def fingerprint_mismatches(locked: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Keys whose current configuration differs from the locked one in model, prompt, temperature
    or seed, with the names of the differing parts. A missing current row differs in all."""
    parts = ("model_id", "prompt_hash", "temperature", "seed")
    both = (locked.select(key, F.col("fingerprint").alias("locked"))
            .join(current.select(key, F.col("fingerprint").alias("current")), key, "left"))
    differing = F.array_compact(F.array(*[
        F.when(~F.col(f"locked.{p}").eqNullSafe(F.col(f"current.{p}")), p) for p in parts]))
    return (both.withColumn("differs", F.when(F.col("current").isNull(), F.array(*map(F.lit, parts)))
                            .otherwise(differing))
            .filter(F.size("differs") > 0).select(key, "differs"))
