"""Scoring outputs along several dimensions, verdicts and score reports."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.functions.basic import no_scores, zero
from tallymill.functions.scoring import band, bar, clamp, two_places

NEUTRAL = 0.5


@dataclass(frozen=True)
class Dimension:
    """A named score. ``evaluator`` maps (input, output) columns to a score column; without one the
    dimension counts as neutral."""

    name: str
    weight: float = 1.0
    evaluator: Callable[[Column, Column], Column] | None = None


def _mean(dimensions: list[Dimension], score_of: Callable[[str], Column]) -> Column:
    if not dimensions:
        return zero()
    total = sum(d.weight for d in dimensions)
    weights = {d.name: d.weight for d in dimensions} if total > 0 else {d.name: 1.0 for d in dimensions}
    weighted = zero()
    for name, weight in weights.items():
        weighted = weighted + score_of(name) * F.lit(float(weight))
    return weighted / F.lit(float(sum(weights.values())))


def judge(df: DataFrame, dimensions: list[Dimension], threshold: float = 0.7, input: str = "input",
          output: str = "output") -> DataFrame:
    """Adds ``scores`` (map), ``weighted_score`` (4 places) and ``passed`` (decided before rounding).

    An evaluator that yields null scores 0. Without dimensions nothing can pass. All evaluators sit
    in one projection over the row.
    """
    names = [d.name for d in dimensions]
    if len(set(names)) != len(names):
        raise ValueError(f"dimension names repeat: {names}")
    columns = {}
    for d in dimensions:
        score = F.lit(NEUTRAL) if d.evaluator is None else d.evaluator(F.col(input), F.col(output))
        columns[f"_d_{d.name}"] = clamp(F.coalesce(score, zero()))
    scored = df.withColumns(columns) if columns else df
    weighted = _mean(dimensions, lambda name: F.col(f"_d_{name}"))
    scores = (F.create_map(*[c for n in names for c in (F.lit(n), F.col(f"_d_{n}"))]) if names
              else no_scores())
    return (scored.withColumn("_weighted", weighted)
            .withColumns({"scores": scores, "weighted_score": F.round("_weighted", 4),
                          "passed": (F.col("_weighted") >= threshold) if names else F.lit(False)})
            .drop("_weighted", *columns))


def score_rows(judged: DataFrame, key: list[str]) -> DataFrame:
    """One row per key and dimension with its score and band."""
    return (judged.select(*key, F.explode("scores").alias("dimension", "score"))
            .withColumn("band", band(F.col("score"))))


def summary_text(judged: DataFrame) -> DataFrame:
    """Adds ``summary``: the overall score, then each dimension with score and band."""
    entries = F.transform(F.map_entries("scores"), lambda e: F.concat(
        F.lit("  "), e["key"], F.lit(": "), two_places(e["value"]), F.lit(" - "), band(e["value"])))
    head = F.concat(F.lit("overall: "), two_places(F.col("weighted_score")))
    return judged.withColumn("summary", F.concat_ws("\n", head, F.array_join(entries, "\n")))


def bar_report(judged: DataFrame) -> DataFrame:
    """Adds ``report``: one bar per dimension."""
    entries = F.transform(F.map_entries("scores"), lambda e: F.concat(
        F.rpad(e["key"], 15, " "), F.lit(" ["), bar(e["value"]), F.lit("] "), two_places(e["value"])))
    return judged.withColumn("report", F.array_join(entries, "\n"))


def corpus_report(judged: DataFrame, by: list[str]) -> DataFrame:
    """Mean, range and band counts of every dimension over many rows."""
    flat = score_rows(judged, by)
    counts = [F.count_if(F.col("band") == b).alias(f"n_{b}")
              for b in ("excellent", "good", "fair", "poor", "failing")]
    return flat.groupBy(*by, "dimension").agg(
        F.count("*").alias("n"), F.avg("score").alias("mean_score"),
        F.min("score").alias("min_score"), F.max("score").alias("max_score"), *counts)


def validation_report(judged: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """Share of rows at or above the threshold per dimension, with subtotals per group and overall."""
    flat = score_rows(judged, by)
    return flat.rollup(*by, "dimension").agg(
        F.count("*").alias("n"), F.count_if(F.col("score") >= threshold).alias("n_passed"),
        F.avg("score").alias("mean_score"))
