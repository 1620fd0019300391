"""Validation rules, score gates, critic reports and consensus votes."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.functions.basic import no_scores, zero
from tallymill.functions import jsons
from tallymill.functions.scoring import clamp, weighted_score

PROGRAMMATIC = ("regex", "json", "expression")


@dataclass(frozen=True)
class Rule:
    """kind: regex (a Java pattern), json (list of required names or None), expression (a Spark SQL
    boolean over the row's columns), or anything else for a rule a model has to judge."""

    kind: str
    criteria: object = None
    weight: float = 1.0
    name: str | None = field(default=None)

    @property
    def key(self) -> str:
        if self.name is not None:
            return self.name
        return f"regex:{str(self.criteria)[:30]}" if self.kind == "regex" else self.kind


def split_rules(rules: list[Rule]) -> tuple[list[Rule], list[Rule]]:
    """(rules checked here, rules left to a judging model)."""
    return ([r for r in rules if r.kind in PROGRAMMATIC], [r for r in rules if r.kind not in PROGRAMMATIC])


def valid_pattern(spark: SparkSession, pattern: str) -> bool:
    """Whether the executors' regex engine accepts the pattern, of any length; asked once, on the driver."""
    try:
        spark.sql("SELECT '' RLIKE :p", args={"p": pattern}).first()
    except PySparkException:
        return False
    return True


def rule_passed(spark: SparkSession, rule: Rule, output: str) -> Column:
    if rule.kind == "regex":
        pattern = str(rule.criteria)
        if not valid_pattern(spark, pattern):
            return F.lit(False)
        return F.coalesce(F.rlike(F.col(output), F.lit(pattern)), F.lit(False))
    if rule.kind == "json":
        return jsons.is_json(F.col(output)) if rule.criteria is None else jsons.has_names(
            F.col(output), list(rule.criteria))
    if rule.kind == "expression":
        return F.coalesce(F.expr(str(rule.criteria)).cast("boolean"), F.lit(False))
    raise ValueError(f"rule needs a model: {rule.kind}")


def apply_rules(df: DataFrame, rules: list[Rule], output: str = "output") -> DataFrame:
    """Adds ``rules_passed`` and ``rule_scores`` (0 or 1 per key). Rules that share a key all count
    for the outcome, the last one shows in the scores. No rules: passed, nothing scored. A rule whose
    pattern is no regular expression fails every row and is named in ``rule_errors``."""
    spark = df.sparkSession
    broken = [r.key for r in rules if r.kind == "regex" and not valid_pattern(spark, str(r.criteria))]
    df = df.withColumn("rule_errors", F.array(*map(F.lit, broken)).cast("array<string>"))
    json_rules = [i for i, rule in enumerate(rules) if rule.kind == "json"]
    if json_rules:
        lists = [None if rules[i].criteria is None else list(rules[i].criteria) for i in json_rules]
        df = df.withColumn("_json", jsons.rule_checks(F.col(output), lists))
    checks = {f"_r{i}": F.col("_json")[json_rules.index(i)] if i in json_rules else rule_passed(spark, rule, output)
              for i, rule in enumerate(rules)}
    if not checks:
        return df.withColumns({"rules_passed": F.lit(True),
                               "rule_scores": no_scores()})
    keyed = {rule.key: F.col(c).cast("double") for rule, c in zip(rules, checks)}
    passed = F.lit(True)
    for c in checks:
        passed = passed & F.col(c)
    return (df.withColumns(checks)
            .withColumn("rules_passed", passed)
            .withColumn("rule_scores", F.create_map(*[c for k, v in keyed.items() for c in (F.lit(k), v)]))
            .drop("_json", *checks))


def rule_weights(rules: list[Rule]) -> dict[str, float]:
    return {rule.key: rule.weight for rule in rules}


def rule_report(checked: DataFrame, by: list[str]) -> DataFrame:
    """Checked rows and pass rate per rule, with subtotals per group and overall."""
    flat = checked.select(*by, F.explode("rule_scores").alias("rule", "score"))
    return flat.rollup(*by, "rule").agg(F.count("*").alias("n"), F.avg("score").alias("pass_rate"))


def min_score_gate(df: DataFrame, scores: Column, minimum: float, weights: Mapping[str, float] | None = None,
                   passed: str = "passed") -> DataFrame:
    """A weighted score below the minimum fails the row; nothing turns a failed row into a passed one.
    Rows without scores are left alone."""
    weighted = weighted_score(scores, weights)
    return (df.withColumn("weighted", F.when(F.size(scores) > 0, weighted))
            .withColumn(passed, F.col(passed) & ~F.coalesce(F.col("weighted") < minimum, F.lit(False))))


BAD_REPORT = "unreadable_report"


def parse_reports(df: DataFrame, report: str = "report", prompt_tokens: str = "prompt_tokens",
                  completion_tokens: str = "completion_tokens") -> DataFrame:
    """A judging model's JSON report as columns passed, score, scores, critique, suggestions.

    Scores are kept within [0, 1]. A report that is no JSON object, or whose scores are no numbers,
    becomes a failed row with a fixed critique. ``audit_cost`` (tokens) is booked either way.
    """
    # Read once by the strict parser, which takes the last of a repeated key, then by Spark's.
    parsed = (df.withColumn("_json", jsons.canonical_object(F.col(report)))
              .withColumns({"_ok": F.col("_json").isNotNull(), "_v": F.try_parse_json("_json")}))

    def read(path: str, kind: str) -> Column:
        return F.try_variant_get("_v", path, kind)

    given = read("$.score", "variant")
    number = F.when(given.isNull(), zero()).otherwise(read("$.score", "double"))
    is_map = read("$.scores", "map<string,variant>").isNotNull()
    numbers = read("$.scores", "map<string,double>")
    numeric = ~F.exists(F.map_values(numbers), lambda v: v.isNull())
    marks = F.when(~is_map, no_scores()).when(numeric, numbers)
    readable = F.col("_ok") & F.col("_v").isNotNull() & F.col("_score").isNotNull() & F.col("_scores").isNotNull()
    no_text = F.array().cast("array<string>")
    return (parsed.withColumns({"_score": number, "_scores": marks}).withColumn("_ok", readable)
            .select(*df.columns,
                    F.when(F.col("_ok"), F.coalesce(read("$.passed", "boolean"), F.lit(False)))
                    .otherwise(F.lit(False)).alias("passed"),
                    F.when(F.col("_ok"), clamp(F.col("_score"))).otherwise(zero()).alias("score"),
                    F.when(F.col("_ok"), F.transform_values("_scores", lambda k, v: clamp(v)))
                    .otherwise(no_scores()).alias("scores"),
                    F.when(F.col("_ok"), F.nullif(read("$.critique", "string"), F.lit("")))
                    .otherwise(F.lit(BAD_REPORT)).alias("critique"),
                    F.when(F.col("_ok"), F.coalesce(read("$.suggestions", "array<string>"), no_text))
                    .otherwise(no_text).alias("suggestions"),
                    (F.col(prompt_tokens) + F.col(completion_tokens)).alias("audit_cost")))


def consensus(votes: DataFrame, by: list[str], threshold: float, primary: Column) -> DataFrame:
    """One verdict per key from several judges: passed where the share of passing judges reaches the
    threshold. Judges whose call failed (null ``passed``) do not vote. Scores merge by the highest
    per name; score and critique are the primary judge's."""
    cast = votes.filter(F.col("passed").isNotNull())
    ballots = cast.groupBy(*by).agg(
        F.count_if(F.col("passed")).alias("yes"), F.count("*").alias("n_votes"),
        F.max(F.when(primary, F.struct("score", "critique"))).alias("main"))
    merged = (cast.select(*by, F.explode("scores").alias("name", "value"))
              .groupBy(*by, "name").agg(F.max("value").alias("value"))
              .groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "value"))))
                                .alias("scores")))
    passed = F.col("yes") / F.col("n_votes") >= threshold
    return (ballots.join(merged, by, "left")
            .select(*by, passed.alias("passed"), "yes", "n_votes", F.col("main.score").alias("score"), "scores",
                    F.when(passed, F.col("main.critique")).otherwise(F.concat(
                        F.lit("consensus_not_reached:"), F.col("yes").cast("string"), F.lit("/"),
                        F.col("n_votes").cast("string"))).alias("critique")))
