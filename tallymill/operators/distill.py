"""Golden samples, run statistics, skill packages and training-record exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.functions.basic import zero
from tallymill.functions.money import ratio
from tallymill.functions.text import short_hash
from tallymill.plans.ordered import first_rows
from tallymill.plans.skew import lookup_join

GOLDEN = 5
PREVIEW = 200


def golden_samples(traces: DataFrame, by: list[str], order: str, n: int = GOLDEN) -> DataFrame:
    """The best successes by final score, the earliest on ties; overall when ``by`` is empty."""
    good = traces.filter((F.col("success") == 1) & (F.col("iterations") > 0))
    ranking = [F.desc("last_score"), F.col(order)]
    return good.orderBy(*ranking).limit(n) if not by else first_rows(good, by, ranking, n)


def run_stats(traces: DataFrame, by: list[str]) -> DataFrame:
    counted = traces.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(F.col("success") == 1).alias("_good"),
        F.sum("iterations").alias("_iterations"))
    return counted.select(
        *by, "total", F.round(ratio(F.col("_good").cast("double"), F.col("total"), zero()), 4).alias("success_rate"),
        F.round(ratio(F.col("_iterations").cast("double"), F.col("total"), zero()), 2).alias("average_retries"))


def skill_id(prompt: Column, prefix: str = "SKILL-") -> Column:
    return F.concat(F.lit(prefix), short_hash(prompt, 12))


def skill_packages(traces: DataFrame, prompts: DataFrame, by: str, order: str, model_config: dict[str, str],
                   rules: list[tuple[str, str]]) -> DataFrame:
    """One package per key: ``prompts`` has the key, name and prompt; ``traces`` also has input and
    output. The samples of a package are its golden ones."""
    samples = (golden_samples(traces, [by], order)
               .withColumn("_rank", F.struct((-F.col("last_score")).alias("s"), F.col(order).alias("o")))
               .groupBy(by).agg(F.sort_array(F.collect_list(F.struct(
                   "_rank", F.substring("input", 1, PREVIEW).alias("input_preview"), "output",
                   F.round("last_score", 4).alias("score")))).alias("g"))
               .select(by, F.transform("g", lambda s: F.struct(
                   s["input_preview"].alias("input_preview"), s["output"].alias("output"), s["score"].alias("score")))
                   .alias("golden_samples")))
    stats = run_stats(traces, [by])
    config = F.create_map(*[c for k, v in model_config.items() for c in (F.lit(k), F.lit(v))])
    rule_list = F.array(*[F.struct(F.lit(kind).alias("type"), F.lit(criteria).alias("criteria")) for kind, criteria in rules])
    return (prompts.join(stats, by).join(samples, by, "left")
            .select(by, skill_id(F.col("prompt")).alias("skill_id"), "name",
                    F.col("prompt").alias("optimized_prompt"), config.alias("model_config"),
                    rule_list.alias("validation_rules"),
                    F.coalesce("golden_samples", F.array().cast(
                        "array<struct<input_preview:string,output:string,score:double>>")).alias("golden_samples"),
                    F.struct("total", "success_rate", "average_retries").alias("performance_stats")))


SKILL_SCHEMA = (
    "skill_id string, name string, created_at string, optimized_prompt string, model_config map<string,string>, "
    "validation_rules array<struct<type:string,criteria:string>>, "
    "golden_samples array<struct<input_preview:string,output:string,score:double>>, "
    "performance_stats struct<total:bigint,success_rate:double,average_retries:double>")


def write_skills(packages: DataFrame, path: str, created_at: str) -> None:
    packages.withColumn("created_at", F.lit(created_at)).write.mode("append").json(path)


def read_skills(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Skill packages from a folder of JSON files; ``multi_line`` for one indented object per file."""
    return spark.read.schema(SKILL_SCHEMA).json(path, multiLine=multi_line)


def list_skills(skills: DataFrame) -> DataFrame:
    return skills.select("skill_id", "name", "performance_stats.total", "performance_stats.success_rate",
                         F.size("golden_samples").alias("n_samples"))


def apply_skills(nodes: DataFrame, skills: DataFrame) -> DataFrame:
    """Nodes (node_id, skill_ref, template, rules) with the prompt and rules of their skill where it
    has any; ``skill_missing`` marks a reference that leads nowhere."""
    found = skills.select(F.col("skill_id").alias("skill_ref"), "optimized_prompt", "validation_rules", F.lit(True).alias("_hit"))
    joined = lookup_join(nodes, found, ["skill_ref"], "left")
    has_rules = F.coalesce(F.size("validation_rules"), F.lit(0)) > 0
    return joined.select(
        "node_id", "skill_ref", F.coalesce(F.nullif(F.col("optimized_prompt"), F.lit("")), F.col("template")).alias("template"),
        F.when(has_rules, F.col("validation_rules")).otherwise(F.col("rules")).alias("rules"),
        (F.col("skill_ref").isNotNull() & F.col("_hit").isNull()).alias("skill_missing"))


def _record(shape: str) -> Column:
    asked, given = F.col("input"), F.col("output")
    if shape == "messages":
        return F.struct(F.array(F.struct(F.lit("user").alias("role"), asked.alias("content")),
                                F.struct(F.lit("assistant").alias("role"), given.alias("content"))).alias("messages"))
    if shape == "instruction":
        return F.struct(asked.alias("instruction"), F.lit("").alias("input"), given.alias("output"))
    if shape == "conversation":
        return F.struct(F.array(F.struct(F.lit("human").alias("from"), asked.alias("value")),
                                F.struct(F.lit("gpt").alias("from"), given.alias("value"))).alias("conversations"))
    raise ValueError(f"unknown record shape: {shape}")


def training_records(traces: DataFrame, shape: str = "messages", minimum: float = 0.8) -> DataFrame:
    """Successful traces scored at least ``minimum`` as JSON records; adds ``record``."""
    return (traces.filter((F.col("success") == 1) & (F.col("last_score") >= minimum))
            .withColumn("record", F.to_json(_record(shape))))


def write_training_records(records: DataFrame, path: str) -> None:
    """Text files of one record per line; an error when there is nothing to write."""
    if records.isEmpty():
        raise ValueError("no trace passes the score minimum")
    records.select("record").write.mode("append").text(path)


def distil_worthy(traces: DataFrame, by: list[str], rate: float = 0.9, minimum: int = 5) -> DataFrame:
    """Traces of the keys whose success rate is above ``rate`` over at least ``minimum`` results."""
    worthy = (traces.groupBy(*by).agg(F.avg(F.col("success").cast("double")).alias("_rate"), F.count("*").alias("_n"))
              .filter((F.col("_rate") > rate) & (F.col("_n") >= minimum)).select(*by))
    return lookup_join(traces, worthy, by, "inner")
