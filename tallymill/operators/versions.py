"""Prompt version log, lineage, per-version results and critique-driven changes.

A version log has node_id, seq, version_id, hash, template, parent_id, change_log,
stats map<string,double>. It only grows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.functions.text import short_hash, strip
from tallymill.plans.ordered import OrderedRows, first_rows
from tallymill.plans.pointers import reachable
from tallymill.plans.skew import lookup_join

LOG = ["node_id", "seq", "version_id", "hash", "template", "parent_id", "change_log", "stats"]


def _version_id(seq: Column) -> Column:
    return F.concat(F.lit("v1."), (seq - 1).cast("string"))


def append_versions(log: DataFrame | None, changes: DataFrame, order: str, **ordered) -> DataFrame:
    """The new log rows for ``changes`` (node_id, ``order``, template, change_log, stats): each
    continues its node's numbering and descends from the version before it."""
    numbered = OrderedRows(changes, ["node_id"], [order], **ordered).number("_n").df
    if log is not None:
        tails = log.groupBy("node_id").agg(F.max("seq").alias("_tail"))
        numbered = lookup_join(numbered, tails, ["node_id"], "left")
    else:
        numbered = numbered.withColumn("_tail", F.lit(0))
    seq = F.coalesce("_tail", F.lit(0)) + F.col("_n")
    return (numbered.withColumn("seq", seq.cast("bigint"))
            .withColumns({"version_id": _version_id(F.col("seq")), "hash": short_hash(F.col("template")),
                          "parent_id": F.when(F.col("seq") > 1, _version_id(F.col("seq") - 1))})
            .select(*LOG))


def current_versions(log: DataFrame) -> DataFrame:
    rest = [c for c in LOG if c != "node_id"]
    return (log.groupBy("node_id").agg(F.max_by(F.struct(*rest), "seq").alias("v")).select("node_id", "v.*"))


def version_history(log: DataFrame) -> DataFrame:
    """Every version in time order: its place (``seq``), what it changed, whether its text differs from the one
    before, and whether it is the current one. The place carries the order; sort by it where rows leave Spark."""
    before = log.select("node_id", (F.col("seq") + 1).alias("seq"), F.col("hash").alias("_before"))
    newest = current_versions(log).select("node_id", F.col("seq").alias("_newest"))
    return (log.join(before, ["node_id", "seq"], "left").join(newest, "node_id")
            .select("node_id", "seq", "version_id", "change_log", (~F.col("hash").eqNullSafe(F.col("_before"))).alias("changed"),
                    (F.col("seq") == F.col("_newest")).alias("is_current")))


def lineage(log: DataFrame) -> DataFrame:
    """The chain from the root to each node's current version, numbered from the root."""
    chain = reachable(log.select("node_id", "version_id", "parent_id"), current_versions(log), ["node_id"],
                      "version_id", "parent_id")
    rows = log.join(chain, ["node_id", "version_id"]).select("node_id", "seq", "version_id", "parent_id", "hash")
    return OrderedRows(rows, ["node_id"], ["seq"]).number("depth").df


def merge_stats(log: DataFrame, updates: DataFrame) -> DataFrame:
    """Log with ``updates`` (node_id, version_id, stats) merged in; new values replace old ones."""
    new = updates.select("node_id", "version_id", F.col("stats").alias("_new"))
    kept = F.map_filter("stats", lambda k, v: ~F.map_contains_key(F.col("_new"), k))
    merged = F.when(F.col("_new").isNull(), F.col("stats")).otherwise(F.map_concat(kept, F.col("_new")))
    return log.join(new, ["node_id", "version_id"], "left").withColumn("stats", merged).select(*LOG)


def version_results(results: DataFrame) -> DataFrame:
    """Pass rate and volume per version from results (node_id, version_id, success), as stats."""
    return (results.groupBy("node_id", "version_id")
            .agg(F.avg(F.col("success").cast("double")).alias("rate"), F.count("*").alias("n"))
            .select("node_id", "version_id", F.create_map(
                F.lit("pass_rate"), F.col("rate"), F.lit("total_processed"), F.col("n").cast("double")).alias("stats")))


PREVIEW = 80


def tree_nodes(log: DataFrame) -> DataFrame:
    return log.select("node_id", "version_id", F.substring("template", 1, PREVIEW).alias("template_preview"),
                      "change_log", "stats")


def tree_edges(log: DataFrame) -> DataFrame:
    return log.filter(F.col("parent_id").isNotNull()).select(
        "node_id", F.col("parent_id").alias("from_version"), F.col("version_id").alias("to_version"))


def compare_versions(log: DataFrame) -> DataFrame:
    """First and last version of every node with at least two, and their pass rates."""
    rate = F.try_element_at("stats", F.lit("pass_rate"))
    row = F.struct("version_id", rate.alias("pass_rate"))
    return (log.groupBy("node_id")
            .agg(F.count("*").alias("n"), F.min_by(row, "seq").alias("a"), F.max_by(row, "seq").alias("b"))
            .filter(F.col("n") >= 2)
            .select("node_id", F.col("a.version_id").alias("first_version"), F.col("a.pass_rate").alias("first_rate"),
                    F.col("b.version_id").alias("last_version"), F.col("b.pass_rate").alias("last_rate")))


PATTERN_LENGTH = 5


def critique_patterns(critiques: DataFrame, by: list[str], order: str, critique: str = "critique",
                      minimum: int = 3) -> DataFrame:
    """The most frequent critique opening of every key, first seen on ties, where it reaches the minimum."""
    opening = strip(F.substring(strip(F.col(critique)), 1, PATTERN_LENGTH))
    counted = (critiques.withColumn("pattern", opening).filter(F.col("pattern") != "")
               .groupBy(*by, "pattern").agg(F.count("*").alias("frequency"), F.min(order).alias("first_seen")))
    top = counted.groupBy(*by).agg(F.max_by(
        F.struct("pattern", "frequency"), F.struct("frequency", -F.col("first_seen"))).alias("t"))
    return (top.select(*by, "t.pattern", "t.frequency").filter(F.col("frequency") >= minimum)
            .withColumn("confidence", F.least(F.lit(1.0), F.col("frequency") / 10.0)))


RECENT_CRITIQUES = 20


def improvement_requests(log: DataFrame, critiques: DataFrame, suggestions: DataFrame, order: str,
                         critique: str = "critique") -> DataFrame:
    """For every node with a suggestion: its current template and latest critiques, oldest first, as
    one request text for a model."""
    said = critiques.filter(strip(F.col(critique)) != "")
    recent = (first_rows(said, ["node_id"], [F.desc(order)], RECENT_CRITIQUES)
              .groupBy("node_id").agg(F.sort_array(F.collect_list(F.struct(order, strip(F.col(critique)).alias("c")))).alias("r")))
    body = F.concat(F.lit("Current prompt:\n"), F.col("template"),
                    F.lit("\n\nRecurring critique ("), F.col("frequency").cast("string"), F.lit(" times): "), F.col("pattern"),
                    F.lit("\nLatest critiques:\n"),
                    F.array_join(F.transform("r", lambda x: F.concat(F.lit("- "), x["c"])), "\n"),
                    F.lit("\n\nWrite an improved prompt. Keep the {{ data }} variable. Reply with the prompt only."))
    return (suggestions.join(current_versions(log).select("node_id", "template"), "node_id")
            .join(recent, "node_id").select("node_id", body.alias("request")))


def apply_suggestions(log: DataFrame, accepted: DataFrame) -> DataFrame:
    """New log rows for accepted suggestions (node_id, template, pattern, frequency, confidence)."""
    changes = accepted.select(
        "node_id", F.lit(0).alias("ord"), "template", F.concat(F.lit("healing: "), F.col("pattern")).alias("change_log"),
        F.create_map(F.lit("frequency"), F.col("frequency").cast("double"), F.lit("confidence"), F.col("confidence")).alias("stats"))
    return append_versions(log, changes, "ord")


def open_critiques(critiques: DataFrame, applied: DataFrame, by: list[str], order: str) -> DataFrame:
    """Critiques made after the latest applied change of their key (``applied``: by..., applied_at)."""
    latest = applied.groupBy(*by).agg(F.max("applied_at").alias("_at"))
    return (lookup_join(critiques, latest, by, "left")
            .filter(F.col("_at").isNull() | (F.col(order) > F.col("_at"))).drop("_at"))
