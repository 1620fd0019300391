"""Realistic operator inputs derived from the star-schema and text tables, in Spark and in SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.plans.ordered import OrderedRows
from tallymill.plans.skew import lookup_join
from tallymill.session import load, spread


def documents(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Documents, fit for heavy work per text: id, the named columns and the text."""
    return spread(load(spark, d, "documents").select("doc_id", *columns, "text"), "doc_id")


def pages(spark: SparkSession, d: str) -> DataFrame:
    return spread(load(spark, d, "pages").select("page_id", "html"), "page_id")


def calls(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select(
        F.col("event_id").alias("call_id"), "ts", F.col("user_id").alias("mission_id"),
        F.expr("""CASE event_type WHEN 'click' THEN 'gpt-4o-mini' WHEN 'view' THEN 'claude-3-haiku'
                  WHEN 'purchase' THEN 'gpt-4o' WHEN 'signup' THEN 'claude-3-5-sonnet'
                  ELSE 'unlisted-model' END""").alias("model"),
        F.when(F.col("event_id") % 3 == 0, "critic").otherwise("actor").alias("role"),
        F.floor(F.col("value") * 10).cast("bigint").alias("prompt_tokens"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("bigint").alias("completion_tokens"))


def attempts(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "events").select(
        F.col("user_id").alias("mission_id"),
        F.concat(F.col("user_id").cast("string"), F.lit(":"),
                 F.col("ts").cast("date").cast("string")).alias("item_id"),
        F.col("event_id").alias("ord"), "ts",
        (F.col("value") / (F.col("value") + F.lit(20.0))).alias("score"),
        (F.col("value") >= 30.0).alias("passed"),
        F.when(F.col("value") < 30.0, F.concat("event_type", F.lit(" below target"))).alias("critique"),
        F.col("props").alias("output"))
    return OrderedRows(rows, ["item_id"], ["ts", "ord"]).number("attempt").df


def traces(spark: SparkSession, d: str) -> DataFrame:
    return attempts(spark, d).groupBy("mission_id", "item_id").agg(
        F.min("ord").alias("ord"), F.count("*").alias("iterations"),
        F.max(F.when(F.col("passed"), 1).otherwise(0)).alias("success"),
        F.max_by("score", "attempt").alias("last_score"))


def io_pairs(spark: SparkSession, d: str) -> DataFrame:
    turns = OrderedRows(load(spark, d, "conversations"), ["conv_id"], ["turn"])
    paired = turns.previous(prev_turn=F.col("turn"), prev_role=F.col("role"), prev_text=F.col("text")).df
    return (paired.filter((F.col("role") == "assistant") & (F.col("prev_role") == "user"))
            .select("conv_id", F.col("prev_turn").alias("turn"), F.col("prev_text").alias("input"),
                    F.col("text").alias("output")))


def scores(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "labels").select(
        "doc_id", F.col("quality").cast("double").alias("quality"),
        (F.lit(1.0) - F.col("toxic")).alias("safety"))


def votes(spark: SparkSession, d: str) -> DataFrame:
    judged = load(spark, d, "events").select(
        F.col("event_id").alias("item"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("judge"))
    product = F.col("item") * F.col("judge")
    return judged.select("item", "judge", (product % 4 != 0).alias("passed"),
                         ((product % 11).cast("double") / 10.0).alias("score"))


def drift_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every vector with its label's first vector as the golden one (none for the golden itself)."""
    vectors = load(spark, d, "embeddings")
    golden = vectors.groupBy("label").agg(F.min_by(F.struct("vec_id", "embedding"), "vec_id").alias("g")).select(
        "label", F.col("g.vec_id").alias("golden_id"), F.col("g.embedding").alias("golden_vec"))
    return (lookup_join(vectors, golden, ["label"], "inner").filter("vec_id <> golden_id")
            .select("vec_id", "label", "golden_id", F.col("embedding").alias("current_vec"), "golden_vec"))


def versions(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "nation").select(
        F.col("n_regionkey").alias("node_id"), F.col("n_nationkey").alias("version_no"),
        F.col("n_name").alias("template"))
    return (OrderedRows(rows, ["node_id"], ["version_no"])
            .previous(parent_no=F.col("version_no")).number("seq").df)


CALLS = """calls AS (SELECT event_id AS call_id, ts, user_id AS mission_id,
  CASE event_type WHEN 'click' THEN 'gpt-4o-mini' WHEN 'view' THEN 'claude-3-haiku'
       WHEN 'purchase' THEN 'gpt-4o' WHEN 'signup' THEN 'claude-3-5-sonnet' ELSE 'unlisted-model' END AS model,
  CASE WHEN event_id % 3 = 0 THEN 'critic' ELSE 'actor' END AS role,
  CAST(floor(value * 10) AS BIGINT) AS prompt_tokens,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS completion_tokens FROM events)"""

ATTEMPTS = """attempts AS (SELECT user_id AS mission_id,
  concat(CAST(user_id AS VARCHAR), ':', CAST(CAST(ts AS DATE) AS VARCHAR)) AS item_id,
  row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS attempt,
  event_id AS ord, ts, value / (value + 20.0) AS score, value >= 30.0 AS passed,
  CASE WHEN value >= 30.0 THEN NULL ELSE concat(event_type, ' below target') END AS critique,
  props AS output FROM events)"""

TRACES = ATTEMPTS + """, traces AS (SELECT mission_id, item_id, min(ord) AS ord, count(*) AS iterations,
  max(CASE WHEN passed THEN 1 ELSE 0 END) AS success, arg_max(score, attempt) AS last_score
  FROM attempts GROUP BY mission_id, item_id)"""

IO_PAIRS = """io_pairs AS (SELECT conv_id, turn, text AS input, reply AS output FROM (
  SELECT conv_id, turn, role, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS reply,
    lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations) t
  WHERE role = 'user' AND next_role = 'assistant')"""

SCORES = """scores AS (SELECT doc_id, CAST(quality AS DOUBLE) AS quality,
  CAST(1.0 - toxic AS DOUBLE) AS safety FROM labels)"""

VOTES = """votes AS (SELECT e.event_id AS item, j.judge, (e.event_id * j.judge) % 4 <> 0 AS passed,
  CAST((e.event_id * j.judge) % 11 AS DOUBLE) / 10.0 AS score
  FROM events e, (VALUES (1), (2), (3)) j(judge))"""

DRIFT_PAIRS = """drift_pairs AS (SELECT e.vec_id, e.label, g.vec_id AS golden_id,
  CAST(e.embedding AS DOUBLE[]) AS current_vec, CAST(g.embedding AS DOUBLE[]) AS golden_vec
  FROM embeddings e JOIN (SELECT label, min(vec_id) AS vec_id FROM embeddings GROUP BY label) m ON e.label = m.label
  JOIN embeddings g ON g.vec_id = m.vec_id WHERE e.vec_id <> g.vec_id)"""

VERSIONS = """versions AS (SELECT n_regionkey AS node_id, n_nationkey AS version_no, n_name AS template,
  lag(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS parent_no,
  row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS seq FROM nation)"""
