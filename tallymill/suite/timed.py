"""Registered queries of joins on time and of stored distinct counts, and their SQL twins."""

from pyspark.sql import functions as F

from tallymill.operators import distinct
from tallymill.plans import timejoins
from tallymill.session import fresh_path, load
from tallymill.suite.state import MICROS

# Every error puts a new prompt version of its user's node into force, some of them at the same time as another.
VERSION = "event_type = 'error'"


def attempt_versions(spark, d):
    """Each attempt with the prompt version in force at its time. A third of all attempts are on one node."""
    events = load(spark, d, "events").select(
        F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col("user_id")).cast("bigint").alias("node_id"), "event_id", "event_type",
        F.date_trunc("hour", "ts").alias("at"))
    versions = events.filter(VERSION).select("node_id", F.col("at").alias("since"), F.col("event_id").alias("version_no"))
    found = timejoins.asof_join(events.filter(f"NOT ({VERSION})").select("node_id", "event_id", "at"), versions, ["node_id"], "at", "since", ["version_no"])
    return found.select("event_id", "node_id", F.col("in_force.version_no").alias("version_no"))


def halted_items(spark, d):
    """Items that start while their mission is halted: a purchase above 150 halts its mission for the hours of its
    value, and one halt of every mission takes a third of the month."""
    events = load(spark, d, "events").select("event_id", F.col("user_id").alias("mission_id"), "event_type", "value", F.expr(MICROS).alias("at"))
    short = events.filter("event_type = 'purchase' AND value > 150").select(
        F.col("event_id").alias("halt_id"), "mission_id", F.col("at").alias("halted_at"), (F.col("at") + F.floor(F.col("value")) * 60_000_000).alias("resumed_at"))
    long = events.groupBy("mission_id").agg(F.min("event_id").alias("halt_id"), F.min("at").alias("halted_at")).select(
        (-F.col("halt_id")).alias("halt_id"), "mission_id", "halted_at", (F.col("halted_at") + F.lit(10 * 86_400_000_000)).alias("resumed_at"))
    items = events.select("event_id", "mission_id", "at")
    pairs = timejoins.interval_join(items, short.unionByName(long), ["mission_id"], "at", "halted_at", "resumed_at", 3_600_000_000)
    return pairs.select("event_id", "mission_id", "halt_id")


def daily_distinct_events(spark, d):
    """Sketches stored per day and type, merged to days and to all, at once and by days; each
    estimate is within its error of the exact count."""
    events = load(spark, d, "events").select(F.col("ts").cast("date").alias("day"), "event_type", F.col("event_id").alias("value"))
    path = fresh_path(spark, "sketches")
    distinct.sketches(events, ["day", "event_type"], "value").write.parquet(path)
    stored = spark.read.parquet(path)
    days = distinct.merged(stored, ["day"])
    def sound(estimate):
        return F.abs(F.col(estimate) - F.col("n_exact")) <= F.greatest(F.lit(1.0), F.lit(distinct.error_bound()) * F.col("n_exact"))

    exact = events.groupBy(F.col("day").cast("string").alias("day")).agg(F.count_distinct("value").alias("n_exact"))
    per_day = distinct.counted(days).withColumn("day", F.col("day").cast("string")).join(exact, "day").select("day", "n_exact", sound("n_distinct").alias("sound"))
    everything = F.lit("all").alias("day")
    at_once, by_days = (distinct.counted(distinct.merged(s, [])) for s in (stored, days))
    whole = (at_once.select(everything, "n_distinct").join(by_days.select(everything, F.col("n_distinct").alias("again")), "day")
             .join(events.agg(F.count_distinct("value").alias("n_exact")).select(everything, "n_exact"), "day"))
    return per_day.unionByName(whole.select("day", "n_exact", (sound("n_distinct") & sound("again")).alias("sound")))


QUERIES = {"attempt_versions": attempt_versions, "halted_items": halted_items, "daily_distinct_events": daily_distinct_events}

ORACLES = {
    "attempt_versions": f"""WITH e AS (SELECT CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS node_id, event_id, event_type, date_trunc('hour', ts) AS "at" FROM events),
 v AS (SELECT node_id, "at" AS since, max(event_id) AS version_no FROM e WHERE {VERSION} GROUP BY 1, 2)
SELECT e.event_id, e.node_id, v.version_no FROM (SELECT * FROM e WHERE NOT ({VERSION})) e ASOF LEFT JOIN v ON e.node_id = v.node_id AND e."at" >= v.since""",
    "halted_items": """WITH e AS (SELECT event_id, user_id AS mission_id, event_type, value, epoch_us(ts) AS "at" FROM events),
 h AS (SELECT event_id AS halt_id, mission_id, "at" AS a, "at" + CAST(floor(value) AS BIGINT) * 60000000 AS b FROM e WHERE event_type = 'purchase' AND value > 150
  UNION ALL SELECT -min(event_id), mission_id, min("at"), min("at") + 864000000000 FROM e GROUP BY mission_id)
SELECT e.event_id, e.mission_id, h.halt_id FROM e JOIN h ON e.mission_id = h.mission_id AND e."at" >= h.a AND e."at" < h.b""",
    "daily_distinct_events": """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(DISTINCT event_id) AS n_exact, TRUE AS sound FROM events GROUP BY 1
 UNION ALL SELECT 'all', count(DISTINCT event_id), TRUE FROM events""",
}
