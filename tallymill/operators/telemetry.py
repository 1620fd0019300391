"""Event levels, subscriptions, phase changes and counts over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.plans.ordered import OrderedRows

# Event types of level 1 and level 3; all others have level 2.
SUMMARY_TYPES = ("STATUS_UPDATE", "ERROR", "APPROVAL_REQUIRED")
DETAIL_TYPES = ("TRACE_EVENT",)
PREVIEW = 200
TERMINAL = ("completed", "failed")


def event_level(event_type: Column, level: Column | None = None) -> Column:
    """An explicit level, else the one the event type implies."""
    inferred = F.when(event_type.isin(*SUMMARY_TYPES), 1).when(event_type.isin(*DETAIL_TYPES), 3).otherwise(2)
    return inferred if level is None else F.coalesce(level, inferred)


def emitted(events: DataFrame, current_level: int, preview: str | None = None) -> DataFrame:
    """Events at or below the current level (kept within 1..3), their preview texts shortened."""
    kept = events.filter(F.col("level") <= max(1, min(3, current_level)))
    return kept if preview is None else kept.withColumn(preview, F.substring(preview, 1, PREVIEW))


def _channels(subscriptions: DataFrame) -> DataFrame:
    """The channels and levels each subscriber covers: of everybody without a mission of their own, else the
    general one and their mission's, up to their level (kept within 1..3)."""
    mission = F.concat(F.lit("mission "), F.col("mission_id").cast("string"))
    allowed = F.least(F.greatest(F.coalesce("level", F.lit(2)), F.lit(1)), F.lit(3))
    return (subscriptions
            .select("subscriber", F.explode(F.when(F.col("mission_id").isNull(), F.array(F.lit("everybody")))
                                            .otherwise(F.array(F.lit("general"), mission))).alias("channel"), allowed.alias("level"))
            .withColumn("level", F.explode(F.sequence(F.lit(1), F.col("level")))))


def _sent(events: DataFrame, *columns: str) -> DataFrame:
    """Events by channel: everybody's, and their mission's or the general one."""
    mission = F.concat(F.lit("mission "), F.col("mission_id").cast("string"))
    return events.select(*columns, F.explode(F.array(F.lit("everybody"), F.coalesce(mission, F.lit("general")))).alias("channel"),
                         F.col("level").cast("int").alias("level"))


def deliveries(events: DataFrame, subscriptions: DataFrame, event: str, subscriber) -> DataFrame:
    """The events one subscriber receives: (event, subscriber). Their few channels are looked up for each
    event; the list is at most as long as the events."""
    covered = _channels(subscriptions.filter(F.col("subscriber") == subscriber)).distinct()
    return _sent(events, event).join(covered, ["channel", "level"]).select(event, "subscriber").distinct()


def delivery_counts(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """How many events each subscriber receives: (subscriber, n), linear in events and subscriptions. Events are
    counted per channel and level first, so no pair is ever made."""
    counts = _sent(events).groupBy("channel", "level").agg(F.count("*").alias("n"))
    return (_channels(subscriptions).join(counts, ["channel", "level"], "left")
            .groupBy("subscriber").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")))


def phase_changes(updates: DataFrame, by: list[str], order: list[str], phase: str = "phase", status: str = "status",
                  **ordered) -> DataFrame:
    """Updates whose phase differs from the one before, up to the first completed or failed one."""
    over = F.col(status).isin(*TERMINAL)
    rows = (OrderedRows(updates, by, order, **ordered).previous(_before=F.col(phase))
            .scan(exclusive=True, _over=("max", over.cast("int"))).df)
    live = F.coalesce("_over", F.lit(0)) == 0
    return rows.filter(live & ~F.col(phase).eqNullSafe(F.col("_before"))).drop("_before", "_over")


def tumbling_counts(events: DataFrame, by: list[str], length: str, ts: str = "ts") -> DataFrame:
    return _window_counts(events, by, F.window(ts, length))


def sliding_counts(events: DataFrame, by: list[str], length: str, slide: str, ts: str = "ts") -> DataFrame:
    return _window_counts(events, by, F.window(ts, length, slide))


def session_counts(events: DataFrame, by: list[str], gap: str, ts: str = "ts", **ordered) -> DataFrame:
    """Counts per burst of events without a pause longer than ``gap``; a burst ends ``gap`` after its last
    event. Bursts are numbered by a running sum, which also spreads a key with very many events."""
    pause = F.expr(f"INTERVAL {gap}")
    rows = OrderedRows(events, by, [ts], **ordered).previous(_before=F.col(ts))
    fresh = F.col("_before").isNull() | (F.col(ts) > F.col("_before") + pause)
    numbered = rows.scan(_burst=("sum", fresh.cast("bigint"))).df
    return (numbered.groupBy(*by, "_burst")
            .agg(F.min(ts).alias("start"), (F.max(ts) + pause).alias("end"), F.count("*").alias("n"), F.sum("value").alias("total"))
            .drop("_burst"))


def _window_counts(events: DataFrame, by: list[str], span: Column) -> DataFrame:
    return (events.groupBy(span, *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
            .select(*by, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "total"))
