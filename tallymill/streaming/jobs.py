"""Streams over event files: windows, running totals, deduplication and upserts in Spark's own state.

Steps that remember more than an aggregate are in ``stateful``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.operators.state import KeyedTable


def read_folder(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def drain(stream: DataFrame, path: str, mode: str = "append") -> None:
    """Process what is available now into Parquet files below ``path``; call again for more."""
    (stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint")
     .outputMode(mode).trigger(availableNow=True).start().awaitTermination())


def drain_batches(stream: DataFrame, path: str, handle: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    (stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{path}/checkpoint")
     .outputMode(mode).trigger(availableNow=True).start().awaitTermination())


def output(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", f"{path}/out").parquet(f"{path}/out")


def drop_repeats(stream: DataFrame, key: list[str], ts: str, ttl: str) -> DataFrame:
    """Spark's own deduplication: a repeat within ``ttl`` of the first is dropped for sure; one that
    comes later may be dropped too while the watermark has not passed the first."""
    return stream.withWatermark(ts, ttl).dropDuplicatesWithinWatermark(key)


def window_counts(stream: DataFrame, by: list[str], length: str, delay: str, ts: str = "ts", slide: str | None = None) -> DataFrame:
    """Counts per closed window; events later than ``delay`` are dropped. Needs a timestamp with time zone."""
    span = F.window(ts, length, slide) if slide else F.window(ts, length)
    return (stream.withWatermark(ts, delay).groupBy(span, *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
            .select(*by, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "total"))


def session_counts(stream: DataFrame, by: list[str], gap: str, delay: str, ts: str = "ts") -> DataFrame:
    return (stream.withWatermark(ts, delay).groupBy(F.session_window(ts, gap), *by).agg(F.count("*").alias("n"))
            .select(*by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n"))


def progress(priced: DataFrame, by: list[str], budget: Column, path: str) -> None:
    """Running calls, cost and fuse flag per key: after every batch, the keys that changed."""
    totals = priced.groupBy(*by).agg(F.count("*").alias("calls"), F.sum("cost").alias("total_cost"))
    state = totals.withColumn("fused", F.col("total_cost") >= budget)
    drain_batches(state, path, lambda batch, batch_id: batch.write.mode("overwrite").parquet(
        f"{path}/out/batch={batch_id}"), mode="update")


def upserts(stream: DataFrame, path: str, key: list[str], order: list[str], parts: int = 64) -> None:
    """Keep the latest row of every key in a table below ``path``; read it with ``upserted``. Every batch is one
    upsert, which rewrites the parts it touches and may be repeated; the stream itself keeps no state."""
    drain_batches(stream, path, lambda batch, _: KeyedTable(batch.sparkSession, f"{path}/table", key, order, parts).upsert(batch))


def upserted(spark: SparkSession, path: str, key: list[str], order: list[str], parts: int = 64) -> DataFrame:
    return KeyedTable(spark, f"{path}/table", key, order, parts).read()
