"""Resumable run state: upserts, pending work, replays, and input-hash deduplication."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.functions.text import short_hash
from tallymill.plans.ordered import OrderedRows
from tallymill.plans.skew import lookup_join
from tallymill.session import checkpointed

COMPLETED, PENDING = "completed", "pending"


def latest(log: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last written row of every key. Map-side combining keeps one row per key and task, so a
    key with very many writes costs no more than any other."""
    rest = [c for c in log.columns if c not in key]
    return (log.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last"))
            .select(*key, "_last.*").select(*log.columns))


def _nothing_yet(error: AnalysisException) -> None:
    """Passes over a folder that is missing or empty; any other error, such as a wrong schema, is raised."""
    if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
        raise error


class Snapshots:
    """Whole-table snapshots below a folder, read by the version a pointer table names.

    The pointer is written after the data, so a job that dies half-way leaves the previous version
    in force, and writing the same version again replaces it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> DataFrame | None:
        try:
            return self.spark.read.schema("version bigint").parquet(f"{self.path}/pointer")
        except AnalysisException as error:
            return _nothing_yet(error)

    def newest(self, before: int | None = None) -> int | None:
        known = self.versions()
        if known is None:
            return None
        if before is not None:
            known = known.filter(F.col("version") < before)
        return known.agg(F.max("version")).first()[0]

    def read(self, before: int | None = None) -> DataFrame | None:
        version = self.newest(before)
        return None if version is None else self.spark.read.parquet(f"{self.path}/data/version={version}")

    def write(self, df: DataFrame, version: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/data/version={version}")
        self.spark.range(version, version + 1, 1, 1).toDF("version").write.mode("append").parquet(f"{self.path}/pointer")


class KeyedTable:
    """The latest row of every key as a Parquet table partitioned by a hash of the key.

    An upsert rewrites only the parts that hold a changed key (Spark's dynamic partition overwrite), so it costs
    what the change touches; files of other parts stay as they are. Applying a change again, or one that
    stopped half-way, gives the same table, as the latest row by ``order`` wins. ``parts`` belongs to the table:
    choose it once so that a part fits a task, and use the same number every time. One writer at a time.
    """

    PART = "part"

    def __init__(self, spark: SparkSession, path: str, key: list[str], order: list[str], parts: int = 64):
        self.spark, self.path, self.key, self.order, self.parts = spark, f"{path.rstrip('/')}/of={parts}", list(key), list(order), parts

    def _stored(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self.path)
        except AnalysisException as error:
            return _nothing_yet(error)

    def read(self) -> DataFrame | None:
        """The table, or None before the first upsert."""
        stored = self._stored()
        return None if stored is None else stored.drop(self.PART)

    def upsert(self, changes: DataFrame) -> None:
        """Apply changes: the latest row of every key stays, whether it is stored or new."""
        dealt = latest(changes, self.key, self.order).withColumn(self.PART, F.pmod(F.xxhash64(*self.key), F.lit(self.parts)).cast("int"))
        dealt = checkpointed(dealt)
        touched = [row[self.PART] for row in dealt.select(self.PART).distinct().collect()]  # at most ``parts``
        if not touched:
            return
        stored = self._stored()
        if stored is not None:
            columns = dealt.columns
            old = stored.filter(F.col(self.PART).isin(touched)).select(*[F.col(c).cast(dealt.schema[c].dataType) for c in columns])
            dealt = latest(dealt.unionByName(old), [*self.key, self.PART], self.order)
        (dealt.repartition(min(len(touched), self.parts), self.PART).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy(self.PART).parquet(self.path))


def pending(ids: DataFrame, state: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``ids`` that are not completed; duplicates stay."""
    return ids.join(completed(state, key), key, "left_anti")


def completed(state: DataFrame, key: str = "id", among: DataFrame | None = None) -> DataFrame:
    done = state.filter(F.col("status") == COMPLETED).select(key)
    return done if among is None else done.join(among.select(key).distinct(), key, "left_semi")


def status_of(ids: DataFrame, state: DataFrame, key: str = "id", stored: bool = False) -> DataFrame:
    """Status per requested id, null where the id was never seen; ``stored`` says that ``state`` is a table."""
    return lookup_join(ids, state.select(key, "status"), [key], "left", stored=stored)


def reset(state: DataFrame, ids: DataFrame, key: str = "id", only_completed: bool = True, now: Column | None = None) -> DataFrame:
    """State with the given ids set back to pending and their output cleared; ``reset`` marks the
    changed rows. A bulk reset leaves unfinished rows alone, a single one does not."""
    asked = ids.select(key).distinct().withColumn("_asked", F.lit(True))
    hit = F.coalesce(F.col("_asked"), F.lit(False))
    if only_completed:
        hit = hit & (F.col("status") == COMPLETED)
    marked = state.join(asked, key, "left").withColumn("reset", hit).drop("_asked")
    changes = {"status": F.when(F.col("reset"), PENDING).otherwise(F.col("status")),
               "final_output": F.when(F.col("reset"), "").otherwise(F.col("final_output"))}
    if now is not None:
        changes["updated_at"] = F.when(F.col("reset"), now).otherwise(F.col("updated_at"))
    return marked.withColumns(changes)


def reset_counts(marked: DataFrame) -> DataFrame:
    """How many rows a reset changed and left alone, by the status they have now."""
    return marked.groupBy("reset", "status").agg(F.count("*").alias("n"))


def in_update_order(state: DataFrame, order: list[str], place: str = "place") -> DataFrame:
    """All rows with their place in update order. The place, not a sort, carries the order, so the
    table stays spread out; sort by it where the rows leave Spark."""
    return OrderedRows(state, [], order).number(place).df


def unit_id(node: str, text: Column) -> Column:
    return F.concat(F.lit(f"{node}:"), short_hash(text))


def plan_units(items: DataFrame, node: str, state: DataFrame, item: str, text: str = "text") -> DataFrame:
    """What to do with every item of a node: ``stored`` (its input was finished before; the stored
    output comes along), ``run``, or ``duplicate`` of the equal input that runs."""
    keyed = items.select(item, unit_id(node, F.col(text)).alias("unit_id"))
    first = keyed.groupBy("unit_id").agg(F.min(item).alias("_first"))
    done = state.filter(F.col("status") == COMPLETED).select(
        F.col("id").alias("unit_id"), "final_output", F.lit(True).alias("_done"))
    known = first.join(done, "unit_id", "left")
    planned = lookup_join(keyed, known, ["unit_id"], "left")
    return planned.select(item, "unit_id", F.when(F.col("_done"), "stored").when(F.col(item) == F.col("_first"), "run")
                          .otherwise("duplicate").alias("action"), "final_output")
