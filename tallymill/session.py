"""Session helpers: recommended settings, table loading and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def build_session(app_name: str = "tallymill", **settings: str) -> SparkSession:
    """A session with adaptive execution on and UTC timestamps; ``settings`` win over the defaults."""
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **settings,
    }
    builder = SparkSession.builder.appName(app_name)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def load(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One of the star-schema or text tables as a DataFrame."""
    if name not in TABLES:
        raise ValueError(f"unknown table: {name}")
    return spark.read.parquet(f"{directory}/{name}.parquet")


# Limits beyond which an operator changes its plan; a session may set its own.
MAX_GROUP_ROWS = ("tallymill.maxGroupRows", 2_000_000)
MAX_BROADCAST_ROWS = ("tallymill.maxBroadcastRows", 100_000)


def limit_of(spark: SparkSession, setting: tuple[str, int]) -> int:
    name, default = setting
    return int(spark.conf.get(name, str(default)))


SPREAD_FACTOR = 8


def spread(df: DataFrame, key: str) -> DataFrame:
    """A scan with fewer splits than cores, cut finer by a unique key before heavy work on its texts.

    A table of many files is returned as it is: texts are never shuffled where the scan alone keeps
    the cores busy.
    """
    splits, cores = df.rdd.getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism
    return df if splits >= cores else df.repartition(min(cores, max(1, splits) * SPREAD_FACTOR), key)


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder; on a cluster that would lose data.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if named is None and context.getCheckpointDir() is not None:
        named = context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="tallymill-")
        spark.conf.set("spark.checkpoint.dir", named)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so that a lost executor cannot change it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
