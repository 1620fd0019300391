"""Item tables (``ord``, ``text``) from files, objects and rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.plans.ordered import global_number
from tallymill.session import checkpointed
from tallymill.sources import tables

NOT_TEXT = "not_utf8"


def read_corpus(spark: SparkSession, root: str, pattern: str = "*.*", limit: int | None = None) -> DataFrame:
    """All files below ``root`` (a local, shared or object-store path) whose name matches: name,
    relative_path, size, content, error. A file that is not UTF-8 text has null content and an error."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .option("pathGlobFilter", pattern).load(root))
    base = "/" + root.split("://", 1)[-1].split(":", 1)[-1].strip("/") + "/"
    text = F.try_validate_utf8(F.col("content").cast("string"))
    newlines = F.regexp_replace(text, r"\r\n?", "\n")
    corpus = files.select(
        F.substring_index("path", "/", -1).alias("name"), F.regexp_replace("path", rf"^.*?\Q{base}\E", "").alias("relative_path"),
        F.col("length").alias("size"), newlines.alias("content"), F.when(text.isNull(), NOT_TEXT).alias("error"))
    return corpus if limit is None else corpus.orderBy("relative_path").limit(limit)


def corpus_items(corpus: DataFrame) -> DataFrame:
    """Readable files as items in path order. One narrow pass finds the readable paths, which are stored and
    numbered; contents are read once more, for the join on the path, of which every file has its own."""
    good = corpus.filter(F.col("error").isNull())
    places = global_number(checkpointed(good.select("relative_path")), ["relative_path"], "ord")
    return good.join(places, "relative_path").select("ord", F.col("relative_path").alias("item_id"), F.col("content").alias("text"))


def rows_to_items(df: DataFrame, order: list[str]) -> DataFrame:
    """Every row as a JSON item text, numbered in the given order."""
    return (global_number(df, order, "ord")
            .select("ord", F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("text")))


@dataclass(frozen=True)
class Resource:
    """Where items may come from. kind: files, csv, parquet, jsonl, or sql (``location`` is the query)."""

    kind: str
    location: str
    order: list[str] = field(default_factory=list)
    pattern: str = "*.*"


def _items_of(spark: SparkSession, resource: Resource) -> DataFrame:
    if resource.kind == "files":
        return corpus_items(read_corpus(spark, resource.location, resource.pattern)).select("ord", "text")
    readers = {
        "csv": lambda: spark.read.option("header", True).csv(resource.location),
        "parquet": lambda: spark.read.parquet(resource.location),
        "jsonl": lambda: spark.read.json(resource.location),
        "sql": lambda: tables.run_sql(spark, resource.location)}
    if resource.kind not in readers:
        raise ValueError(f"unknown resource kind: {resource.kind}")
    rows = readers[resource.kind]()
    return rows_to_items(rows, resource.order or rows.columns)


def load_items(spark: SparkSession, resources: list[Resource]) -> DataFrame:
    """Items of the first resource that has any. None at all is an error."""
    for resource in resources:
        try:
            items = _items_of(spark, resource)
            if not items.isEmpty():
                return items
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    raise ValueError("no resource yields items")
