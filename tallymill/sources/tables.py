"""Named tables and SQL over them."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

_IDENTIFIER = re.compile(r"[a-zA-Z_]\w*")


def checked_name(name: str) -> str:
    if not _IDENTIFIER.fullmatch(name):
        raise ValueError(f"not a table name: {name!r}")
    return name


def register_csv(spark: SparkSession, name: str, path: str, schema: str | None = None) -> DataFrame:
    """A CSV file or folder as a named table. Without a schema the types are inferred, which reads
    the data once more."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    df = reader.csv(path)
    df.createOrReplaceTempView(checked_name(name))
    return df


def register_parquet(spark: SparkSession, name: str, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    df.createOrReplaceTempView(checked_name(name))
    return df


def table_columns(spark: SparkSession, name: str) -> list[tuple[str, str]]:
    """Column names and types of a named table."""
    return [(f.name, f.dataType.simpleString()) for f in spark.table(checked_name(name)).schema.fields]


def run_sql(spark: SparkSession, query: str, params: Sequence | Mapping | None = None,
            limit: int | None = None) -> DataFrame:
    """A query with positional ``?`` or named ``:name`` parameters. No limit unless asked for."""
    args = None if params is None else dict(params) if isinstance(params, Mapping) else list(params)
    df = spark.sql(query, args=args) if args else spark.sql(query)
    return df if limit is None else df.limit(limit)


def jdbc_options(url: str, query: str, driver: str | None = None, partition_column: str | None = None,
                 lower: int | None = None, upper: int | None = None, partitions: int | None = None,
                 fetch_size: int = 10_000) -> dict[str, str]:
    """Reader options for a database query. With a partition column and its bounds the query is read
    by many tasks at once; a lone query runs in one."""
    options = {"url": url, "fetchsize": str(fetch_size)}
    if driver:
        options["driver"] = driver
    if partition_column is None:
        return {**options, "query": query}
    if lower is None or upper is None or not partitions:
        raise ValueError("a partition column needs lower, upper and partitions")
    return {**options, "dbtable": f"({query}) q", "partitionColumn": partition_column, "lowerBound": str(lower),
            "upperBound": str(upper), "numPartitions": str(partitions)}


def read_jdbc(spark: SparkSession, url: str, query: str, limit: int | None = None, **options) -> DataFrame:
    df = spark.read.format("jdbc").options(**jdbc_options(url, query, **options)).load()
    return df if limit is None else df.limit(limit)
