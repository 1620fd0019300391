"""Where results go: JSON lines, all-text tables and the layout vector stores load."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def successes(results: DataFrame) -> DataFrame:
    return results.filter(F.col("status") == "success")


def write_jsonl(results: DataFrame, path: str) -> None:
    """Successful results appended as JSON lines."""
    successes(results).write.mode("append").json(path)


def _as_text(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        return F.col(name)
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(name)
    return F.col(name).cast("string")


def all_text(df: DataFrame) -> DataFrame:
    """Every column as text: strings as they are, nested values as JSON."""
    return df.select(*[_as_text(df, c).alias(c) for c in df.columns])


def write_text_table(results: DataFrame, path: str) -> None:
    all_text(successes(results)).write.mode("append").parquet(path)


def vector_documents(df: DataFrame, key: list[str]) -> DataFrame:
    """id, document, metadata: the document is ``output``, else ``content``, else the row as JSON;
    scalar fields become text metadata; the id depends on key and document alone."""
    texts = [F.nullif(F.col(c), F.lit("")) for c in ("output", "content") if c in df.columns]
    document = F.coalesce(*texts, F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}))
    scalars = [f.name for f in df.schema.fields if f.name not in ("output", "content")
               and not isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))]
    pairs = [F.struct(F.lit(c).alias("k"), F.coalesce(F.col(c).cast("string"), F.lit("None")).alias("v")) for c in scalars]
    metadata = F.map_from_entries(F.array(*pairs)) if pairs else F.create_map().cast("map<string,string>")
    return (df.withColumn("_document", document)
            .select(F.sha2(F.concat_ws("\u0001", *[F.col(k).cast("string") for k in key], "_document"), 256).alias("id"),
                    F.col("_document").alias("document"), metadata.alias("metadata")))


def write_vector_documents(results: DataFrame, key: list[str], path: str) -> None:
    vector_documents(successes(results), key).write.mode("append").parquet(path)


def create_sink(kind: str, path: str, key: list[str] | None = None) -> Callable[[DataFrame], None]:
    """The writer for a configured sink type."""
    if kind == "jsonl":
        return lambda results: write_jsonl(results, path)
    if kind == "table":
        return lambda results: write_text_table(results, path)
    if kind == "vector":
        if not key:
            raise ValueError("a vector sink needs key columns")
        return lambda results: write_vector_documents(results, key, path)
    raise ValueError(f"unknown sink type: {kind}")
