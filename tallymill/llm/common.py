"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tallymill.session import fresh_path

LAST_ID = 2**63 - 1
_KEPT: dict[str, dict] = {}


def kept(owner: str) -> dict:
    """What ``owner`` keeps in this worker process from task to task. Workers serve one stage after the other: what
    other owners have kept goes, so that memories of several operators do not add up."""
    for other in [name for name in _KEPT if name != owner]:
        del _KEPT[other]
    return _KEPT.setdefault(owner, {})


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet below the shared folder and read back: lineage is cut, a lost
    executor costs nothing that was finished, and no expensive step is computed twice."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_udf(make: Callable, returns: str) -> Callable[..., Column]:
    """A scalar Arrow function evaluated once per row, even where its result is used several times."""
    return arrow_udf(make, returns).asNondeterministic()


def utf8(texts: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a null text is an empty one."""
    return [b"" if t is None else t for t in texts.cast(pa.binary()).to_pylist()]


def strings(texts: pa.Array) -> list[str]:
    """Each text as str; a null text is an empty one, broken UTF-8 becomes U+FFFD."""
    return [t.decode("utf-8", "replace") for t in utf8(texts)]


def code_points(data: bytes) -> int:
    """Number of code points in UTF-8 bytes."""
    if data.isascii():
        return len(data)
    return int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


def id_key(name: str = "doc_id") -> Column:
    """The id as a key that is never null: a null id counts as the greatest."""
    return F.coalesce(F.col(name).cast("bigint"), F.lit(LAST_ID))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest member of each index's component when ``a[i]`` and ``b[i]`` are linked."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            further = label[label]
            if np.array_equal(further, label):
                break
            label = further
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label
