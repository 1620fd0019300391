"""Running aggregates over ordered groups of any size.

``Window.partitionBy(key).orderBy(...)`` puts each key into one task. That is the best plan while
every key is small, and no plan at all when one key holds a third of the table. ``OrderedRows``
counts the largest key once and, if it is too big, cuts the rows into range buckets by
(key, order): a big key spreads over many buckets. A running aggregate is then taken in two
levels: one summary row per (key, bucket), a window over those few rows, and each bucket starting
from the carry of the buckets before it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymill.session import MAX_GROUP_ROWS, checkpointed, limit_of

_BUCKET = "_bucket"
_ROW = "_is_row"


def _running(kind: str, value: Column, window) -> Column:
    if kind == "sum":
        return F.sum(value).over(window)
    if kind == "max":
        return F.max(value).over(window)
    if kind == "min":
        return F.min(value).over(window)
    if kind == "last":
        return F.last(value, ignorenulls=True).over(window)
    if kind == "bit_xor":
        return F.bit_xor(value).over(window)
    raise ValueError(f"unknown running aggregate: {kind}")


class OrderedRows:
    """Rows of ``df`` in a total order inside each key.

    by             key columns; an empty list means one global order, which is always bucketed
    order          ascending column names that order a key's rows without ties
    max_group_rows largest key that may be handled by one task (default: the session's limit)
    """

    def __init__(self, df: DataFrame, by: list[str], order: list[str], *,
                 max_group_rows: int | None = None, buckets: int | None = None):
        self.by, self.order = list(by), list(order)
        self.bucketed = True
        rows = None
        if max_group_rows is None:
            max_group_rows = limit_of(df.sparkSession, MAX_GROUP_ROWS)
        if self.by:
            sizes = df.groupBy(*self.by).count()
            largest = sizes.agg(F.max("count").alias("largest"), F.sum("count").alias("rows")).first()
            rows = largest["rows"] or 0
            self.bucketed = (largest["largest"] or 0) > max_group_rows
        if self.bucketed:
            if buckets is None:
                buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
                if rows is not None:
                    buckets = max(buckets, -(-rows // max(max_group_rows, 100_000)))
            # The bucket number is stored with the row: a range shuffle samples its input, so a
            # recomputed one could cut elsewhere.
            df = checkpointed(df.repartitionByRange(buckets, *self.by, *self.order)
                              .withColumn(_BUCKET, F.spark_partition_id()))
        self._df, self._scanned = df, False

    def _with(self, df: DataFrame, scanned: bool | None = None) -> OrderedRows:
        other = object.__new__(OrderedRows)
        other.by, other.order, other.bucketed, other._df = self.by, self.order, self.bucketed, df
        other._scanned = self._scanned if scanned is None else scanned
        return other

    @property
    def df(self) -> DataFrame:
        return self._df.drop(_BUCKET)

    def with_columns(self, columns: dict[str, Column]) -> OrderedRows:
        """Row-wise columns added without losing the order."""
        return self._with(self._df.withColumns(columns))

    def scan(self, *, exclusive: bool = False, **running: tuple[str, Column]) -> OrderedRows:
        """Add ``name=(kind, value)`` columns: the aggregate of the key's rows up to this one.

        ``exclusive`` leaves the row itself out (null on a key's first row). Kinds are sum, max,
        min, bit_xor and last (latest non-null value).
        """
        upto = -1 if exclusive else Window.currentRow
        if not self.bucketed:
            window = (Window.partitionBy(*self.by).orderBy(*self.order)
                      .rowsBetween(Window.unboundedPreceding, upto))
            return self._with(self._df.withColumns(
                {name: _running(kind, value, window) for name, (kind, value) in running.items()}))

        names = list(running)
        # Each scan reads its rows twice. Storing the scan before keeps a chain of scans linear.
        source = checkpointed(self._df) if self._scanned else self._df
        rows = source.withColumns({f"_v_{n}": v for n, (_, v) in running.items()})
        summary = []
        for n, (kind, _) in running.items():
            value = F.col(f"_v_{n}")
            if kind == "last":
                position = F.when(value.isNotNull(), F.struct(*self.order))
                summary.append(F.max_by(value, position).alias(f"_v_{n}"))
            else:
                summary.append(getattr(F, kind)(value).alias(f"_v_{n}"))
        earlier = (Window.partitionBy(*self.by).orderBy(_BUCKET)
                   .rowsBetween(Window.unboundedPreceding, -1))
        carry = (rows.groupBy(*self.by, _BUCKET).agg(*summary)
                 .withColumns({f"_v_{n}": _running(running[n][0], F.col(f"_v_{n}"), earlier)
                               for n in names})
                 .withColumn(_ROW, F.lit(0)))
        inside = (Window.partitionBy(*self.by, _BUCKET).orderBy(_ROW, *self.order)
                  .rowsBetween(Window.unboundedPreceding, upto))
        scanned = (rows.withColumn(_ROW, F.lit(1)).unionByName(carry, allowMissingColumns=True)
                   .withColumns({n: _running(running[n][0], F.col(f"_v_{n}"), inside) for n in names})
                   .filter(F.col(_ROW) == 1)
                   .drop(_ROW, *[f"_v_{n}" for n in names]))
        return self._with(scanned, scanned=True)

    def previous(self, **columns: Column) -> OrderedRows:
        """Values of the key's row before this one (null on its first row)."""
        boxed = self.scan(exclusive=True, **{f"_p_{n}": ("last", F.struct(c.alias("v")))
                                             for n, c in columns.items()})
        df = boxed._df.withColumns({n: F.col(f"_p_{n}.v") for n in columns})
        return self._with(df.drop(*[f"_p_{n}" for n in columns]))

    def number(self, name: str) -> OrderedRows:
        """1-based position of the row inside its key."""
        return self.scan(**{name: ("sum", F.lit(1).cast("bigint"))})


def global_number(df: DataFrame, order: list[str], name: str, *, buckets: int | None = None) -> DataFrame:
    """1-based position of every row in one global order, without a single-task window."""
    return OrderedRows(df, [], order, buckets=buckets).number(name).df


def first_rows(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of every key. Spark limits each key inside the map tasks before it
    shuffles (window group limit), so a hot key sends at most ``k`` rows per task."""
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).filter(F.col("_rn") <= k).drop("_rn")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
