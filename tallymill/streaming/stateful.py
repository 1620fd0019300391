"""Steps over streams that remember something per key, in Spark's own keyed state.

Each step is a stateful processor: Spark deals a batch's rows by key, hands every key its rows and its
state, and stores both with the stream's checkpoint, so a restarted stream goes on where it stopped. A key
has a few numbers of state however long it lives; timers on the event-time watermark drop what is not
needed any more. Rows of a key are put in order within a batch. What must be exact although rows come out
of order across batches (the budget fuse) waits in state until the watermark has passed it.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallymill.operators.telemetry import TERMINAL

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Shards to which the keys of a budget fuse are dealt, and calls that wait in one entry of the state.
FUSE_SHARDS, CALLS_AT_ONCE = 256, 10_000


def _stepped(stream: DataFrame, by: list[str], step: StatefulProcessor, schema: T.StructType, mode: str) -> DataFrame:
    """``step`` on the stream's keys. Keyed state needs the RocksDB state store, set for the session."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return stream.groupBy(*by).transformWithStateInPandas(step, schema, "append", mode)


def _in_order(frames: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    """A key's rows of one batch in order."""
    parts = [f for f in frames if len(f)]
    if not parts:
        return pd.DataFrame()
    rows = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
    return rows.sort_values(order, kind="stable", ignore_index=True)


def _micros(values: pd.Series) -> pd.Series:
    return values.astype("datetime64[us]").astype("int64")


def _with(schema: T.StructType, *fields: T.StructField) -> T.StructType:
    return T.StructType([*schema.fields, *fields])


class _Gate(StatefulProcessor):
    """Runs of low and of good scores, and whether the gate is halted."""

    def __init__(self, order: list[str], score: str, threshold: float, window: int, recovery: int):
        self._order, self._score, self._threshold, self._window, self._recovery = order, score, threshold, window, recovery

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("gate", "low bigint, good bigint, halted boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _in_order(rows, self._order)
        if not len(batch):
            return
        low, good, halted = self._state.get() if self._state.exists() else (0, 0, False)
        states = []
        for high in (batch[self._score] >= self._threshold).tolist():
            low, good = (0, good + 1) if high else (low + 1, 0)
            if low >= self._window:
                halted = True
            elif 0 < self._recovery <= good:
                halted = False
            states.append(halted)
        self._state.update((low, good, halted))
        yield batch.assign(halted=states)


def quality_gate(stream: DataFrame, by: list[str], order: list[str], score: str = "score", *,
                 threshold: float = 0.6, window: int = 5, recovery: int = 0) -> DataFrame:
    """The quality gate on a stream: ``halted`` after every scored row, as over all rows at once when a key's
    rows arrive batch by batch in order. Rows without a score do not take part. State: two counters and a
    flag per key."""
    scored = stream.filter(stream[score].isNotNull())
    step = _Gate(order, score, threshold, window, recovery)
    return _stepped(scored, by, step, _with(scored.schema, T.StructField("halted", T.BooleanType())), "None")


class _Phases(StatefulProcessor):
    """The last phase of a key, until some time after its terminal status."""

    def __init__(self, order: list[str], phase: str, status: str, ts: str, keep_ms: int):
        self._order, self._phase, self._status, self._ts, self._keep_ms = order, phase, status, ts, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("phase", "phase string, over boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _in_order(rows, self._order)
        if not len(batch):
            return
        known = self._state.exists()
        last, over = self._state.get() if known else (None, False)
        if over:
            return
        kept = []
        phases = [None if pd.isna(p) else p for p in batch[self._phase]]
        for at, (phase, status) in enumerate(zip(phases, batch[self._status])):
            if not known or phase != last:
                kept.append(at)
            known, last = True, phase
            if status in TERMINAL:
                over = True
                self._handle.registerTimer(int(_micros(batch[self._ts])[at] // 1000) + self._keep_ms)
                break
        self._state.update((last, over))
        if kept:
            yield batch.iloc[kept]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._state.clear()
        return iter(())


def phase_changes(stream: DataFrame, by: list[str], order: list[str], ts: str, phase: str = "phase", status: str = "status", *,
                  delay: str = "1 hour", keep_ms: int = 3_600_000) -> DataFrame:
    """Updates whose phase differs from the one before, up to the first completed or failed one of a key. What
    comes after that is passed over; once the watermark is ``keep_ms`` past the end, the key is forgotten."""
    timed = stream.withWatermark(ts, delay)
    return _stepped(timed, by, _Phases(order, phase, status, ts, keep_ms), timed.schema, "EventTime")


class _FirstSeen(StatefulProcessor):
    """When the entry of a key was stored, for as long as it lives."""

    def __init__(self, ts: str, ttl_us: int):
        self._ts, self._ttl_us = ts, ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("stored", "at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _in_order(rows, [self._ts])
        if not len(batch):
            return
        stored = self._state.get()[0] if self._state.exists() else None
        kept = []
        for row, at in enumerate(_micros(batch[self._ts]).tolist()):
            if stored is None or (self._ttl_us > 0 and at - stored > self._ttl_us):
                kept.append(row)
                stored = at
        if kept:
            self._state.update((stored,))
            if self._ttl_us > 0:
                self._handle.registerTimer(-(-(stored + self._ttl_us) // 1000) + 1)
            yield batch.iloc[kept]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # An older entry's timer does not end a younger one.
        if self._state.exists() and self._state.get()[0] + self._ttl_us < expiredTimerInfo.getExpiryTimeInMs() * 1000:
            self._state.clear()
        return iter(())


def first_seen(stream: DataFrame, by: list[str], ts: str, ttl_us: int, *, delay: str = "1 hour") -> DataFrame:
    """The requests of a stream that a cache with this time to live does not answer: a key's first one, and the
    first one later than the ttl after the last that was stored; hits do not extend an entry's life, and a ttl of
    0 never ends. An entry leaves the state when the watermark passes its end, so state holds the keys stored
    within the ttl and the delay, not all keys ever seen."""
    timed = stream.withWatermark(ts, delay)
    return _stepped(timed, by, _FirstSeen(ts, ttl_us), timed.schema, "EventTime")


class _Fuse(StatefulProcessor):
    """Calls that the watermark has not passed, and the cost of those it has, for the keys of one shard.

    Calls wait as Arrow tables of many rows: a call handed to the state store on its own costs more than all the rest.
    """

    def __init__(self, schema: T.StructType, key: str, order: list[str], ts: str, cost: str, budget: Decimal, more: list[str]):
        self._key, self._order, self._ts, self._cost, self._budget, self._more = key, order, ts, cost, budget, more
        clock = T.TimestampType, T.TimestampNTZType
        # The clock stays as pandas has it, without a zone.
        self._schema = pa.schema([(f.name, pa.timestamp("us") if isinstance(f.dataType, clock) else to_arrow_type(f.dataType)) for f in schema.fields])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._waiting = handle.getListState("waiting", "calls binary")
        self._total = handle.getMapState("total", "key string", "total decimal(38,12), calls bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        oldest = []
        for batch in rows:
            if len(batch):
                calls = pa.Table.from_pandas(batch[self._schema.names], self._schema, preserve_index=False)
                self._waiting.appendList(self._packed(calls))
                oldest.append(_micros(batch[self._ts]).min())
        if oldest:
            self._wake(min(oldest))
        yield from ()

    def _wake(self, oldest: int) -> None:
        """A timer for the oldest waiting call; its release sets the next."""
        self._handle.registerTimer(int(oldest // 1000) + 1)

    @staticmethod
    def _packed(calls: pa.Table) -> list[tuple]:
        packed = []
        for at in range(0, len(calls), CALLS_AT_ONCE):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, calls.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
                writer.write_table(calls.slice(at, CALLS_AT_ONCE))
            packed.append((sink.getvalue().to_pybytes(),))
        return packed

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self._waiting.exists():
            return
        waiting = pa.concat_tables([pa.ipc.open_stream(calls).read_all() for calls, in self._waiting.get()])
        at = _micros(waiting.column(self._ts).to_pandas())
        passed = (at // 1000 < timerValues.getCurrentWatermarkInMs()).to_numpy()
        if not passed.any():
            return
        ready, rest = waiting.filter(pa.array(passed)), waiting.filter(pa.array(~passed))
        if len(rest):
            self._waiting.put(self._packed(rest))
            self._wake(at[~passed].min())
        else:
            self._waiting.clear()
        ready = ready.sort_by([(c, "ascending") for c in (self._key, *self._order)])
        sums, fuse, last, total, calls = [], [], None, Decimal(0), 0
        for name, cost in zip(ready.column(self._key).to_pylist(), ready.column(self._cost).to_pylist()):
            if name != last:
                if last is not None:
                    self._total.updateValue((last,), (total, calls))
                total, calls = self._total.getValue((name,)) or (Decimal(0), 0)
                last = name
            before, calls = total, calls + 1
            total += Decimal(0) if cost is None else cost
            sums.append(total)
            fuse.append("before" if total < self._budget else "trip" if before < self._budget or calls == 1 else "after")
        self._total.updateValue((last,), (total, calls))
        yield ready.drop_columns([self._key]).to_pandas().assign(**dict(zip(self._more, (sums, fuse))))


def budget_fuse(stream: DataFrame, by: list[str], order: list[str], ts: str, budget: Decimal, *, cost: str = "cost", delay: str = "1 hour",
                shards: int = FUSE_SHARDS) -> DataFrame:
    """Cumulative cost of every call and whether it came before the fuse, tripped it or came after, in order of
    ``order`` (which begins with ``ts``) although calls arrive out of order by up to ``delay``. A call comes out once
    the watermark has passed it; later ones are late and dropped. State: one total per key, and the calls of the
    last ``delay``.

    Keys are dealt to ``shards``, each of which takes its calls of a batch at once; a started stream keeps their number.
    """
    timed = stream.withWatermark(ts, delay)
    schema, name, shard = timed.schema, "fuse_key", "fuse_shard"
    whole = [f.name for f in schema.fields if isinstance(f.dataType, T.IntegralType)]
    key = F.to_json(F.struct(*[F.col(c) for c in by]), {"ignoreNullFields": "false"})
    # pandas would turn whole numbers beside nulls into doubles.
    exact = timed.withColumns({name: key, shard: F.pmod(F.xxhash64(*by), F.lit(shards))}).withColumns({c: F.col(c).cast("decimal(20,0)") for c in whole})
    held = exact.drop(shard).schema
    more = T.StructField("cumulative_cost", T.DecimalType(38, 12)), T.StructField("fuse", T.StringType())
    step = _Fuse(held, name, order, ts, cost, Decimal(budget), [f.name for f in more])
    out = T.StructType([f for f in held.fields if f.name != name])
    fused = _stepped(exact, [shard], step, _with(out, *more), "EventTime")
    return fused.withColumns({c: F.col(c).cast(schema[c].dataType) for c in whole})
