"""Periodic runs of words, found online by catchers over dyadic blocks.

For every power of two the words already seen are cut into completed blocks of that size. A catcher
holds one completed block; each word appended completes one more window of every block size, and that
window, the newest suffix of its size, is compared with the catcher of the block before it. A hit at
distance q is a square in the making with period q: it is extended to both sides, word by word, and
merges into the run of that period which covers it. Runs that reach the last word stay open and are
extended by later appends.

A run of length >= max(24, 3 q) repeats at least max(16, 2 q) consecutive words at distance q, so with
blocks of 2**k <= max(q, 8) < 2**(k + 1) words an aligned block lies in them whole: no run is missed.
Window hashes only choose what to compare; every hit is settled on the words themselves.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.llm.common import text_udf, utf8

#: A run has at least this many words and at least this many periods.
MIN_WORDS, MIN_PERIODS = 24, 3
#: Smallest block: a run with a period below it still holds a whole one (see above).
LEAST_BLOCK = 8
#: Words of small texts that one catcher takes together; a longer text has a catcher to itself.
BATCH_WORDS = 1 << 18
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(29)


class SquareCatcher:
    """Runs of a growing word sequence; words are non-negative integers, equal for equal words.

    ``append`` may be called with any number of words at a time: the runs are the same.
    """

    def __init__(self, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS):
        if min_words < 3 * LEAST_BLOCK - 1 or min_periods < 3:
            raise ValueError(f"a run has at least {3 * LEAST_BLOCK - 1} words and three periods")
        self.min_words, self.min_periods = min_words, min_periods
        self._n = 0
        self._words = np.zeros(1024, np.int64)
        self._prints: list[np.ndarray] = []      # per block size 2**k: hash of the window from each word on
        self._known: list[int] = []              # how many of them are computed
        self._open: dict[int, int] = {}          # period -> start of its stretch that reaches the last word
        self._closed: dict[tuple[int, int], int] = {}  # (start, end) -> smallest period
        self._last: dict[int, int] = {}          # period -> end of its latest stretch

    def __len__(self) -> int:
        return self._n

    def append(self, words: np.ndarray) -> None:
        old, new = self._n, self._n + len(words)
        if new > len(self._words):
            self._words = np.concatenate((self._words[:old], np.zeros(max(new, 2 * old) - old, np.int64)))
        self._words[old:new] = words
        self._n = new
        self._advance(old)
        for size, periods, starts in self._caught():
            self._settle_all(size, periods, starts)

    def _advance(self, old: int) -> None:
        """Extends the open stretches over the words that came."""
        for period, start in list(self._open.items()):
            end = old + self._agreeing(old, period, 1)
            if end < self._n:
                del self._open[period]
                self._close(start, end, period)
            self._last[period] = end

    def _caught(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per block size, (size, periods, starts of the blocks) of the new windows that equal a catcher."""
        n, level, size = self._n, 0, 1
        while size <= n:
            if level == len(self._prints):
                self._prints.append(np.zeros(0, np.uint64))
                self._known.append(0)
            done, ready = self._known[level], n - size + 1
            if len(self._prints[level]) < ready:
                grown = np.zeros(max(ready, 2 * len(self._prints[level])), np.uint64)
                grown[:done] = self._prints[level][:done]
                self._prints[level] = grown
            prints = self._prints[level]
            if level == 0:
                mixed = (self._words[done:ready].astype(np.uint64) + _A) * _B
                prints[done:ready] = mixed ^ (mixed >> _C)
            else:
                below, half = self._prints[level - 1], size // 2
                mixed = below[done:ready] * _A + below[done + half:ready + half] * _B
                prints[done:ready] = mixed ^ (mixed >> _C)
            self._known[level] = ready
            if size >= LEAST_BLOCK:
                yield from self._hits(prints, size, done, ready)
            level, size = level + 1, 2 * size

    def _hits(self, prints: np.ndarray, size: int, done: int, ready: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """New windows against the block before theirs; of the smallest size also against the block they start in."""
        for back in (0, size) if size == LEAST_BLOCK else (size,):
            lo = max(done, back)
            if lo >= ready:
                continue
            first = lo // size
            blocks = np.arange(first, (ready - 1) // size + 1) * size - back
            caught = np.repeat(prints[blocks], size)[lo - first * size:ready - first * size]
            hits = np.flatnonzero(prints[lo:ready] == caught) + lo
            starts = hits // size * size - back
            if not back:
                hits, starts = hits[hits > starts], starts[hits > starts]
            if len(hits):
                order = np.argsort(hits - starts, kind="stable")
                yield size, (hits - starts)[order], starts[order]

    def _settle_all(self, size: int, periods: np.ndarray, starts: np.ndarray) -> None:
        """Settles hits in order of period and place. A hit inside a run of a period no longer than the block is
        that run again, at a multiple of its period, and is passed over with all others of its kind at once."""
        begins, ends = self._covers(size)
        known = len(self._closed) + len(self._open)
        apart = self._apart(begins, ends, size, periods, starts)
        periods, starts = periods[apart], starts[apart]
        if not len(periods):
            return
        cuts = np.flatnonzero(np.diff(periods)) + 1
        for period, places in zip(periods[np.concatenate(([0], cuts))].tolist(), np.split(starts, cuts)):
            if known != (now := len(self._closed) + len(self._open)):
                (begins, ends), known = self._covers(size), now
            places = places[self._apart(begins, ends, size, period, places)]
            at = 0
            while at < len(places):
                self._settle(period, int(places[at]))
                at = int(np.searchsorted(places, self._last[period] - period, "right"))

    @staticmethod
    def _apart(begins: np.ndarray, ends: np.ndarray, size: int, periods, starts: np.ndarray) -> np.ndarray:
        """Which squares lie in none of the known runs."""
        if not len(begins):
            return np.ones(len(starts), bool)
        before = np.searchsorted(begins, starts, "right") - 1
        return (before < 0) | (ends[before] < starts + periods + size)

    def _covers(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the known runs with a period up to ``size``, and the greatest end among those that start no later."""
        runs = [(s, e) for (s, e), p in self._closed.items() if p <= size]
        runs += [(s, self._n) for p, s in self._open.items() if p <= size and self._n - s >= max(self.min_words, self.min_periods * p)]
        runs.sort()
        both = np.array(runs, np.int64).reshape(-1, 2)
        return both[:, 0], np.maximum.accumulate(both[:, 1]) if len(runs) else both[:, 1]

    def _settle(self, period: int, at: int) -> None:
        """The whole stretch of this period through a caught square."""
        if self._last.get(period, -1) >= at + period:
            return                               # it lies in the latest stretch of its period
        right = self._agreeing(at + period, period, 1)
        left = self._agreeing(at + period - 1, period, -1)
        start, end = at - left, at + period + right
        self._last[period] = max(end, self._last.get(period, -1))
        if end == self._n:
            self._open[period] = min(start, self._open.get(period, start))
        else:
            self._close(start, end, period)

    def _agreeing(self, at: int, period: int, step: int) -> int:
        """How many words from ``at`` on (or back) equal the word a period before them."""
        w, n, total, take = self._words, self._n, 0, 16
        while True:
            if step > 0:
                lo, hi = at + total, min(n, at + total + take)
                same = w[lo:hi] == w[lo - period:hi - period]
            else:
                lo, hi = max(period, at - total - take + 1), at - total + 1
                same = (w[lo:hi] == w[lo - period:hi - period])[::-1] if hi > lo else w[:0] == 0
            if not len(same):
                return total
            if not same.all():
                return total + int(np.argmin(same))
            total, take = total + len(same), take * 4

    def _close(self, start: int, end: int, period: int) -> None:
        if end - start >= max(self.min_words, self.min_periods * period):
            # A stretch with a period and a multiple of it is one run, of the smallest period.
            self._closed[start, end] = min(period, self._closed.get((start, end), period))

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of all runs of the words so far, by start and period."""
        found = dict(self._closed)
        for period, start in self._open.items():
            if self._n - start >= max(self.min_words, self.min_periods * period):
                found[start, self._n] = min(period, found.get((start, self._n), period))
        return sorted((start, end - start, period) for (start, end), period in found.items())


def runs_of(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """Runs of several word sequences. Between two sequences stands a word found nowhere else, so no square crosses."""
    out: list[list[tuple[int, int, int]]] = []
    at = 0
    while at < len(texts):
        upto, total = at, 0
        while upto < len(texts) and (upto == at or total + len(texts[upto]) <= BATCH_WORDS):
            total += len(texts[upto])
            upto += 1
        group = texts[at:upto]
        top = max((int(t.max()) for t in group if len(t)), default=0) + 1
        joined = np.concatenate([part for i, t in enumerate(group) for part in (t, np.array([top + i]))])
        starts = np.cumsum([0] + [len(t) + 1 for t in group])
        catcher = SquareCatcher()
        catcher.append(joined)
        own: list[list[tuple[int, int, int]]] = [[] for _ in group]
        for start, length, period in catcher.runs():
            owner = int(np.searchsorted(starts, start, "right")) - 1
            own[owner].append((start - int(starts[owner]), length, period))
        out.extend(own)
        at = upto
    return out


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay when every run keeps its first period only."""
    keep = np.ones(n, bool)
    for start, length, period in runs:
        keep[start + period:start + length] = False
    return keep


TYPE = "struct<runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:binary>"


def _numbered(words: list[bytes], numbers: defaultdict) -> np.ndarray:
    return np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))


def looped(words: list[bytes], doc: str) -> list[bytes]:
    """The contract's test loops: where the crc32 of the decimal doc_id is a multiple of 10, the words from some
    place on repeat the words from there with some period."""
    h = zlib.crc32(doc.encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def _found(make_words):
    def run(*columns: pa.Array) -> pa.Array:
        texts = columns[0]
        rows: list[dict] = []
        at = 0
        while at < len(texts):
            split, total, first = [], 0, at
            while at < len(texts) and (not split or total < 4 * BATCH_WORDS):
                text = utf8(texts.slice(at, 1))[0]
                words = make_words(text.split(), *[c[at].as_py() for c in columns[1:]])
                split.append(words)
                total += len(words)
                at += 1
            numbers: defaultdict = defaultdict(count().__next__)
            found = runs_of([_numbered(w, numbers) for w in split])
            for words, runs in zip(split, found):
                if runs:
                    keep = kept_words(len(words), runs)
                    words = [w for w, k in zip(words, keep.tolist()) if k]
                rows.append({"runs": [{"start": s, "length": m, "period": q} for s, m, q in runs], "collapsed": b" ".join(words)})
        kind = pa.struct([("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
                          ("collapsed", pa.binary())])
        return pa.array(rows, kind)

    return run


def find_runs(docs: DataFrame, text: str = "text", name: str = "_runs", *, loops_by: Column | None = None) -> DataFrame:
    """All columns of ``docs`` plus ``name``: a struct of ``runs`` (start, length, period in words, by start and
    period) and ``collapsed``, the words left when every run keeps its first period, joined by one space.

    Words are split at ASCII white space. A null or empty text has no words: no runs, collapsed empty. A text of any
    length is searched whole, in its own row's task; nothing is shuffled. Only the text is read, so repeated rows and
    null ids are rows like any other and an empty table gives an empty one; an input column called ``name`` is
    replaced. ``loops_by`` names the decimal ids that choose the test loops of ``looped``; without it texts are as
    they are.
    """
    if loops_by is None:
        return docs.withColumn(name, text_udf(_found(lambda words: words), TYPE)(F.col(text)))
    made = _found(lambda words, doc: words if doc is None else looped(words, doc))
    return docs.withColumn(name, text_udf(made, TYPE)(F.col(text), loops_by))


def best_run(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest exponent; of equal ones the first, then the one of the smaller period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def digests(found: DataFrame, name: str = "_runs") -> DataFrame:
    """doc_id, n_runs, the run with the greatest exponent (exact, by cross-multiplication) and two digests."""
    runs = F.col(f"{name}.runs")
    first = F.when(F.size(runs) > 0, runs[0])
    better = (lambda a, r: (r["length"] * a["period"] > a["length"] * r["period"])
              | ((r["length"] * a["period"] == a["length"] * r["period"]) & (r["start"] < a["start"])))
    best = F.aggregate(runs, first, lambda a, r: F.when(better(a, r), r).otherwise(a))
    lines = F.concat_ws("", F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    rows = found.select("doc_id", F.size(runs).cast("bigint").alias("n_runs"), best.alias("_best"), F.sha2(lines, 256).alias("runs_sha256"),
                        F.sha2(F.col(f"{name}.collapsed"), 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", F.col("_best.start").alias("start"), F.col("_best.length").alias("length"),
                       F.col("_best.period").alias("period"),
                       F.floor(1000 * F.col("_best.length") / F.col("_best.period")).cast("bigint").alias("exponent_milli"),
                       "runs_sha256", "collapsed_sha256")
