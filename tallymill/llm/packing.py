"""Best-fit packing of token sequences in bulk-synchronous rounds.

Documents are tokenized and cut into pieces of at most ``capacity`` tokens. Pieces are range-sorted by
length, so that each has a rank among the pieces of its length. Rounds then work on lengths: open
sequences (gaps) and pieces stand in one order of size, a sweep from small to large hands every gap the
largest piece that fits and is still free, ties go by rank, gaps shrink, and the next round starts. When no
gap takes anything more, new sequences are opened for what is left.

There are at most ``capacity`` lengths and as many gap sizes, so a round's sweep is a walk over that many
counters, whatever the number of documents, and runs where the counters are; it yields at most two intervals
of ranks per counter (``best_fit_rounds`` has the bound). All rows find their sequence in their own tasks: their
rank names the interval, and with it the round and the gap, which the rounds lead back to its sequence.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymill.llm.chunks import file_encoder
from tallymill.llm.common import shuffle_partitions, stored, strings

CAPACITY = 4096
END = 1


@dataclass
class Plan:
    """Where the pieces go. ``moves`` has rows (length, rank, step, round, first, n, offset): of the pieces of a length
    those with ranks from ``rank`` on, n * step of them, go to the n gaps of a round from ``first`` on, step to each,
    the first at offset. The gaps of a round are numbered anew, those of one room next to each other. ``rounds`` has
    per round how its gaps' numbers lead back: (starts, numbers in the round before), or, where sequences were
    opened, the first sequence."""

    moves: np.ndarray
    rounds: list[tuple[np.ndarray, np.ndarray] | int]

    def sequences(self, rounds: np.ndarray, gaps: np.ndarray) -> np.ndarray:
        """The sequence that each gap of a round is the rest of."""
        gaps, rounds = gaps.copy(), rounds.copy()
        for number in range(int(rounds.max(initial=-1)), -1, -1):
            at, back = np.flatnonzero(rounds == number), self.rounds[number]
            if isinstance(back, int):
                gaps[at] += back
                rounds[at] = -1
            else:
                run = np.searchsorted(back[0], gaps[at], side="right") - 1
                gaps[at] += back[1][run] - back[0][run]
                rounds[at] = number - 1
        return gaps


def best_fit_rounds(lengths: dict[int, int], capacity: int) -> Plan:
    """The plan for ``lengths`` (pieces per length).

    A round has one row of gaps per room. A move uses up a length or a row of gaps, so a round makes at most
    2 * capacity moves, whatever the number of documents. While sequences stay open, every round gives each gap
    that goes on a piece: at most capacity / shortest length rounds. What is left then fits none of these
    sequences, so they are more than half full: had the shortest piece left more than half the capacity, all of
    them would have begun with one as long. Each time sequences are opened, the tokens left are thus at most halved.
    """
    left = dict(sorted((s, n) for s, n in lengths.items() if n))
    taken = dict.fromkeys(left, 0)
    moves, rounds, opened = [], [], 0
    while total := sum(s * n for s, n in left.items()):
        fresh = -(-total // capacity)
        rounds.append(opened)
        gaps = {capacity: (0, fresh)}
        opened += fresh
        while gaps:
            stack, shrunk = [], {}
            for size in sorted({*(s for s, n in left.items() if n), *gaps}):
                if left.get(size):
                    stack.append(size)
                first, n = gaps.get(size, (0, 0))
                while n and stack:
                    top = stack[-1]
                    free = left[top]
                    step = min(size // top, free // n) if free >= 2 * n else 1
                    count = min(n, free)
                    moves.append((top, taken[top], step, len(rounds) - 1, first, count, capacity - size))
                    taken[top] += count * step
                    left[top] -= count * step
                    if size > top * step:
                        shrunk.setdefault(size - top * step, []).append((first, count))
                    first, n = first + count, n - count
                    if not left[top]:
                        stack.pop()
            gaps, starts, before, number = {}, [], [], 0
            for room, runs in sorted(shrunk.items()):
                gaps[room] = (number, sum(n for _, n in runs))
                for first, n in runs:
                    starts.append(number)
                    before.append(first)
                    number += n
            if gaps:
                rounds.append((np.array(starts, np.int64), np.array(before, np.int64)))
    table = np.array(moves, np.int64).reshape(-1, 7)
    return Plan(table[np.lexsort((table[:, 1], table[:, 0]))], rounds)


def _pieces(path: str, capacity: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = file_encoder(path, attached=False), np.array([END], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                doc, piece, start, length, crc, kept = [], [], [], [], [], []
                for one, ids in zip(part.column(0).to_pylist(), encoder.encode(strings(part.column(1)))):
                    ids += end
                    for number, begin in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[begin:begin + 4 * capacity]
                        doc.append(one)
                        piece.append(number)
                        start.append(begin // 4)
                        length.append(len(cut) // 4)
                        crc.append(zlib.crc32(cut))
                        kept.append(cut if keep_ids else None)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                     pa.array(crc, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])
    return run


def _placed(plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = plan.value.moves
        starts = table[:, 0] << 48 | table[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            row = table[np.searchsorted(starts, length << 48 | rank, side="right") - 1]
            within = rank - row[:, 1]
            columns = {name: batch.column(name) for name in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            sequence = plan.value.sequences(row[:, 3], row[:, 4] + within // row[:, 2])
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(sequence), pa.array(row[:, 6] + within % row[:, 2] * length)],
                                             [*columns, "sequence_id", "offset"])
    return run


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary"


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset) per piece.

    A document is its ids with END behind them; one longer than ``capacity`` is cut into full pieces and
    a rest. Every piece lies whole in one sequence, sequences have no holes before their last token. A null
    or empty text is END alone. ``ids`` (packed little-endian uint32) is filled with ``keep_ids``. Repeated
    ids are documents of their own; equal pieces are interchangeable and ordered by doc_id, piece and
    checksum. An empty table packs into nothing. Other columns are not read.
    """
    spark = docs.sparkSession
    pieces = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_pieces(tokenizer, capacity, keep_ids), PIECES)
    # The bucket is stored with the row: a range shuffle samples its input and could cut elsewhere again.
    order = ["length", "doc_id", "piece", "ids_crc32"]
    cut = stored(stored(pieces, "pieces").repartitionByRange(shuffle_partitions(spark), *order)
                 .withColumn("bucket", F.spark_partition_id()), "ranged-pieces")
    counts = cut.groupBy("length", "bucket").count()
    before = stored(counts.withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("bucket")) - F.col("count")), "ranks")
    lengths = {r["length"]: r["n"] for r in before.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    shared = spark.sparkContext.broadcast(best_fit_rounds(lengths, capacity))
    within = F.row_number().over(Window.partitionBy("bucket", "length").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = (cut.withColumn("within", within).join(before.select("length", "bucket", "before"), ["bucket", "length"])
              .withColumn("rank", (F.col("within") + F.col("before")).cast("bigint")))
    return (ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "ids", "rank")
            .mapInArrow(_placed(shared), PIECES + ", sequence_id bigint, offset bigint"))
