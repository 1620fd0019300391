"""Token files by a static range asymmetric numeral system (rANS).

Texts are range-sorted by doc_id and tokenized in that order. Every GROUP_TOKENS ids or so form a group: its
counts, scaled to a power of two, are the frequency table that all its blocks share. A block holds whole
documents, is coded on its own by interleaved lanes, and carries checkpoints (lane states and place in the
stream) with a checksum per segment, so segments decode in parallel and damage is found. A file is a Parquet
table with one row per group. No ids are kept anywhere but in these files, and a lost task writes only its own
range again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.llm.chunks import file_encoder
from tallymill.llm.common import shuffle_partitions, strings

BITS = 20
LANES = 2048
SEGMENT_STEPS = 128
BLOCK_TOKENS = 524_288
GROUP_TOKENS = 4 * BLOCK_TOKENS
END = 0
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)
_SCALE = np.uint64(BITS)
_MASK = np.uint64((1 << BITS) - 1)


class Frequencies:
    """Scaled frequencies of the ids that occur; every one has at least 1, all have 2**BITS together."""

    def __init__(self, scaled: np.ndarray):
        self.frequency = scaled.astype(np.uint64)
        self.start = (np.cumsum(scaled) - scaled).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(scaled), dtype=np.int64), scaled)

    @classmethod
    def of(cls, ids: np.ndarray) -> Frequencies:
        raw = np.bincount(ids)
        if np.count_nonzero(raw) > 1 << (BITS - 1):
            raise ValueError(f"{np.count_nonzero(raw)} different ids need more than {BITS} bits")
        scaled = np.where(raw > 0, np.maximum(1, np.floor(raw * ((1 << BITS) / max(1, raw.sum())))), 0).astype(np.int64)
        excess = int(scaled.sum()) - (1 << BITS)
        while excess and len(ids):
            order = np.argsort(-scaled, kind="stable")
            if excess < 0:
                scaled[order[0]] -= excess
                break
            for token in order:
                take = min(excess, max(0, int(scaled[token]) // 2), int(scaled[token]) - 1)
                scaled[token] -= take
                excess -= take
                if not excess:
                    break
        return cls(scaled)

    def packed(self) -> bytes:
        seen = np.flatnonzero(self.frequency)
        return zlib.compress(np.concatenate((np.diff(seen, prepend=0), self.frequency[seen].astype(np.int64))).astype("<u4").tobytes())

    @classmethod
    def unpacked(cls, data: bytes) -> Frequencies:
        both = np.frombuffer(zlib.decompress(data), "<u4").astype(np.int64).reshape(2, -1)
        seen = np.cumsum(both[0])
        scaled = np.zeros(int(seen[-1]) + 1 if len(seen) else 0, np.int64)
        scaled[seen] = both[1]
        return cls(scaled)


def encode_block(ids: np.ndarray, table: Frequencies) -> dict:
    """One block: words, lane states and checkpoints, for ids in order."""
    states = np.full(LANES, _LOW, np.uint64)
    steps = -(-len(ids) // LANES)
    stream, written, checks = [], 0, []
    for step in range(steps - 1, -1, -1):
        part = ids[step * LANES:(step + 1) * LANES]
        f, c = table.frequency[part], table.start[part]
        x = states[:len(part)]
        full = x >= f << np.uint64(31 - BITS + 32)
        if full.any():
            stream.append(x[full].astype(np.uint32))
            written += len(stream[-1])
            x = np.where(full, x >> _WORD, x)
        q = x // f
        states[:len(part)] = (q << _SCALE) + (x - q * f) + c
        if step % SEGMENT_STEPS == 0:
            checks.append((written, states.astype("<u8").tobytes()))
    words = np.concatenate(stream[::-1]).astype("<u4") if stream else np.empty(0, "<u4")
    segment = LANES * SEGMENT_STEPS
    return {"n_ids": len(ids), "payload": words.tobytes(),
            "places": [written - w for w, _ in reversed(checks)], "states": [s for _, s in reversed(checks)],
            "checksums": [zlib.crc32(ids[at:at + segment].astype("<u4").tobytes()) for at in range(0, len(ids), segment)]}


def decode_segment(block: dict, segment: int, table: Frequencies) -> np.ndarray:
    """The ids of one segment, from its checkpoint alone; ValueError if they are not what was written."""
    words = np.frombuffer(block["payload"], "<u4")
    states = np.frombuffer(block["states"][segment], "<u8").astype(np.uint64)
    begin = segment * SEGMENT_STEPS * LANES
    n = min(block["n_ids"] - begin, SEGMENT_STEPS * LANES)
    place, out = block["places"][segment], np.empty(n, np.int64)
    for at in range(0, n, LANES):
        count = min(LANES, n - at)
        x = states[:count]
        slot = x & _MASK
        token = table.symbol[slot.astype(np.int64)]
        out[at:at + count] = token
        x = table.frequency[token] * (x >> _SCALE) + slot - table.start[token]
        empty = x < _LOW
        need = int(np.count_nonzero(empty))
        if need:
            x[empty] = x[empty] << _WORD | words[place:place + need].astype(np.uint64)
            place += need
        states[:count] = x
    if zlib.crc32(out.astype("<u4").tobytes()) != block["checksums"][segment]:
        raise ValueError(f"segment {segment} of a block does not match its checksum")
    return out


def decode_block(block: dict, table: Frequencies) -> np.ndarray:
    parts = [decode_segment(block, s, table) for s in range(len(block["states"]))]
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


# --- on Spark -----------------------------------------------------------------------------------

GROUPS = ("part int, start_in_part bigint, n_ids bigint, frequencies binary, blocks array<struct<doc_ids:array<bigint>,lengths:array<int>,"
          "n_ids:int,payload:binary,places:array<int>,states:array<binary>,checksums:array<bigint>>>")
_BLOCK = pa.struct([("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("n_ids", pa.int32()), ("payload", pa.binary()),
                    ("places", pa.list_(pa.int32())), ("states", pa.list_(pa.binary())), ("checksums", pa.list_(pa.int64()))])
_GROUP = pa.schema([("part", pa.int32()), ("start_in_part", pa.int64()), ("n_ids", pa.int64()), ("frequencies", pa.binary()), ("blocks", pa.list_(_BLOCK))])


def _group(part: int, start: int, docs: list, coded: list[bytes]) -> pa.RecordBatch:
    """One group: its table and its blocks of whole documents."""
    lengths = np.array([len(i) // 4 for i in coded], np.int64)
    ids = np.frombuffer(b"".join(coded), "<u4").astype(np.int64)
    table = Frequencies.of(ids)
    ends, blocks, first = np.cumsum(lengths), [], 0
    while first < len(docs):
        begin = int(ends[first] - lengths[first])
        last = max(first + 1, int(np.searchsorted(ends, begin + BLOCK_TOKENS, side="right")))
        own = ids[begin:int(ends[last - 1])]
        blocks.append({"doc_ids": docs[first:last], "lengths": lengths[first:last].tolist(), **encode_block(own, table)})
        first = last
    row = {"part": part, "start_in_part": start, "n_ids": len(ids), "frequencies": table.packed(), "blocks": blocks}
    return pa.RecordBatch.from_pylist([row], schema=_GROUP)


def _written(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = file_encoder(path, attached=True), np.array([END], "<u4").tobytes()
        part, start, size, docs, coded = TaskContext.get().partitionId(), 0, 0, [], []
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                piece = batch.slice(at, 2048)
                for doc, ids in zip(piece.column("doc_id").to_pylist(), encoder.encode(strings(piece.column("text")))):
                    docs.append(doc)
                    coded.append(ids + end)
                    size += len(ids) // 4 + 1
                    if size >= GROUP_TOKENS:
                        yield _group(part, start, docs, coded)
                        start, size, docs, coded = start + size, 0, [], []
        if docs:
            yield _group(part, start, docs, coded)
    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Write the ids of all texts, each with END behind it, to ``path`` in ascending doc_id order.

    A null or empty text is END alone. Null ids come first; rows with the same id are ordered by the
    checksum of their texts and then by the texts, so that even an id in a third of all rows is spread out. An
    empty table gives an empty file. Other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.crc32("text").alias("crc"))
    ordered = (rows.repartitionByRange(shuffle_partitions(docs.sparkSession), "doc_id", "crc")
               .sortWithinPartitions("doc_id", "crc", "text").select("doc_id", "text"))
    ordered.mapInArrow(_written(tokenizer), GROUPS).write.parquet(path)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            table, start = Frequencies.unpacked(row["frequencies"]), row["start"]
            for block in row["blocks"]:
                ids = decode_block(block, table).astype("<u4")
                ends = np.cumsum(block["lengths"], dtype=np.int64)
                begins = ends - np.array(block["lengths"], np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(block["doc_ids"], pa.int64()), pa.array(begins + start), pa.array(ends - begins),
                    pa.array([ids[b:e].tobytes() for b, e in zip(begins, ends)], pa.binary())], ["doc_id", "start", "n_tokens", "ids"])
                start += block["n_ids"]


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) per document from the file at ``path``; start counts the ids of all
    documents before it. Groups decode independently. One total per written part comes to the driver."""
    groups = spark.read.schema(GROUPS).parquet(path)
    totals = sorted((r["part"], r["n"]) for r in groups.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    before, starts = 0, []
    for part, n in totals:
        starts.append((part, before))
        before += n
    offsets = spark.createDataFrame(starts, "part int, before bigint")
    placed = groups.join(F.broadcast(offsets), "part").select((F.col("start_in_part") + F.col("before")).alias("start"), "frequencies", "blocks")
    return placed.mapInArrow(_decoded, "doc_id bigint, start bigint, n_tokens bigint, ids binary")
