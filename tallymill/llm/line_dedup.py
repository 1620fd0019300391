"""Line deduplication by a sharded minimal perfect hash.

Distinct line hashes that more than one document holds are numbered by a minimal perfect hash per shard;
the numbers index compact arrays of fingerprints, counts and owners (smallest doc_id). Documents probe the
arrays: the hashes of a batch of documents travel to a shard as one packed block, are looked up there at
once, and only what has to go comes back. Lines are never joined, and a line in a third of all documents
is one entry in each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.llm.common import code_points, free_name, id_key, shuffle_partitions, stored, text_udf, utf8

MIN_CHARS = 10
SPACE = b" \t\n\x0b\x0c\r"
SHARD_KEYS = 16384
_MIX = np.uint64(0x9E3779B97F4A7C15)


def line_keys(text: bytes) -> list[bytes | None]:
    """The key of each line, or None where it is shorter than MIN_CHARS code points."""
    keys = [line.strip(SPACE) for line in text.lower().split(b"\n")]
    return [k if len(k) >= MIN_CHARS and (len(k) >= 4 * MIN_CHARS or code_points(k) >= MIN_CHARS) else None for k in keys]


def _hashes(text: bytes) -> list[bytes | None]:
    digest = xxhash.xxh3_128_digest
    return [None if k is None else digest(k) for k in line_keys(text)]


# --- the minimal perfect hash -------------------------------------------------------------------

def _slots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    mixed = (keys ^ np.uint64(level * 0xD1B54A32D192ED03 & (2**64 - 1))) * _MIX
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return (mixed % np.uint64(size)).astype(np.int64)


def build_hash(keys: np.ndarray) -> list[np.ndarray]:
    """Bit arrays of a minimal perfect hash over distinct 64-bit keys: a level keeps the keys that are alone
    in their slot, the others go on to the next. A key's number is the rank of its bit."""
    levels = []
    while len(keys):
        size = max(64, (3 * len(keys) // 2 + 63) // 64 * 64)
        slot = _slots(keys, len(levels), size)
        alone = np.bincount(slot, minlength=size) == 1
        levels.append(alone)
        keys = keys[~alone[slot]]
    return levels


def look_up(levels: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Each key's number; -1 where no level has its bit. A key that was not built in may get any number."""
    found = np.full(len(keys), -1, np.int64)
    left, base = np.arange(len(keys)), 0
    for level, bits in enumerate(levels):
        if not len(left):
            break
        slot = _slots(keys[left], level, len(bits))
        hit = bits[slot]
        found[left[hit]] = base + np.cumsum(bits)[slot[hit]] - 1
        left, base = left[~hit], base + int(bits.sum())
    return found


# --- building and probing the shards ------------------------------------------------------------

def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h1, h2, doc) once per document row and line key."""
    for batch in batches:
        docs = batch.column(0).to_pylist()
        for at in range(0, len(docs), 512):
            owners, packed = [], []
            for doc, text in zip(docs[at:at + 512], utf8(batch.column(1).slice(at, 512))):
                own = {h for h in _hashes(text) if h is not None}
                owners.extend([doc] * len(own))
                packed.extend(own)
            pair = np.frombuffer(b"".join(packed), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(owners, pa.int64())], ["h1", "h2", "doc"])


def _shard_arrays(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    h1, h2, n, owner = (table.column(c).to_numpy() for c in ("h1", "h2", "n", "owner"))
    keys = _joint(h1.view(np.uint64), h2.view(np.uint64))
    # The same 64-bit mix twice would need two of 2**128 hashes to meet; the extra list keeps even that right.
    keys, first = np.unique(keys, return_index=True)
    rest = np.setdiff1d(np.arange(len(h1)), first)
    levels = build_hash(keys)
    number = look_up(levels, keys)
    place = np.empty(len(keys), np.int64)
    place[number] = first
    order = np.concatenate((place, rest))
    return pa.table({
        "shard": pa.array([key[0].as_py()], pa.int32()),
        "levels": pa.array([[np.packbits(b).tobytes() for b in levels]], pa.list_(pa.binary())),
        "prints": pa.array([h2[order].tobytes()], pa.binary()),
        "seconds": pa.array([h1[order].tobytes()], pa.binary()),
        "counts": pa.array([np.minimum(n[order], 2**32 - 1).astype(np.uint32).tobytes()], pa.binary()),
        "owners": pa.array([owner[order].tobytes()], pa.binary())})


def _joint(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return h1 ^ (h2 * _MIX)


INDEX = "shard int, levels array<binary>, prints binary, seconds binary, counts binary, owners binary"


def line_index(docs: DataFrame, shards: int | None = None) -> tuple[DataFrame, int]:
    """The index of all lines held by two documents or more: one row of arrays per shard, and the number of
    shards. ``docs`` has doc and text. Counts are of document rows."""
    spark = docs.sparkSession
    held = docs.select("doc", "text").mapInArrow(_held, "h1 bigint, h2 bigint, doc bigint")
    lines = held.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("doc").alias("owner"), F.max("doc").alias("_last"))
    common = stored(lines.filter("owner < _last").drop("_last"), "common-lines")
    if shards is None:
        shards = max(shuffle_partitions(spark), -(-common.count() // SHARD_KEYS))
    placed = common.withColumn("shard", F.pmod(F.col("h1"), F.lit(shards)).cast("int"))
    return stored(placed.groupBy("shard").applyInArrow(_shard_arrays, INDEX), "line-index"), shards


def _blocks(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, packed = [], []
            for doc, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                own = {h for h in _hashes(text) if h is not None}
                docs.extend([doc] * len(own))
                packed.extend(own)
            if not docs:
                continue
            pair = np.frombuffer(b"".join(packed), np.int64).reshape(-1, 2)
            shard = np.mod(pair[:, 0], shards)
            order = np.argsort(shard, kind="stable")
            pair, doc, shard = pair[order], np.array(docs, np.int64)[order], shard[order]
            cuts = np.flatnonzero(np.diff(shard)) + 1
            begin, end = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(shard)]))
            yield pa.RecordBatch.from_arrays([
                pa.array(shard[begin], pa.int32()),
                pa.array([pair[b:e].tobytes() for b, e in zip(begin, end)], pa.binary()),
                pa.array([doc[b:e].tobytes() for b, e in zip(begin, end)], pa.binary())], ["shard", "lines", "docs"])
    return run


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard, the shard's arrays before its blocks; (doc, gone) where lines have to go."""
    shard, arrays = None, None
    for batch in batches:
        rows = batch.to_pylist()
        docs, gone = [], []
        for row in rows:
            if row["prints"] is not None:
                shard = row["shard"]
                arrays = ([np.unpackbits(np.frombuffer(b, np.uint8)).astype(bool) for b in row["levels"]],
                          *(np.frombuffer(row[c], np.int64) for c in ("prints", "seconds", "owners")))
                continue
            if row["shard"] != shard:
                continue  # no line of this shard is held twice
            levels, prints, seconds, owners = arrays
            pair = np.frombuffer(row["lines"], np.int64).reshape(-1, 2)
            doc = np.frombuffer(row["docs"], np.int64)
            number = look_up(levels, _joint(pair[:, 0].view(np.uint64), pair[:, 1].view(np.uint64)))
            number = np.where(number < 0, 0, number)
            hit = (prints[number] == pair[:, 1]) & (seconds[number] == pair[:, 0])
            owner = owners[number]
            for extra in range(sum(int(b.sum()) for b in levels), len(prints)):
                also = (prints[extra] == pair[:, 1]) & (seconds[extra] == pair[:, 0])
                hit, owner = hit | also, np.where(also, owners[extra], owner)
            drop = hit & (owner != doc)
            if not drop.any():
                continue
            doc, lines = doc[drop], pair[drop]
            order = np.argsort(doc, kind="stable")
            doc, lines = doc[order], lines[order]
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(doc)) + 1, [len(doc)]))
            docs.extend(doc[cuts[:-1]].tolist())
            gone.extend(lines[b:e].tobytes() for b, e in zip(cuts[:-1], cuts[1:]))
        if docs:
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(gone, pa.binary())], ["doc", "gone"])


def lines_to_drop(docs: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """(doc, gone): packed 128-bit hashes of the lines each document loses."""
    blocks = docs.select("doc", "text").mapInArrow(_blocks(shards), "shard int, lines binary, docs binary")
    probing = index.unionByName(blocks, allowMissingColumns=True)
    found = (probing.repartition(shuffle_partitions(docs.sparkSession), "shard")
             .withColumn("_block", F.col("prints").isNull()).sortWithinPartitions("shard", "_block")
             .mapInArrow(_probe, "doc bigint, gone binary"))
    return found.groupBy("doc").agg(F.collect_list("gone").alias("gone"))


def _cleaned(texts: pa.Array, gone: pa.Array) -> pa.Array:
    out, n_lines, n_dropped = [], [], []
    for text, packed in zip(utf8(texts), gone.to_pylist()):
        if not packed:
            out.append(text)
            n_lines.append(text.count(b"\n") + 1)
            n_dropped.append(0)
            continue
        drop = {block[i:i + 16] for block in packed for i in range(0, len(block), 16)}
        lines = text.split(b"\n")
        kept = [line for line, h in zip(lines, _hashes(text)) if h is None or h not in drop]
        out.append(b"\n".join(kept))
        n_lines.append(len(lines))
        n_dropped.append(len(lines) - len(kept))
    return pa.StructArray.from_arrays(
        [pa.array(out, pa.binary()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], ["kept", "n_lines", "n_dropped"])


def dedup_lines(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` with ``text`` rid of repeated lines, plus ``_n_lines`` and ``_n_dropped``.

    A line's key is the line without ASCII white space at its ends, A-Z in lower case. A key of at least
    ten code points that two documents hold loses all its lines but those in the smallest doc_id holding
    it; within that document repeats stay. A null or empty text is one empty line. Rows with the same
    doc_id are one document; a null doc_id is greater than all others, and rows without an id are one
    document. An empty table gives an empty one; other columns pass through untouched, but for
    ones named ``_n_lines`` or ``_n_dropped``, which are replaced.
    """
    narrow = docs.select(id_key().alias("doc"), "text")
    index, shards = line_index(narrow)
    key, gone, done = (free_name(docs, n) for n in ("_doc", "_gone", "_cleaned"))
    drops = lines_to_drop(narrow, index, shards).select(F.col("doc").alias(key), F.col("gone").alias(gone))
    joined = docs.withColumn(key, id_key()).join(drops, key, "left")
    cleaned = joined.withColumn(done, text_udf(_cleaned, "struct<kept:binary,n_lines:bigint,n_dropped:bigint>")(F.col("text"), F.col(gone)))
    return cleaned.select(*[F.when(F.col("text").isNotNull(), F.col(f"{done}.kept").cast("string")).alias("text") if c == "text" else F.col(c)
                            for c in docs.columns if c not in ("_n_lines", "_n_dropped")],
                          F.col(f"{done}.n_lines").alias("_n_lines"), F.col(f"{done}.n_dropped").alias("_n_dropped"))
