"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of at most 23 bits. The binary Golay code (23, 12) gives
every 23-bit word one nearest codeword, and so a 12-bit index. Of three segments with three wrong bits in
all, two have at most one wrong bit each, so a pair of segments is the key: in one of the two a text offers
the index of every word one bit away (at most a handful of different ones), in the other just its own.
Two texts that are linked share such a key for certain; what shares a key is then verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.llm.common import forest, shuffle_partitions, stored, text_udf, utf8
from tallymill.llm.components import components

SHINGLE = 3
SEED = 42
MAX_BITS = 3
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Rows of one key that a task compares with each other; a larger key is cut into tiles.
TILE = 4096
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: bytes) -> int:
    """Bit i is set if it is set in over half of the shingles' hashes; no word gives zero."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - SHINGLE + 1
    if n < 2:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:n - 1])).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts, (ends[SHINGLE - 1:] - 1).tolist())], np.uint64)
    columns = hashes.astype("<u8").view(np.uint8).reshape(n, 8)
    counts = np.concatenate([np.bincount(columns[:, i], minlength=256) @ _BYTE_BITS for i in range(8)])
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def _fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array(np.array([fingerprint(t) for t in utf8(texts)], np.uint64).astype(np.int64))


def _golay_errors() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low and the high part of a word, and the error pattern of each syndrome."""
    poly = 0b101011100011  # generator of the (23, 12) code

    def syndrome(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= poly << (bit - 11)
        return word

    single = [syndrome(1 << i) for i in range(23)]
    errors = np.zeros(2048, np.int64)
    for i in range(23):
        errors[single[i]] = 1 << i
        for j in range(i):
            errors[single[i] ^ single[j]] = 1 << i | 1 << j
            for k in range(j):
                errors[single[i] ^ single[j] ^ single[k]] = 1 << i | 1 << j | 1 << k
    low = np.array([syndrome(x) for x in range(4096)])
    high = np.array([syndrome(x << 12) for x in range(2048)])
    return low, high, errors


_LOW, _HIGH, _ERRORS = _golay_errors()


def golay_index(words: np.ndarray) -> np.ndarray:
    """12-bit index of the codeword nearest to each 23-bit word (three wrong bits or fewer)."""
    return (words ^ _ERRORS[_LOW[words & 0xFFF] ^ _HIGH[words >> 12]]) >> 11


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for every key of every fingerprint, each key once a fingerprint."""
    near, own = [], []
    for start, width in SEGMENTS:
        word = ((prints >> np.uint64(start)) & np.uint64((1 << width) - 1)).astype(np.int64)
        flips = np.array([0] + [1 << i for i in range(width)])
        near.append(golay_index(word[:, None] ^ flips[None, :]))
        own.append(near[-1][:, 0])
    rows, keys = [], []
    for p, (i, j) in enumerate(PAIRS):
        both = np.concatenate([near[i] << 12 | own[j][:, None], own[i][:, None] << 12 | near[j]], axis=1)
        both.sort(axis=1)
        first = np.ones(both.shape, bool)
        first[:, 1:] = both[:, 1:] != both[:, :-1]
        at = np.nonzero(first)
        rows.append(at[0])
        keys.append(both[at] | p << 24)
    return np.concatenate(rows), np.concatenate(keys)


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        signed = batch.column(0).to_numpy()
        for at in range(0, len(signed), 4096):
            part = signed[at:at + 4096]
            rows, keys = fuzzy_keys(part.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array(part[rows])], ["key", "fp"])


def _linked(prints: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of one group that differ in at most MAX_BITS bits. ``group`` is sorted."""
    edges = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
    sizes = np.diff(edges)
    left, right = [], []
    small = np.repeat(sizes <= 64, sizes)
    for shift in range(1, int(sizes[sizes <= 64].max(initial=1))):
        near = (group[shift:] == group[:-shift]) & small[shift:]
        near &= np.bitwise_count(prints[shift:] ^ prints[:-shift]) <= MAX_BITS
        at = np.flatnonzero(near)
        left.append(at)
        right.append(at + shift)
    for g in np.flatnonzero(sizes > 64):
        begin, end = edges[g], edges[g + 1]
        label = np.arange(end - begin)
        for at in range(begin, end, 256):  # a few rows against the whole group: memory stays small
            stop = min(at + 256, end)
            a, b = np.nonzero(np.bitwise_count(prints[at:stop, None] ^ prints[None, begin:end]) <= MAX_BITS)
            root = forest(label[a + (at - begin)], label[b], len(label))
            label = root[label]
        left.append(np.arange(begin, end))
        right.append(label + begin)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, int), np.empty(0, int))


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that join the same texts as all pairs of each key would; rows come sorted by key and tile."""
    held_group, held = np.empty(0, np.int64), np.empty(0, np.uint64)

    def out(group, prints):
        a, b = _linked(prints, group)
        different = prints[a] != prints[b]
        a, b = a[different], b[different]
        touched, index = np.unique(np.concatenate((prints[a], prints[b])), return_inverse=True)
        root = forest(index[:len(a)], index[len(a):], len(touched))
        off = root != np.arange(len(touched))
        return pa.RecordBatch.from_arrays([pa.array(touched[off].view(np.int64)), pa.array(touched[root[off]].view(np.int64))], ["a", "b"])

    for batch in batches:
        key, tile, fp = (batch.column(i).to_numpy() for i in range(3))
        group = np.concatenate((held_group, key.astype(np.int64) << 32 | tile))
        prints = np.concatenate((held, fp.view(np.uint64)))
        if not len(group):
            continue
        last = np.searchsorted(group, group[-1])
        held_group, held = group[last:], prints[last:]
        if last:
            yield out(group[:last], prints[:last])
    if len(held):
        yield out(held_group, held)


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """(a, b) for different fingerprints of ``prints`` (column fp, each once): enough links to join whatever
    differs in at most MAX_BITS bits.

    Keys are counted before they are dealt out. A key with more than TILE rows is cut into blocks, and
    each pair of blocks is a tile of its own, so no task holds more than two blocks of one key.
    """
    keys = prints.select("fp").mapInArrow(_key_rows, "key int, fp bigint")
    heavy = (keys.groupBy("key").count().filter(F.col("count") > TILE)
             .select("key", F.ceil(F.col("count") / TILE).cast("int").alias("blocks")))
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda c: F.least(block, c) * F.col("blocks") + F.greatest(block, c))
    dealt = keys.join(heavy, "key", "left").select(
        "key", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(tiles)).alias("tile"), "fp")
    return (dealt.repartition("key", "tile").sortWithinPartitions("key", "tile").mapInArrow(_links, "a bigint, b bigint"))


def simhash_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) per row of ``docs``: fp is the fingerprint as a signed bigint, component_id
    the smallest doc_id reachable over links of at most MAX_BITS bits.

    Null, empty and blank texts have fingerprint zero and are linked like any other. Equal fingerprints are
    reduced to one before anything is compared, so copies cost nothing, however many there are. Rows
    with a null doc_id take part but name no group; a group of such rows alone has a null component_id.
    Rows with the same doc_id keep their own fingerprints. Other columns are not read.
    """
    rows = stored(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                              text_udf(_fingerprints, "bigint")(F.col("text")).alias("fp")), "fingerprints")
    prints = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    spread = prints.repartition(shuffle_partitions(docs.sparkSession), "fp")
    roots = components(fingerprint_links(spread)).withColumnRenamed("node", "fp")
    joined = stored(prints.join(roots, "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root")), "classes")
    named = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = joined.join(named, "root").select("fp", "component_id")
    return rows.join(classes, "fp", "left").select("doc_id", "fp", "component_id")


def fingerprint_hex(fp):
    """The fingerprint as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
