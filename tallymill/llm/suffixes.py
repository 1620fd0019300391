"""Suffix-array removal of long repeated byte strings, by difference covers.

Two texts share a string of W bytes only if they share the string's anchor: its G-byte gram with the least
hash, the first of equal ones. Anchors of grams found once rule out all windows they stand for; the other
windows are kept as contexts, the bytes around an anchor from the first window that has it to the last.
Contexts of one gram make a family, families are dealt to shards, so equal windows always meet in one
shard whatever the number of texts. A shard sorts the suffixes of its contexts with a difference cover
modulo three: triples at the places 1 and 2 are sorted and named, the names are sorted by the same rule
until they are unique or cover W bytes, the places 0 are merged in by (symbol, rank) and (symbol, symbol,
rank), and neighbours in the order are compared on their W bytes.

Equal contexts are one row with a count, so copies cost nothing. A family that is still too big for a shard
is cut by the distance from window to anchor: each part has more bytes in common, by which it is dealt
again, down to single windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.llm.common import free_name, id_key, stored, text_udf, utf8
from tallymill.plans.skew import lookup_join

WINDOW, GRAM = 400, 128
#: Bytes of contexts that one shard takes, and of a family that is not cut.
SHARD_BYTES, FAMILY_BYTES = 1 << 20, 1 << 19
#: Ranges of distances that such a family is cut in at once; a round of cutting costs the same number of jobs however many.
PARTS = 4
#: Bytes of text whose grams are hashed together; a longer text is cut with windows overlapping.
CHUNK = 1 << 20
_A, _B, _S = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(29)
_PLACE = np.uint64((1 << 24) - 1)
ANCHOR = np.dtype([("g", "<i8"), ("at", "<i4"), ("lo", "<i4"), ("hi", "<i4")])


# --- anchors --------------------------------------------------------------------------------------

def _gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes from every place on; ``size`` is a power of two."""
    h = (data.astype(np.uint64) + np.uint64(1)) * _A
    width = 1
    while width < size:
        h = h[:-width] * _A + h[width:] * _B
        h ^= h >> _S
        width *= 2
    return h * _B


def _least(keys: np.ndarray, span: int) -> np.ndarray:
    """Minimum of every ``span`` keys in a row, from the running minima of blocks to both sides."""
    n = len(keys) - span + 1
    padded = np.full(-(-len(keys) // span) * span, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(keys)] = keys
    blocks = padded.reshape(-1, span)
    down = np.minimum.accumulate(blocks, axis=1).ravel()
    up = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(up[:n], down[span - 1:span - 1 + n])


def _chunk_anchors(data: np.ndarray) -> np.ndarray:
    """(gram, its place, first window, last window) of the anchors of all windows of ``data``."""
    hashes = _gram_hashes(data, GRAM)
    keys = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    at = (_least(keys, WINDOW - GRAM + 1) & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    out = np.empty(len(first), ANCHOR)
    out["g"], out["at"] = hashes[at[first]].view(np.int64), at[first]
    out["lo"], out["hi"] = first, np.concatenate((first[1:], [len(at)])) - 1
    return out


def anchors(texts: list[bytes]) -> list[np.ndarray]:
    """The anchors of every text; none for a text of fewer than WINDOW bytes."""
    out = [np.zeros(0, ANCHOR)] * len(texts)
    i = 0
    while i < len(texts):
        if len(texts[i]) > CHUNK:
            data, parts = np.frombuffer(texts[i], np.uint8), []
            for begin in range(0, len(data) - WINDOW + 1, CHUNK):
                part = _chunk_anchors(data[begin:begin + CHUNK + WINDOW - 1])
                for field in ("at", "lo", "hi"):
                    part[field] += begin
                parts.append(part)
            out[i] = np.concatenate(parts)
            i += 1
            continue
        group, total = [], 0
        while i < len(texts) and len(texts[i]) <= CHUNK and (not group or total + len(texts[i]) <= CHUNK):
            if len(texts[i]) >= WINDOW:
                group.append(i)
                total += len(texts[i])
            i += 1
        if not group:
            continue
        found = _chunk_anchors(np.frombuffer(b"".join(texts[j] for j in group), np.uint8))
        ends = np.cumsum([len(texts[j]) for j in group])
        begins = ends - [len(texts[j]) for j in group]
        # Windows that cross into the next text are none; an anchor's windows may lie in two texts.
        cuts = np.searchsorted(found["lo"], begins, "right") - 1
        for j, begin, end, cut in zip(group, begins.tolist(), ends.tolist(), cuts.tolist()):
            last = int(np.searchsorted(found["lo"], end - WINDOW, "right"))
            own = found[cut:last].copy()
            own["lo"] = np.maximum(own["lo"], begin)
            own["hi"] = np.minimum(own["hi"], end - WINDOW)
            for field in ("at", "lo", "hi"):
                own[field] -= begin
            out[j] = own
    return out


def _packed_anchors(texts: pa.Array) -> pa.Array:
    return pa.array([a.tobytes() for at in range(0, len(texts), 512) for a in anchors(utf8(texts.slice(at, 512)))], pa.binary())


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = batch.column(2).to_pylist()
        sizes = np.array([len(p) // ANCHOR.itemsize for p in packed], np.int64)
        rows = np.frombuffer(b"".join(packed), ANCHOR)
        own = np.repeat(np.arange(len(packed)), sizes)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own)), batch.column(1).take(pa.array(own)),
                                          *[pa.array(rows[f].astype(np.int64)) for f in ("g", "at", "lo", "hi")]],
                                         ["t1", "t2", "g", "at", "lo", "hi"])


# --- difference cover -------------------------------------------------------------------------------

def _names(*columns: np.ndarray) -> np.ndarray:
    """Dense names, from 1, of rows of non-negative integers, in the rows' order."""
    names = columns[0].astype(np.uint64)
    for column in columns[1:]:
        top = int(column.max()) + 1
        if int(names.max()) > (1 << 63) // top:
            names = _names(names).astype(np.uint64)
        names = names * np.uint64(top) + column.astype(np.uint64)
    order = np.argsort(names)
    ordered = names[order]
    out = np.empty(len(names), np.int64)
    out[order] = np.cumsum(np.concatenate(([1], ordered[1:] != ordered[:-1])))
    return out


def ranks(symbols: np.ndarray, cover: int) -> np.ndarray:
    """Rank of the suffix at every place: suffixes that differ within ``cover`` symbols are in the order of the first
    such difference; others may share a rank. Symbols are positive; beyond the end stands 0.

    Difference cover {1, 2} modulo 3: the sampled suffixes are ranked by recursion on the names of their triples.
    """
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    s = np.concatenate((symbols, np.zeros(3, symbols.dtype)))
    if n < 3 or cover <= 1:
        return _names(s[:n], s[1:n + 1])
    one, two = np.arange(1, n, 3), np.arange(2, n, 3)
    sample = np.concatenate((one, two))
    names = _names(s[sample], s[sample + 1], s[sample + 2])
    if names.max() < len(sample) and cover > 3:
        # A least symbol between the parts ends the suffixes of the first.
        parts = ranks(np.concatenate((names[:len(one)] + 1, [1], names[len(one):] + 1)), -(-cover // 3) + 1)
        names = np.concatenate((parts[:len(one)], parts[len(one) + 1:]))
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = names
    zero = np.arange(0, n, 3)
    # Places 0 against places 1 by (symbol, rank of the next), against places 2 by (symbol, symbol, rank of the second
    # next): those places are sampled. A place's rank counts what is less among its own kind and the two others.
    first = _names(np.concatenate((s[zero], s[one])), np.concatenate((rank[zero + 1], rank[one + 1])))
    second = _names(*(np.concatenate(pair) for pair in ((s[zero], s[two]), (s[zero + 1], s[two + 1]), (rank[zero + 2], rank[two + 2]))))
    zero_first, zero_second = first[:len(zero)], second[:len(zero)]
    out = np.empty(n, np.int64)
    out[zero] = _less(zero_first, zero_first) + _less(first[len(zero):], zero_first) + _less(second[len(zero):], zero_second)
    out[one] = _less(names, names[:len(one)]) + _less(zero_first, first[len(zero):])
    out[two] = _less(names, names[len(one):]) + _less(zero_second, second[len(zero):])
    return out + 1


def _less(among: np.ndarray, values: np.ndarray) -> np.ndarray:
    """How many of ``among`` are less than each of ``values``; both are positive integers of bounded size."""
    if not len(values):
        return np.zeros(0, np.int64)
    top = int(max(values.max(), among.max(initial=0)))
    return np.cumsum(np.bincount(among, minlength=top + 1))[values - 1]


def repeated_windows(data: np.ndarray, valid: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Which of the ``valid`` places start a string of ``width`` bytes that starts at another valid place too."""
    order = np.argsort(ranks(data.astype(np.int64) + 1, width))
    order = order[valid[order]]
    a, b = order[:-1], order[1:]
    pairs = np.arange(len(a))
    words = np.lib.stride_tricks.sliding_window_view(data, 8).copy().view(np.uint64).ravel()
    for step in (width - 8, *range(0, width - 8, 8)):
        pairs = pairs[words[a[pairs] + step] == words[b[pairs] + step]]
    out = np.zeros(len(data), bool)
    out[a[pairs]] = True
    out[b[pairs]] = True
    return out


# --- contexts and families ----------------------------------------------------------------------------

def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes around every kept anchor, from its first window to its last."""
    for batch in batches:
        for row in range(batch.num_rows):
            t1, t2 = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
            text = utf8(batch.column(2).slice(row, 1))[0]
            spots = batch.column(3).slice(row, 1).flatten()
            g, at, lo, hi = (spots.field(f).to_numpy(zero_copy_only=False) for f in ("g", "at", "lo", "hi"))
            for i in range(0, len(g), 4096):
                part = slice(i, i + 4096)
                cut = [text[x:y + WINDOW] for x, y in zip(lo[part].tolist(), hi[part].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cut), t1)), pa.array(np.full(len(cut), t2)), pa.array(lo[part]), pa.array(g[part]),
                                                  pa.array(at[part] - hi[part]), pa.array(at[part] - lo[part]), pa.array(cut, pa.binary())],
                                                 ["t1", "t2", "lo", "family", "near", "far", "context"])


def _named(rows: DataFrame) -> DataFrame:
    """Contexts with their names c1, c2: equal contexts of a family have equal names."""
    return rows.withColumns({f"c{i}": F.xxhash64(F.lit(i), "family", "near", "far", "context") for i in (1, 2)})


def _distinct(rows: DataFrame) -> DataFrame:
    return rows.groupBy("c1", "c2").agg(*[F.any_value(c).alias(c) for c in ("family", "near", "far", "least", "most", "context")], F.sum("n").alias("n"))


def _parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts cut by their family's distances in PARTS equal ranges; a part's family is what all its windows have in common."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            far, context = row["far"], row["context"]
            cuts = [row["least"] + (row["most"] + 1 - row["least"]) * i // PARTS for i in range(PARTS + 1)]
            for least, most in zip(cuts, (c - 1 for c in cuts[1:])):
                lo, hi = max(row["near"], least), min(far, most)
                if lo > hi:
                    continue
                common = hashlib.blake2b(context[far - least:far + WINDOW - most], digest_size=8, key=b"%d %d %d" % (row["family"], least, most))
                out.append({"p1": row["c1"], "p2": row["c2"], "shift": far - hi, "family": int.from_bytes(common.digest(), "little", signed=True),
                            "near": lo, "far": hi, "least": least, "most": most, "context": context[far - hi:far - lo + WINDOW], "n": row["n"]})
        yield pa.RecordBatch.from_pylist(out, _PART)


_PART = pa.schema([(c, pa.int64()) for c in ("p1", "p2", "shift", "family", "near", "far", "least", "most")] + [("context", pa.binary()), ("n", pa.int64())])
_PART_TYPE = ", ".join(f"{f.name} {'binary' if f.name == 'context' else 'bigint'}" for f in _PART)


def _runs(flags: np.ndarray) -> np.ndarray:
    """(first, last) of the stretches of set flags."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
    return np.stack((edges[::2], edges[1::2] - 1), axis=1).astype("<i8")


def _shard_spans(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """(c1, c2, windows): stretches of windows of a shard's contexts that are found at two places or more."""
    contexts = table.column("context").to_pylist()
    data = np.frombuffer(b"".join(contexts), np.uint8)
    sizes = np.array([len(c) for c in contexts])
    ends = np.cumsum(sizes)
    valid = np.ones(len(data), bool)
    for end in ends.tolist():
        valid[end - WINDOW + 1:end] = False
    flags = repeated_windows(data, valid)
    rows = [(c1, c2, _runs(flags[end - size:end - WINDOW + 1])) for c1, c2, end, size in
            zip(table.column("c1").to_pylist(), table.column("c2").to_pylist(), ends.tolist(), sizes.tolist())]
    rows = [(a, b, r.tobytes()) for a, b, r in rows if len(r)]
    return pa.table({"c1": pa.array([r[0] for r in rows], pa.int64()), "c2": pa.array([r[1] for r in rows], pa.int64()),
                     "windows": pa.array([r[2] for r in rows], pa.binary())})


_SPANS = "c1 bigint, c2 bigint, windows binary"


def _shifted(shifts: pa.Array, windows: pa.Array) -> pa.Array:
    """Stretches of windows of several cuts, moved to the places of what they were cut from and joined."""
    out = []
    for moves, stretches in zip(shifts.to_pylist(), windows.to_pylist()):
        out.append(b"".join((np.frombuffer(w, "<i8") + m).tobytes() for m, w in zip(moves, stretches)))
    return pa.array(out, pa.binary())


def _moved(rows: DataFrame, by: list[str], shift: str) -> DataFrame:
    """One row of stretches per ``by``, from rows (by, shift, windows)."""
    lists = rows.groupBy(*by).agg(F.collect_list(F.struct(F.col(shift).alias("s"), "windows")).alias("_all"))
    return lists.select(*by, text_udf(_shifted, "binary")(F.col("_all.s"), F.col("_all.windows")).alias("windows"))


def _dealt_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join with a stored table of one row per key by shuffling both, hot keys salted: the same plan at every size."""
    return lookup_join(left, right, on, "inner", stored=True, limit=0)


def _repeated(contexts: DataFrame) -> DataFrame:
    """(c1, c2, windows) of stored distinct contexts: every stretch of windows that other places have too."""
    spark = contexts.sparkSession
    whole = contexts.filter("n > 1").select("c1", "c2", _all_windows(F.octet_length("context") - WINDOW).alias("windows"))
    families = stored(contexts.groupBy("family").agg(F.sum(F.octet_length("context")).alias("bytes"), F.count("*").alias("members"),
                                                     F.any_value(F.col("most") - F.col("least")).alias("wide")).filter("members > 1"), "families")
    rows = _dealt_join(contexts, families, ["family"])
    hot = (F.col("bytes") > FAMILY_BYTES) & (F.col("wide") > 0)
    size = families.filter(~hot).agg(F.sum("bytes")).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    dealt = rows.filter(~hot).select(F.pmod(F.xxhash64("family"), F.lit(shards)).alias("shard"), "c1", "c2", "context")
    found = dealt.groupBy("shard").applyInArrow(_shard_spans, _SPANS)
    if not families.filter(hot).isEmpty():
        columns = ["c1", "c2", "family", "near", "far", "least", "most", "context", "n"]
        parts = stored(_named(rows.filter(hot).select(*columns).mapInArrow(_parted, _PART_TYPE)), "parts")
        inner = _repeated(stored(_distinct(parts), "part-contexts"))
        links = lookup_join(parts.select("p1", "p2", "shift", "c1", "c2"), inner, ["c1", "c2"], "inner")
        found = found.unionByName(_moved(links, ["p1", "p2"], "shift").withColumnsRenamed({"p1": "c1", "p2": "c2"}))
    return stored(_moved(whole.unionByName(found).withColumn("zero", F.lit(0).cast("bigint")), ["c1", "c2"], "zero"), "repeated-windows")


def _all_windows(last: Column) -> Column:
    """The stretch of the windows 0 to ``last`` as it is packed."""
    return text_udf(lambda x: pa.array([np.array([0, v], "<i8").tobytes() for v in x.to_pylist()], pa.binary()), "binary")(last.cast("bigint"))


_REMOVED = "array<struct<start:bigint,length:bigint>>"


def _byte_spans(starts: pa.Array, windows: pa.Array) -> pa.Array:
    """Maximal removed stretches of bytes of every text."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
    out = []
    for moves, stretches in zip(starts.to_pylist(), windows.to_pylist()):
        both = np.concatenate([np.frombuffer(w, "<i8").reshape(-1, 2) + m for m, w in zip(moves, stretches)])
        both = both[np.argsort(both[:, 0], kind="stable")]
        first, last = both[:, 0], np.maximum.accumulate(both[:, 1] + WINDOW)
        new = np.concatenate(([True], first[1:] > last[:-1]))
        begin = np.flatnonzero(new)
        end = last[np.concatenate((begin[1:], [len(first)])) - 1]
        out.append([{"start": s, "length": e - s} for s, e in zip(first[begin].tolist(), end.tolist())])
    return pa.array(out, kind)


def repeated_bytes(docs: DataFrame) -> DataFrame:
    """(t1, t2, spans): for every text of (doc_id, text) with bytes to remove, named by its two hashes, its
    maximal stretches of bytes covered by strings of WINDOW bytes that start elsewhere too."""
    texts = _hashed(docs)
    prints = texts.filter(F.octet_length("text") >= WINDOW).select("doc", "t1", "t2", F.octet_length("text").cast("bigint").alias("size"),
                                                                   text_udf(_packed_anchors, "binary")(F.col("text")).alias("anchors"))
    classes = stored(prints.groupBy("t1", "t2").agg(F.min("doc").alias("rep"), F.count("*").alias("copies"), F.any_value("size").alias("size"),
                                                    F.any_value("anchors").alias("anchors")), "text-classes")
    spots = classes.select("t1", "t2", "anchors").mapInArrow(_unpacked, "t1 bigint, t2 bigint, g bigint, at bigint, lo bigint, hi bigint")
    again = stored(spots.groupBy("g").count().filter("count > 1").select("g"), "grams")
    kept = _dealt_join(spots, again, ["g"]).groupBy("t1", "t2").agg(F.collect_list(F.struct("g", "at", "lo", "hi")).alias("spots"))
    kept = stored(kept.join(classes.select("t1", "t2", "rep"), ["t1", "t2"]), "spots")
    held = _dealt_join(texts, kept, ["t1", "t2"]).filter("doc = rep").select("t1", "t2", "text", "spots")
    whole = stored(_named(held.mapInArrow(_contexts, "t1 bigint, t2 bigint, lo bigint, family bigint, near bigint, far bigint, context binary")), "contexts")
    ones = whole.withColumns({"least": F.lit(0).cast("bigint"), "most": F.lit(WINDOW - GRAM).cast("bigint"), "n": F.lit(1).cast("bigint")})
    found = _repeated(stored(_distinct(ones), "distinct-contexts"))
    places = _dealt_join(whole.select("t1", "t2", "lo", "c1", "c2"), found, ["c1", "c2"])
    lists = places.groupBy("t1", "t2").agg(F.collect_list(F.struct("lo", "windows")).alias("_all"))
    parts = lists.select("t1", "t2", text_udf(_byte_spans, _REMOVED)(F.col("_all.lo"), F.col("_all.windows")).alias("spans"))
    copies = classes.filter("copies > 1").select("t1", "t2", F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("size").alias("length"))).alias("spans"))
    parts = parts.join(copies.select("t1", "t2"), ["t1", "t2"], "left_anti")
    return stored(parts.unionByName(copies), "removed")


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.select(id_key().alias("doc"), *[F.xxhash64(F.lit(i), "text").alias(f"t{i}") for i in (1, 2)], "text")


def _cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for text, gone in zip(utf8(texts), spans.to_pylist()):
        if gone:
            ends = [0, *(s["start"] + s["length"] for s in gone)]
            text = b"".join(text[e:s] for e, s in zip(ends, [*(s["start"] for s in gone), len(text)]))
        out.append(text)
    return pa.array(out, pa.binary())


def remove_repeats(docs: DataFrame, name: str = "_repeats") -> DataFrame:
    """All columns of ``docs`` plus ``name``: a struct of ``spans`` (start, length), the maximal stretches of bytes
    that are covered by a string of WINDOW bytes found at another place too, in the same text or another, and
    ``kept``, the bytes left (binary: a cut may fall inside a character).

    Every copy goes, as the other place is judged on the input. A null text is empty; texts below WINDOW bytes,
    null and empty ones stay as they are; rows without an id and repeated rows are rows like any other, so two equal
    rows are each other's repeat. Texts of any length are taken whole. An empty table gives an empty one; an input
    column called ``name`` is replaced.
    """
    gone = repeated_bytes(docs.select("doc_id", "text"))
    h1, h2, spans = (free_name(docs, c) for c in ("_t1", "_t2", "_spans"))
    keyed = docs.withColumns({h1: F.xxhash64(F.lit(1), "text"), h2: F.xxhash64(F.lit(2), "text")})
    joined = lookup_join(keyed, gone.withColumnsRenamed({"t1": h1, "t2": h2, "spans": spans}), [h1, h2], "left", stored=True)
    rest = [c for c in docs.columns if c.lower() != name.lower()]
    none = F.array().cast(_REMOVED)
    return joined.select(*rest, F.struct(F.coalesce(spans, none).alias("spans"),
                                         text_udf(_cut, "binary")(F.col("text"), F.col(spans)).alias("kept")).alias(name))
