"""Prefix trie of conversations by vertical bitmaps.

Conversations are numbered in order of their id and cut into blocks, positions are cut into parts. A
shard is one block and one part: an index from (position, turn) to the bitset of the block's
conversations that have this turn there. Depth first, a node's bitset is intersected with the postings
of the next position; what is left is a child. Shards are bounded whatever the number or length of
conversations, and a hot prefix is a few bitsets in every block. A node is named by the xor of the
128-bit hashes of its (position, turn) pairs, so nodes of different shards meet by name, and a shard in
the middle of long conversations knows its nodes without the parts before it.

Sums over subtrees need no walk: a node's value is charged to its smallest member, and a subtree's sum
is what the members of its top were charged, less what the top's own smallest member was charged
nearer to the root.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.llm.common import stored
from tallymill.plans.ordered import OrderedRows, global_number
from tallymill.plans.skew import lookup_join

#: Conversations of a block, and positions of a part: a shard has at most BLOCK * PART turns.
BLOCK, PART = 1024, 64
#: Node rows whose bitsets are unpacked together.
UNPACKED = 2048
NODE = ("block bigint, part bigint, k1 bigint, k2 bigint, p1 bigint, p2 bigint, depth bigint, n_chars bigint, n_convs bigint, "
        "conv_id bigint, members binary, ends binary")
SUMS = "k1 bigint, k2 bigint, charged bigint, leaves bigint"
DIGESTS = "k1 bigint, k2 bigint, ends_sha256 string"


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, t1, t2, n_chars): every conversation's turns numbered from 0 by ``turn``, null first; of
    equal turns by role, then by the hash of role and text. t1 and t2 hash (role, text); a null role or text is
    empty. Rows without a conv_id belong to no conversation and go. Texts do not leave the scan."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").isNotNull().cast("int").alias("_known"),
        F.coalesce(F.col("turn").cast("bigint"), F.lit(0)).alias("_turn"), role.alias("_role"),
        *[F.xxhash64(F.lit(seed), role, text).alias(name) for seed, name in ((11, "t1"), (23, "t2"))],
        F.length(text).cast("bigint").alias("n_chars"))
    placed = OrderedRows(rows, ["conv_id"], ["_known", "_turn", "_role", "t1", "t2"]).number("_n").df
    return placed.select("conv_id", (F.col("_n") - 1).alias("place"), "t1", "t2", "n_chars")


def rebuilt(turns: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(turns, lengths): conversation c with its first h turns replaced by those of conversation c - c % group;
    h is the crc32 of the decimal c modulo ``most``; a
    negative id has a negative remainder, as in SQL. ``lengths`` has (conv_id, n_turns) of every conversation,
    also of those left without turns."""
    turns = stored(turns, "turns")
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    heads = (turns.filter((F.col("conv_id") % group == 0) & (F.col("place") < most - 1))
             .groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("place", "t1", "t2", "n_chars"))).alias("head")))
    convs = sizes.withColumns({"base": F.col("conv_id") - F.col("conv_id") % group,
                               "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % most})
    convs = stored(convs.join(heads, "base", "left").withColumn(
        "head", F.slice(F.coalesce("head", F.array()), F.lit(1), F.col("h").cast("int"))).withColumn(
        "m", F.size("head").cast("bigint")), "heads")
    taken = convs.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.*")
    own = (lookup_join(turns, convs.select("conv_id", "h", "m"), ["conv_id"], "inner", stored=True).filter("place >= h")
           .select("conv_id", (F.col("place") - F.col("h") + F.col("m")).alias("place"), "t1", "t2", "n_chars"))
    lengths = convs.select("conv_id", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns"))
    return taken.unionByName(own), lengths


# --- shards ---------------------------------------------------------------------------------------

def _shard_rows(turns: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, places): the turns and the entry points of every shard, and the block and bit of every conversation.

    An entry row (position -1) says that a conversation enters the shard, with the name of the node it comes
    from, its id and its number of turns.
    """
    numbered = global_number(lengths, ["conv_id"], "_no")
    places = stored(numbered.select("conv_id", "n_turns", F.expr(f"(_no - 1) div {BLOCK}").alias("block"), F.expr(f"(_no - 1) % {BLOCK}").alias("bit")), "places")
    named = turns.select("conv_id", F.expr(f"place div {PART}").alias("part"), F.col("place").alias("at"),
                         *[F.xxhash64(F.lit(seed), "place", "t1", "t2").alias(name) for seed, name in ((5, "a1"), (7, "a2"))], "n_chars")
    named = stored(lookup_join(named, places.drop("n_turns"), ["conv_id"], "inner", stored=True), "named-turns")
    parts = named.groupBy("conv_id", "part").agg(F.bit_xor("a1").alias("x1"), F.bit_xor("a2").alias("x2"))
    nodes = (OrderedRows(parts, ["conv_id"], ["part"]).scan(exclusive=True, a1=("bit_xor", F.col("x1")), a2=("bit_xor", F.col("x2")))
             .df.select("conv_id", "part", F.coalesce("a1", F.lit(0)).alias("a1"), F.coalesce("a2", F.lit(0)).alias("a2")))
    zero = F.lit(0).cast("bigint")
    nodes = nodes.unionByName(places.filter("n_turns = 0").select("conv_id", zero.alias("part"), zero.alias("a1"), zero.alias("a2")))
    entries = (lookup_join(nodes, places, ["conv_id"], "inner", stored=True)
               .withColumn("at", F.lit(-1).cast("bigint")).withColumnRenamed("n_turns", "n_chars"))
    columns = ["block", "part", "bit", "at", "a1", "a2", "n_chars", "conv_id"]
    return named.select(columns).unionByName(entries.select(columns)), places


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _bits(members: int) -> Iterator[int]:
    while members:
        low = members & -members
        yield low.bit_length() - 1
        members ^= low


def _shard(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """All trie nodes of one shard."""
    block, part = (k.as_py() for k in key)
    rows = zip(*(table.column(c).to_pylist() for c in ("bit", "at", "a1", "a2", "n_chars", "conv_id")))
    postings: dict[tuple[int, int, int], int] = defaultdict(int)
    turn_of: dict[tuple[int, int], tuple[int, int]] = {}
    chars: dict[tuple[int, int, int], int] = {}
    present: dict[int, int] = defaultdict(int)
    over: dict[int, int] = defaultdict(int)
    entering: dict[tuple[int, int], int] = defaultdict(int)
    conv: dict[int, int] = {}
    for bit, at, a1, a2, n, c in rows:
        if at < 0:
            entering[a1, a2] |= 1 << bit
            over[n] |= 1 << bit
            conv[bit] = c
        else:
            postings[at, a1, a2] |= 1 << bit
            turn_of[at, bit] = a1, a2
            chars[at, a1, a2] = n
            present[at] |= 1 << bit
    found: list[tuple] = []

    def found_node(k: tuple[int, int], p: tuple[int | None, int | None], depth: int, n: int, members: int) -> None:
        ends = np.fromiter((conv[b] for b in _bits(members & over[depth])), "<i8").tobytes()
        found.append((block, part, *k, *p, depth, n, members.bit_count(), conv[(members & -members).bit_length() - 1],
                      members.to_bytes(BLOCK // 8, "little"), ends or None))

    first = part * PART
    if part == 0 and entering:
        found_node((0, 0), (None, None), 0, 0, entering[0, 0])
    stack = [(k, members, first) for k, members in entering.items()]
    while stack:
        k, members, at = stack.pop()
        rest = members & present[at]
        while rest:
            a1, a2 = turn_of[at, (rest & -rest).bit_length() - 1]
            child = members & postings[at, a1, a2]
            rest &= ~child
            name = k[0] ^ a1, k[1] ^ a2
            found_node(name, k, at + 1, chars[at, a1, a2], child)
            if at + 1 < first + PART:
                stack.append((name, child, at + 1))
    columns = list(zip(*found)) or [()] * 12
    kinds = [pa.int64()] * 10 + [pa.binary()] * 2
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)],
                                ["block", "part", "k1", "k2", "p1", "p2", "depth", "n_chars", "n_convs", "conv_id", "members", "ends"])


def _charged(key: tuple[pa.Scalar, ...], nodes: pa.Table, charges: pa.Table) -> pa.Table:
    """What the members of every node of a shard were charged, in all."""
    value = np.zeros((BLOCK, 2), np.int64)
    for row in charges.column("charges").to_pylist():
        for charge in row:
            value[charge["bit"]] = charge["charged"], charge["leaves"]
    packed = nodes.column("members").combine_chunks().to_pylist()
    sums = [np.zeros((0, 2), np.int64)]
    for at in range(0, len(packed), UNPACKED):
        bitsets = np.frombuffer(b"".join(packed[at:at + UNPACKED]), np.uint8).reshape(-1, BLOCK // 8)
        sums.append(np.unpackbits(bitsets, axis=1, bitorder="little").astype(np.int64) @ value)
    total = np.concatenate(sums)
    return pa.table({"k1": nodes.column("k1"), "k2": nodes.column("k2"), "charged": total[:, 0], "leaves": total[:, 1]})


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the ids of every node, streamed block by block; rows come by node, then block."""
    last, digest = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"k1": last[0], "k2": last[1], "ends_sha256": digest.hexdigest()}],
                                          pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())]))

    for batch in batches:
        done = []
        for k1, k2, _, ends in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if (k1, k2) != last:
                if last is not None:
                    done.append(row())
                last, digest = (k1, k2), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(",".join(map(str, np.frombuffer(ends, "<i8").tolist())).encode())
        if done:
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
    if last is not None:
        yield row()


def prefix_trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row per distinct sequence of first turns of any conversation, the empty one included.

    turns    (conv_id, place, t1, t2, n_chars) with places 0, 1, ... in every conversation
    lengths  (conv_id, n_turns), one row for every conversation

    conv_id is the node's smallest member; n_convs its members; n_children, n_leaves (childless nodes of its subtree,
    itself included) and saved_tokens (over its subtree, members less one times the code points of the last text);
    ends_sha256 digests the decimal ids of the members that end there, ascending, comma-joined. Without conversations
    there is no node. Repeated conversations share all their nodes; a conversation may have any number of turns.
    """
    rows, places = _shard_rows(turns, lengths)
    shard_nodes = stored(rows.groupBy("block", "part").applyInArrow(_shard, NODE), "shard-nodes")
    nodes = shard_nodes.groupBy("k1", "k2").agg(*[F.min(c).alias(c) for c in ("p1", "p2", "depth", "conv_id")],
                                                F.max("n_chars").alias("n_chars"), F.sum("n_convs").alias("n_convs"))
    nodes = stored(nodes, "nodes")
    children = nodes.filter("p1 is not null").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["k1", "k2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    nodes = lookup_join(nodes, parents, ["p1", "p2"], "left")
    value, leaf = (F.col("n_convs") - 1) * F.col("n_chars"), (F.col("n_children") == 0).cast("bigint")
    nodes = stored(nodes.withColumns({"_value": value, "_leaf": leaf}), "valued-nodes")
    charges = (nodes.groupBy("conv_id").agg(F.sum("_value").alias("charged"), F.sum("_leaf").alias("leaves"))
               .join(places.drop("n_turns"), "conv_id").groupBy("block").agg(F.collect_list(F.struct("bit", "charged", "leaves")).alias("charges")))
    charges = (shard_nodes.select("block", "part").distinct().join(charges, "block")
               .select(F.col("block").alias("of_block"), F.col("part").alias("of_part"), "charges"))
    sums = (shard_nodes.select("block", "part", "k1", "k2", "members").groupBy("block", "part").cogroup(charges.groupBy("of_block", "of_part"))
            .applyInArrow(_charged, SUMS).groupBy("k1", "k2").agg(F.sum("charged").alias("charged"), F.sum("leaves").alias("n_leaves")))
    digests = (shard_nodes.filter("ends is not null").select("k1", "k2", "block", "ends").repartition("k1", "k2")
               .sortWithinPartitions("k1", "k2", "block").mapInArrow(_digests, DIGESTS))
    before = OrderedRows(nodes, ["conv_id"], ["depth"]).scan(exclusive=True, _before=("sum", F.col("_value"))).df
    full = before.join(sums, ["k1", "k2"]).join(digests, ["k1", "k2"], "left")
    return full.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                       (F.col("charged") - F.coalesce("_before", F.lit(0))).alias("saved_tokens"),
                       F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
