"""Periodic runs, suffix removal and conversation tries next to brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymill.llm import conversations, runs, suffixes
from tallymill.llm.queries import QUERIES
from tests.llm.test_operators import CLASHING, odd_rows

DIRECTORY = "/root/testdata/sf0.001"


# --- periodic runs --------------------------------------------------------------------------------

def plain_runs(words):
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            start = i - q
            while i < n and words[i] == words[i - q]:
                i += 1
            if i - start >= max(24, 3 * q):
                found.setdefault((start, i - start), q)
    return sorted((s, m, q) for (s, m), q in found.items())


def planted(rng):
    n, k = rng.randrange(0, 240), rng.choice([1, 2, 2, 3, 5, 40])
    words = [rng.randrange(k) for _ in range(n)]
    for _ in range(rng.randrange(4)):
        if n > 30:
            a, p, m = rng.randrange(n - 24), rng.randrange(1, 40), rng.randrange(24, 160)
            for i in range(a + p, min(n, a + m)):
                words[i] = words[i - p]
    return words


def test_runs_equal_brute_force_however_words_arrive():
    rng = random.Random(5)
    for _ in range(400):
        words = planted(rng)
        expected = plain_runs(words)
        whole, online, at = runs.SquareCatcher(), runs.SquareCatcher(), 0
        whole.append(np.array(words, np.int64))
        while at < len(words):
            step = rng.choice([1, 1, 2, 5, 40])
            online.append(np.array(words[at:at + step], np.int64))
            at += step
        assert whole.runs() == online.runs() == expected


def test_runs_do_not_cross_texts(monkeypatch):
    rng = random.Random(6)
    texts = [planted(rng) for _ in range(200)] + [[7] * 30, [7] * 30, [], [7] * 23]
    for size in (1, 500, 1 << 18):
        monkeypatch.setattr(runs, "BATCH_WORDS", size)
        assert runs.runs_of([np.array(t, np.int64) for t in texts]) == [plain_runs(t) for t in texts]


def test_runs_of_long_words_sequences_are_cheap():
    for period in (1, 7, 1000):
        catcher = runs.SquareCatcher()
        catcher.append(np.tile(np.arange(period), 300_000 // period))
        assert catcher.runs() == [(0, 300_000 // period * period, period)]


def expected_runs_row(doc, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    digest = hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest()
    kept = hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()
    return (doc, len(found), *(best or (None, None, None)), best and 1000 * best[1] // best[2], digest, kept)


def test_runs_query(spark):
    docs = spark.read.parquet(f"{DIRECTORY}/documents.parquet").filter("length(text) < 6000")
    rows = runs.digests(runs.find_runs(docs.select("doc_id", "text"), loops_by=F.col("doc_id").cast("string"))).collect()
    expected = {expected_runs_row(r["doc_id"], r["text"]) for r in docs.collect()}
    assert {tuple(r) for r in rows} == expected and any(r["n_runs"] for r in rows)
    whole = QUERIES["op11_periodic_runs"](spark, DIRECTORY)
    assert set(map(tuple, rows)) <= set(map(tuple, whole.collect()))
    assert whole.count() == spark.read.parquet(f"{DIRECTORY}/documents.parquet").count()


def test_runs_take_odd_rows(spark):
    docs = spark.createDataFrame([*odd_rows(), (20, "a b " * 5000), (21, "x\x1cy " * 30)], "doc_id bigint, text string").withColumns({c: F.lit(1) for c in [*CLASHING, "_runs", "runs"]})
    found = runs.find_runs(docs)
    assert set(found.columns) == set(docs.columns)
    by_id = {r["doc_id"]: r["_runs"] for r in found.filter("doc_id in (3, 4, 5, 20, 21)").collect()}
    assert [by_id[i]["collapsed"] for i in (3, 4, 5)] == [bytearray()] * 3 and by_id[20]["collapsed"] == b"a b"
    assert [tuple(r) for r in by_id[20]["runs"]] == [(0, 10_000, 2)] and [tuple(r) for r in by_id[21]["runs"]] == [(0, 30, 1)]
    assert runs.find_runs(docs.limit(0)).count() == 0


# --- suffix removal -------------------------------------------------------------------------------

def test_ranks_follow_the_first_symbols():
    rng = random.Random(7)
    for _ in range(300):
        n, k, cover = rng.randrange(0, 50), rng.choice([1, 2, 3]), rng.choice([1, 2, 3, 4, 7, 20, 1000])
        symbols = [rng.randrange(1, k + 1) for _ in range(n)]
        rank = suffixes.ranks(np.array(symbols, np.int64), cover)
        heads = [(symbols[i:] + [0] * n)[:cover] for i in range(n)]
        assert all(rank[i] < rank[j] for i in range(n) for j in range(n) if heads[i] < heads[j])


def plain_removal(texts, width=suffixes.WINDOW):
    count = Counter(t[i:i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - width + 1):
            if count[t[i:i + width]] > 1:
                gone[i:i + width] = b"\1" * width
        spans = sum(1 for i in range(len(t)) if gone[i] and (not i or not gone[i - 1]))
        out.append((bytes(c for c, g in zip(t, gone) if not g), sum(gone), spans))
    return out


def passages(rng):
    """Texts with shared passages of about WINDOW bytes, copies, loops, one passage shared by a third of them."""
    def some(n):
        return "".join(rng.choice("abcde é") for _ in range(n))

    shared = [some(rng.randrange(380, 900)) for _ in range(6)]
    hot, texts = some(700), []
    for i in range(90):
        parts = [some(rng.randrange(0, 500))]
        if i % 3 == 0:
            parts.append(hot[:rng.randrange(395, 700)])
        if rng.random() < 0.4:
            parts += [rng.choice(shared)[rng.randrange(0, 20):], some(rng.randrange(0, 80))]
        rng.shuffle(parts)
        texts.append("".join(parts))
    texts += [texts[3], texts[3], "z" * 500, "z" * 399, "z" * 3 + some(5), "ab" * 600, some(450) * 2, "", None]
    return texts


@pytest.mark.parametrize("family_bytes", [1 << 20, 2000])
def test_removal_equals_brute_force(spark, monkeypatch, family_bytes):
    monkeypatch.setattr(suffixes, "FAMILY_BYTES", family_bytes)
    monkeypatch.setattr(suffixes, "SHARD_BYTES", 1 << 16)
    texts = passages(random.Random(8))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    rows = {r["doc_id"]: r["_repeats"] for r in suffixes.remove_repeats(docs).collect()}
    plain = plain_removal([(t or "").encode() for t in texts])
    for i, (kept, n, spans) in enumerate(plain):
        assert (bytes(rows[i]["kept"]), sum(s["length"] for s in rows[i]["spans"]), len(rows[i]["spans"])) == (kept, n, spans), i
    assert any(n for _, n, _ in plain) and any(not n for _, n, _ in plain)


def test_removal_query(spark):
    rows = {r["doc_id"]: r for r in QUERIES["op12_suffix_dedup"](spark, DIRECTORY).collect()}
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{DIRECTORY}/documents.parquet").collect()}
    for (doc, text), (kept, n, spans) in zip(texts.items(), plain_removal(list(texts.values()))):
        assert tuple(rows[doc])[1:] == (len(text), n, spans, hashlib.sha256(kept).hexdigest())


def test_removal_takes_odd_rows(spark):
    docs = spark.createDataFrame(odd_rows(), "doc_id bigint, text string").withColumns({c: F.lit(1) for c in [*CLASHING, "_repeats", "t1", "spans", "_spans", "n"]})
    rows = suffixes.remove_repeats(docs)
    assert set(rows.columns) == set(docs.columns)
    texts = [(t or "").encode() for _, t in odd_rows()]
    short = [t if len(t) < 400 else b"" for t in texts]   # the long texts are copies of one another
    assert sorted(bytes(r["_repeats"]["kept"]) for r in rows.collect()) == sorted(short)
    assert suffixes.remove_repeats(docs.limit(0)).count() == 0


def test_anchors_of_long_texts_do_not_depend_on_chunks(monkeypatch):
    rng = random.Random(9)
    text = bytes(rng.randrange(97, 100) for _ in range(6000))
    whole = suffixes.anchors([b"short", text, b"", text[:1000]])
    monkeypatch.setattr(suffixes, "CHUNK", 1024)
    cut = suffixes.anchors([text])[0]

    def windows(found):
        return {i: (r["g"], r["at"]) for r in found for i in range(r["lo"], r["hi"] + 1)}

    assert windows(whole[1]) == windows(cut) and sorted(windows(cut)) == list(range(6000 - 400 + 1))
    assert windows(whole[3]) == {i: a for i, a in windows(cut).items() if i <= 600} and not len(whole[0]) and not len(whole[2])


# --- conversations --------------------------------------------------------------------------------

def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    members, ended = defaultdict(list), {}
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        turns = own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:]   # remainders as in SQL
        ended[c] = len(turns)
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    below = {k: [0, 0, 0] for k in members}
    for k in sorted(members, key=len, reverse=True):
        own_value = (len(members[k]) - 1) * (len(k[-1][1]) if k else 0)
        below[k][1] = below[k][1] or 1
        below[k][2] += own_value
        if k:
            up = below[k[:-1]]
            up[0] += 1
            up[1] += below[k][1]
            up[2] += below[k][2]
    return {(m[0], len(k), members[k[:-1]][0] if k else None, len(m), *below[k],
             hashlib.sha256(",".join(str(c) for c in m if ended[c] == len(k)).encode()).hexdigest()) for k, m in members.items()}


TRIE = "conv_id bigint, turn int, role string, text string"


def trie(frame):
    return [tuple(r) for r in conversations.prefix_trie(*conversations.rebuilt(conversations.turns_of(frame))).collect()]


def test_trie_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DIRECTORY}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = [tuple(r) for r in QUERIES["op13_conversation_trie"](spark, DIRECTORY).collect()]
    assert len(found) == len(set(found)) and set(found) == plain_trie(rows)


def test_trie_of_odd_and_many_conversations(spark):
    """More conversations than a block, more turns than a part, nulls, copies, turnless ones, a hot prefix."""
    rng = random.Random(10)
    rows = [(c, t, "user" if t % 2 else None, rng.choice(["hello", "bye", "é", "", None])) for c in range(0, 2600, 2) for t in range(rng.randrange(1, 6))]
    rows += [(c, t, "user", "hello" if t < 150 or c % 2 else f"{c}") for c in (5000, 5001, 5002, 5100) for t in range(200)]
    rows += [(None, 1, "user", "nobody"), (7001, None, "user", "first"), (7001, 0, "user", "second"), (7002, None, None, None), (-5, 1, "a", "b"), (7003, 1, "x", "y"),
             (7003, 1, "x", "y"), (7004, 9, "a", "bc"), (7005, 9, "ab", "c")]
    # A null turn comes first; equal turns stand in order of role.
    frame = spark.createDataFrame(rows, TRIE).withColumns({c: F.lit(1) for c in ("block", "place", "depth", "part")}).repartition(7)
    found = trie(frame)
    assert len(found) == len(set(found)) and set(found) == plain_trie(rows)
    assert trie(frame.limit(0)) == []
