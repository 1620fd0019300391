"""Byte-level BPE by dynamic programming over prefixes.

A byte string has one BPE encoding, and so has each of its prefixes; the table keeps the last token of every
prefix. A token that ends at position i is that last token if it stands next to the last token of the
prefix before it: two tokens may be neighbours if merging their joined bytes would give just these two.
Nothing behind a position changes what stands there, so bytes can be appended, and after an edit only the
entries near it have to be worked out again.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.llm.chunks import LONGEST, REMEMBERED, ChunkEncoder
from tallymill.llm.common import kept, strings, text_udf

KNOWN_PAIRS = 1_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Vocabulary:
    """Ranks of byte strings, how each was merged, and which tokens may be neighbours."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        reachable = []
        for token, rank in ranks.items():
            if len(token) > 1:
                parts = self._merged(token, rank)
                if len(parts) != 2:
                    continue
                self.halves[rank] = (ranks[parts[0]], ranks[parts[1]])
            reachable.append(token)
        self.merge_of = {pair: rank for rank, pair in self.halves.items()}
        #: All ends of the tokens that merging can yield, so that a search backwards knows when to stop: with
        #: the rank where the end is such a token itself, else -1.
        self.ends = dict.fromkeys((token[i:] for token in reachable for i in range(len(token))), -1)
        self.ends.update((token, ranks[token]) for token in reachable)
        self.longest = max(map(len, reachable), default=1)
        self.known_pairs: dict[tuple[int, int], bool] = {}

    def _merged(self, data: bytes, below: int) -> list[bytes]:
        """``data`` merged by all ranks less than ``below``, lowest first and leftmost first."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            options = [(self.ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1)]
            rank, at = min(options)
            if rank >= below:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def neighbours(self, left: int, right: int) -> bool:
        """Whether the bytes of both tokens, joined, are encoded as just these two.

        The merges on both sides are undone from the last to the first. Between two of them the tokens at
        the border could have merged across it, if that merge came before the one undone.
        """
        key = (left, right)
        answer = self.known_pairs.get(key)
        if answer is None:
            if len(self.known_pairs) >= KNOWN_PAIRS:
                self.known_pairs.clear()
            answer = self.known_pairs[key] = self._untouched(left, right)
        return answer

    def _untouched(self, left: int, right: int) -> bool:
        next_merge = float("inf")
        while True:
            across = self.merge_of.get((left, right))
            if across is not None and across < next_merge:
                return False
            made_left = left if left in self.halves else -1
            made_right = right if right in self.halves else -1
            if made_left < 0 and made_right < 0:
                return True
            if made_left > made_right:
                next_merge, left = left, self.halves[left][1]
            else:  # a merge of equal rank further left comes first
                next_merge, right = right + 1, self.halves[right][0]


class PrefixTable:
    """The last token of every prefix of some bytes; grows by ``append``, changes by ``edit``."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def _last_of(self, end: int) -> int:
        """The longest token ending at ``end`` that may stand there; only one may."""
        ends, data, last, known = self.vocabulary.ends, self.data, self.last, self.vocabulary.known_pairs
        candidates = []
        for begin in range(end - 1, -1, -1):
            token = ends.get(data[begin:end])
            if token is None:
                break
            if token >= 0:
                candidates.append((begin, token))
        for begin, token in reversed(candidates):
            if begin == 0:
                return token
            before = last[begin - 1]
            fits = known.get((before, token))
            if fits if fits is not None else self.vocabulary.neighbours(before, token):
                return token
        raise ValueError(f"no token ends at byte {end}")

    def append(self, data: bytes) -> None:
        begin = len(self.data)
        self.data += data
        for end in range(begin + 1, len(self.data) + 1):
            self.last.append(self._last_of(end))

    def become(self, data: bytes) -> None:
        """Hold ``data`` instead, keeping the entries of the prefix both have."""
        same = 0
        for old, new in zip(self.data, data):
            if old != new:
                break
            same += 1
        del self.last[same:]
        self.data = data[:same]
        self.append(data[same:])

    def edit(self, begin: int, end: int, new: bytes) -> int:
        """Put ``new`` in place of bytes begin..end; returns how many entries were worked out.

        Past the edit, once as many entries in a row as the longest token has bytes are what they were, all
        others are too: nothing they depend on has changed.
        """
        before, tail = self.last, self.data[end:]
        self.data, self.last = self.data[:begin] + new + tail, before[:begin]
        same, worked = 0, 0
        for at in range(begin + 1, len(self.data) + 1):
            self.last.append(self._last_of(at))
            worked += 1
            old = at - len(new) - begin + end
            same = same + 1 if at > begin + len(new) and self.last[-1] == before[old - 1] else 0
            if same >= self.vocabulary.longest:
                self.last.extend(before[old:])
                break
        return worked

    def tokens(self) -> list[int]:
        out, at = [], len(self.data)
        while at:
            out.append(self.last[at - 1])
            at -= len(self.vocabulary.bytes_of[out[-1]])
        return out[::-1]


class Codec:
    """Encoding of whole texts, each match of ``pattern`` on its own, and decoding."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.vocabulary = Vocabulary(read_ranks(path))
        # White space as Unicode's property; the regex module's own class has four control characters more.
        self.pieces = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}")
                                    .replace(r"\S", r"\P{White_Space}"))
        self._words: dict[str, bytes] = {}
        self.chunks = ChunkEncoder(self._chunk_ids, attached=True)
        self.table = [self.vocabulary.bytes_of.get(i) for i in range(max(self.vocabulary.bytes_of) + 1)]

    def _chunk_ids(self, chunks: list[str], between: str | None) -> list[bytes]:
        """In sorted order pieces have long prefixes in common, and one table grows from piece to piece."""
        words, ranks = self._words, self.vocabulary.ranks
        if len(words) > REMEMBERED:
            words.clear()
        pieces = [self.pieces.findall(chunk) for chunk in chunks]
        new = set().union(*pieces).difference(words)
        table = PrefixTable(self.vocabulary)
        for data, piece in sorted((piece.encode(), piece) for piece in new):
            whole = ranks.get(data)
            if whole is None:
                table.become(data)
                words[piece] = np.array(table.tokens(), "<u4").tobytes()
            else:
                words[piece] = whole.to_bytes(4, "little")
        out = [b"".join(map(words.__getitem__, own)) for own in pieces]
        for piece in new:
            if len(piece) > LONGEST:
                del words[piece]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed little-endian uint32 ids of each text."""
        return self.chunks.encode(texts)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def codec(path: str, pattern: str) -> Codec:
    """One codec per worker process, while no other operator works there."""
    codecs = kept("codecs")
    if (path, pattern) not in codecs:
        codecs[path, pattern] = Codec(path, pattern)
    return codecs[path, pattern]


def encode_texts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded) per row: ids as packed little-endian uint32, decoded the bytes they stand for.

    Row-local. A null or empty text has no ids. Broken UTF-8 is read as U+FFFD, so that decoding gives the
    text as read. Long runs without a cut take time in proportion to their length. Other columns are
    not read; repeated rows are rows like any other.
    """
    def run(texts: pa.Array) -> pa.Array:
        own = codec(path, pattern)
        ids = own.encode(strings(texts))
        return pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array([own.decode(i) for i in ids], pa.binary())], ["ids", "decoded"])

    coded = docs.select("doc_id", text_udf(run, "struct<ids:binary,decoded:binary>")(F.col("text")).alias("_c"))
    return coded.select("doc_id", "_c.ids", "_c.decoded")
