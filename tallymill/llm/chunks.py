"""Tokenizing by memory of short chunks.

Text is cut at single spaces and line ends. Where both neighbours of such a cut are visible characters, no
token of the vocabularies used here spans it, so the ids of a text are the ids of its chunks in a row. A
chunk's ids are worked out once and remembered; the memory is bounded and emptied when full. Chunks that are
not known go to the tokenizer many at a time, as one string with the same cuts.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tallymill.llm.common import kept

REMEMBERED = 300_000
LONGEST = 64
TOGETHER = 512
#: Characters of the texts that are worked on at once.
GROUP = 6_000_000
TAIL = ".,;:!?"


class ChunkEncoder:
    """``encode`` maps chunks to packed little-endian uint32 ids; it is told what may stand between chunks if
    they are joined, or None. With ``attached`` a space belongs to the
    chunk after it (" word"); without, white space is dropped and every space is a cut. ``specials`` are strings
    that the encoder finds as they are written, so their case is never changed."""

    def __init__(self, encode: Callable[[list[str], str | None], Iterable[bytes]], attached: bool, room: int = REMEMBERED, specials: tuple[str, ...] = ()):
        self._encode, self._attached, self._room, self._specials = encode, attached, room, specials
        self._memory: dict[str, bytes] = {}
        self._heads: dict[str, bytes] = {}
        self._often: set[str] = set()

    def _make_room(self) -> None:
        """When memory is full, chunks that were seen twice within a group stay; if those are too many, none."""
        if len(self._memory) > self._room:
            if len(self._often) > self._room // 2:
                self._often = set()
            self._memory = {c: ids for c, ids in self._memory.items() if c in self._often}
        if len(self._heads) > self._room // 4:
            self._heads = {}
        if not self._attached:
            self._memory[""] = b""

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        out, begin, size = [], 0, 0
        for end, text in enumerate(texts, 1):
            size += len(text)
            if size >= GROUP or end == len(texts):
                out.extend(self._encode_group(texts[begin:end]))
                begin, size = end, 0
        return out

    def _encode_group(self, texts: list[str]) -> list[bytes]:
        """The texts are cut and their different chunks found by Arrow; only those are looked up."""
        self._make_room()
        memory, heads = self._memory, self._heads
        marked = [t.replace("\n", " \n") for t in texts] if self._attached else [self._lowered(t).replace("\n", " ") for t in texts]
        parts = pc.split_pattern(pa.array(marked, pa.large_string()), " ")
        begins = parts.offsets.to_numpy()
        coded = parts.flatten().dictionary_encode()
        chunks, index = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().astype(np.int64)
        known = list(map(memory.get, chunks))
        missing = {c for c, ids in zip(chunks, known) if ids is None}
        # Most chunks are one visible word; only the others are looked at closely.
        loose = {c for c in missing if (not c or c[0].isspace() or c[-1].isspace()) and _loose(c)} if self._attached else set()
        long = self._learn(memory, missing - loose)
        ids = [memory.get(c, b"") if own is None else own for c, own in zip(chunks, known)]
        self._often.update(compress(chunks, np.bincount(index, minlength=len(chunks)) > 1))
        again = set()
        if self._attached:
            first = [m.split(" ", 1) for m in marked]
            self._learn_heads({f[0] for f in first})
            ids += [heads[f[0]] for f in first]
            index[begins[:-1]] = len(chunks) + np.arange(len(texts))
            again = {i for i, f in enumerate(first) if len(f) > 1 and (not f[0] or f[0][-1].isspace())}
            if loose:
                bad = np.concatenate((np.array([c in loose for c in chunks]), np.zeros(len(texts), bool)))[index]
                again.update(np.flatnonzero(np.add.reduceat(bad, begins[:-1])).tolist())
        taken = pa.array(ids, pa.large_binary()).take(pa.array(index))
        cuts = np.frombuffer(taken.buffers()[1], np.int64)[begins].tolist()
        data = taken.buffers()[2] or pa.py_buffer(b"")
        out = [data[b:e].to_pybytes() for b, e in zip(cuts, cuts[1:])]
        for i in again:
            out[i] = self._whole(texts[i])
        for chunk in long:
            del memory[chunk]
        for chunk in [h for h in heads if len(h) > LONGEST]:
            del heads[chunk]
        return out

    def _lowered(self, text: str) -> str:
        """Lower case where that is what the tokenizer will do anyway: Latin-1 letters map one to one."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
        lower = text.lower()
        return text if any(s in lower for s in self._specials) else lower

    def _whole(self, text: str) -> bytes:
        """A text with white space beside white space: cut only where both sides are visible."""
        parts = _joined(text.split(" "))
        return b"".join(self._encode([parts[0], *(" " + p for p in parts[1:])], None))

    def _learn_heads(self, wanted: set[str]) -> None:
        asked = list(wanted.difference(self._heads))
        simple = [a for a in asked if a and a.strip() == a]
        self._heads.update(zip(simple, self._encode(simple, "\n")))
        others = [a for a in asked if not a or a.strip() != a]
        self._heads.update(zip(others, self._encode(others, None)))

    def _learn(self, memory: dict[str, bytes], missing: set[str]) -> list[str]:
        """Works out the ids of chunks not in ``memory``; returns the ones too long to stay."""
        if not missing:
            return []
        heads, starts = self._heads, [w for w in missing if w[:1] == "\n"]
        # Punctuation behind a letter or digit, in lower case too, is always a token of its own.
        cores = {w: core for w in missing if (core := w.rstrip(TAIL)) != w and core and core[-1].lower().isalnum() and core[0] != "\n"}
        asked = list(missing.difference(cores, starts).union(cores.values()).difference(memory))
        memory.update(zip(asked, self._encode([" " + w for w in asked], "") if self._attached else self._encode(asked, " ")))
        tails = {w[len(core):] for w, core in cores.items()}.difference(heads)
        if tails:
            listed = list(tails)
            heads.update(zip(listed, self._encode(listed, None)))
        self._learn_heads({w[1:] for w in starts} | {"\n"})
        memory.update((w, memory[core] + heads[w[len(core):]]) for w, core in cores.items())
        memory.update((w, heads["\n"] + heads[w[1:]]) for w in starts)
        return [w for w in missing.union(asked) if len(w) > LONGEST]


def _loose(part: str) -> bool:
    """White space at an edge, but for a line end before a visible character; only such parts are not known."""
    visible = part.strip()
    return not visible or visible != part and not (part[0] == "\n" and part[1:] == visible)


def _joined(parts: list[str]) -> list[str]:
    """Parts put together again where a space between them has white space beside it."""
    out, run = [], [parts[0]]
    for before, after in zip(parts, parts[1:]):
        if before and after and not before[-1].isspace() and not after[0].isspace():
            out.append(" ".join(run))
            run = []
        run.append(after)
    out.append(" ".join(run))
    return out


class FileTokenizer:
    """A tokenizers file for chunks: many are encoded as one string, whose ids are dealt out again by the
    number of bytes each id stands for. Strings of special tokens give their ids, as in the library's plain call;
    with ``special_as_text`` they are ordinary text. None is added."""

    def __init__(self, path: str, special_as_text: bool = False):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = special_as_text
        self._normalizer = self._tokenizer.normalizer
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        added = {token.content: number for number, token in self._tokenizer.get_added_tokens_decoder().items()}
        self.specials = tuple(added) if not special_as_text else ()
        self._bytes_of = np.zeros(max(*vocabulary.values(), *added.values(), 0) + 1, np.int64)
        for token, number in vocabulary.items():
            self._bytes_of[number] = len(token.removesuffix("</w>"))
        for token, number in added.items():
            self._bytes_of[number] = len(token.encode())

    def __call__(self, chunks: list[str], between: str | None) -> Iterable[bytes]:
        """Packed ids of each chunk. With ``between`` the chunks, joined by it, have the ids they have alone."""
        if between is None:
            return map(self._one, chunks)
        return (ids for at in range(0, len(chunks), TOGETHER) for ids in self._many(chunks[at:at + TOGETHER], between))

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _one(self, chunk: str) -> bytes:
        return self._ids(chunk).tobytes()

    def _size(self, chunk: str) -> int:
        """Bytes of a chunk as the tokenizer sees it; its tokens stand for these, or for fewer where white space goes."""
        if self._normalizer is not None and not chunk.isascii():
            chunk = self._normalizer.normalize_str(chunk)
        return len(chunk.encode())

    def _many(self, chunks: list[str], between: str) -> list[bytes]:
        joined = between.join(chunks)
        ids = self._ids(joined)
        sizes = np.fromiter(map(len if joined.isascii() else self._size, chunks), np.int64, len(chunks))
        gap = 1 if between == "\n" else 0  # a line end has an id, a space between words has none
        ends = np.cumsum(sizes + gap) - gap
        reached = np.cumsum(self._bytes_of[ids])
        if not len(ids) or reached[-1] != ends[-1] or not np.array_equal(reached[cuts := np.searchsorted(reached, ends)], ends):
            # White space inside a chunk is dropped, or a chunk is empty: find out which.
            if len(chunks) == 1:
                return [self._one(chunks[0])]
            half = len(chunks) // 2
            return self._many(chunks[:half], between) + self._many(chunks[half:], between)
        data, stops = ids.tobytes(), (4 * (cuts + 1)).tolist()
        return [data[b:e] for b, e in zip([0, *(s + 4 * gap for s in stops)], stops)]


def file_encoder(path: str, attached: bool, special_as_text: bool = False) -> ChunkEncoder:
    """The encoder of a tokenizers file, one per worker process while no other operator works there."""
    loaded, key = kept("chunks"), (path, attached, special_as_text)
    if key not in loaded:
        tokenizer = FileTokenizer(path, special_as_text)
        # With its space and its case a word is more than one chunk.
        loaded[key] = ChunkEncoder(tokenizer, attached, 3 * REMEMBERED if attached else 3 * REMEMBERED // 2, tokenizer.specials)
    return loaded[key]
