"""String expressions with the semantics of the text functions users know from Python."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space.
WHITE_SPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
               "\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


# The same characters as a regular expression.
SPACE = r"[\t-\r\x1c-\x1f \x85\p{Z}]"
NO_SPACE = r"[^\t-\r\x1c-\x1f \x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]"


def unicode_pattern(pattern: str) -> str:
    """A pattern written with ``\\b`` at its ends, ``\\s``, ``\\S`` and ``\\d``, for the JVM's regex engine
    with every letter, number and white space of Unicode counted. Next to a word character a word
    edge is the absence of another one."""
    if pattern.startswith(r"\b"):
        pattern = f"(?<!{WORD})" + pattern[2:]
    if pattern.endswith(r"\b"):
        pattern = pattern[:-2] + f"(?!{WORD})"
    return pattern.replace(r"\s", SPACE).replace(r"\S", NO_SPACE).replace(r"\d", r"\p{Nd}")


def strip(text: Column) -> Column:
    """Without leading and trailing white space of any kind (``trim`` only knows the blank)."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once per row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# Characters beyond ASCII that equal an ASCII letter when case is ignored: long s, dotless i,
# dotted capital i, Kelvin sign.
_FOLDING = ("\u017f", "\u0131", "\u0130", "\u212a")


def folded(text: Column) -> Column:
    """What ``may_contain`` asks about a text: its lower-case form, and whether that form might hide
    a letter."""
    odd = F.lit(False)
    for letter in _FOLDING:
        odd = odd | F.contains(text, F.lit(letter))
    return F.struct(F.lower(text).alias("lower"), odd.alias("odd"))


def may_contain(fold: Column, words: tuple[str, ...]) -> Column:
    """False only if a text certainly holds none of the lower-case words in any case. A plain search
    that saves the regular expression on most rows."""
    hit = fold["odd"]
    for word in words:
        hit = hit | F.contains(fold["lower"], F.lit(word))
    return hit


def short_hash(text: Column, length: int = 16) -> Column:
    """The first ``length`` hex digits of the SHA-256 of ``text``."""
    return F.substring(F.sha2(text, 256), 1, length)


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def interleave(pieces: Column, fillers: Column) -> Column:
    """pieces[0] + fillers[0] + pieces[1] + ...; there is one more piece than fillers."""
    return F.array_join(F.zip_with(pieces, fillers, lambda piece, filler: F.concat(piece, F.coalesce(filler, F.lit("")))), "")


def numbers_from_last(values: Column) -> Column:
    """For every value the 1-based number of its first use, reading the array from the end.

    Sorted by value, equal values lie side by side, so each run is found and numbered without
    comparing every value with every other: a text with very many values stays cheap.
    """
    def runs(ordered: Column) -> Column:
        marked = F.transform(ordered, lambda e, i: F.struct(
            e["back"].alias("back"), i.alias("at"), ((i == 0) | (F.get(ordered, i - 1)["value"] != e["value"])).alias("head")))
        return let(F.filter(marked, lambda e: e["head"]), lambda heads: number(ordered, heads))

    def number(ordered: Column, heads: Column) -> Column:
        by_use = F.array_sort(F.transform(heads, lambda h, run: F.struct(h["back"].alias("back"), run.alias("run"))))
        by_run = F.array_sort(F.transform(by_use, lambda u, i: F.struct(u["run"].alias("run"), (i + 1).alias("n"))))
        return let(by_run, lambda numbers: expand(ordered, heads, numbers))

    def expand(ordered: Column, heads: Column, numbers: Column) -> Column:
        def members(head: Column, run: Column) -> Column:
            end = F.coalesce(F.get(heads, run + 1)["at"], F.size(ordered))
            return F.transform(F.slice(ordered, head["at"] + 1, end - head["at"]), lambda e: F.struct(
                (-e["back"]).alias("pos"), F.get(numbers, run)["n"].alias("n")))

        return F.transform(F.array_sort(F.flatten(F.transform(heads, members))), lambda e: e["n"])

    return let(F.array_sort(F.transform(values, lambda v, i: F.struct(v.alias("value"), (-i).alias("back")))), runs)


#: Elements that a fold over an array takes together.
CHUNK = 64


def chunked_fold(items: Column, start: Column, step: Callable[[Column, Column], Column], keeps: Callable[[Column, Column], Column],
                 kind: str) -> Column:
    """Array of chunks of the elements that ``keeps(state, element)`` says, in order; ``step`` gives the state after
    a kept element. Elements are appended to small chunks, so long arrays are not copied for every element."""
    empty = F.array().cast(f"array<{kind}>")

    def element(acc: Column, item: Column) -> Column:
        kept = keeps(acc["state"], item)
        return F.struct(F.when(kept, step(acc["state"], item)).otherwise(acc["state"]).alias("state"),
                        F.when(kept, F.concat(acc["out"], F.array(item))).otherwise(acc["out"]).alias("out"))

    def chunk(acc: Column, number: Column) -> Column:
        inner = F.aggregate(F.slice(items, number * CHUNK + 1, F.lit(CHUNK)), F.struct(acc["state"].alias("state"), empty.alias("out")), element)
        return let(inner, lambda x: F.struct(x["state"].alias("state"), F.concat(acc["out"], F.array(x["out"])).alias("out")))

    numbers = F.when(F.size(items) > 0, F.sequence(F.lit(0), ((F.size(items) - 1) / CHUNK).cast("int"))).otherwise(F.array().cast("array<int>"))
    zero = F.struct(start.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    return F.aggregate(numbers, zero, chunk, lambda acc: F.filter(acc["out"], lambda x: F.size(x) > 0))
