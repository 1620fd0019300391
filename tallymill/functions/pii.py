"""Personal-data patterns as one regular expression, and placeholders for masked values."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallymill.functions.text import unicode_pattern

# Detection patterns, by label.
PATTERNS = {
    "EMAIL": r"[a-zA-Z0-9_.+\-]+@[a-zA-Z0-9\-]+\.[a-zA-Z0-9.\-]+",
    "PHONE": r"(?:\+?86)?1[3-9]\d{9}",
    "ID_CARD": r"\b\d{17}[\dXx]\b",
    "IP_ADDR": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "API_KEY": r"sk-[a-zA-Z0-9]{20,}",
}

# Where two labels can start at the same character the longer match must win; trying them in this
# order gives that with a single pass over the text.
_TRY_ORDER = ("EMAIL", "ID_CARD", "API_KEY", "IP_ADDR", "PHONE")

DEFAULT_PREFIX = "PII"


def resolve_labels(labels: Iterable[str] | None) -> list[str]:
    """Label names from singular or plural spellings in any case; none given means all."""
    if not labels:
        return list(_TRY_ORDER)
    wanted = set()
    for label in labels:
        name = label.upper()
        for candidate in (name, name.removesuffix("S"), name.removesuffix("ES")):
            if candidate in PATTERNS:
                wanted.add(candidate)
                break
        else:
            raise ValueError(f"unknown PII label: {label!r}; known: {sorted(PATTERNS)}")
    return [label for label in _TRY_ORDER if label in wanted]


# An address can only start where its run of allowed characters starts, or where the match before
# ended: from any later character the earlier start would have matched too. Saying so keeps the
# search linear on long runs without an "@".
_STARTS = {"EMAIL": r"(?:\G|(?<![a-zA-Z0-9_.+\-]))"}

# What every match of a label contains, as a cheap test: a literal, or what follows some digit.
_NEEDS = {"EMAIL": "@", "API_KEY": "sk-"}
_NEEDS_DIGITS = {"ID_CARD": r"\p{Nd}{10}", "PHONE": r"\p{Nd}{10}", "IP_ADDR": r"\.\p{Nd}{1,3}\.\p{Nd}"}


def pattern(labels: Iterable[str] | None = None) -> str:
    """One alternation over the chosen labels."""
    return "|".join(_STARTS.get(label, "") + unicode_pattern(PATTERNS[label]) for label in resolve_labels(labels))


def may_hold(text: Column, labels: Iterable[str] | None = None) -> Column:
    """False only for texts that certainly hold no match; most texts need no more than this."""
    wanted = resolve_labels(labels)
    test = F.lit(False)
    for label in wanted:
        if label in _NEEDS:
            test = test | F.contains(text, F.lit(_NEEDS[label]))
    digits = sorted({_NEEDS_DIGITS[label] for label in wanted if label in _NEEDS_DIGITS})
    return test | F.rlike(text, F.lit(rf"\p{{Nd}}(?:{'|'.join(digits)})")) if digits else test


def matches(text: Column, labels: Iterable[str] | None = None) -> Column:
    """All non-overlapping values, left to right."""
    found = F.regexp_extract_all(text, F.lit(pattern(labels)), F.lit(0))
    return F.when(may_hold(text, labels), found).when(text.isNotNull(), F.array().cast("array<string>"))


def pieces(text: Column, labels: Iterable[str] | None = None) -> Column:
    """The text between the matches."""
    return F.split(text, pattern(labels), -1)


def label_of(value: Column) -> Column:
    """The label of a matched value; the five shapes exclude each other."""
    return (F.when(F.contains(value, F.lit("@")), "EMAIL")
            .when(F.startswith(value, F.lit("sk-")), "API_KEY")
            .when(F.contains(value, F.lit(".")), "IP_ADDR")
            .when(F.length(value) == 18, "ID_CARD")
            .otherwise("PHONE"))


def placeholder(label: Column, number: Column, prefix: str = DEFAULT_PREFIX) -> Column:
    return F.concat(F.lit(f"[[{prefix}_"), label, F.lit("_"), number.cast("string"), F.lit("]]"))


def placeholder_pattern(prefix: str = DEFAULT_PREFIX) -> str:
    return r"\[\[" + prefix + r"_[A-Z_]+_[0-9]+\]\]"
