"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document; the ledger keeps its measurements and one bit per failed
rule. A policy is a mask over the bits, so changing a policy, comparing versions or leaving one rule
out never reads a text again.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.llm.common import code_points, text_udf, utf8

SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_marks")
TYPE = "struct<" + ",".join(f"{m}:bigint" for m in MEASURES) + ">"


@dataclass(frozen=True)
class Rule:
    """``fails`` is a SQL condition over the measurements; ``bit`` never changes once given."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "n_symbols > 0.1 * n_words"),
    Rule(3, "word_length", "n_words > 0 and (word_chars < 2 * n_words or word_chars > 15 * n_words)"),
    Rule(4, "duplicate_lines", "n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines"),
    Rule(5, "upper_case", "n_letters >= 50 and 100 * n_upper > 60 * n_letters"),
    Rule(6, "few_letters", "100 * n_letters < 50 * word_chars"),
    Rule(7, "exclamations", "n_marks > 0.3 * n_words"),
)
BASE = 0b11
#: Versioned policies: a document is kept if none of the policy's bits is set.
POLICIES = {"base": BASE, "v1": 0b00011111, "v2": 0b11111111}
CURRENT = "v2"


def _repeated(words: list[bytes]) -> int:
    """Words inside a three-word window that is found twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    k = len(number)
    if k < 2_000_000:
        windows = (ids[:-2] * k + ids[1:-1]) * k + ids[2:]
    else:
        pairs = np.unique(ids[:-1] * k + ids[1:], return_inverse=True)[1]
        windows = pairs[:-1] * k + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift:n - 2 + shift] |= twice
    return int(covered.sum())


def measure(text: bytes) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES."""
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    joined = b"".join(words)
    decoded = joined.decode("utf-8", "replace")
    plain = sum(map(str.isalpha, decoded)) if not joined.isascii() else len(joined) - len(joined.translate(None, _LETTERS))
    upper = sum(map(str.isupper, decoded)) if not joined.isascii() else len(joined) - len(joined.translate(None, _UPPER))
    return (len(words), code_points(joined), len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)),
            _repeated(words), len(lines), plain, upper, joined.count(b"!"))


_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))


def _measured(texts: pa.Array) -> pa.Array:
    rows = [measure(t) for t in utf8(texts)]
    columns = np.array(rows, np.int64).reshape(len(rows), len(MEASURES)).T
    return pa.StructArray.from_arrays([pa.array(c) for c in columns], list(MEASURES))


def ledger(docs: DataFrame, text: str = "text", name: str = "_ledger") -> DataFrame:
    """All columns of ``docs`` plus ``name``: a struct of the measurements and ``failed``, the bits of
    the failed rules (one bigint).

    One pass in the rows' own tasks; nothing is shuffled. A null text is an empty one: all measurements
    are 0, so it fails ``few_words``. Only the text is read, so repeated rows and ties are rows like any
    other; an input column called ``name`` is replaced.
    """
    measured = docs.withColumn(name, text_udf(_measured, TYPE)(F.col(text)))
    bits = F.lit(0).cast("bigint")
    for rule in RULES:
        fails = F.expr(_qualified(rule.fails, name))
        bits = bits.bitwiseOR(F.when(fails, F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("bigint"))
    return measured.withColumn(name, F.col(name).withField("failed", bits))


def _qualified(condition: str, name: str) -> str:
    return re.sub(rf"\b({'|'.join(MEASURES)})\b", rf"{name}.\1", condition)


def verdict(failed, policy: str = CURRENT):
    """Whether a document passes a policy: a column over the ledger's bits."""
    return failed.bitwiseAND(F.lit(POLICIES[policy]).cast("bigint")) == 0


def ablations(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Per rule of a policy, from the ledger alone: how many documents fail it, how many fail only it (kept
    if it were left out), and how many the policy keeps. One aggregation of a few counters."""
    failed = F.col("_ledger.failed").bitwiseAND(F.lit(POLICIES[policy]).cast("bigint"))
    used = [r for r in RULES if POLICIES[policy] >> r.bit & 1]
    sums = rows.select(failed.alias("f")).agg(
        F.count("*").alias("n"), F.count_if(F.col("f") == 0).alias("kept"),
        *[F.count_if(F.col("f").bitwiseAND(F.lit(1 << r.bit)) != 0).alias(f"any{r.bit}") for r in used],
        *[F.count_if(F.col("f") == (1 << r.bit)).alias(f"only{r.bit}") for r in used])
    return sums.select(F.explode(F.array(*[F.struct(
        F.lit(r.name).alias("rule"), F.col(f"any{r.bit}").alias("n_failed"), F.col(f"only{r.bit}").alias("n_failed_alone"),
        F.col("kept").alias("n_kept"), (F.col("kept") + F.col(f"only{r.bit}")).alias("n_kept_without")) for r in used])).alias("r")).select("r.*")


def quality(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """One row per document: doc_id, the measurements, failed (bits), base_failed, kept."""
    rows = ledger(docs.select("doc_id", "text")).select("doc_id", "_ledger.*")
    return rows.withColumns({"base_failed": ~verdict(F.col("failed"), "base"),
                             "kept": verdict(F.col("failed"), "base") & verdict(F.col("failed"), policy)})
