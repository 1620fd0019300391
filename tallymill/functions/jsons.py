"""Strict JSON checks. Spark's own parsers accept trailing junk and reject repeated keys, so the
yes/no question goes to the standard parser in Arrow batches; reading fields stays in the JVM."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _parses(check):
    def one(value: str | None) -> bool:
        if value is None:
            return False
        try:
            return check(json.loads(value))
        except (ValueError, TypeError, RecursionError):
            return False

    @F.pandas_udf("boolean")
    def batch(values: pd.Series) -> pd.Series:
        return values.map(one).astype(bool)

    return batch


def is_json(text: Column) -> Column:
    return _parses(lambda parsed: True)(text)


def is_json_object(text: Column) -> Column:
    return _parses(lambda parsed: isinstance(parsed, dict))(text)


def rule_checks(text: Column, rules: list[list[str] | None]) -> Column:
    """One boolean per rule, from one parse: valid JSON, and with names all of them in it. What cannot be JSON by its
    first character never leaves the JVM."""
    def checks(value: str | None) -> list[bool]:
        try:
            parsed = json.loads(value)
            return [names is None or all(name in parsed for name in names) for names in rules]
        except (ValueError, RecursionError):
            return [False] * len(rules)
        except TypeError:  # a number or a literal holds no names
            return [names is None or not names for names in rules]

    @F.pandas_udf("array<boolean>")
    def batch(values: pd.Series) -> pd.Series:
        return values.map(lambda v: [False] * len(rules) if v is None else checks(v))

    return batch(F.when(F.rlike(text, F.lit(r"^\s*[\[{\"\-0-9tfnNI]")), text))


def canonical_object(text: Column) -> Column:
    """A JSON object written anew, a repeated key with its last value; null for anything else."""
    def one(value: str | None) -> str | None:
        try:
            parsed = None if value is None else json.loads(value)
        except (ValueError, TypeError, RecursionError):
            return None
        return json.dumps(parsed) if isinstance(parsed, dict) else None

    @F.pandas_udf("string")
    def batch(values: pd.Series) -> pd.Series:
        return values.map(one)

    return batch(text)


def has_names(text: Column, required: list[str]) -> Column:
    """Valid JSON in which every required name occurs: as a key of an object, an element of an
    array or a part of a string. A number or a literal holds nothing."""
    return _parses(lambda parsed: all(name in parsed for name in required))(text)
