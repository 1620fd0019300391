"""Registered queries with SQL twins, by family."""

from importlib import import_module

FAMILIES = ("privacy", "attempts", "cost", "scoring", "monitor", "versions", "prompts", "state", "telemetry", "jobs", "timed")


def _collect(attribute: str) -> dict:
    merged: dict = {}
    for family in FAMILIES:
        part = getattr(import_module(f"tallymill.suite.{family}"), attribute)
        clash = merged.keys() & part.keys()
        if clash:
            raise ValueError(f"query names used twice: {sorted(clash)}")
        merged.update(part)
    return merged


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict:
    return _collect("ORACLES")
