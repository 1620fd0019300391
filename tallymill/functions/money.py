"""Exact call prices. All money is DECIMAL, so totals do not depend on how rows are partitioned."""

from __future__ import annotations

from collections.abc import Mapping
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# USD per 1 000 tokens, (prompt, completion).
PRICING = {
    "gpt-4o": ("0.0025", "0.01"),
    "gpt-4o-mini": ("0.00015", "0.0006"),
    "claude-3-5-sonnet": ("0.003", "0.015"),
    "claude-3-haiku": ("0.00025", "0.00125"),
}
FALLBACK = ("0.01", "0.03")

Pricing = Mapping[str, tuple[str, str]]

PER_TOKEN = "decimal(18,12)"


def _per_token(per_1k: str) -> Column:
    return F.lit(Decimal(per_1k) / 1000).cast(PER_TOKEN)


def _price(model: Column, pricing: Pricing, side: int) -> Column:
    table = F.create_map(*[c for name, price in pricing.items() for c in (F.lit(name), _per_token(price[side]))])
    return F.coalesce(F.try_element_at(table, model), _per_token(FALLBACK[side]))


def prompt_price(model: Column, pricing: Pricing = PRICING) -> Column:
    """USD per prompt token; an unlisted model costs the fallback."""
    return _price(model, pricing, 0)


def completion_price(model: Column, pricing: Pricing = PRICING) -> Column:
    return _price(model, pricing, 1)


def call_cost(model: Column, prompt_tokens: Column, completion_tokens: Column,
              pricing: Pricing = PRICING) -> Column:
    return (prompt_tokens.cast("decimal(18,0)") * prompt_price(model, pricing)
            + completion_tokens.cast("decimal(18,0)") * completion_price(model, pricing))


def ratio(numerator: Column, denominator: Column, otherwise: Column) -> Column:
    """numerator / denominator, or ``otherwise`` where the denominator is not positive."""
    return F.when(denominator > 0, numerator / denominator).otherwise(otherwise)
