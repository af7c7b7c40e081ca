"""Prices of token usage by model, as a Column expression over a price map."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# US dollars a million tokens, for input, output, cache read and cache write, by the beginning of a model's name.
FAMILIES = {
    "claude-opus-": (5.00, 25.00, 0.50, 6.25),
    "claude-sonnet-": (3.00, 15.00, 0.30, 3.75),
    "claude-haiku-": (1.00, 5.00, 0.10, 1.25),
    "claude-fable-": (10.00, 50.00, 1.00, 12.50),
    "gpt-5.6-sol": (5.00, 30.00, 0.50, 6.25),
    "gpt-5.6-terra": (2.50, 15.00, 0.25, 3.125),
    "gpt-5.6-luna": (1.00, 6.00, 0.10, 1.25),
    "gpt-5.5": (5.00, 30.00, 0.50, 0.0),
    "gpt-5.4-mini": (0.75, 4.50, 0.075, 0.0),
    "gpt-5.4-nano": (0.20, 1.25, 0.02, 0.0),
    "gpt-5.4": (2.50, 15.00, 0.25, 0.0),
    "gpt-5.3-codex": (1.75, 14.00, 0.175, 0.0),
    "gpt-5.2-codex": (1.75, 14.00, 0.175, 0.0),
    "gpt-5.2": (1.75, 14.00, 0.175, 0.0),
    "gpt-5.1-codex-max": (1.25, 10.00, 0.125, 0.0),
    "gpt-5.1-codex-mini": (0.25, 2.00, 0.025, 0.0),
    "gpt-5.1-codex": (1.25, 10.00, 0.125, 0.0),
    "gpt-5.1": (1.25, 10.00, 0.125, 0.0),
    "gpt-5-codex": (1.25, 10.00, 0.125, 0.0),
    "gpt-5-mini": (0.25, 2.00, 0.025, 0.0),
    "gpt-5-nano": (0.05, 0.40, 0.005, 0.0),
    "gpt-5": (1.25, 10.00, 0.125, 0.0),
}
# Whole model names that differ from their family; the others of the exact list have their family's prices.
EXACT = {
    "gpt-5.5-pro": (30.00, 180.00, 0.0, 0.0),
    "gpt-5.5-cyber": (12.50, 75.00, 1.25, 0.0),
    "gpt-5.4-pro": (30.00, 180.00, 0.0, 0.0),
    "gpt-5.2-pro": (21.00, 168.00, 0.0, 0.0),
    "gpt-5-pro": (15.00, 120.00, 0.0, 0.0),
    "codex-mini-latest": (1.50, 6.00, 0.375, 0.0),
}
# Models without a price.
UNPRICED = ("codex-auto-review", "gpt-5.3-codex-spark")
# What stands before a model's name at some vendors.
VENDORS = ("anthropic.", "vertex_ai/", "bedrock/")


@dataclass(frozen=True)
class Prices:
    """A price list; users pass their own in place of the default."""

    families: dict[str, tuple] = field(default_factory=lambda: FAMILIES)
    exact: dict[str, tuple] = field(default_factory=lambda: EXACT)
    unpriced: tuple[str, ...] = UNPRICED


def model_name(model: Column) -> Column:
    """The model's name without vendor prefixes, however many, and without a date at its end."""
    vendors = "|".join(v.replace(".", r"\.") for v in VENDORS)
    return F.regexp_replace(F.regexp_replace(model, f"^(?:{vendors})+", ""), r"[@-](\d{8}|\d{4}-\d{2}-\d{2})$", "")


def _tier(tier: tuple) -> Column:
    return F.array(*[F.lit(float(x)) for x in tier])


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def tier(model: Column, prices: Prices | None = None) -> Column:
    """The four prices of a model: by whole name, else by the longest family; null without one."""
    p = prices or Prices()

    def of(name: Column) -> Column:
        found = F.when(F.lit(False), _tier((0, 0, 0, 0)))
        for k, v in p.exact.items():
            found = found.when(name == k, _tier(v))
        if p.unpriced:
            found = found.when(name.isin(*p.unpriced), F.lit(None))
        for k in sorted(p.families, key=len, reverse=True):
            found = found.when(name.startswith(k), _tier(p.families[k]))
        return found

    return _let(model_name(model), of)


def cost_usd(model: Column, tokens_in: Column, tokens_out: Column, cache_read: Column, cache_write: Column, prices: Prices | None = None) -> Column:
    """The cost of a turn; null if the model has no price. Null counters count as 0. The order of additions is part of the result."""
    part = lambda tokens, price: F.coalesce(tokens, F.lit(0)).cast("double") / 1_000_000 * price
    return _let(tier(model, prices), lambda t: part(tokens_in, t[0]) + part(tokens_out, t[1]) + part(cache_read, t[2]) + part(cache_write, t[3]))
