"""Statistics as Column expressions: quantiles, intervals, exact small-sample tests, agreement."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_INT_MAX = 2**31 - 1
QUANTILES = {"median": 0.5, "p25": 0.25, "p75": 0.75, "p90": 0.9}


def nearest_rank(column: str, q: float) -> Column:
    """The value at rank ceil(q * n), clamped to 1..n, of the non-null values; 0 of none."""
    return F.coalesce(F.expr(f"percentile_disc({min(max(q, 0.0), 1.0)}) WITHIN GROUP (ORDER BY {column})").cast("double"), F.lit(0.0))


def stats_of(column: str) -> Column:
    """n, median, p25, p75 and p90 of the non-null values of a group; zeros of none."""
    return F.struct(F.count(column).alias("n"), *[nearest_rank(column, q).alias(k) for k, q in QUANTILES.items()])


def wilson(successes: Column, n: Column, z: float) -> tuple[Column, Column]:
    """The Wilson score interval, clamped to [0, 1]; (0, 1) without trials."""
    n, p = n.cast("double"), F.try_divide(successes.cast("double"), n.cast("double"))
    z2 = z * z
    scale = 1 + z2 / F.when(n > 0, n)
    centre = p + z2 / (2 * F.when(n > 0, n))
    reach = z * F.sqrt(p * (1 - p) / F.when(n > 0, n) + z2 / (4 * F.when(n > 0, n * n)))
    low, high = (centre - reach) / scale, (centre + reach) / scale
    return F.coalesce(F.greatest(low, F.lit(0.0)), F.lit(0.0)), F.coalesce(F.least(high, F.lit(1.0)), F.lit(1.0))


def binomial_tail(s: str, m: str) -> Column:
    """P(X >= s) of m fair coins: 1 for s <= 0, 0 for s > m. Terms are summed from their logarithms."""
    choose = f"aggregate(sequence(1L, k), 0D, (a, i) -> a + ln(({m} - i + 1) / i))"
    term = f"exp(CASE WHEN k = 0 THEN 0D ELSE {choose} END - {m} * ln(2D))"
    total = f"aggregate(transform(sequence(greatest({s}, 0L), {m}), k -> {term}), 0D, (a, x) -> a + x)"
    return F.expr(f"CASE WHEN {s} <= 0 THEN 1D WHEN {s} > {m} THEN 0D ELSE least(1D, {total}) END")


def signed_rank(deltas: str) -> Column:
    """Wilcoxon's signed ranks of an array of non-zero deltas, exactly, with midranks.

    struct(w_plus, w_total, p_up, p_down): p_up is P(W+ >= w_plus) under random signs, p_down P(W+ <= w_plus).
    Ranks are doubled to stay whole. The null distribution is built by convolution over the ranks.
    """
    ranks = f"transform({deltas}, one -> 2L * size(filter({deltas}, other -> abs(other) < abs(one))) + size(filter({deltas}, other -> abs(other) = abs(one))) + 1L)"
    plus = f"aggregate(zip_with({deltas}, r, (one, x) -> CASE WHEN one > 0 THEN x ELSE 0L END), 0L, (a, x) -> a + x)"
    total = "aggregate(r, 0L, (a, x) -> a + x)"
    ways = f"aggregate(r, transform(sequence(0L, {total}), k -> CASE WHEN k = 0 THEN 1D ELSE 0D END), (dist, x) -> transform(dist, (c, k) -> (c + CASE WHEN k >= x THEN element_at(dist, int(k - x) + 1) ELSE 0D END) / 2))"
    return F.expr(
        f"""CASE WHEN size({deltas}) = 0 THEN named_struct('w_plus', 0D, 'w_total', 0D, 'p_up', 1D, 'p_down', 1D) ELSE
        element_at(transform(array({ranks}), r ->
            element_at(transform(array(named_struct('p', {plus}, 't', {total}, 'w', {ways})), s -> named_struct(
                'w_plus', s.p / 2D, 'w_total', s.t / 2D,
                'p_up', aggregate(slice(s.w, int(s.p) + 1, size(s.w)), 0D, (a, x) -> a + x),
                'p_down', aggregate(slice(s.w, 1, int(s.p) + 1), 0D, (a, x) -> a + x))), 1)), 1) END"""
    )


def pass_k(c: str, n: str, k: str) -> Column:
    """The chance that k runs drawn from n, of which c pass, all pass."""
    return F.expr(f"aggregate(sequence(0L, {k} - 1), 1D, (a, i) -> a * greatest({c} - i, 0L) / ({n} - i))")


def pass_k_steps(c: str, n: str, start: str, end: str) -> Column:
    """The products of the factors of ``pass_k`` that come after ``start`` draws, up to each of the next ones to ``end``."""
    factors = f"transform(sequence({start}, {end} - 1), i -> greatest({c} - i, 0L) / ({n} - i))"
    return F.expr(f"slice(aggregate({factors}, array(1D), (a, x) -> array_append(a, element_at(a, -1) * x)), 2, {_INT_MAX})")


def unanimous(alpha: float, cap: int = 1000) -> int:
    """The smallest n with 2^-n <= alpha, or 0 beyond the cap."""
    return next((n for n in range(1, cap + 1) if 2.0**-n <= alpha), 0)
