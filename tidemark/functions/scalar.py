"""Scalar expressions: returns, Ornstein-Uhlenbeck algebra, buckets, angles and calendar features."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PRICE_COLUMNS = {("mid", c): c for c in ("open", "high", "low", "close")} | {
    ("bid", "open"): "first_bid", ("bid", "close"): "last_bid", ("ask", "open"): "first_ask", ("ask", "close"): "last_ask",
}


def price_column(source: str, price: str) -> str:
    """Column of a bar table that holds a price of a quote side."""
    if (source, price) not in PRICE_COLUMNS:
        raise ValueError(f"no {price} of {source} in bars")
    return PRICE_COLUMNS[source, price]


def corr(x, y, over=None) -> Column:
    """Pearson correlation over rows where both are present, null without variance (the built-in one raises there)."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    parts = [F.covar_pop(a, b), F.stddev_pop(a), F.stddev_pop(b)]
    cov, sa, sb = [p.over(over) for p in parts] if over is not None else parts
    return F.try_divide(cov, sa * sb)


def nan_null(c: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def simple_return(now: Column, before: Column) -> Column:
    return F.try_divide(now - before, before)


def log_return(now: Column, before: Column) -> Column:
    return F.ln(F.try_divide(now, before))


def quotient(a: Column, b: Column) -> Column:
    """a / b of doubles by IEEE 754: infinite or NaN where b is zero."""
    return F.coalesce(F.try_divide(a, b), F.when(b == 0, a * float("inf")))


def logarithm(x: Column) -> Column:
    """ln x by IEEE 754: minus infinity of zero, NaN of less."""
    return F.coalesce(F.ln(x), F.sqrt(x) - float("inf"))


def log_ratio(now: Column, before: Column) -> Column:
    """Log return that is infinite or NaN, not missing, where a price is zero."""
    return logarithm(quotient(now, before))


def signed_log(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def _mean_reverting(b: Column) -> Column:
    return (b > 0) & (b < 1)


def theta_from_b(b: Column, dt: float = 1.0) -> Column:
    """Speed of reversion of an AR(1) coefficient; null outside (0, 1)."""
    return F.when(_mean_reverting(b), -F.ln(b) / dt)


def half_life_bars(b: Column) -> Column:
    return F.when(_mean_reverting(b), F.lit(-math.log(2.0)) / F.ln(b))


def stationary_std(sigma: Column, theta: Column) -> Column:
    return F.when(theta > 0, sigma / F.sqrt(2 * theta))


def expected_value(x: Column, mu: Column, theta: Column, h: float) -> Column:
    return mu + (x - mu) * F.exp(-theta * h)


def decay_ratio(theta: Column, h: float) -> Column:
    return F.exp(-theta * h)


def innovation_variance(theta: Column, sigma: Column, dt: float = 1.0) -> Column:
    """Exact variance of one step of the process."""
    return F.when(theta > 0, sigma * sigma * (1 - F.exp(-2 * theta * dt)) / (2 * theta))


def ou_state(b: Column, complete: Column, degenerate: Column, max_half_life: float = 10_000.0, tolerance: float = 1e-9, low: float = 0.0, high: float = 1.0) -> Column:
    """One of eight states of an AR(1) fit; only ``valid`` has OU parameters."""
    return (
        F.when(~complete, "insufficient_data").when(degenerate | b.isNull() | F.isnan(b), "degenerate").when(b <= 0, "non_positive")
        .when(b > 1 + tolerance, "explosive").when(F.abs(b - 1) <= tolerance, "unit_root")
        .when(~F.coalesce(half_life_bars(b) <= max_half_life, F.lit(False)), "near_unit_root")
        .when((b > low) & (b < high), "valid").otherwise("outside_valid_range")
    )


def map_ar1_to_ou(a: Column, b: Column, innovation: Column, complete: Column, degenerate: Column, dt: float = 1.0, zero: float = 1e-12) -> dict[str, Column]:
    """State and OU parameters (null unless the state is valid) of an AR(1) fit; an innovation variance at or below
    ``zero`` counts as none."""
    state = ou_state(b, complete, degenerate)
    theta = -F.ln(b) / dt
    spread = F.sqrt(F.when(innovation <= zero, 0.0).otherwise(innovation) / ((1 - b) * (1 + b)))
    pick = lambda c: F.when(state == "valid", c)
    return {
        "ou_state": state, "ou_theta": pick(theta), "ou_mu": pick(a / (1 - b)), "ou_sigma": pick(spread * F.sqrt(2 * theta)),
        "ou_half_life": pick(half_life_bars(b)), "ou_stationary_std": pick(spread),
    }


def wrap_phase(a: Column) -> Column:
    """Angle in [-pi, pi)."""
    return F.pmod(a + math.pi, F.lit(2 * math.pi)) - math.pi


def time_features(ts: Column) -> dict[str, Column]:
    """Hour and ISO weekday on the circle."""
    hour = (F.hour(ts) + F.minute(ts) / 60.0) * (2 * math.pi / 24)
    day = (F.weekday(ts)) * (2 * math.pi / 7)
    return {"hour_sin": F.sin(hour), "hour_cos": F.cos(hour), "weekday_sin": F.sin(day), "weekday_cos": F.cos(day)}


def effect_size(rho: Column) -> Column:
    """Name of a correlation's magnitude; the bounds are fixed values."""
    r = F.abs(rho)
    return F.when(rho.isNull(), "undefined").when(r < 0.01, "negligible").when(r < 0.05, "very small").when(r < 0.1, "small").when(r < 0.2, "moderate").otherwise("large")


def half_open_bin(x: Column, edges: list[float]) -> Column:
    """Number of the bin [e_i, e_i+1) that holds a value; null outside."""
    out = F.when(x.isNull() | F.isnan(x), None)
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        out = out.when((x >= a) & (x < b), k)
    return out


def edge_bucket(x: Column, edges: Column, right: bool = True) -> Column:
    """Bucket by an array of ascending inner edges: how many are at most x (``right``) or below it."""
    below = F.filter(edges, lambda e: (e <= x) if right else (e < x))
    return F.when(x.isNotNull() & ~F.isnan(x) & edges.isNotNull(), F.size(below))


def clip(x: Column, low, high) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)))


def any_of(*flags: Column) -> Column:
    out = F.lit(False)
    for f in flags:
        out = out | F.coalesce(f, F.lit(False))
    return out
