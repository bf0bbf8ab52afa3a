"""Distribution tails, in NumPy only."""

from __future__ import annotations

import math

import numpy as np


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    if x < a + 1:  # series of the lower function
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1.0 - total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    b = x + 1 - a  # continued fraction, by Lentz
    c, d = 1e300, 1.0 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1.0 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        step = d * c
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def chi2_sf(x: float, df: float) -> float:
    return gamma_upper(df / 2.0, x / 2.0)


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def normal_cdf(z):
    return 0.5 * np.vectorize(math.erfc)(-np.asarray(z, float) / math.sqrt(2))


# Published response surfaces of the Dickey-Fuller distribution (one variable), by deterministic terms:
# split point, bounds, and polynomial coefficients below and above the split.
DICKEY_FULLER = {
    "n": (-1.04, -19.04, math.inf, (0.6344, 1.2378, 0.032496), (0.4797, 0.93557, -0.06999, 0.033066)),
    "c": (-1.61, -18.83, 2.74, (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)),
    "ct": (-2.89, -16.18, 0.70, (3.2512, 1.6047, 0.049588), (2.5261, 0.61654, -0.37956, -0.060285)),
}
# Published critical values of the KPSS statistic and their levels.
KPSS_CRITICAL = {"c": (0.347, 0.463, 0.574, 0.739), "ct": (0.119, 0.146, 0.176, 0.216)}
KPSS_LEVELS = (0.10, 0.05, 0.025, 0.01)


def dickey_fuller_p(stat: float, regression: str = "c") -> float:
    split, low, high, below, above = DICKEY_FULLER[regression]
    if stat > high:
        return 1.0
    if stat < low:
        return 0.0
    coef = below if stat <= split else above
    return 1.0 - normal_sf(sum(c * stat**k for k, c in enumerate(coef)))


def kpss_p(stat: float, regression: str = "c") -> float:
    return float(np.interp(stat, KPSS_CRITICAL[regression], KPSS_LEVELS))
