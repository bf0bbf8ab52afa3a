"""Kernels on one ordered series of numbers. NaN is missing inside; tables get null."""

from __future__ import annotations

import math

import numpy as np

from tidemark.functions.special import chi2_sf, dickey_fuller_p, kpss_p


def ols(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients, their standard errors and the residual sum of squares."""
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    e = y - x @ beta
    sse = float(e @ e)
    cov = np.linalg.pinv(x.T @ x) * sse / max(1, len(y) - x.shape[1])
    return beta, np.sqrt(np.diag(cov)), sse


def autocorrelation(x: np.ndarray, max_lag: int) -> np.ndarray:
    """Lags 1 to ``max_lag`` by FFT, the whole series' mean and variance."""
    d = x[np.isfinite(x)]
    d = d - d.mean()
    f = np.fft.rfft(d, 1 << (2 * len(d) - 1).bit_length())
    acf = np.fft.irfft(f * np.conj(f))[: max_lag + 1]
    return acf[1:] / acf[0]


def ljung_box(acf: np.ndarray, n: int, lags: list[int]) -> list[tuple[int, float, float]]:
    """(lag, Q, p)."""
    q = n * (n + 2) * np.cumsum(acf**2 / (n - np.arange(1, len(acf) + 1)))
    return [(k, float(q[k - 1]), chi2_sf(float(q[k - 1]), k)) for k in lags]


def thin(x: np.ndarray, most: int) -> np.ndarray:
    """At most so many values, evenly spread."""
    return x if len(x) <= most else x[np.linspace(0, len(x) - 1, most).round().astype(int)]


def _terms(n: int, regression: str) -> np.ndarray:
    return {"n": np.zeros((n, 0)), "c": np.ones((n, 1)), "ct": np.c_[np.ones(n), np.arange(1, n + 1)]}[regression]


def adf(x: np.ndarray, regression: str = "c", max_lag: int | None = None) -> tuple[float, float, int]:
    """Augmented Dickey-Fuller statistic, p and lags; lags by AIC on a common sample."""
    x = x[np.isfinite(x)]
    n = len(x)
    k = _terms(1, regression).shape[1]
    top = min(max_lag if max_lag is not None else math.ceil(12 * (n / 100) ** 0.25), n // 2 - k - 1)
    d = np.diff(x)

    def fit(lags: int, start: int):
        y = d[start:]
        lagged = [d[start - j : len(d) - j] for j in range(1, lags + 1)]
        m = np.column_stack([x[start : len(x) - 1], *lagged, _terms(len(y), regression)])
        beta, se, sse = ols(m, y)
        return beta[0] / se[0], len(y) * math.log(sse / len(y)) + 2 * m.shape[1]

    best = min(range(top + 1), key=lambda j: fit(j, top)[1])
    stat = float(fit(best, best)[0])
    return stat, dickey_fuller_p(stat, regression), best


def kpss(x: np.ndarray, regression: str = "c", lags: int | None = None) -> tuple[float, float, int]:
    """KPSS statistic, p (within the table) and lags (Hobijn and others' automatic choice)."""
    x = x[np.isfinite(x)]
    n = len(x)
    beta, _, _ = ols(_terms(n, regression), x)
    e = x - _terms(n, regression) @ beta
    if lags is None:
        cov = int(n ** (2 / 9))
        s0 = e @ e / n
        s1 = 0.0
        for i in range(1, cov + 1):
            c = 2 * (e[i:] @ e[: n - i]) / n
            s0 += c
            s1 += i * c
        lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
    var = e @ e
    for i in range(1, lags + 1):
        var += 2 * (e[i:] @ e[: n - i]) * (1 - i / (lags + 1))
    stat = float((np.cumsum(e) ** 2).sum() / n**2 / (var / n))
    return stat, kpss_p(stat, regression), lags


def stationarity(x: np.ndarray, alpha: float = 0.05, most: int | None = None) -> dict:
    """Both tests and a verdict, on all finite values unless ``most`` asks for a thinner series."""
    x = x[np.isfinite(x)]
    x = x if most is None else thin(x, most)
    a, pa, la = adf(x)
    k, pk, lk = kpss(x)
    verdict = {(True, False): "stationary", (False, True): "unit_root", (True, True): "conflicting", (False, False): "inconclusive"}[pa < alpha, pk < alpha]
    return {"n": len(x), "adf": a, "adf_p": pa, "adf_lags": la, "kpss": k, "kpss_p": pk, "kpss_lags": lk, "verdict": verdict}


def ewma_lagged(r: np.ndarray, lam: float, warmup: int) -> np.ndarray:
    """Volatility from s2_t = lam s2_(t-1) + (1 - lam) r_(t-1)^2, seeded by the variance of the first ``warmup`` present
    returns; a missing return leaves the state as it is."""
    out = np.full(len(r), np.nan)
    at = np.flatnonzero(np.isfinite(r))
    if len(at) <= warmup:
        return out
    s2 = float(np.var(r[at[:warmup]], ddof=1))
    start = at[warmup - 1] + 1
    for t in range(start, len(r)):
        if t > start and np.isfinite(r[t - 1]):
            s2 = lam * s2 + (1 - lam) * r[t - 1] ** 2
        out[t] = math.sqrt(s2)
    return out


def ewma_current(x: np.ndarray, lam: float) -> np.ndarray:
    """v_t = lam v_(t-1) + (1 - lam) x_t, seeded by the mean of the first ceil(3 / (1 - lam)) values."""
    out = np.full(len(x), np.nan)
    k = math.ceil(3 / (1 - lam))
    at = np.flatnonzero(np.isfinite(x))
    if len(at) < k:
        return out
    v = float(x[at[:k]].mean())
    for t in range(at[k - 1], len(x)):
        if t > at[k - 1] and np.isfinite(x[t]):
            v = lam * v + (1 - lam) * x[t]
        out[t] = v
    return out


def linear_variance(x: np.ndarray, omega: float, alpha: float, beta: float, first: float) -> np.ndarray:
    """h_t = omega + alpha x_(t-1)^2 + beta h_(t-1)."""
    h = np.empty(len(x))
    h[0] = first
    for t in range(1, len(x)):
        h[t] = omega + alpha * x[t - 1] ** 2 + beta * h[t - 1]
    return h


def bootstrap_mean(x: np.ndarray, iterations: int = 500, level: float = 0.95, seed: int = 7, chunk: int = 1 << 20) -> tuple[float, float, float]:
    """Mean of all finite values with a seeded percentile interval; also for shares, as means of flags. Each replicate
    draws as many values as there are, ``chunk`` at a time."""
    rng = np.random.default_rng(seed)
    x = x[np.isfinite(x)]
    n = len(x)
    if not n:
        return math.nan, math.nan, math.nan
    means = np.array([sum(x[rng.integers(0, n, min(chunk, n - k))].sum() for k in range(0, n, chunk)) / n for _ in range(iterations)])
    low, high = np.quantile(means, [(1 - level) / 2, (1 + level) / 2])
    return float(x.mean()), float(low), float(high)


def block_bootstrap(x: np.ndarray, segment: np.ndarray, block: int, horizon: int, replicates: int, seed: int) -> tuple[float, float, float] | None:
    """Mean with moving blocks inside segments; None where a segment is shorter than a block or a block than the horizon."""
    if block < horizon:
        return None
    parts = [x[segment == s] for s in np.unique(segment)]
    if any(len(p) < block for p in parts):
        return None
    rng = np.random.default_rng(seed)
    means = []
    for _ in range(replicates):
        total = count = 0.0
        for p in parts:
            k = math.ceil(len(p) / block)
            at = rng.integers(0, len(p) - block + 1, k)
            drawn = (p[at[:, None] + np.arange(block)]).ravel()[: len(p)]
            total += drawn.sum()
            count += len(p)
        means.append(total / count)
    low, high = np.quantile(means, [0.025, 0.975])
    return float(np.concatenate(parts).mean()), float(low), float(high)


def pelt_mean(x: np.ndarray, penalty: float | None = None, min_size: int = 5, multiplier: float = 2.0) -> list[int]:
    """Starts of segments with their own mean, by pruned exact dynamic programming."""
    n = len(x)
    if penalty is None:
        spread = np.median(np.abs(np.diff(x))) / 0.9539 if n > 1 else 0.0
        penalty = multiplier * spread**2 * math.log(max(n, 2))
    s1, s2 = np.r_[0.0, np.cumsum(x)], np.r_[0.0, np.cumsum(x * x)]
    best = np.full(n + 1, np.inf)
    best[0] = -penalty
    back = np.zeros(n + 1, int)
    open_ = np.array([0])
    for t in range(min_size, n + 1):
        m = t - open_
        cost = s2[t] - s2[open_] - (s1[t] - s1[open_]) ** 2 / m
        total = best[open_] + cost + penalty
        total = np.where(m >= min_size, total, np.inf)
        k = int(total.argmin())
        best[t], back[t] = total[k], open_[k]
        keep = (best[open_] + cost <= best[t]) | (m < min_size)
        open_ = np.r_[open_[keep], t - min_size + 1] if t - min_size + 1 > 0 else open_[keep]
    cuts, t = [], n
    while t > 0:
        t = int(back[t])
        cuts.append(t)
    return sorted(cuts)


def circular_shift_null(x: np.ndarray, y: np.ndarray, draws: int, min_fraction: float, seed: int) -> np.ndarray:
    """Correlations of x with y turned by a random number of rows from [f n, (1 - f) n)."""
    rng = np.random.default_rng(seed)
    n = len(x)
    shifts = rng.integers(int(min_fraction * n), max(int((1 - min_fraction) * n), int(min_fraction * n) + 1), draws)
    return np.array([np.corrcoef(x, np.roll(y, -s))[0, 1] for s in shifts])


def permutation_null(x: np.ndarray, y: np.ndarray, draws: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.array([np.corrcoef(x, rng.permutation(y))[0, 1] for _ in range(draws)])


def surrogate(kind: str, r: np.ndarray, seed: int, block: int = 20) -> np.ndarray:
    """Control returns: random walk, shuffled, block bootstrap, white or AR(1) noise of the same size."""
    rng = np.random.default_rng(seed)
    n, sd = len(r), float(np.std(r))
    if kind in ("random_walk", "white_noise"):
        return rng.normal(0, sd, n)
    if kind == "shuffled":
        return rng.permutation(r)
    if kind == "block_bootstrap":
        at = rng.integers(0, max(1, n - block + 1), math.ceil(n / block))
        return np.concatenate([r[a : a + block] for a in at])[:n]
    if kind == "ar_noise":
        phi = float(np.corrcoef(r[1:], r[:-1])[0, 1])
        e = rng.normal(0, sd * math.sqrt(max(0.0, 1 - phi**2)), n)
        out = np.empty(n)
        out[0] = e[0]
        for t in range(1, n):
            out[t] = phi * out[t - 1] + e[t]
        return out
    raise ValueError(f"no control {kind!r}")


def segmented_hac(x: np.ndarray, e: np.ndarray, times: np.ndarray, seconds: float, lags: int) -> np.ndarray:
    """Newey-West covariance of OLS coefficients whose lagged products count only at their true spacing."""
    u = x * e[:, None]
    meat = u.T @ u
    for k in range(1, lags + 1):
        true = (times[k:] - times[:-k]) == k * seconds
        g = u[k:][true].T @ u[:-k][true]
        meat += (1 - k / (lags + 1)) * (g + g.T)
    bread = np.linalg.pinv(x.T @ x)
    return bread @ meat @ bread


def half_life_of_decay(lags: np.ndarray, ic: np.ndarray, se: np.ndarray, zero_z: float = 1.0, min_points: int = 3) -> float | None:
    """Half-life of an exponential fit to |IC| over the lags before it is first lost in its error."""
    gone = np.flatnonzero(np.abs(ic) < zero_z * se)
    stop = gone[0] if len(gone) else len(ic)
    if stop < min_points:
        return None
    slope = np.polyfit(lags[:stop], np.log(np.abs(ic[:stop])), 1)[0]
    return float(-math.log(2) / slope) if slope < 0 else None


def decay_summary(horizons: np.ndarray, ic: np.ndarray, se: np.ndarray, zero_z: float = 1.0) -> dict:
    """Peak, half-decay, zero and sign-reversal horizons."""
    k = int(np.abs(ic).argmax())
    later = np.arange(len(ic)) > k
    first = lambda m: int(horizons[np.flatnonzero(m)[0]]) if m.any() else None
    return {
        "peak": int(horizons[k]), "half": first(later & (np.abs(ic) <= abs(ic[k]) / 2)), "zero": first(np.abs(ic) < zero_z * se),
        "reversal": first(later & (np.sign(ic) == -np.sign(ic[k])) & (np.abs(ic) > zero_z * se)),
    }


def theil_sen(y: np.ndarray) -> float:
    """Median of the slopes of all pairs of one window."""
    i, j = np.triu_indices(len(y), 1)
    return float(np.median((y[j] - y[i]) / (j - i)))


def rolling_theil_sen(y: np.ndarray, window: int) -> np.ndarray:
    """``theil_sen`` of the window that ends at each value; missing before the first whole window."""
    out = np.full(len(y), np.nan)
    for k in range(window, len(y) + 1):
        out[k - 1] = theil_sen(y[k - window : k])
    return out
