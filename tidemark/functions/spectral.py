"""Fourier and wavelet kernels on windows of an ordered series."""

from __future__ import annotations

import math

import numpy as np

#: Scaling taps of orthogonal wavelets.
_R3 = math.sqrt(3.0)
SCALING_TAPS = {
    "haar": (1 / math.sqrt(2), 1 / math.sqrt(2)),
    "db2": ((1 + _R3) / (4 * math.sqrt(2)), (3 + _R3) / (4 * math.sqrt(2)), (3 - _R3) / (4 * math.sqrt(2)), (1 - _R3) / (4 * math.sqrt(2))),
    "sym4": (0.0322231006040427, -0.012603967262037833, -0.09921954357684722, 0.29785779560527736, 0.8037387518059161, 0.49761866763201545, -0.02963552764599851, -0.07576571478927333),
}


def taper(name: str, n: int) -> np.ndarray:
    k = np.arange(n)
    if name == "boxcar":
        return np.ones(n)
    if name == "hann":
        return 0.5 - 0.5 * np.cos(2 * np.pi * k / n)
    if name == "hamming":
        return 0.54 - 0.46 * np.cos(2 * np.pi * k / n)
    if name == "blackman":
        return 0.42 - 0.5 * np.cos(2 * np.pi * k / n) + 0.08 * np.cos(4 * np.pi * k / n)
    raise ValueError(f"no taper {name!r}")


def entropy(power: np.ndarray, normalise: bool = True) -> np.ndarray:
    total = power.sum(-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        h = np.log(total) - np.nansum(power * np.log(power), -1) / total
    return h / math.log(power.shape[-1]) if normalise else h


def flatness(power: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.exp(np.log(power).mean(-1) - np.log(power.sum(-1)) + math.log(power.shape[-1]))


def window_spectrum(block: np.ndarray, window: str = "hann", detrend: bool = True, bands: tuple[tuple[float, float], ...] = ((2, 6), (6, 16), (16, 64))) -> dict[str, np.ndarray]:
    """Features of windows (rows), oldest value first: periods are in rows, the phase is that of the newest row."""
    n = block.shape[1]
    x = block - block.mean(1, keepdims=True)
    if detrend:
        t = np.arange(n) - (n - 1) / 2
        x = x - (x @ t / (t @ t))[:, None] * t
    w = taper(window, n)
    f = np.fft.rfft(x * w, axis=1)[:, 1:]
    freq = np.arange(1, n // 2 + 1) / n
    power = np.abs(f) ** 2
    total = power.sum(1)
    ok = total > 1e-24
    safe = np.where(ok, total, np.nan)
    left = np.c_[np.full(len(power), -np.inf), power[:, :-1]]
    right = np.c_[power[:, 1:], np.full(len(power), -np.inf)]
    peak = np.where((power > left) & (power >= right), power, -1).argmax(1)
    rows = np.arange(len(block))
    nyquist = (n % 2 == 0) & (peak == len(freq) - 1)
    amplitude = np.abs(f[rows, peak]) * np.where(nyquist, 1, 2) / w.sum()
    phase = np.angle(f[rows, peak] * np.exp(2j * np.pi * freq[peak] * (n - 1)))
    period = 1 / freq
    out = {
        "entropy": np.where(ok, entropy(np.where(ok[:, None], power, 1.0)), np.nan), "flatness": np.where(ok, flatness(np.where(ok[:, None], np.maximum(power, 1e-300), 1.0)), np.nan),
        "centroid": (power * freq).sum(1) / safe, "dominant_period": np.where(ok, period[peak], np.nan), "amplitude": np.where(ok, amplitude, np.nan), "phase": np.where(ok, phase, np.nan),
    }
    for a, b in bands:
        out[f"band_{a}_{b}"] = power[:, (period >= a) & (period < b)].sum(1) / safe
    return out


def rolling_spectrum(x: np.ndarray, n: int, missing: np.ndarray | None = None, tolerance: float = 0.1, chunk: int = 4_096, **options) -> dict[str, np.ndarray]:
    """Features of the window that ends at each row; NaN where a value is missing or too many slots are."""
    out: dict[str, np.ndarray] = {}
    slots = np.zeros(len(x)) if missing is None else missing
    for start in range(n - 1, len(x), chunk):
        ends = np.arange(start, min(start + chunk, len(x)))
        view = np.lib.stride_tricks.sliding_window_view(x, n)[ends - n + 1]
        gap = np.lib.stride_tricks.sliding_window_view(slots, n)[ends - n + 1].sum(1)
        good = np.isfinite(view).all(1) & (gap <= tolerance * n)
        for k, v in window_spectrum(np.where(good[:, None], view, 0.0), **options).items():
            out.setdefault(k, np.full(len(x), np.nan))[ends[good]] = v[good]
    return out


def reconstruct(window: np.ndarray, components: int, ahead: int = 0) -> np.ndarray:
    """Mean and strongest components of a window, carried ``ahead`` rows on."""
    n = len(window)
    f = np.fft.rfft(window - window.mean())
    top = 1 + np.argsort(-np.abs(f[1:]), kind="stable")[:components]
    t = np.arange(n + ahead)
    scale = np.where((n % 2 == 0) & (top == n // 2), 1, 2) / n
    return window.mean() + (scale[:, None] * np.real(f[top][:, None] * np.exp(2j * np.pi * top[:, None] * t / n))).sum(0)


def extrapolation_errors(x: np.ndarray, ends: np.ndarray, n: int, components: int, horizons: tuple[int, ...]) -> list[tuple[int, int, float, float]]:
    """(horizon, windows, RMSE of the projection, RMSE of the last value)."""
    out = []
    usable = [e for e in ends if e + max(horizons) < len(x) and e >= n - 1]
    made = {e: reconstruct(x[e - n + 1 : e + 1], components, max(horizons)) for e in usable}
    for h in horizons:
        real = np.array([x[e + h] for e in usable])
        a = np.array([made[e][n - 1 + h] for e in usable]) - real
        b = np.array([x[e] for e in usable]) - real
        out.append((h, len(usable), float(np.sqrt((a**2).mean())), float(np.sqrt((b**2).mean()))))
    return out


def modwt_filters(wavelet: str, levels: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Equivalent detail filters of every level and the last smooth filter, newest row first."""
    g = np.array(SCALING_TAPS[wavelet]) / math.sqrt(2)
    h = g[::-1] * (-1.0) ** np.arange(len(g))

    def spaced(f: np.ndarray, step: int) -> np.ndarray:
        out = np.zeros((len(f) - 1) * step + 1)
        out[::step] = f
        return out

    details, smooth = [], np.ones(1)
    for j in range(levels):
        details.append(np.convolve(smooth, spaced(h, 2**j)))
        smooth = np.convolve(smooth, spaced(g, 2**j))
    return details, smooth


def causal_modwt(x: np.ndarray, wavelet: str, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients by level from past rows only (missing read as 0), and flags of rows with a full present history."""
    details, smooth = modwt_filters(wavelet, levels)
    z, have = np.where(np.isfinite(x), x, 0.0), np.isfinite(x).astype(float)
    filters = [*details, smooth]
    out = np.array([np.convolve(z, f)[: len(x)] for f in filters])
    full = np.array([np.convolve(have, np.ones(len(f)))[: len(x)] >= len(f) - 0.5 for f in filters])
    return out, full


def circular_modwt(x: np.ndarray, wavelet: str, levels: int) -> np.ndarray:
    """Periodic coefficients of a whole series: not causal."""
    details, smooth = modwt_filters(wavelet, levels)
    fx = np.fft.fft(x)

    def wrap(f: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        np.add.at(out, np.arange(len(f)) % len(x), f)
        return out

    return np.array([np.real(np.fft.ifft(fx * np.fft.fft(wrap(f)))) for f in [*details, smooth]])


def multiresolution(x: np.ndarray, wavelet: str, levels: int) -> np.ndarray:
    """Zero-phase components that add up to the series: not causal."""
    details, smooth = modwt_filters(wavelet, levels)
    fx, out = np.fft.fft(x), []
    for f in [*details, smooth]:
        w = np.zeros(len(x))
        np.add.at(w, np.arange(len(f)) % len(x), f)
        out.append(np.real(np.fft.ifft(fx * np.abs(np.fft.fft(w)) ** 2)))
    return np.array(out)


def rolling_wavelet(x: np.ndarray, window: int, wavelet: str = "haar", levels: int = 4) -> dict[str, np.ndarray]:
    """Trailing energy by level, shares, entropy and dominant band; NaN without a full history."""
    w, full = causal_modwt(x, wavelet, levels)
    e = np.cumsum(np.c_[np.zeros(levels), w[:levels] ** 2], 1)
    ok = np.cumsum(np.c_[np.zeros(levels), full[:levels]], 1)
    energy = np.full((levels, len(x)), np.nan)
    if len(x) >= window:
        sums, good = e[:, window:] - e[:, :-window], ok[:, window:] - ok[:, :-window] == window
        energy[:, window - 1 :] = np.where(good, np.maximum(sums, 0.0), np.nan)
    total = energy.sum(0)
    share = np.where(total > 1e-18, energy / np.where(total > 1e-18, total, 1), np.nan)
    with np.errstate(divide="ignore", invalid="ignore"):
        ent = -np.nansum(np.where(share > 0, share * np.log(share), 0.0), 0) / math.log(levels)
    known = np.isfinite(share).all(0)
    dominant = np.where(known, np.where(known, share, 0).argmax(0) + 1.0, np.nan)
    return {**{f"share_{j + 1}": share[j] for j in range(levels)}, "entropy": np.where(known, ent, np.nan), "dominant": dominant}


def morlet_power(x: np.ndarray, scales: np.ndarray, w0: float = 6.0) -> np.ndarray:
    """Power of the continuous transform, by scale and row, with zeros beyond the ends: not causal."""
    n = 1 << (2 * len(x) - 1).bit_length()
    f, om = np.fft.fft(x, n), 2 * np.pi * np.fft.fftfreq(n)
    out = []
    for s in scales:
        psi = np.pi**-0.25 * np.sqrt(2 * np.pi * s) * np.exp(-0.5 * (s * om - w0) ** 2) * (om > 0)
        out.append(np.abs(np.fft.ifft(f * psi)[: len(x)]) ** 2)
    return np.array(out)
