"""Regime, linear, ensemble and econometric models on arrays. Fits see training rows only; callers pass those."""

from __future__ import annotations

import itertools
import math

import numpy as np

# Regimes.


def fit_scaler(x: np.ndarray, method: str = "robust", clip: float = 5.0) -> dict:
    if method == "robust":
        q = np.nanquantile(x, [0.25, 0.5, 0.75], axis=0)
        centre, scale = q[1], (q[2] - q[0]) / 1.349
    else:
        centre, scale = np.nanmean(x, 0), np.nanstd(x, 0, ddof=1)
    return {"centre": centre, "scale": np.where(scale > 0, scale, 1.0), "clip": clip}


def scale(x: np.ndarray, s: dict) -> np.ndarray:
    return np.clip((x - s["centre"]) / s["scale"], -s["clip"], s["clip"])


def kmeans(x: np.ndarray, k: int, n_init: int = 5, max_iter: int = 100, tol: float = 1e-6, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """Centres, labels and inertia of the best of several k-means++ starts."""
    rng = np.random.default_rng(seed)
    best = None
    for _ in range(n_init):
        c = x[rng.integers(len(x))][None]
        while len(c) < k:
            d = ((x[:, None] - c) ** 2).sum(2).min(1)
            c = np.vstack([c, x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[rng.integers(len(x))]])
        for _ in range(max_iter):
            d = ((x[:, None] - c) ** 2).sum(2)
            lab = d.argmin(1)
            new = np.array([x[lab == j].mean(0) if (lab == j).any() else x[d.min(1).argmax()] for j in range(k)])
            moved = np.abs(new - c).max()
            c = new
            if moved < tol:
                break
        d = ((x[:, None] - c) ** 2).sum(2)
        inertia = float(d.min(1).sum())
        if best is None or inertia < best[2]:
            best = c, d.argmin(1), inertia
    order = np.lexsort(best[0].T[::-1])
    return best[0][order], np.argsort(order)[best[1]], best[2]


def log_gaussian(x: np.ndarray, means: np.ndarray, covs: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(means)))
    for j, (m, c) in enumerate(zip(means, covs, strict=True)):
        low = np.linalg.cholesky(c)
        z = np.linalg.solve(low, (x - m).T)
        out[:, j] = -0.5 * ((z**2).sum(0) + x.shape[1] * math.log(2 * math.pi)) - np.log(np.diag(low)).sum()
    return out


def logsumexp(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return np.squeeze(top + np.log(np.exp(a - top).sum(axis, keepdims=True)), axis)


def _moments(x: np.ndarray, r: np.ndarray, kind: str, reg: float) -> tuple[np.ndarray, np.ndarray]:
    n = r.sum(0) + 1e-12
    means = r.T @ x / n[:, None]
    d = x.shape[1]
    covs = np.array([((r[:, j, None] * (x - means[j])).T @ (x - means[j])) / n[j] for j in range(r.shape[1])])
    if kind == "tied":
        covs = np.repeat(((n[:, None, None] * covs).sum(0) / n.sum())[None], len(covs), 0)
    if kind == "diag":
        covs = np.array([np.diag(np.diag(c)) for c in covs])
    return means, covs + reg * np.eye(d)


def gmm(x: np.ndarray, k: int, kind: str = "full", max_iter: int = 200, tol: float = 1e-6, reg: float = 1e-6, seed: int = 7) -> dict:
    """Expectation maximisation from a k-means start."""
    _, lab, _ = kmeans(x, k, seed=seed)
    r = np.eye(k)[lab]
    last = -np.inf
    for _ in range(max_iter):
        means, covs = _moments(x, r, kind, reg)
        weights = r.mean(0)
        lp = log_gaussian(x, means, covs) + np.log(weights + 1e-300)
        total = logsumexp(lp, 1)
        r = np.exp(lp - total[:, None])
        if total.mean() - last < tol:
            break
        last = total.mean()
    return {"weights": weights, "means": means, "covs": covs, "log_likelihood": float(total.sum())}


def forward_filter(log_b: np.ndarray, transition: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """P(state at t | rows up to t): causal."""
    out = np.empty_like(log_b)
    p = prior
    for t in range(len(log_b)):
        p = (p if t == 0 else p @ transition) * np.exp(log_b[t] - log_b[t].max())
        p = p / p.sum()
        out[t] = p
    return out


def forward_backward(log_b: np.ndarray, transition: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Smoothed state probabilities, summed transition probabilities and the log-likelihood: not causal."""
    n, k = log_b.shape
    b = np.exp(log_b - log_b.max(1, keepdims=True))
    a, c = np.empty((n, k)), np.empty(n)
    for t in range(n):
        a[t] = (prior if t == 0 else a[t - 1] @ transition) * b[t]
        c[t] = a[t].sum()
        a[t] /= c[t]
    beta, xi = np.ones(k), np.zeros((k, k))
    gamma = np.empty((n, k))
    gamma[-1] = a[-1]
    for t in range(n - 2, -1, -1):
        w = b[t + 1] * beta / c[t + 1]
        xi += a[t][:, None] * transition * w
        beta = transition @ w
        gamma[t] = a[t] * beta
    return gamma, xi, float(np.log(c).sum() + log_b.max(1).sum())


def viterbi(log_b: np.ndarray, transition: np.ndarray, prior: np.ndarray) -> np.ndarray:
    lt = np.log(transition + 1e-300)
    score, back = np.log(prior + 1e-300) + log_b[0], []
    for row in log_b[1:]:
        s = score[:, None] + lt
        back.append(s.argmax(0))
        score = s.max(0) + row
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return np.array(path[::-1])


def fit_hmm(x: np.ndarray, k: int, kind: str = "full", max_iter: int = 60, tol: float = 1e-5, reg: float = 1e-4, pseudo: float = 1.0, seed: int = 7) -> dict:
    """Baum-Welch from a mixture start; states in order of their first mean."""
    g = gmm(x, k, kind, seed=seed)
    means, covs = g["means"], g["covs"]
    transition, prior = np.full((k, k), 0.1 / max(1, k - 1)) + np.eye(k) * (0.9 - 0.1 / max(1, k - 1)), np.full(k, 1 / k)
    last = -np.inf
    for _ in range(max_iter):
        gamma, xi, ll = forward_backward(log_gaussian(x, means, covs), transition, prior)
        transition = (xi + pseudo * np.eye(k)) / (xi + pseudo * np.eye(k)).sum(1, keepdims=True)
        prior = gamma[0] / gamma[0].sum()
        means, covs = _moments(x, gamma, kind, reg)
        if ll - last < tol * len(x):
            break
        last = ll
    order = np.argsort(means[:, 0])
    return {"means": means[order], "covs": covs[order], "transition": transition[np.ix_(order, order)], "prior": prior[order], "log_likelihood": ll}


def align_states(cost: np.ndarray) -> list[int]:
    """Permutation of columns with the least total cost; a few states."""
    k = len(cost)
    return list(min(itertools.permutations(range(k)), key=lambda p: sum(cost[i, p[i]] for i in range(k))))


# Linear models on Gram matrices.


def gram(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Correlation matrix of features and correlations with the target."""
    z = (x - x.mean(0)) / x.std(0)
    t = (y - y.mean()) / y.std()
    return z.T @ z / len(z), z.T @ t / len(z)


def ridge(q: np.ndarray, c: np.ndarray, alpha: float) -> np.ndarray:
    return np.linalg.solve(q + alpha * np.eye(len(q)), c)


def lasso_path(q: np.ndarray, c: np.ndarray, l2: float = 0.0, n_alphas: int = 30, min_ratio: float = 1e-3, tol: float = 1e-8, sweeps: int = 500) -> list[tuple[float, np.ndarray]]:
    """Coordinate descent on a correlation Gram matrix, warm along falling penalties."""
    top = np.abs(c).max()
    b, out = np.zeros(len(c)), []
    for a in np.geomspace(top, top * min_ratio, n_alphas):
        for _ in range(sweeps):
            move = 0.0
            for j in range(len(c)):
                g = c[j] - q[j] @ b + q[j, j] * b[j]
                new = math.copysign(max(abs(g) - a, 0.0), g) / (q[j, j] + l2)
                move = max(move, abs(new - b[j]))
                b[j] = new
            if move < tol:
                break
        out.append((float(a), b.copy()))
    return out


def logistic_l1(x: np.ndarray, y: np.ndarray, lambdas: list[float], max_iter: int = 500, tol: float = 1e-7) -> list[np.ndarray]:
    """Proximal gradient path; the first coefficient is the free intercept."""
    a = np.c_[np.ones(len(x)), x]
    step = 4.0 / np.linalg.norm(a.T @ a / len(a), 2)
    b, out = np.zeros(a.shape[1]), []
    for lam in lambdas:
        for _ in range(max_iter):
            p = 1 / (1 + np.exp(-np.clip(a @ b, -35, 35)))
            new = b - step * (a.T @ (p - y)) / len(a)
            new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * lam, 0)
            done = np.abs(new - b).max() < tol
            b = new
            if done:
                break
        out.append(b.copy())
    return out


def pca(x: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, loadings (sign fixed by the largest entry) and variance shares."""
    m = x.mean(0)
    _, s, v = np.linalg.svd(x - m, full_matrices=False)
    v = v * np.sign(v[np.arange(len(v)), np.abs(v).argmax(1)])[:, None]
    return m, v[:components], (s**2 / (s**2).sum())[:components]


def collinearity(corr: np.ndarray) -> tuple[float, np.ndarray]:
    """Condition number and variance inflation factors."""
    w = np.linalg.eigvalsh(corr)
    return float(w[-1] / max(w[0], 1e-15)), np.diag(np.linalg.pinv(corr))


def clusters(abs_corr: np.ndarray, threshold: float, method: str = "average") -> np.ndarray:
    """Labels of agglomerative clusters at distance 1 - |rho| up to 1 - threshold."""
    d = 1 - abs_corr
    groups = [[i] for i in range(len(d))]
    link = {"average": np.mean, "single": np.min, "complete": np.max}[method]
    while len(groups) > 1:
        pairs = [(link(d[np.ix_(a, b)]), i, j) for (i, a), (j, b) in itertools.combinations(enumerate(groups), 2)]
        best, i, j = min(pairs)
        if best > 1 - threshold:
            break
        groups[i] += groups.pop(j)
    out = np.empty(len(d), int)
    for k, g in enumerate(sorted(groups, key=min)):
        out[g] = k
    return out


def connected_groups(abs_corr: np.ndarray, threshold: float) -> np.ndarray:
    """Connected components of features correlated at least so much."""
    return clusters(abs_corr, threshold, "single")


# Calibration, importance, distance.


def isotonic(p: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps of a rising fit: pooled adjacent violators."""
    o = np.argsort(p, kind="stable")
    blocks: list[list[float]] = []
    for x, v in zip(p[o], y[o], strict=True):
        blocks.append([v, 1.0, x])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b = blocks.pop()
            a = blocks[-1]
            a[0] = (a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1])
            a[1] += b[1]
            a[2] = b[2]
    return np.array([b[2] for b in blocks]), np.array([b[0] for b in blocks])


def platt(p: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and intercept of a logistic map of the log odds."""
    x = np.c_[np.log(np.clip(p, 1e-9, 1 - 1e-9) / (1 - np.clip(p, 1e-9, 1 - 1e-9))), np.ones(len(p))]
    b = np.zeros(2)
    for _ in range(steps):
        q = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.solve((x * (q * (1 - q) + 1e-9)[:, None]).T @ x, x.T @ (y - q))
    return float(b[0]), float(b[1])


def fit_calibrator(p: np.ndarray, y: np.ndarray, method: str, min_rows: int = 20_000):
    """A map of probabilities; the identity for ``none`` or too few rows."""
    if method == "none" or len(p) < min_rows:
        return lambda q: q
    if method == "platt":
        a, b = platt(p, y)
        return lambda q: 1 / (1 + np.exp(-(a * np.log(np.clip(q, 1e-9, 1 - 1e-9) / (1 - np.clip(q, 1e-9, 1 - 1e-9))) + b)))
    edges, values = isotonic(p, y)
    return lambda q: np.interp(q, edges, values)


def block_permutation_importance(predict, x: np.ndarray, y: np.ndarray, j: int, block: int, repeats: int, seed: int) -> float:
    """Rise of the squared error when blocks of a column are shuffled."""
    rng = np.random.default_rng(seed)
    base = ((predict(x) - y) ** 2).mean()
    rise = []
    for _ in range(repeats):
        parts = [x[k : k + block, j] for k in range(0, len(x), block)]
        z = x.copy()
        z[:, j] = np.concatenate([parts[k] for k in rng.permutation(len(parts))])
        rise.append(((predict(z) - y) ** 2).mean() - base)
    return float(np.mean(rise))


def ale(predict, x: np.ndarray, j: int, bins: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """First-order accumulated local effects: bin edges and centred effect at each edge."""
    edges = np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)))
    at = np.clip(np.searchsorted(edges, x[:, j], side="left") - 1, 0, len(edges) - 2)
    low, high = x.copy(), x.copy()
    low[:, j], high[:, j] = edges[at], edges[at + 1]
    d = predict(high) - predict(low)
    n = np.bincount(at, minlength=len(edges) - 1)
    step = np.bincount(at, d, len(edges) - 1) / np.maximum(n, 1)
    effect = np.r_[0.0, np.cumsum(step)]
    return edges, effect - ((effect[1:] + effect[:-1]) / 2 * n).sum() / n.sum()


def mahalanobis(train: np.ndarray, x: np.ndarray, ridge_share: float = 1e-3) -> np.ndarray:
    """Distance from training rows, with a ridge on the covariance."""
    m = train.mean(0)
    c = np.cov(train.T).reshape(train.shape[1], -1)
    c = c + ridge_share * np.trace(c) / len(c) * np.eye(len(c))
    d = x - m
    return np.sqrt(np.einsum("ij,ij->i", d, np.linalg.solve(c, d.T).T))


# Ensembles.


def weighted_mean(p: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Row means over present models with weights rescaled; NaN where none is present."""
    ok = np.isfinite(p)
    ww = np.where(ok, w, 0.0)
    s = ww.sum(1)
    return np.where(s > 0, (np.where(ok, p, 0.0) * ww).sum(1) / np.where(s > 0, s, 1), np.nan)


def skill_weights(loss: np.ndarray, base: float, shrink: float = 0.5) -> np.ndarray:
    """Weights from skill against a base loss, shrunk to equal ones."""
    s = np.maximum(1 - loss / base, 0.0)
    w = s / s.sum() if s.sum() > 0 else np.full(len(s), 1 / len(s))
    return (1 - shrink) * w + shrink / len(w)


def diversity_weights(skill: np.ndarray, corr: np.ndarray, lam: float = 0.5, duplicate: float = 0.999) -> np.ndarray:
    """Skill less redundancy; of duplicates the better one only."""
    k = len(skill)
    off = np.abs(corr - np.diag(np.diag(corr)))
    w = np.maximum(skill, 0) * (1 - lam * off.sum(1) / max(1, k - 1))
    for i, j in itertools.combinations(range(k), 2):
        if off[i, j] >= duplicate:
            w[i if skill[i] < skill[j] else j] = 0.0
    return w / w.sum() if w.sum() > 0 else np.full(k, 1 / k)


def dynamic_weights(day: np.ndarray, resolved_day: np.ndarray, loss: np.ndarray, base: np.ndarray, days: np.ndarray, window: int, min_rows: int, shrink: float = 0.5) -> np.ndarray:
    """Weights of every day from rows whose label resolved before it, within a trailing window; equal without enough."""
    out = np.full((len(days), loss.shape[1]), 1 / loss.shape[1])
    for k, d in enumerate(days):
        rows = (resolved_day < d) & (day >= d - window)
        if rows.sum() >= min_rows:
            out[k] = skill_weights(loss[rows].mean(0), base[rows].mean(), shrink)
    return out


def diversity(p: np.ndarray, y: np.ndarray) -> list[dict]:
    """Q statistic, disagreement and correlation of every pair of models."""
    hit = (p >= 0.5) == (y[:, None] == 1)
    out = []
    for i, j in itertools.combinations(range(p.shape[1]), 2):
        a, b = hit[:, i], hit[:, j]
        n11, n00, n10, n01 = (a & b).sum(), (~a & ~b).sum(), (a & ~b).sum(), (~a & b).sum()
        den = n11 * n00 + n10 * n01
        out.append({"i": i, "j": j, "q": float((n11 * n00 - n10 * n01) / den) if den else None, "disagreement": float((a != b).mean()), "corr": float(np.corrcoef(p[:, i], p[:, j])[0, 1])})
    return out


def minimum_variance(cov: np.ndarray) -> np.ndarray:
    """Long-only weights of least variance; over the supports of a few assets."""
    k, best = len(cov), None
    for size in range(1, k + 1):
        for s in itertools.combinations(range(k), size):
            w = np.linalg.solve(cov[np.ix_(s, s)] + 1e-15 * np.eye(size), np.ones(size))
            w = w / w.sum()
            if (w >= -1e-12).all():
                full = np.zeros(k)
                full[list(s)] = np.maximum(w, 0)
                v = full @ cov @ full
                if best is None or v < best[0] - 1e-18:
                    best = v, full
    return best[1]


# Econometrics.


def nnls(a: np.ndarray, b: np.ndarray, iterations: int = 1000) -> np.ndarray:
    """Least squares with coefficients of at least 0, by active sets."""
    x, passive = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(iterations):
        g = a.T @ (b - a @ x)
        if passive.all() or g[~passive].max() <= 1e-10:
            break
        passive[np.where(~passive, g, -np.inf).argmax()] = True
        while True:
            s = np.zeros(len(x))
            s[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            if (s[passive] > 0).all():
                x = s
                break
            bad = passive & (s <= 0)
            step = (x[bad] / (x[bad] - s[bad])).min()
            x = x + step * (s - x)
            passive &= x > 1e-12
    return x


def fit_garch(segments: list[np.ndarray], minimum: int = 200, steps: int = 400) -> dict | None:
    """GARCH(1,1) by maximum likelihood with variance targeting; gaps restart the recursion. None for too few returns."""
    from tidemark.functions.series import linear_variance

    parts = [s for s in segments if len(s) > 1]
    if sum(map(len, parts)) < minimum:
        return None
    var = float(np.concatenate(parts).var())

    def loss(u: np.ndarray) -> float:
        e = np.exp(np.clip(u, -20, 20))
        a, b = e / (1 + e.sum())
        omega = var * (1 - a - b)
        total = 0.0
        for s in parts:
            h = linear_variance(s, omega, a, b, var)
            total += float((np.log(h) + s**2 / h).sum())
        return total

    simplex = [np.array([-1.0, 2.0]), np.array([-2.0, 2.5]), np.array([0.0, 1.0])]  # a downhill simplex on two numbers
    vals = [loss(u) for u in simplex]
    for _ in range(steps):
        o = np.argsort(vals)
        simplex, vals = [simplex[i] for i in o], [vals[i] for i in o]
        if vals[2] - vals[0] < 1e-8 * abs(vals[0]):
            break
        mid = (simplex[0] + simplex[1]) / 2
        new = 2 * mid - simplex[2]
        v = loss(new)
        if v < vals[0]:
            far = 3 * mid - 2 * simplex[2]
            fv = loss(far)
            new, v = (far, fv) if fv < v else (new, v)
        elif v >= vals[1]:
            near = (mid + simplex[2]) / 2
            nv = loss(near)
            if nv < vals[2]:
                new, v = near, nv
            else:
                simplex = [simplex[0], *[(simplex[0] + s) / 2 for s in simplex[1:]]]
                vals = [vals[0], *[loss(s) for s in simplex[1:]]]
                continue
        simplex[2], vals[2] = new, v
    e = np.exp(np.clip(simplex[0], -20, 20))
    a, b = e / (1 + e.sum())
    return {"omega": var * (1 - a - b), "alpha": float(a), "beta": float(b), "loss": vals[0]}


def local_level(y: np.ndarray, gap: np.ndarray, q: float, r: float) -> tuple[np.ndarray, np.ndarray]:
    """Kalman level and variance (Joseph form); a gap resets the level to the observation."""
    level, var = np.empty(len(y)), np.empty(len(y))
    m = p = None
    for t in range(len(y)):
        if m is None or gap[t]:
            m, p = y[t], r
        else:
            p = p + q
            k = p / (p + r)
            m = m + k * (y[t] - m)
            p = (1 - k) ** 2 * p + k**2 * r
        level[t], var[t] = m, p
    return level, var


def delayed_intervals(error: np.ndarray, known_at: np.ndarray, alpha: float = 0.1, gamma: float = 0.01, pool: int = 500, minimum: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Half-width for every forecast and the running miss rate target: the quantile of rank ceil((n + 1)(1 - a)) of the
    latest absolute errors known by then; a moves by gamma (target - miss), within [0.01, 0.5]."""
    width, rate = np.full(len(error), np.nan), np.empty(len(error))
    a, held, waiting = alpha, [], []
    for t in range(len(error)):
        rest = []
        for s in waiting:
            if known_at[s] <= t:
                if np.isfinite(width[s]):
                    a = min(0.5, max(0.01, a + gamma * (alpha - float(abs(error[s]) > width[s]))))
                held.append(abs(error[s]))
            else:
                rest.append(s)
        waiting = [*rest, t]
        held = held[-pool:]
        rate[t] = a
        if len(held) >= minimum:
            rank = math.ceil((len(held) + 1) * (1 - a))
            if rank <= len(held):
                width[t] = sorted(held)[rank - 1]
    return width, rate


def cusum(z: np.ndarray, drift: float, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two-sided Page sums and alarms; both sums start again from 0 after an alarm."""
    up, down, alarm = np.empty(len(z)), np.empty(len(z)), np.zeros(len(z), bool)
    a = b = 0.0
    for t, v in enumerate(z):
        a, b = max(0.0, a + v - drift), max(0.0, b - v - drift)
        up[t], down[t] = a, b
        if a >= threshold or b >= threshold:
            alarm[t] = True
            a = b = 0.0
    return up, down, alarm


# Folds.


def walk_forward_folds(n: int, eval_rows: int, folds: int, horizon: int, embargo: int, inner_fraction: float = 0.15, rolling: int | None = None) -> list[dict]:
    """Row ranges of purged, embargoed folds: the training span ends a gap of horizon + embargo before evaluation, the
    inner slice is its last part, and fitting ends a gap before that."""
    gap = horizon + embargo
    out = []
    for k in range(folds):
        low = n - (folds - k) * eval_rows
        end = low - gap
        start = max(0, end - rolling) if rolling else 0
        span = end - start
        if span < 10 * gap or span <= 0:
            raise ValueError("training span is shorter than ten gaps")
        inner = end - round(inner_fraction * span)
        out.append({"fold": k, "fit_start": start, "fit_end": inner - gap, "inner_start": inner, "inner_end": end, "eval_start": low, "eval_end": low + eval_rows})
    return out


def outcome_safe(values: np.ndarray, horizon: int, boundaries: list[int]) -> np.ndarray:
    """Outcomes whose window crosses a boundary row become missing: rows b - h to b - 1."""
    out = values.astype(float).copy()
    for b in boundaries:
        out[max(0, b - horizon) : b] = np.nan
    return out


def time_decay_weights(age: np.ndarray, half_life: float) -> np.ndarray:
    return 2.0 ** (-(age - age.min()) / half_life)


def har_design(v: np.ndarray, spans: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Constant and trailing means of variance over several spans, with the next row's variance."""
    c = np.r_[0.0, np.cumsum(v)]
    first = max(spans) - 1
    at = np.arange(first, len(v) - 1)
    x = np.column_stack([np.ones(len(at)), *[(c[at + 1] - c[at + 1 - s]) / s for s in spans]])
    return x, v[at + 1]


def walk_forward_regimes(x: np.ndarray, period: np.ndarray, k: int, minimum: int, seed: int = 7) -> np.ndarray:
    """Causal state of each row: refitted at the start of each period on all rows before it, then filtered forward; NaN
    while there are too few."""
    out = np.full(len(x), np.nan)
    for p in np.unique(period):
        now = np.flatnonzero(period == p)
        if now[0] < minimum:
            continue
        s = fit_scaler(x[: now[0]])
        h = fit_hmm(scale(x[: now[0]], s), k, "diag", 15, seed=seed)
        upto = now[-1] + 1
        out[now] = forward_filter(log_gaussian(scale(x[:upto], s), h["means"], h["covs"]), h["transition"], h["prior"]).argmax(1)[now]
    return out


def interaction_gain(a: np.ndarray, b: np.ndarray, y: np.ndarray, folds: int, embargo: int, ridge_alpha: float = 1e-3) -> float:
    """Mean gain of out-of-sample R2 over chronological folds when the product of two features joins them."""
    n, gains = len(y), []
    for k in range(1, folds):
        low, high = n * k // folds, n * (k + 1) // folds
        train, test = np.arange(0, max(1, low - embargo)), np.arange(low, high)
        scores = []
        for cols in ((a, b), (a, b, a * b)):
            z = np.column_stack(cols)
            m, s = z[train].mean(0), z[train].std(0)
            z = np.c_[np.ones(n), (z - m) / np.where(s > 0, s, 1)]
            beta = np.linalg.solve(z[train].T @ z[train] + ridge_alpha * len(train) * np.eye(z.shape[1]), z[train].T @ y[train])
            scores.append(1 - ((y[test] - z[test] @ beta) ** 2).sum() / ((y[test] - y[train].mean()) ** 2).sum())
        gains.append(scores[1] - scores[0])
    return float(np.mean(gains))
