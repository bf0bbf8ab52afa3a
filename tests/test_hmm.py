"""Filtering, smoothing, best paths and Baum-Welch in blocks agree with the plain recursions over the whole series."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import models as M
from tidemark.operators import hmm as H


def known(n, seed, k=2, d=1):
    rng = np.random.default_rng(seed)
    t = np.full((k, k), 0.06 / max(1, k - 1)) + np.eye(k) * (0.94 - 0.06 / max(1, k - 1))
    s = [0]
    while len(s) < n:
        s.append(int(rng.choice(k, p=t[s[-1]])))
    s = np.array(s)
    return s, rng.normal(size=(n, d)) * 0.7 + s[:, None] * 2.5


@pytest.mark.parametrize("k,d,n", [(2, 1, 700), (3, 2, 257), (2, 1, 1), (4, 1, 30)])
def test_kernels(k, d, n):
    _, x = known(n, k + n, k, d)
    rng = np.random.default_rng(1)
    t = rng.dirichlet(np.ones(k) * 3, k)
    prior = rng.dirichlet(np.ones(k))
    log_b = M.log_gaussian(x, rng.normal(size=(k, d)) * 2, np.repeat(np.eye(d)[None], k, 0))
    a, ll = H.forward(log_b, t, prior, True)
    g, _, want = M.forward_backward(log_b, t, prior)
    assert np.allclose(a, M.forward_filter(log_b, t, prior)) and ll == pytest.approx(want)
    s = a * H.backward(log_b, t, np.full(k, 1 / k), True)
    assert np.allclose(s / s.sum(1, keepdims=True), g)
    whole = H.transfer(log_b, t, True)
    assert np.allclose(prior @ whole / (prior @ whole).sum(), a[-1])
    path = M.viterbi(log_b, t, prior)
    assert np.array_equal(H.best_path(log_b, t, np.log(prior), int(path[-1]), True), path)
    assert int((np.log(prior)[:, None] + H.best_transfer(log_b, t, True)).max(0).argmax()) == path[-1]


HELD = {"a": known(900, 5), None: known(350, 6), "small": known(40, 7)}


def packed(spark, block_rows):
    rows = [(s, i, float(v)) for s, (_, x) in HELD.items() for i, v in enumerate(x[:, 0])]
    df = spark.createDataFrame(rows, "s string, k long, x double").repartition(4).withColumn("ts", F.timestamp_seconds(F.col("k") * 3600))
    return H.pack(df, ["s"], ["ts"], F.to_date("ts"), ["x"], F.col("k"), block_rows)


@pytest.fixture(scope="module")
def fits(spark):
    """The same fit for blocks of 64 rows and for one block."""
    out = {}
    for block_rows in (64, 100_000):
        m = H.Model(packed(spark, block_rows), ["s"], 2, 1)
        out[block_rows] = m, m.fit("diag", 6)
    return out


def test_baum_welch(fits):
    """Rounds are those of plain Baum-Welch from the same start; blocks do not matter; known states are found."""
    a, b = ({r["s"]: r for r in p.collect()} for _, p in fits.values())
    for s, (_, x) in HELD.items():
        mean, var = x.mean(), x.var()
        means, covs = (mean + np.array([-0.6, 0.6]) * np.sqrt(var))[:, None], np.full((2, 1, 1), var)
        t, prior = np.array([[0.9, 0.1], [0.1, 0.9]]), np.full(2, 0.5)
        last = -np.inf
        for _ in range(6):
            g, xi, ll = M.forward_backward(M.log_gaussian(x, means, covs), t, prior)
            t = (xi + np.eye(2)) / (xi + np.eye(2)).sum(1, keepdims=True)
            prior = g[0] / g[0].sum()
            means, covs = M._moments(x, g, "diag", 1e-4)
            if ll - last < 1e-5 * len(x):
                break
            last = ll
        p = H.Parameters.of(a[s]["params"], 2, 1)
        assert np.allclose(p.means, means, atol=1e-6) and np.allclose(p.covs, covs, atol=1e-6) and np.allclose(p.transition, t, atol=1e-6)
        assert np.allclose(a[s]["params"], b[s]["params"], atol=1e-8) and a[s]["ll"] == pytest.approx(ll, rel=1e-9)
    assert np.allclose(H.Parameters.of(a["a"]["params"], 2, 1).means.ravel(), [0, 2.5], atol=0.15)


@pytest.mark.parametrize("block_rows", [64, 100_000])
def test_states(fits, block_rows):
    model, params = fits[block_rows]
    held = {r["s"]: H.Parameters.of(r["params"], 2, 1) for r in params.collect()}
    causal, whole = {}, {}
    for r in sorted(model.filtered(params).collect(), key=lambda r: r["t"]):
        causal.setdefault(r["s"], []).append((r["t"], r["state"], r["p"]))
    for r in sorted(model.smoothed(params).collect(), key=lambda r: r["t"]):
        whole.setdefault(r["s"], []).append((r["t"], r["state"], r["p"], r["path"]))
    for s, (truth, x) in HELD.items():
        p = held[s]
        log_b = M.log_gaussian(x, p.means, p.covs)
        assert [r[0] for r in causal[s]] == [r[0] for r in whole[s]] == list(range(len(x)))
        assert np.allclose([r[2] for r in causal[s]], M.forward_filter(log_b, p.transition, p.prior))
        g, _, _ = M.forward_backward(log_b, p.transition, p.prior)
        assert np.allclose([r[2] for r in whole[s]], g) and [r[1] for r in whole[s]] == g.argmax(1).tolist()
        assert [r[3] for r in whole[s]] == M.viterbi(log_b, p.transition, p.prior).tolist()
        assert s != "a" or (np.array([r[3] for r in whole[s]]) == truth).mean() > 0.97
