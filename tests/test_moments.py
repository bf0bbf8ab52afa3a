"""Tests and regressions from sums agree with plain NumPy over the whole series, wherever blocks are cut."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import models as M
from tidemark.functions import series as SR
from tidemark.operators import moments as MO

RNG = np.random.default_rng(11)
HELD = {
    "white": RNG.normal(size=900), "walk": 1_000 + np.cumsum(RNG.normal(size=700)), None: np.convolve(RNG.normal(size=420), [1, 0.8, 0.3])[:400],
    "short": RNG.normal(size=9), "flat": np.full(60, 3.0), "small": RNG.normal(size=25),
}


def frame(spark, held, gaps=0):
    rows = [(s, k, k * 3600 + (k // gaps * 7_200 if gaps else 0), float(v)) for s, vs in held.items() for k, v in enumerate(vs)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "s string, k long, sec long, x double").repartition(5).withColumn("t", F.timestamp_seconds("sec"))


@pytest.mark.parametrize("block_rows", [64, 100_000])
def test_stationarity(spark, block_rows):
    df = frame(spark, HELD).withColumn("x", F.when((F.col("s") == "white") & (F.col("k") == 5), float("nan")).otherwise(F.col("x")))
    got = {r["s"]: r for r in MO.stationarity(df, ["s"], ["t"], F.to_date("t"), "x", block_rows=block_rows).collect()}
    assert got.keys() == HELD.keys()
    assert (got["short"]["verdict"], got["flat"]["verdict"], got["flat"]["adf"]) == ("too_short", "constant", None)
    for s in ("white", "walk", None, "small"):
        want = SR.stationarity(np.delete(HELD[s], 5) if s == "white" else HELD[s])
        for k, v in want.items():
            assert got[s][k] == (v if isinstance(v, str | int) else pytest.approx(v, rel=1e-6, abs=1e-6)), (s, k)
    assert got["walk"]["verdict"] == "unit_root" and got["white"]["verdict"] == "stationary"


def test_kpss_that_reaches_further(spark):
    """More lags than the first pass has sums for: a second pass gives them, and only to the series that ask."""
    held = {"walk": HELD["walk"], "white": HELD["white"]}
    got = {r["s"]: r for r in MO.stationarity(frame(spark, held), ["s"], ["t"], F.to_date("t"), "x", reach=0, block_rows=50).collect()}
    for s, x in held.items():
        want = SR.stationarity(x)
        assert {k: got[s][k] for k in want} == {k: v if isinstance(v, str | int) else pytest.approx(v, rel=1e-6) for k, v in want.items()}
    assert got["walk"]["kpss_lags"] > MO.kpss_lags(700)
    assert MO.stationarity(frame(spark, held).limit(0), ["s"], ["t"], F.to_date("t"), "x").count() == 0


@pytest.mark.parametrize("block_rows", [40, 100_000])
def test_lag_regression(spark, block_rows):
    held = {s: v for s, v in HELD.items() if s not in ("flat",)}
    df = frame(spark, held, 30)
    got = {r["s"]: r for r in MO.lag_regression(df, ["s"], ["t"], F.to_date("t"), "x", 3600, 5, block_rows).collect()}
    for s, x in held.items():
        k = np.arange(len(x))
        t = k * 3600 + k // 30 * 7_200
        z = np.c_[np.ones(len(x) - 1), x[:-1]]
        beta, se, _ = SR.ols(z, x[1:])
        v = SR.segmented_hac(z, x[1:] - z @ beta, t[1:], 3600, 5)
        r = got[s]
        assert (r["intercept"], r["slope"], r["ols_se"], r["hac_se"]) == pytest.approx((beta[0], beta[1], se[1], np.sqrt(v[1, 1])), rel=1e-6), s


@pytest.mark.parametrize("block_rows", [40, 100_000])
def test_nonnegative_har(spark, block_rows):
    held = {s: v**2 for s, v in HELD.items() if s in ("white", None)}
    got = {}
    for r in MO.har_nonnegative(frame(spark, held), ["s"], ["t"], F.to_date("t"), "x", (1, 6, 24), ["const", "short", "middle", "long"], block_rows).collect():
        got.setdefault(r["s"], {})[r["term"]] = (r["coefficient"], r["n"])
    for s, v in held.items():
        x, y = M.har_design(v, (1, 6, 24))
        want = M.nnls(x, y)
        assert [c for c, _ in got[s].values()] == pytest.approx(list(want), abs=1e-8) and {n for _, n in got[s].values()} == {len(y)}
