"""Bootstrap intervals against theory and plain resampling, and the same for any partitioning."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import series as SR
from tidemark.operators import ordering as O
from tidemark.operators import resampling as RS


def frame(spark, held, parts):
    rows = [(s, k, float(v)) for s, vs in held.items() for k, v in enumerate(vs)]
    return spark.createDataFrame(rows, "s string, k long, x double").repartition(parts).withColumn("t", F.timestamp_seconds(F.col("k") * 3600))


def test_weights_are_poisson():
    keys = np.arange(40_000)
    for rate in (0.05, 1.0, 7.0):
        w = RS.poisson_weights(keys, np.full(len(keys), rate), 20, 7)
        assert w.mean() == pytest.approx(rate, rel=0.02) and w.var() == pytest.approx(rate, rel=0.03)
        assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.02 and abs(np.corrcoef(w[:-1, 3], w[1:, 3])[0, 1]) < 0.02
        assert (w == 0).mean() == pytest.approx(math.exp(-rate), rel=0.05, abs=0.002)
    assert np.array_equal(RS.poisson_weights(keys[5:9], np.ones(4), 20, 7), RS.poisson_weights(keys, np.ones(len(keys)), 20, 7)[5:9])
    assert not np.array_equal(RS.poisson_weights(keys, np.ones(len(keys)), 20, 7), RS.poisson_weights(keys, np.ones(len(keys)), 20, 8))


def test_mean_and_interval(spark):
    rng = np.random.default_rng(2)
    held = {"a": rng.lognormal(0, 1, 6_000), None: (rng.random(3_000) < 0.2).astype(float), "one": [4.0]}
    one, many = ({r["s"]: r for r in RS.bootstrap_mean(frame(spark, held, p), ["s"], ["k"], "x", 400).collect()} for p in (1, 9))
    for s, v in held.items():
        v = np.asarray(v)
        for r in (one[s], many[s]):
            assert r["mean"] == pytest.approx(v.mean())
            assert r["high"] - r["low"] == pytest.approx(2 * 1.96 * v.std() / math.sqrt(len(v)), rel=0.15, abs=1e-9)
        assert (one[s]["low"], one[s]["high"]) == pytest.approx((many[s]["low"], many[s]["high"]), rel=1e-12)
    odd = frame(spark, {"a": [1.0, 3.0, float("nan"), float("inf")]}, 2)
    assert RS.bootstrap_mean(odd, ["s"], ["k"], "x", 50).first()["mean"] == 2.0
    assert RS.bootstrap_mean(odd.limit(0), ["s"], ["k"], "x", 50).count() == 0


@pytest.mark.parametrize("block_rows", [100, 100_000])
def test_blocks_keep_dependence(spark, block_rows):
    """The interval of dependent values is that of plain moving blocks, and much wider than one of single rows."""
    rng = np.random.default_rng(3)
    e = rng.normal(size=3_000)
    x = np.zeros(3_000)
    for t in range(1, 3_000):
        x[t] = 0.8 * x[t - 1] + e[t]
    halves = F.floor(F.col(O.INDEX) * 2 / F.col("__rows"))
    df = frame(spark, {"a": x, "short": x[:30]}, 4)
    got = RS.block_bootstrap(df, ["s"], ["t"], F.to_date("t"), halves, "x", 20, 5, 400, block_rows=block_rows).collect()
    assert [r["s"] for r in got] == ["a"]
    mean, low, high = SR.block_bootstrap(x, np.arange(3_000) * 2 // 3_000, 20, 5, 400, 7)
    r = got[0]
    assert r["mean"] == pytest.approx(mean) and r["high"] - r["low"] == pytest.approx(high - low, rel=0.2)
    assert r["high"] - r["low"] > 1.8 * 2 * 1.96 * x.std() / math.sqrt(3_000)
    with pytest.raises(ValueError):
        RS.block_bootstrap(df, ["s"], ["t"], F.to_date("t"), halves, "x", 3, 5)
