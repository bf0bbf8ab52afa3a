"""Queries take in all rows that they are given."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import series as SR
from tidemark.plans.base import returns, ticks
from tidemark.plans.registry import QUERIES

LARGER = "/root/testdata/sf0.01"


def counts(df):
    return {r["series"]: r["n"] for r in df.groupBy("series").agg(F.count("*").alias("n")).collect()}


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="no test data")
def test_stationarity_of_all_values(spark):
    assert SR.stationarity(np.random.default_rng(1).normal(size=25_000))["n"] == 25_000
    want = counts(returns(spark, LARGER).where("r IS NOT NULL"))
    assert max(want.values()) > 500
    assert {r["series"]: r["n"] for r in QUERIES["stationarity_tests"](spark, LARGER).collect()} == want


def test_theil_sen_of_all_windows(spark, sf_dir):
    rows = returns(spark, sf_dir).where("r IS NOT NULL").orderBy("timestamp").select("series", F.unix_timestamp("timestamp").alias("t"), "close").collect()
    want = {}
    for s in {r["series"] for r in rows}:
        own = [(r["t"], np.log(r["close"])) for r in rows if r["series"] == s]
        for k, (t, _) in enumerate(own):
            y = [v for _, v in own[max(0, k - 63) : k + 1]]
            want[s, t] = np.median([(y[j] - y[i]) / (j - i) for i in range(64) for j in range(i + 1, 64)]) if len(y) == 64 else None
    got = {(r["series"], r["t"]): r["slope"] for r in QUERIES["theil_sen"](spark, sf_dir).collect()}
    assert sum(v is not None for v in want.values()) > 5
    assert got.keys() == want.keys()
    assert all(v is None and got[k] is None or got[k] == pytest.approx(v, abs=1e-6) for k, v in want.items())


def test_bootstrap_of_all_values():
    x = np.random.default_rng(2).lognormal(0, 2, 60_000)
    mean, low, high = SR.bootstrap_mean(x, 200)
    se = x.std() / np.sqrt(len(x))
    assert mean == pytest.approx(x.mean(), rel=1e-12)
    assert high - low == pytest.approx(2 * 1.96 * se, rel=0.25)
    a, b, c = SR.bootstrap_mean(x, 200, chunk=7_000)
    assert a == mean and c - b == pytest.approx(2 * 1.96 * se, rel=0.25)
    assert np.isnan(SR.bootstrap_mean(np.array([np.nan]))).all()


def test_near_duplicates_of_all_ticks(spark, sf_dir):
    seqs = {r["seq"] for r in ticks(spark, sf_dir).select("seq").collect()}
    assert max(seqs) > 200
    worse = {max((a % 7, a), ((a + 3) % 7, a + 3))[1] for a in seqs if a % 10 == 0 and a + 3 in seqs}
    got = QUERIES["near_duplicates_out"](spark, sf_dir).collect()
    assert sorted(r["seq"] for r in got) == sorted(seqs - worse)


def test_every_series_takes_part(spark, sf_dir):
    from tidemark.plans.kernels import design

    held = counts(design(spark, sf_dir))
    assert len(held) == len(counts(ticks(spark, sf_dir))) > 1
    assert counts(QUERIES["principal_components"](spark, sf_dir)) == held


def test_index_sees_repeated_lines_change(spark):
    from tidemark.sources.ticks import source_index

    def index(lines):
        return source_index(spark.createDataFrame([(x,) for x in lines], "value string"), F.substring("value", 1, 1)).collect()

    assert index(["1a", "1a", "1b"]) != index(["1b", "1b", "1b"]) and index(["1a", "1b"]) == index(["1b", "1a"])
