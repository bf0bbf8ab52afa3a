"""Recursions in blocks agree with plain recursions over the whole series, wherever blocks are cut."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import models as M
from tidemark.functions import series as SR
from tidemark.operators import scans as SC


def frame(spark, held):
    """Series of values an hour apart, in any order."""
    rows = [(s, k, v) for s, vs in held.items() for k, v in enumerate(vs)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "s string, k long, x double").repartition(5)
    return df.withColumn("t", F.timestamp_seconds(F.col("k") * 3600))


def series(n, seed):
    return [float(v) for v in np.random.default_rng(seed).normal(0, 1, n)]


HELD = {"a": series(700, 1), "b": series(51, 2), None: series(130, 3), "short": series(5, 4), "one": [2.0]}


def columns(df, *names):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["t"]):
        out.setdefault(r["s"], []).append(tuple(r[n] for n in names))
    return {s: [np.array([np.nan if v is None else v for v in c], float) for c in zip(*rows, strict=True)] for s, rows in out.items()}


@pytest.mark.parametrize("block_rows", [7, 64, 100_000])
def test_ewma_and_variance(spark, block_rows):
    df = frame(spark, HELD)
    got = columns(SC.ewma(df, ["s"], ["t"], F.to_date("t"), "x", 0.94, 20, block_rows), "lagged", "current")
    path = columns(SC.variance_path(df, ["s"], ["t"], F.to_date("t"), "x", 0.01, 0.1, 0.85, 1.0, block_rows), "h")
    assert got.keys() == HELD.keys() == path.keys()
    for s, v in HELD.items():
        x = np.array(v)
        assert np.allclose(got[s][0], SR.ewma_lagged(x, 0.94, 20), equal_nan=True, rtol=1e-12)
        assert np.allclose(got[s][1], SR.ewma_current(x**2, 0.94), equal_nan=True, rtol=1e-12)
        assert np.allclose(path[s][0], SR.linear_variance(x, 0.01, 0.1, 0.85, 1.0), rtol=1e-12)


@pytest.mark.parametrize("block_rows", [9, 100_000])
def test_local_level(spark, block_rows):
    df = frame(spark, HELD).withColumn("t", F.timestamp_seconds(F.col("k") * 3600 + F.floor(F.col("k") / 50) * 9_000))
    gap = F.unix_timestamp("t") - F.unix_timestamp("__before") > 3600
    got = columns(SC.local_level(df, ["s"], ["t"], F.to_date("t"), "x", 0.05, 0.5, gap, block_rows), "level", "variance")
    for s, v in HELD.items():
        k = np.arange(len(v))
        level, var = M.local_level(np.array(v), (k == 0) | (k % 50 == 0), 0.05, 0.5)
        assert np.allclose(got[s][0], level, rtol=1e-9) and np.allclose(got[s][1], var, rtol=1e-9)


def test_local_level_with_missing_values(spark):
    v = [None, None, 1.0, 2.0, None, 4.0]
    got = columns(SC.local_level(frame(spark, {"a": v}), ["s"], ["t"], F.to_date("t"), "x", 0.5, 1.0, F.lit(False), 2), "level", "variance")["a"]
    assert np.isnan(got[0][:2]).all() and np.isnan(got[1][:2]).all()
    p = (1.5 / 2.5, 1.5 / 2.5 + 0.5)  # variances after the fourth and the fifth row
    assert got[1][2:].tolist() == pytest.approx([1.0, p[0], p[1], (p[1] + 0.5) / (p[1] + 1.5)])
    level = 1 + p[0] * (2 - 1)
    assert got[0][2:].tolist() == pytest.approx([1.0, level, level, level + (p[1] + 0.5) / (p[1] + 1.5) * (4 - level)])


def test_steps_compose():
    """A block's map takes any state to where the rows take it."""
    rng = np.random.default_rng(5)
    x = {"a": np.where(rng.random(40) < 0.1, np.nan, rng.normal(size=40)), "b": rng.normal(size=40)}
    step = SC.Affine({"s": ("a", "b")})
    assert step.advance([1.7], step.block_map(x))[0] == pytest.approx(step.run(x, [1.7])["s"][-1])
    reset = {"a": np.array([0.5, 0.0, 0.5]), "b": np.array([1.0, 4.0, 1.0])}
    assert step.advance([float("nan")], step.block_map(reset)) == [3.0]
    m = {c: rng.random(33) + 0.1 for c in "pquv"}
    step = SC.Moebius("s", tuple("pquv"))
    assert step.advance([0.3], step.block_map(m))[0] == pytest.approx(step.run(m, [0.3])["s"][-1])


@pytest.mark.parametrize("block_rows", [8, 100_000])
def test_running_totals(spark, block_rows):
    held = {s: [None if k % 7 in (0, 3) else v for k, v in enumerate(vs)] for s, vs in HELD.items()} | {"none": [None] * 20}
    x = F.col("x")
    df = SC.running(frame(spark, held), ["s"], ["t"], F.to_date("t"), {"total": ("sum", x), "high": ("max", x), "low": ("min", x), "n": ("count", x), "held": ("last", x)}, block_rows)
    got = columns(df, "total", "high", "low", "n", "held")
    for s, v in held.items():
        sums, n, high, low, last, want = None, 0, None, None, None, []
        for e in v:
            if e is not None:
                sums, n, high, low, last = (sums or 0) + e, n + 1, e if high is None else max(high, e), e if low is None else min(low, e), e
            want.append([np.nan if w is None else w for w in (sums, high, low, n, last)])
        assert np.allclose(np.array(got[s]), np.array(want, float).T, equal_nan=True), s


def test_empty_table(spark):
    df = frame(spark, HELD).limit(0)
    assert SC.ewma(df, ["s"], ["t"], F.to_date("t"), "x", 0.9, 5).count() == 0
    assert SC.running(df, ["s"], ["t"], F.to_date("t"), {"n": ("sum", F.col("x"))}).count() == 0


def test_runs_and_ages_over_blocks(spark):
    from tidemark.operators import windows as WN

    rng = random.Random(8)
    labels = {s: [v for v in rng.choices([-1, 0, 1], k=40) for _ in range(rng.choice([1, 2, 40]))] for s in ("a", None)} | {"c": [1]}
    df = frame(spark, {s: [float(v) for v in vs] for s, vs in labels.items()}).withColumn("label", F.col("x").cast("int"))
    got = columns(WN.with_runs(df, "label", ["s"], ["t"], F.to_date("t"), 16), "run", "age")
    for s, vs in labels.items():
        run, age, want = 0, 0, []
        for k, v in enumerate(vs):
            run, age = (run + 1, 1) if k == 0 or v != vs[k - 1] else (run, age + 1)
            want.append((run, age))
        assert list(zip(*got[s], strict=True)) == want


def test_digest_of_order_for_any_parts(spark):
    """One swapped pair, a changed cell, a null for an empty text and a moved border of cells are all seen; parts are not."""
    from tidemark.sources.ticks import table_digest

    rows = [(k, "a" if k % 3 else "b", str(k * 7 % 11), None if k % 5 == 0 else "x") for k in range(400)]
    digest = lambda rows, parts=64: {r["g"]: (r["rows"], r["digest"]) for r in table_digest(spark.createDataFrame(rows, "seq long, g string, v string, w string").repartition(3), "seq", ["v", "w"], ["g"], parts).collect()}
    want = digest(rows)
    assert want == digest(rows[::-1], 7) == digest(rows, 100_000) and want["a"][0] + want["b"][0] == 400
    at = [k for k, r in enumerate(rows) if r[1] == "a"]
    i, j = next((i, j) for i in at for j in at if i < j and rows[i][2:] != rows[j][2:])
    swapped = list(rows)
    swapped[i], swapped[j] = (rows[i][0], *rows[j][1:]), (rows[j][0], *rows[i][1:])
    assert digest(swapped)["a"] != want["a"] and digest(swapped)["b"] == want["b"]
    for change in ((rows[at[3]][0], "a", "other", "x"), (rows[at[3]][0], "a", rows[at[3]][2] + "x", "")):
        assert digest([change if r[0] == change[0] else r for r in rows])["a"] != want["a"]
    assert digest([(r[0], r[1], r[2], r[3] or "") for r in rows]) != want


def test_running_maximum_of_source_order(spark):
    from tidemark.sources.ticks import ordering_report

    rows = [(k, 500 - k if k % 50 == 3 else k) for k in range(400)]
    df = spark.createDataFrame(rows, "seq long, sec long").select(F.lit("s").alias("s"), "seq", F.timestamp_seconds("sec").alias("ts"))
    got = {r["seq"]: r["high_water"].timestamp() - r["ts"].timestamp() for r in ordering_report(df, "ts", "seq", ["s"], 16).collect()}
    high, want = -1, {}
    for k, t in rows:
        if t < high:
            want[k] = float(high - t)
        high = max(high, t)
    assert got == want and len(want) > 20
