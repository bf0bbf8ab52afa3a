"""Exact quantiles against plain Python, for any cuts, ties, missing values and periods over years."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import selection as Q


def linear(values, p):
    own = sorted(values, key=lambda v: (math.isnan(v), v))
    h = p * (len(own) - 1)
    a, b = own[math.floor(h)], own[math.ceil(h)]
    return a if a == b or h == math.floor(h) else (math.floor(h) + 1 - h) * a + (h - math.floor(h)) * b


def same(a, b):
    return (a is None) == (b is None) and (a is None or math.isnan(a) and math.isnan(b) or a == pytest.approx(b, rel=1e-12, abs=1e-12))


@pytest.mark.parametrize("accuracy", [10_000, 20])
def test_exact_quantiles(spark, monkeypatch, accuracy):
    """Also where the cuts are coarse and cells hold many rows."""
    monkeypatch.setattr(Q, "ACCURACY", accuracy)
    rng = random.Random(1)
    rows = []
    for g, n in (("a", 3_000), ("b", 1), ("c", 2), (None, 700), ("hot", 2_000), ("odd", 40), ("none", 5)):
        for _ in range(n):
            x = None if g == "none" or rng.random() < 0.1 and n > 2 else 7.0 if g == "hot" and rng.random() < 0.8 else rng.choice([math.inf, -math.inf, 1.0, -0.0]) if g == "odd" and rng.random() < 0.6 else rng.gauss(0, 1)
            rows.append((g, x, rng.randint(0, 9)))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, x double, k long").repartition(7)
    probs = (0.0, 0.05, 0.25, 1 / 3, 0.5, 0.9, 0.999, 1.0)
    got = {r["g"]: r for r in Q.exact_quantiles(df, ["g"], {"x": F.col("x"), "k": F.col("k")}, probs).collect()}
    assert set(got) == {r[0] for r in rows}
    for g, r in got.items():
        for name, at in (("x", 1), ("k", 2)):
            own = [float(v[at]) for v in rows if v[0] == g and v[at] is not None]
            assert r[name] is None if not own else all(same(a, linear(own, p)) for a, p in zip(r[name], probs, strict=True)), (g, name)
    whole = Q.exact_quantiles(df, [], {"x": F.col("x")}, (0.1, 0.5)).first()["x"]
    assert all(same(a, linear([r[1] for r in rows if r[1] is not None], p)) for a, p in zip(whole, (0.1, 0.5), strict=True))
    assert Q.exact_quantiles(df.limit(0), ["g"], {"x": F.col("x")}, (0.5,)).count() == 0


def weekly(years=2, rows=900, seed=3):
    rng = random.Random(seed)
    start = dt.datetime(2023, 1, 2)
    return [(start + dt.timedelta(hours=rng.randrange(years * 365 * 24)), None if rng.random() < 0.05 else rng.choice([rng.gauss(0, 1), 0.5, 0.5])) for _ in range(rows)]


@pytest.mark.parametrize("fan,cell_rows", [(64, 1 << 20), (3, 10)])
def test_expanding_quantiles_over_years(spark, fan, cell_rows):
    """Two years of weeks: history is all that is earlier and nothing later, in one level of cells and in several."""
    rows = weekly()
    df = spark.createDataFrame(rows, "ts timestamp, x double").repartition(5)
    probs = (0.05, 0.5, 0.95, 1.0)
    got = {r["period"]: r for r in Q.expanding_quantiles(df, "x", F.date_trunc("week", "ts"), probs, 20, fan, cell_rows).collect()}
    week = lambda t: dt.datetime.combine(t.date() - dt.timedelta(days=t.weekday()), dt.time())
    weeks = sorted({week(t) for t, _ in rows})
    assert len(weeks) > 100
    want = {w: [x for t, x in rows if x is not None and week(t) < w] for w in weeks}
    want = {w: v for w, v in want.items() if len(v) >= 20}
    assert {k: r["history"] for k, r in got.items()} == {w: len(v) for w, v in want.items()}
    for w, v in want.items():
        assert all(same(a, linear(v, p)) for a, p in zip(got[w]["q"], probs, strict=True))
    assert Q.expanding_quantiles(df.limit(0), "x", F.date_trunc("week", "ts"), probs, 20).count() == 0
    assert Q.expanding_quantiles(df.where("x IS NULL"), "x", F.date_trunc("week", "ts"), probs, 0).where("q IS NOT NULL").count() == 0


def test_no_sort_or_buffer_of_a_whole_group(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("x"))
    plan = Q.exact_quantiles(df, ["g"], {"x": F.col("x")}, (0.5,))._jdf.queryExecution().optimizedPlan().toString()
    assert " percentile(" not in plan
    assert np.isclose(Q.exact_quantiles(df, [], {"x": F.col("x")}, (0.5,)).first()["x"][0], 499.5)
