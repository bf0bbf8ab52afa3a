"""Orders found in parts of a series or a group agree with plain Python over the whole."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import simulate as SM
from tidemark.operators import aggregates as A
from tidemark.operators import ordering as O
from tidemark.operators import validate as V


def test_previous_over_buckets(spark):
    rows = [("a", k, None if k % 7 == 3 else k * 2) for k in range(0, 90, 2)] + [(None, k, k) for k in (1, 50, 51)] + [("b", 5, 1)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "s string, k long, v long")
    got = {(r["s"], r["k"]): r["p"] for r in O.with_previous(df, ["s"], ["k"], F.floor(F.col("k") / 8), "v", "p").collect()}
    want = {}
    for s in ("a", "b", None):
        own = sorted(r for r in rows if r[0] == s)
        want |= {(s, b[1]): a[2] for a, b in itertools.pairwise([(s, 0, None), *own])}
    assert got == want
    assert O.with_previous(df.limit(0), ["s"], ["k"], F.floor(F.col("k") / 8), "v", "p").count() == 0


@pytest.mark.parametrize("by", [[], ["g"]])
def test_counts_below(spark, by):
    rng = random.Random(2)
    values = {g: {round(rng.gauss(0, 1), 2) for _ in range(400)} | {float("nan"), math.inf, -math.inf, 1e300} for g in ("x", "y", None)}
    rows = [(g, v, rng.randint(1, 9)) for g, vs in values.items() for v in vs if by or g == "x"]
    got = O.counts_below(spark.createDataFrame(rows, "g string, v double, c long"), by, "v", "c", 16).collect()
    key = lambda v: (math.isnan(v), v)
    assert len(got) == len(rows)
    for r in got:
        own = [x for x in rows if x[0] == r["g"]]
        assert r["__n"] == sum(c for *_, c in own)
        assert r["__below"] == sum(c for _, v, c in own if key(v) < key(r["v"]) and not (math.isnan(v) and math.isnan(r["v"])))


def test_rank_scores_of_ties_and_missing(spark):
    rows = [("a", k, x) for k, x in enumerate([3.0, 1.0, 3.0, None, 2.0, 1.0, 1.0])] + [("b", 9, 5.0), ("c", 10, None)]
    df = spark.createDataFrame(rows, "s string, k long, x double")
    want = {0: 5.5 - 0.5, 1: 2 - 0.5, 2: 5.5 - 0.5, 3: None, 4: 4 - 0.5, 5: 2 - 0.5, 6: 2 - 0.5}
    want = {k: None if v is None else v / 6 for k, v in want.items()} | {9: 0.5, 10: None}
    assert {r["k"]: r["u"] for r in A.rank_scores(df, "x", ["s"], "u").collect()} == pytest.approx(want)
    wide = A.rank_scores_of(df, ["x"], ["s"], ["s", "k"], "u_")
    assert {r["k"]: r["u_x"] for r in wide.collect()} == pytest.approx(want)


def test_runs_over_blocks(spark):
    rng = random.Random(3)
    labels = {s: [v for v in rng.choices([-1, 0, 1, 2], k=60) for _ in range(rng.choice([1, 2, 40]))] for s in ("a", "b")} | {"c": [1], "d": [-1, -1]}
    rows = [(s, k, v) for s, vs in labels.items() for k, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "s string, k long, v int").withColumn("t", F.timestamp_seconds(F.col("k") * 3600))
    got = A.run_lengths(df, "v", ["s"], ["t"], F.to_date("t"), 16)
    mine = {(r["s"], r["run"]): (r["label"], r["length"], r["start"]["t"].timestamp() // 3600, r["censored"]) for r in got.collect()}
    want = {}
    for s, vs in labels.items():
        at = 0
        for n, (v, run) in enumerate(itertools.groupby(vs), 1):
            length = len(list(run))
            if v >= 0:
                want[s, n] = (v, length, at, at == 0 or at + length == len(vs))
            at += length
    zero = next(iter(got.where("run = 1").collect()))["start"]["t"].timestamp() // 3600
    assert {k: (a, b, c - zero, d) for k, (a, b, c, d) in mine.items()} == want


def test_source_order_is_checked_over_buckets(spark):
    rows = [(k, 100 - k if k % 5 == 0 else k) for k in range(40)]
    df = spark.createDataFrame(rows, "seq long, sec long").select("seq", F.timestamp_seconds("sec").alias("ts"), F.lit(1.0).alias("bid"), F.lit(2.0).alias("ask"), F.lit(1.0).alias("volume"))
    got = {r["seq"] for r in V.flag_ticks(df, bucket_rows=4).where("non_monotonic").collect()}
    assert got == {b[0] for a, b in itertools.pairwise(rows) if b[1] < a[1]}


def test_decisions_and_wider_quotes(spark):
    nan = float("nan")
    rows = [(None, 0.1, True), (nan, 0.1, True), (math.inf, 0.1, True), (1.0, 0.1, False), (1.0, 0.1, None), (1.0, 0.3, True), (0.1, 0.1, True), (-0.5, 0.2, True), (0.5, 0.1, True)]
    df = spark.createDataFrame(rows, "f double, s double, o boolean")
    side, reason = SM.decide(F.col("f"), F.col("s"), 0.2, 0.2, F.col("o"))
    got = [(r["side"], r["reason"]) for r in df.select(side.alias("side"), reason.alias("reason")).collect()]
    assert got == [(0, "no_forecast")] * 3 + [(0, "session_closed")] * 2 + [(0, "wide_spread"), (0, "weak_signal"), (-1, "ok"), (1, "ok")]
    t, b, a = SM.Scenario(spread=3.0, outage=(1, 2)).quotes(np.arange(3), np.full(3, 99.0), np.full(3, 101.0))
    assert t.tolist() == [0, 2] and b.tolist() == [97, 97] and a.tolist() == [103, 103]


def test_first_quote_over_slices(spark):
    """Hot slices, gaps of many slices, equal times and missing keys; and no rows are paired by their times."""
    from tidemark.operators import joins as J

    rng = random.Random(4)
    at = lambda t: F.timestamp_seconds(F.col(t))
    quotes = [("a", t, v) for t in [*range(0, 40), 5, 5, 900, 5000, 5000] for v in rng.choices(range(9), k=3)] + [("b", 7, 1), (None, 8, 1), ("a", None, 1)]
    events = [(k, s, t, t + life) for k, (s, t, life) in enumerate((s, t, life) for s in ("a", "b", "c", None) for t in [*range(0, 45, 3), 899, 900, 4000, 6000] for life in (0, 1, 2, 500, 9000))] + [(9999, "a", None, 5)]
    q = spark.createDataFrame(quotes, "s string, q long, v int").select("s", at("q").alias("ts"), "v")
    e = spark.createDataFrame(events, "id long, s string, a long, x long").select("id", "s", at("a").alias("a"), at("x").alias("x"))
    got = {r["id"]: (r["fill_ts"] and int(r["fill_ts"].timestamp()), r["fill_v"]) for r in J.first_after(e, q, "a", "x", "ts", ["s"], 60).collect()}
    want = {}
    for k, s, a, x in events:
        own = [(t, v) for qs, t, v in quotes if qs is not None and qs == s and t is not None and a is not None and a < t < x]
        want[k] = min(own, default=(None, None))
    zero = spark.range(1).select(F.timestamp_seconds(F.lit(0)).alias("z")).first()["z"].timestamp()
    assert {k: (t if t is None else t - int(zero), v) for k, (t, v) in got.items()} == want
    n = 2000
    hot = spark.range(n).select(F.lit("a").alias("s"), "id", F.timestamp_seconds(F.col("id") / 10).alias("a"), F.timestamp_seconds(F.lit(900)).alias("x"))
    made = J.first_after(hot, hot.select("s", F.col("a").alias("ts"), F.col("id").alias("v")), "a", "x", "ts", ["s"], 3600)
    assert [r["fill_v"] for r in made.orderBy("id").collect()] == [*range(1, n), None]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Join" in x and (" < " in x or " > " in x)]


def test_leakage_check_in_one_pass(spark):
    """Ranks with ties and missing values agree with plain Python, and the plan does not grow with every column."""
    from tidemark.operators import learning as L

    rng = random.Random(5)
    rows = [tuple(None if rng.random() < 0.1 else f(rng) for f in (lambda r: r.gauss(0, 1), lambda r: float(r.randint(0, 3)), lambda r: r.gauss(0, 1), lambda r: 1.0)) for _ in range(300)]
    rows = [(a, b, y if a is None else a**3 if k % 9 else y, c) for k, (a, b, y, c) in enumerate(rows)]
    df = spark.createDataFrame(rows, "a double, b double, y double, c double")

    def ranks(xs):
        own = [x for x in xs if x is not None]
        return [None if x is None else (sum(v < x for v in own) + (sum(v == x for v in own) + 1) / 2 - 0.5) / len(own) for x in xs]

    u = {c: ranks([r[k] for r in rows]) for k, c in enumerate("abyc")}
    want = {}
    for c in "ab":
        both = np.array([(x, y) for x, y in zip(u[c], u["y"], strict=True) if x is not None and y is not None])
        want[c] = np.corrcoef(both.T)[0, 1]
    out = L.leakage_check(df, ["a", "b", "c"], "y", 0.9)
    got = {r["feature"]: (r["rank_corr"], r["suspect"]) for r in out.collect()}
    assert got["c"] == (None, None) and {c: got[c][0] for c in "ab"} == pytest.approx(want)
    assert [got[c][1] for c in "ab"] == [abs(want[c]) > 0.9 for c in "ab"]
    assert {tuple(r) for r in L.leakage_check(df.limit(0), ["a"], "y").collect()} == {("a", None, None)}
    plan = lambda f: L.leakage_check(df, f, "y")._jdf.queryExecution().analyzed().toString().count("Join")
    assert plan(["a", "b", "c"]) == plan(["a"])
