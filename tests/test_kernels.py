"""Kernels against plain references, known answers and causality by perturbation."""

import numpy as np
import pandas as pd
import pytest

from tidemark.functions import models as M
from tidemark.functions import series as SR
from tidemark.functions import simulate as SM
from tidemark.functions import special as SP
from tidemark.functions import spectral as SC

RNG = np.random.default_rng(3)
X = RNG.normal(size=400)


def test_tails():
    assert SP.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-9)
    assert SP.chi2_sf(18.307038053275146, 10) == pytest.approx(0.05, rel=1e-9)
    assert SP.normal_sf(1.959963984540054) == pytest.approx(0.025, rel=1e-12)
    assert SP.dickey_fuller_p(-2.86, "c") == pytest.approx(0.05, abs=0.002)
    assert SP.kpss_p(0.463) == pytest.approx(0.05)


def test_autocorrelation_is_the_plain_sum():
    d = X - X.mean()
    plain = [(d[k:] * d[:-k]).sum() / (d * d).sum() for k in range(1, 6)]
    assert SR.autocorrelation(X, 5) == pytest.approx(plain)


def test_unit_root_tests_tell_noise_from_walk():
    assert SR.stationarity(X)["verdict"] == "stationary"
    assert SR.stationarity(np.cumsum(RNG.normal(size=600)))["verdict"] == "unit_root"


def test_ewma_versions_differ_and_skip_missing():
    r = X[:60].copy()
    r[30] = np.nan
    a = SR.ewma_lagged(r, 0.9, 10)
    assert np.isnan(a[:10]).all() and a[10] == pytest.approx(r[:10].std(ddof=1))
    assert a[31] == a[30]
    b = SR.ewma_current(r**2, 0.75)
    assert b[11] == pytest.approx((r[:12] ** 2).mean()) and b[30] == b[29]


@pytest.mark.parametrize("name", ["haar", "db2", "sym4"])
def test_wavelets(name):
    h, g = SC.modwt_filters(name, 3)
    assert g.sum() == pytest.approx(1) and all(abs(f.sum()) < 1e-9 for f in h)
    w = SC.circular_modwt(X, name, 3)
    assert (w**2).sum() == pytest.approx((X**2).sum())
    assert SC.multiresolution(X, name, 3).sum(0) == pytest.approx(X)
    c, full = SC.causal_modwt(X, name, 3)
    assert c[:, full.all(0)] == pytest.approx(w[:, full.all(0)])


@pytest.mark.parametrize("fn", [lambda x: SC.rolling_spectrum(x, 32), lambda x: SC.rolling_wavelet(x, 32, "haar", 3), lambda x: {"e": SR.ewma_lagged(x, 0.9, 10)}, lambda x: {"s": np.array(SM.intent_states(x, 3, 2)) == "long"}])
def test_no_look_ahead(fn):
    later = X.copy()
    later[300:] = 99.0
    a, b = fn(X), fn(later)
    for k in a:
        assert np.array_equal(np.asarray(a[k][:300], float), np.asarray(b[k][:300], float), equal_nan=True)


def test_spectrum_of_a_sine():
    out = SC.rolling_spectrum(3 * np.cos(2 * np.pi * np.arange(200) / 8), 64, detrend=False)
    assert out["dominant_period"][-1] == pytest.approx(8)
    assert out["amplitude"][-1] == pytest.approx(3, rel=1e-6)
    assert out["phase"][-1] == pytest.approx(2 * np.pi * (199 % 8) / 8 - 2 * np.pi, abs=1e-6)


def test_change_points():
    assert SR.pelt_mean(np.r_[X[:100], X[:100] + 6, X[:100]]) == [0, 100, 200]


def test_hmm_finds_states_and_filters_causally():
    s = np.repeat([0, 1, 0], 150)
    x = (RNG.normal(size=450) + 5 * s)[:, None]
    h = M.fit_hmm(x, 2)
    lb = M.log_gaussian(x, h["means"], h["covs"])
    p = M.forward_filter(lb, h["transition"], h["prior"])
    assert (p.argmax(1) == s).mean() > 0.97
    assert (M.viterbi(lb, h["transition"], h["prior"]) == s).mean() > 0.97
    assert np.array_equal(p[:200], M.forward_filter(lb[:200], h["transition"], h["prior"]))


def test_linear_fits():
    f = RNG.normal(size=(300, 3))
    y = f @ [2.0, 0.0, -1.0]
    q, c = M.gram(f, y)
    b = M.ridge(q, c, 0.0)
    assert b == pytest.approx(np.linalg.lstsq((f - f.mean(0)) / f.std(0), (y - y.mean()) / y.std(), rcond=None)[0], abs=1e-9)
    assert abs(M.lasso_path(q, c)[-1][1][1]) < 0.02
    assert M.nnls(f, y)[2] == 0


def test_calibration_and_effects():
    p = RNG.random(4000)
    y = (RNG.random(4000) < p**2).astype(float)
    for method in ("platt", "isotonic"):
        q = M.fit_calibrator(p, y, method, 100)(np.array([0.2, 0.8]))
        assert q == pytest.approx([0.04, 0.64], abs=0.08)
    assert M.fit_calibrator(p, y, "platt")(p) is p
    e, v = M.ale(lambda z: 3 * z[:, 0], RNG.random((500, 2)), 0)
    assert np.diff(v) / np.diff(e) == pytest.approx(3)


def test_filters():
    level, var = M.local_level(np.array([1.0, 2.0, 9.0]), np.array([True, False, True]), 0.1, 1.0)
    assert level[2] == 9 and var[2] == 1
    up, _, alarm = M.cusum(np.full(10, 1.0), 0.5, 2.0)
    assert alarm.tolist() == [False, False, False, True] * 2 + [False, False] and up[4] == 0.5
    w, _ = M.delayed_intervals(np.abs(X), np.arange(400) + 2, 0.1, 0.0, 200, 20)
    assert np.isnan(w[:20]).all() and 0.8 < (np.abs(X) <= w)[100:].mean() < 1.0


def test_folds_are_purged():
    for f in M.walk_forward_folds(1000, 100, 2, 5, 5):
        assert f["inner_end"] + 10 == f["eval_start"] and f["fit_end"] + 10 == f["inner_start"]
    with pytest.raises(ValueError):
        M.walk_forward_folds(150, 100, 1, 5, 5)
    assert np.isnan(M.outcome_safe(np.arange(10.0), 2, [5])).nonzero()[0].tolist() == [3, 4]


def test_engine_rules():
    t = np.array([0.0, 10, 20, 500, 510, 600])
    fills, marks = SM.run_engine(t, t * 0 + 99, t * 0 + 101, np.array([5.0, 15.0]), np.array([1, 1]), SM.ExecutionRules(latency=0, expiry=100, max_gap=300, holding=1000))
    assert [f["kind"] for f in fills] == ["open", "refused"] and fills[0]["price"] == 101 and fills[0]["ts"] == 10
    assert marks[-1]["equity"] == 10_000 - 2
    fills, _ = SM.run_engine(t, t * 0 + 99, t * 0 + 101, np.array([20.0]), np.array([1]), SM.ExecutionRules(expiry=1000, max_gap=300, latency=470))
    assert [f["kind"] for f in fills] == ["open"]
    fills, _ = SM.run_engine(t, t * 0 + 99, t * 0 + 101, np.array([19.0]), np.array([1]), SM.ExecutionRules(expiry=1000, max_gap=300, latency=0.5))
    assert fills[0]["kind"] == "open"


def test_risk_engine_is_idempotent_and_latches():
    e = SM.RiskEngine(2.0, 50.0, 0.5, 10, 100)
    assert e.evaluate("a", 0, 1, 0) == (False, "stale_account")
    e.observe_account(1, 1000)
    assert e.evaluate("b", 2, 1, 0) == (True, "accepted") == e.evaluate("b", 3, 1, 0)
    assert e.evaluate("c", 4, 3, 0) == (False, "size")
    assert e.evaluate("b", 5, 2, 0) == (False, "reused_intent")
    assert e.evaluate("d", 6, 1, 0) == (False, "halted_reused_intent")


def test_minimum_variance_and_diversity():
    assert M.minimum_variance(np.array([[1.0, 0.9], [0.9, 1.0]])) == pytest.approx([0.5, 0.5])
    assert M.minimum_variance(np.array([[1.0, 1.5], [1.5, 4.0]])) == pytest.approx([1, 0])
    d = M.diversity(np.array([[0.9, 0.9], [0.1, 0.1], [0.8, 0.2]]), np.array([1, 0, 1]))[0]
    assert d["disagreement"] == pytest.approx(1 / 3)


def test_blocks_equal_one_window(spark):
    from pyspark.sql import Window as W
    from pyspark.sql import functions as F

    from tidemark.operators import ordering as O

    pdf = pd.DataFrame({"series": ["a"] * 500, "k": range(500), "day": [k // 37 for k in range(500)], "v": RNG.normal(size=500)})
    df = spark.createDataFrame(pdf)
    b = O.blocks(df, ["series"], ["k"], F.col("day"), 9, 4, 50)
    w = O.block_window(["series"])
    cut = O.own_rows(b.withColumn("m", F.avg("v").over(w.rowsBetween(-9, 4)))).orderBy("k").toPandas()
    whole = df.withColumn("m", F.avg("v").over(W.partitionBy("series").orderBy("k").rowsBetween(-9, 4))).orderBy("k").toPandas()
    assert len(cut) == 500 and np.allclose(cut["m"], whole["m"])


def test_conversion_round_trip(spark, tmp_path):
    from pyspark.sql import functions as F

    from tidemark.sources import ticks as TK
    from tidemark.operators.validate import CHECKS, TickRules
    from tidemark.sources.commits import TickSet

    lines = ["DateTime,Bid,Ask,Volume"]
    for i in range(300):
        lines.append(f"202101{4 + i // 200:02d} 01:{i % 60:02d}:00.{i % 1000:03d},{2000 + i % 10},{2000.3 + i % 10},120")
    lines += [",2000,2000.3,1", "bad,2000,2000.3,1", "20210105 02:00:00.000,,2000,1", "20210105 02:00:01.000,2001,2000,1", "20210105 02:00:02.000,2000"]
    src = tmp_path / "raw.csv"
    src.write_text("\n".join(lines) + "\n")
    fmt = TK.TickFormat()
    ticks = TickSet(spark, str(tmp_path / "ticks"))
    enabled = [c for c in CHECKS if c not in ("duplicate_timestamp", "non_monotonic")]
    out = ticks.update(str(src), fmt, ["DateTime", "Bid", "Ask", "Volume"], TickRules(), enabled)
    assert out["reconciliation"]["ok"] and out["malformed"] == 1 and out["rows"] == 300
    assert out["dropped"] == {"missing_timestamp": 1, "unparseable_timestamp": 1, "missing_quote": 1, "ask_below_bid": 1}
    assert ticks.update(str(src), fmt, ["DateTime", "Bid", "Ask", "Volume"], TickRules(), enabled) == out
    rows = ticks.read().withColumn("year", F.year("timestamp")).withColumn("month", F.month("timestamp"))
    bad = TK.verify_ticks(rows).agg({"stray": "sum", "dup": "sum", "bad": "sum"}).first()
    assert sum(bad) == 0
    assert TK.detect_columns(["DateTime", "Bid", "Ask", "Volume"]) == {"timestamp": "DateTime", "bid": "Bid", "ask": "Ask", "volume": "Volume"}
    assert TK.sniff_dialect(src.read_bytes()[:400])["delimiter"] == ","
    assert TK.detect_timestamp_format(spark, ["20210104 01:00:00.000", "20210105 01:00:00.100"]) == "yyyyMMdd HH:mm:ss.SSS"


def test_stores(spark, tmp_path):
    import datetime as dt

    from tidemark.sources import store as ST

    v = ST.VersionedStore(spark, str(tmp_path))
    df = spark.range(10).withColumnRenamed("id", "k")
    v.write("f", df, {"a": 1})
    assert v.read("f", settings={"a": 1}).count() == 10
    with pytest.raises(LookupError):
        v.read("f", settings={"a": 2})
    s = ST.DataStore(spark, {"t": df.selectExpr("k", "timestamp_seconds(k) AS timestamp")}, max_rows=5)
    with pytest.raises(ST.RowCapError):
        s.load("t")
    assert s.load("t", limit=3).count() == 3
    with pytest.raises(ValueError):
        s.scan("t", dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 1))
    assert "month" in str(ST.partition_predicate(dt.datetime(2023, 11, 5), dt.datetime(2024, 2, 1)))


def test_guards(spark):
    from tidemark.operators import joins as J
    from tidemark.operators import validate as V

    with pytest.raises(ValueError):
        V.assert_feature_schema(["a", "target_x"], {"a": {}, "target_x": {}})
    with pytest.raises(ValueError):
        V.assert_no_forward_columns(spark.range(1).selectExpr("1 AS fwd_1"))
    b = spark.range(5)
    with pytest.raises(J.AlignmentError):
        J.align_to_bars(spark.createDataFrame([(1,), (1,)], "id long"), b, ["id"])
    with pytest.raises(J.AlignmentError):
        J.check_alignment(b, spark.range(6), ["id"])


def test_dst_edges(spark):
    from pyspark.sql import functions as F

    from tidemark.operators.bars import ClockRule, to_utc

    rule = ClockRule("iana", zone="America/New_York")
    df = spark.createDataFrame([("2021-03-14 02:30:00",), ("2021-11-07 01:30:00",), ("2021-07-01 12:00:00",)], "s string")
    got = [r[0] for r in df.select(F.date_format(to_utc(F.to_timestamp("s"), rule), "HH:mm")).collect()]
    assert got == [None, "05:30", "16:00"]


def test_late_tick_halts(spark, tmp_path):
    from tidemark.streaming import bars as SB

    src = tmp_path / "in"
    spark.createDataFrame([("a", 1, 0, 1.0), ("a", 2, 10_000, 2.0), ("a", 3, 1, 3.0)], "series string, seq long, s long, mid double").selectExpr("series", "seq", "timestamp_seconds(s) AS ts", "mid").coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("series string, seq long, ts timestamp, mid double").parquet(str(src))
    out = SB.replay(SB.split_late(stream, "1h", 0), str(tmp_path / "o"), str(tmp_path / "c"))
    assert {r["seq"]: r["status"] for r in out.collect()} == {1: "ok", 2: "ok", 3: "late"}
    with pytest.raises(Exception, match="LateTick"):
        SB.replay(SB.split_late(stream, "1h", 0, halt=True), str(tmp_path / "o2"), str(tmp_path / "c2"))
