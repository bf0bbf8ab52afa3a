"""Queries over odd tick tables agree with their SQL: prices of zero, and ticks of a long series in any order."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rounded
from tidemark.plans.registry import ORACLES, QUERIES


def same(spark, folder, name):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    df = QUERIES[name](spark, folder)
    held = lambda v: "nan" if v != v else rounded(v)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    mine = sorted((tuple(held(r[x]) for x in df.columns) for r in df.collect()), key=key)
    names = ", ".join(f'"{x}"' for x in df.columns)
    theirs = sorted((tuple(map(held, r)) for r in c.execute(f"SELECT {names} FROM ({ORACLES[name]})").fetchall()), key=key)
    assert mine == theirs
    return mine


@pytest.fixture(scope="module")
def zeros(spark, sf_dir, tmp_path_factory):
    """Zero at every eleventh tick, and a day of zeros only."""
    folder = str(tmp_path_factory.mktemp("zeros"))
    zero = (F.col("event_id") % 11 == 3) | (F.dayofmonth("ts") == 9)
    spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("value", F.when(zero, 0.0).otherwise(F.col("value"))).write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.mark.parametrize("name", ["timeframe_comparison", "feature_families", "outcome_targets"])
def test_prices_of_zero(spark, zeros, name):
    rows = same(spark, zeros, name)
    assert any(v in ("nan", float("inf"), float("-inf")) for r in rows for v in r)


def test_late_ticks_of_a_long_series(spark, tmp_path):
    """More ticks than a frame holds, in files whose order is not that of the sequence."""
    t = spark.range(30_000, numPartitions=1).select(F.col("id").alias("event_id"), F.timestamp_seconds(1_704_067_200 + F.col("id") * 60).cast("timestamp_ntz").alias("ts"), F.lit(1).cast("long").alias("user_id"), F.lit("view").alias("event_type"), (F.col("id") % 90 + 1.0).alias("value"), F.lit("{}").alias("props"))
    t.repartition(3, F.hash("event_id")).sortWithinPartitions(F.hash("event_id", F.lit(7))).write.parquet(f"{tmp_path}/events.parquet")
    assert len([f for f in os.listdir(f"{tmp_path}/events.parquet") if f.endswith(".parquet")]) > 1
    rows = same(spark, str(tmp_path), "stream_late_split")
    assert len(rows) == 30_000 and sum("late" in r for r in rows) > 100


@pytest.fixture(scope="module")
def years(spark, tmp_path_factory):
    """Two years of ticks of two series, about one in five hours."""
    folder = str(tmp_path_factory.mktemp("years"))
    k = F.col("id")
    noise = lambda seed: F.pmod(F.hash("id", F.lit(seed)), F.lit(10_000)) / 10_000.0
    ts = F.timestamp_seconds(1_672_617_600 + k * 9_000 + F.floor(noise(1) * 9_000)).cast("timestamp_ntz")
    t = spark.range(7_000, numPartitions=3).select(k.alias("event_id"), ts.alias("ts"), F.lit(1).cast("long").alias("user_id"), F.when(k % 2 == 0, "view").otherwise("click").alias("event_type"), (100 + 20 * noise(2) + k / 500).alias("value"), F.lit("{}").alias("props"))
    t.write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.mark.parametrize("name", ["winsorize_causal", "causal_quantile_buckets", "ic_rolling", "ic_by_period", "period_stability", "aggregate_folds", "missing_shares", "segment_ar1_fits", "state_frequency_pivot", "drift_by_period"])
def test_periods_over_years(spark, years, name):
    """Equal weeks of two years stay apart, and no history lies ahead."""
    rows = same(spark, years, name)
    assert len(rows) > 100 or name in ("aggregate_folds",)


def test_winsorized_history_is_earlier(spark, years):
    """A price that jumps in the last week changes no earlier week's bounds."""
    from tidemark.plans.base import returns, week
    from tidemark.operators.selection import expanding_quantiles

    r = returns(spark, years)
    last = r.agg(F.max(week())).first()[0]
    bounds = lambda df: {x["period"]: (x["history"], x["q"]) for x in expanding_quantiles(df, "r", week(), (0.05, 0.95), 20).collect()}
    a, b = bounds(r), bounds(r.withColumn("r", F.when(week() >= last - 10, 1_000.0).otherwise(F.col("r"))))
    assert len(a) > 100 and {k: v for k, v in a.items() if k <= last - 10} == {k: v for k, v in b.items() if k <= last - 10} and a[last] != b[last]


def test_features_of_a_long_series(spark, tmp_path):
    """More bars than a frame holds, in three files out of order, in one micro-batch; then a second one that goes on."""
    from tidemark.streaming import bars as SB

    n = 30_000
    b = spark.range(n, numPartitions=1).select(F.lit("view").alias("series"), F.timestamp_seconds(F.col("id") * 3600).alias("timestamp"), (F.pmod(F.hash("id"), F.lit(900)) / 7.0 + 1).alias("close"))
    shuffled = lambda df, k: df.repartition(k, F.hash("timestamp")).sortWithinPartitions(F.hash("timestamp", F.lit(7)))
    first = F.col("timestamp") < F.timestamp_seconds(F.lit(20_011 * 3600))
    out = None
    for part in (b.where(first), b.where(~first)):
        shuffled(part, 3).write.mode("append").parquet(f"{tmp_path}/bars")
        stream = spark.readStream.schema(b.schema).parquet(f"{tmp_path}/bars")
        out = SB.replay(SB.stream_features(stream, 6), f"{tmp_path}/out", f"{tmp_path}/state")
    got = out.orderBy("timestamp").collect()
    closes = [r["close"] for r in b.orderBy("timestamp").collect()]
    assert [r["close"] for r in got] == closes
    x = np.array(closes)
    assert got[0]["r"] is None and np.allclose([r["r"] for r in got[1:]], np.diff(np.log(x)))
    w = np.lib.stride_tricks.sliding_window_view(x, 6)
    assert [r["mean"] for r in got[:5]] == [None] * 5 and np.allclose([r["mean"] for r in got[5:]], w.mean(1))
    assert np.allclose([r["std"] for r in got[5:]], w.std(1, ddof=1)) and np.allclose([r["z"] for r in got[5:]], (x[5:] - w.mean(1)) / w.std(1, ddof=1))
