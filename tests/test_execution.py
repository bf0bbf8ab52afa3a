"""The event simulation in blocks agrees with the plain engine over a whole series, wherever blocks are cut."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import simulate as SM
from tidemark.operators import execution as EX

RULES = SM.ExecutionRules(latency=1, expiry=40, max_gap=300, holding=30, commission=0.01, slippage=0.003, size=1.7)
RUNS = {
    "base": SM.Scenario(), "wide": SM.Scenario(spread=3.0), "slow": SM.Scenario(latency=35.5), "outage": SM.Scenario(outage=(1_000_060.0, 1_000_700.0)),
    "missed": SM.Scenario(missed=0.6), "costly": SM.Scenario(commission=1.0, slippage=0.5), "none": SM.Scenario(outage=(0.0, 2e9)),
}


def series(n, seed, most):
    """Ticks of one series: microseconds (with ties and gaps), number, bid, ask, side."""
    g = np.random.default_rng(seed)
    us = 1_000_000_000_000 + np.cumsum(g.choice([0, 0, 1, int(most * 1e5), int(most * 1e6), int(most * 3e7)], n, p=[0.2, 0.1, 0.1, 0.3, 0.2, 0.1]))
    mid = np.round(g.normal(100, 5, n), 2)
    bid = [None if seed == 3 and k % 97 == 50 else float(m) - 0.01 for k, m in enumerate(mid)]
    return [(int(t), k, b, float(m) + 0.01, int(s)) for k, (t, b, m, s) in enumerate(zip(us, bid, mid, g.choice([-1, 1], n), strict=True))]


HELD = {"dense": series(900, 1, 0.3), "sparse": series(300, 2, 6.0), None: series(400, 3, 1.0), "two": series(2, 4, 1.0), "one": series(1, 5, 1.0)}


def plain(rows, scenario):
    t, _, bid, ask, side = (np.array([math.nan if x is None else x for x in c], float) for c in zip(*rows, strict=True))
    t = t / 1e6
    return SM.run_engine(*scenario.quotes(t, bid, ask), *scenario.orders(t, side.astype(int)), scenario.rules(RULES))


def same(v):
    return None if v is None or isinstance(v, float) and not math.isfinite(v) else v


def in_order(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("block_rows", [1, 7, 64, 100_000])
def test_blocks_give_the_plain_engine(spark, block_rows):
    held = HELD if block_rows > 7 else {s: rows[: 8 * block_rows + 10] for s, rows in HELD.items()}
    rows = [(s, *r) for s, rs in held.items() for r in rs]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "s string, us long, seq long, bid double, ask double, side int").withColumn("timestamp", F.timestamp_micros("us")).drop("us")
    run = EX.Execution(df.repartition(5), ["s"], {n: (c, RULES) for n, c in RUNS.items()}, block_rows)
    fills, marks, totals = run.fills().collect(), run.marks().collect(), run.totals().collect()
    assert len(totals) == len(held) * len(RUNS)
    some = set()
    for s, rs in held.items():
        for n, c in RUNS.items():
            f, m = plain(rs, c)
            mine = [(r["ts"], r["kind"], r["order"], r["side"], same(r["price"])) for r in fills if (r["s"], r["scenario"]) == (s, n)]
            assert in_order(mine) == in_order([(x["ts"], x["kind"], x["order"], x["side"], same(x["price"])) for x in f])
            mine = [(r["ts"], same(r["equity"]), same(r["drawdown"]), r["position"]) for r in marks if (r["s"], r["scenario"]) == (s, n)]
            assert in_order(mine) == in_order([(x["ts"], same(x["equity"]), same(x["drawdown"]), x["position"]) for x in m])
            (total,) = [r for r in totals if (r["s"], r["scenario"]) == (s, n)]
            assert (total["events"], total["opened"]) == (len(f), sum(x["kind"] == "open" for x in f))
            assert same(total["equity"]) == (same(m[-1]["equity"]) if m else None)
            some |= {x["kind"] for x in f}
    assert some == {"open", "close", "expired", "refused"} or block_rows < 64


def test_no_task_holds_a_series(spark):
    """A series of many blocks: no call of a block's code gets more rows than a block has."""
    df = spark.range(5000).select(F.lit("a").alias("s"), F.col("id").alias("seq"), F.timestamp_seconds(F.col("id") * 7).alias("timestamp"), F.lit(99.0).alias("bid"), F.lit(101.0).alias("ask"), F.lit(1).alias("side"))
    run = EX.Execution(df, ["s"], {"base": (SM.Scenario(), RULES)}, 100)
    assert run.blocks.count() == 100 and run.blocks.agg(F.max(F.length("at"))).first()[0] == 800
