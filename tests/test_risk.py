"""Risk decisions by windows agree with the plain engine over a whole series."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import simulate as SM
from tidemark.operators import risk as RK

SCHEMA = "series string, t long, seq long, intent string, size double, equity double, observed boolean"
LIMITS = (3.0, 50.0, 0.02, 3, 500)


def made(seed, n, intents, swing, conflicts=0.0):
    """Rows of one series: times with ties and gaps, intents sent again, and some for another size."""
    g, t, out, sizes = random.Random(seed), 1_700_000_000, [], {}
    for k in range(n):
        t += g.choice([0, 0, 1, 7, 25, 25, 700])
        name = f"i{g.randrange(intents)}"
        size = sizes.setdefault(name, g.choice([1.0, 2.0, 3.0, 3.5]))
        out.append((t, k, name, size + (g.random() < conflicts), None if g.random() < 0.02 and k > 20 else 10_000 + swing * g.random(), g.random() < 0.4))
    return out


HELD = {"calm": made(1, 900, 700, 20), "loss": made(2, 400, 300, 150), None: made(3, 500, 300, 45, 0.004), "drop": made(5, 300, 200, 600), "one": made(4, 1, 1, 1)}


def plain(rows):
    e, out = SM.RiskEngine(*LIMITS), []
    for t, k, intent, size, equity, observed in rows:
        if observed:
            e.observe_account(float(t), float("nan") if equity is None else equity)
        out.append((k, *e.evaluate(intent, float(t), size, 0.0)))
    return out


@pytest.mark.parametrize("block_rows", [16, 100_000])
def test_windows_give_the_plain_engine(spark, block_rows):
    rows = [(s, *r) for s, rs in HELD.items() for r in rs]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("exposure", F.lit(0.0)).repartition(5)
    names = dict(zip(("max_size", "max_daily_loss", "max_drawdown", "max_rate", "stale_after"), LIMITS, strict=True))
    got = RK.decisions(
        df, ["series"], ["t", "seq"], F.floor(F.col("t") / 86_400), t="t", intent="intent", size="size", exposure="exposure", equity="equity", observed="observed", block_rows=block_rows, **names
    ).collect()
    some = set()
    for s, rs in HELD.items():
        expected = plain(rs)
        assert sorted((r["seq"], r["ok"], r["reason"]) for r in got if r["series"] == s) == sorted(expected)
        some |= {w for *_, w in expected}
    assert {"accepted", "rate", "size", "stale_account", "reused_intent", "halted_daily_loss", "halted_reused_intent"} <= some
