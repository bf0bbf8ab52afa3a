"""Statuses of overlapping polls agree with a plain pass over each series' rows, in one micro-batch or in many."""

import random
from datetime import datetime, timedelta

from tidemark.streaming import bars as SB

SCHEMA = "series string, batch long, seq long, ts timestamp, bid double, ask double, received timestamp"


def plain(rows):
    out, second, held, left, poll = [], -1, [], [], None
    for batch, seq, ts, bid, ask, received in sorted(rows, key=lambda r: r[:2]):
        if batch != poll:
            poll, left = batch, list(held)
        content = (ts, bid, ask)
        s = None if ts is None else int(ts.timestamp() // 1)
        if ts is not None and ts > received + timedelta(seconds=5):
            status = "future"
        elif s is None or s < second:
            status = "repeat"
        elif s == second and content in left:
            left.remove(content)
            status = "repeat"
        else:
            if s > second:
                second, held, left = s, [], []
            held.append(content)
            status = "new"
        out.append((batch, seq, status))
    return sorted(out)


def polls(seed):
    """Polls that repeat rows of the one before, some rows twice, old ones and early ones."""
    g, start = random.Random(seed), datetime(2024, 1, 1)
    made = []
    for batch in range(40):
        for seq in range(g.randrange(12)):
            ts = start + timedelta(milliseconds=500 * (batch // 2 + g.choice([0, 0, 1, 1, -2, 20])))
            made.append((batch, seq, None if g.random() < 0.03 else ts, g.choice([1.0, 2.0, None]), 3.0, start + timedelta(milliseconds=500 * (batch // 2) + 1000)))
    return made


def test_statuses_in_any_micro_batches(spark, tmp_path):
    held = {"a": polls(1), "b": polls(2), None: polls(3)}
    for cuts in ([40], [1, 7, 8, 25, 40]):
        at = tmp_path / f"in{len(cuts)}"
        at.mkdir()
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(at))
        low = 0
        for high in cuts:
            rows = [(s, *r) for s, rs in held.items() for r in rs if low <= r[0] < high]
            random.Random(4).shuffle(rows)
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(at))
            got = SB.ingest(stream, f"{at}-out", f"{at}-state").collect()
            low = high
        for s, rows in held.items():
            assert sorted((r["batch"], r["seq"], r["status"]) for r in got if r["series"] == s) == plain(rows)
        assert {r["status"] for r in got} == {"new", "repeat", "future"}


def test_no_python_and_no_window_over_a_series(spark):
    rows = spark.createDataFrame([("a", *r) for r in polls(1)], SCHEMA)
    plan = SB.statuses(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
    assert rows.count() == SB.statuses(rows).count()
