"""Structured Streaming: watermarked bars, late ticks, occurrence-aware ingestion, replay."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import scans
from tidemark.operators.bars import parse_timeframe
from tidemark.session import ship


def stream_bars(ticks: DataFrame, timeframe: str, lateness: str, *, series: str = "series", ts: str = "ts", seq: str = "seq", price: str = "mid") -> DataFrame:
    """Tumbling event-time bars that are emitted once, when the watermark passes their end. Ticks later than that are
    dropped by the engine; `split_late` finds them beforehand."""
    parse_timeframe(timeframe)
    unit = {"s": "seconds", "m": "minutes", "h": "hours", "d": "days"}[timeframe[-1]]
    order = F.struct(ts, seq)
    bars = (
        ticks.withWatermark(ts, lateness)
        .groupBy(series, F.window(ts, f"{timeframe[:-1]} {unit}").alias("w"))
        .agg(F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.count("*").alias("tick_count"))
    )
    return bars.select(series, F.col("w.start").alias("timestamp"), "open", "high", "low", "close", "tick_count")


class LateTick(RuntimeError):
    """A tick came after its bar was emitted."""


_LATE_OUT = "series string, seq long, ts timestamp, mid double, status string"
_LATE_STATE = "high long"
_LATE_ROWS = 65_536


def split_late(ticks: DataFrame, timeframe: str, lateness_seconds: float, halt: bool = False) -> DataFrame:
    """Every tick with ``ok`` or ``late``: late is one whose bar ended at or before the highest earlier time less the
    lateness. Earlier is by sequence within a micro-batch, whose ticks come in any order and in many frames: a series' ticks
    of one micro-batch are held together, 24 bytes each. With ``halt`` the query fails instead. State is one number a series."""
    step, slack = parse_timeframe(timeframe), int(lateness_seconds * 1e6)
    ship(ticks.sparkSession)

    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        high = state.get[0] if state.exists else -(2**62)
        held = [(f["seq"].to_numpy(), f["ts"].to_numpy("datetime64[us]"), f["mid"].to_numpy()) for f in frames]
        seq, ts, mid = (np.concatenate(c) for c in zip(*held, strict=True))
        held.clear()
        order = np.argsort(seq, kind="stable")
        seq, ts, mid = seq[order], ts[order], mid[order]
        t, known = ts.astype("int64"), ~np.isnat(ts)
        highs = np.maximum.accumulate(np.concatenate([[high], np.where(known, t, -(2**62))]))
        late = known & (t - t % step + step <= highs[:-1] - slack)
        if halt and late.any():
            raise LateTick(f"{key}: {t[late][0]}")
        for k in range(0, len(seq), _LATE_ROWS):
            part = slice(k, k + _LATE_ROWS)
            yield pd.DataFrame({"series": key[0], "seq": seq[part], "ts": ts[part], "mid": mid[part], "status": np.where(late[part], "late", "ok")})
        state.update((int(highs[-1]),))

    return ticks.select("series", "seq", "ts", "mid").groupBy("series").applyInPandasWithState(run, _LATE_OUT, _LATE_STATE, "append", "NoTimeout")


_INGESTED = "series string, batch long, seq long, ts timestamp, bid double, ask double, status string"


def statuses(rows: DataFrame, seconds: DataFrame | None = None, seen: DataFrame | None = None, max_future_seconds: float = 5.0) -> DataFrame:
    """``rows`` with their ``status`` (see `ingest`), their second ``s``, and, of rows that are neither of the future nor older
    than the last second, which occurrence of their content in their poll they are (``n``). ``seconds`` and ``seen`` are what
    earlier micro-batches left. Only windows over a content or a block of rows are used. A content has been held as often as
    it has occurred in the earlier poll with most of it."""
    us = F.unix_micros("ts")
    future = F.coalesce(us > F.unix_micros("received") + int(max_future_seconds * 1e6), F.col("ts").isNotNull())
    price = {c: F.when(~F.isnan(c), F.col(c)) for c in ("bid", "ask")}
    marked = rows.withColumns({"s": F.expr("(unix_micros(ts) - pmod(unix_micros(ts), 1000000)) div 1000000"), "future": future, **price})
    run = scans.running(marked, ["series"], ["batch", "seq"], F.floor(F.col("batch") / 1024), {"high": ("max", F.when(~F.col("future"), F.col("s")))})
    if seconds is not None:
        run = run.join(F.broadcast(seconds.select(F.col("series").alias("__of"), "second")), F.col("series").eqNullSafe(F.col("__of")), "left").drop("__of")
    else:
        run = run.withColumn("second", F.lit(None).cast("long"))
    live = ~F.col("future") & (F.col("s") >= F.greatest("high", F.coalesce("second", F.lit(-1))))
    content = ["series", "ts", "bid", "ask"]
    run = run.withColumn("live", F.coalesce(live, F.lit(False)))
    # Other rows need no window.
    rest, run = run.where("NOT live").withColumns({"n": F.lit(None).cast("int"), "held": F.lit(None).cast("int")}), run.where("live")
    run = run.withColumn("n", F.row_number().over(W.partitionBy(*content, "batch").orderBy("seq")))
    run = run.withColumn("held", F.max("n").over(W.partitionBy(*content).orderBy("batch").rangeBetween(W.unboundedPreceding, -1)))
    if seen is not None:
        keys = ["series", "ts", "bid", "ask"]
        before = seen.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("n").alias("__n"))
        on = F.lit(True)
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
        run = run.join(before, on, "left").withColumn("held", F.greatest("held", "__n")).drop(*before.columns)
    status = F.when(F.col("future"), "future").when(~F.col("live") | (F.col("n") <= F.coalesce("held", F.lit(0))), "repeat").otherwise("new")
    return run.unionByName(rest).select("series", "batch", "seq", "ts", "bid", "ask", status.alias("status"), "s", "n")


def ingest(rows: DataFrame, path: str, checkpoint: str, max_future_seconds: float = 5.0) -> DataFrame:
    """New rows of overlapping polls (``series, batch, seq, ts, bid, ask, received``). Rows of the last second seen may come again and
    are told apart by how often each content has occurred there, as repeats within a second are legal. ``status``:
    ``new``, ``repeat`` (also rows older than the last second), or ``future`` (too far after the poll was received).

    Runs the stream over all that is there now and reads what it wrote; a second run goes on where the first stopped. No task
    holds a series: what a micro-batch leaves to the next (each series' last second and its contents) are tables in
    ``checkpoint``, one for each micro-batch, and a micro-batch that is run again replaces what it wrote."""
    spark = rows.sparkSession
    at = f"{checkpoint.rstrip('/')}-held"
    rows = rows.select(F.col("series").cast("string"), *(F.col(c) for c in ("batch", "seq", "ts", "bid", "ask", "received")))
    full = _INGESTED + ", s long, n int"
    spark.createDataFrame([], full).write.mode("overwrite").parquet(f"{path}/micro=-1")

    def write(polls: DataFrame, number: int) -> None:
        here = polls.sparkSession
        before = {k: here.read.parquet(f"{at}/{k}/{number - 1}") if number else None for k in ("seconds", "seen")}
        statuses(polls, before["seconds"], before["seen"], max_future_seconds).write.mode("overwrite").parquet(f"{path}/micro={number}")
        made = here.read.schema(full).parquet(f"{path}/micro={number}").where("n IS NOT NULL")
        last = made.groupBy("series").agg(F.max("s").alias("second"))
        seen = made.select("series", "ts", "bid", "ask", "s", "n")
        if number:
            last = last.unionByName(before["seconds"]).groupBy("series").agg(F.max("second").alias("second"))
            seen = seen.unionByName(before["seen"])
        last.write.mode("overwrite").parquet(f"{at}/seconds/{number}")
        last = here.read.parquet(f"{at}/seconds/{number}").withColumnRenamed("series", "__of")
        seen = seen.join(F.broadcast(last), F.col("series").eqNullSafe(F.col("__of")) & (F.col("s") == F.col("second")))
        seen.groupBy("series", "ts", "bid", "ask", "s").agg(F.max("n").alias("n")).write.mode("overwrite").parquet(f"{at}/seen/{number}")

    rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(full + ", micro int").parquet(path).select(*[f.split()[0] for f in _INGESTED.split(", ")])


_FEATURE_STATE = "closes array<double>"
_FEATURE_OUT = "series string, timestamp timestamp, close double, r double, mean double, std double, z double"


def window_features(closes: np.ndarray, carried: int, window: int) -> dict[str, np.ndarray]:
    """Log return, and mean, deviation and z-score over the last ``window`` closes, of all but the first ``carried`` values;
    NaN where there are too few values before."""
    n = len(closes) - carried
    before = np.concatenate([np.full(max(0, window - 1 - carried), np.nan), closes[max(0, carried - window + 1) :]])
    frames = np.lib.stride_tricks.sliding_window_view(before, window)
    mean = frames.mean(1)
    std = frames.std(1, ddof=1) if window > 1 else np.full(n, np.nan)
    own = closes[carried:]
    last = np.concatenate([closes[carried - 1 : carried] if carried else [np.nan], own[:-1]])
    with np.errstate(divide="ignore", invalid="ignore"):
        return {"r": np.log(own / last), "mean": mean, "std": std, "z": np.where(std > 0, (own - mean) / std, np.nan)}


def stream_features(bars: DataFrame, window: int) -> DataFrame:
    """Incremental log return and trailing mean, deviation and z-score of closes per bar, with the last ``window`` closes as
    state. Within a micro-batch bars come in any order and in many frames: a series' bars of one micro-batch are held
    together, 16 bytes each. Micro-batches must follow in time, as emitted bars do; a bar at or before the last one of an
    earlier micro-batch raises."""
    ship(bars.sparkSession)

    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        carried, last = (list(state.get[0]), state.get[1]) if state.exists else ([], -(2**62))
        held = [(f["timestamp"].to_numpy("datetime64[us]"), f["close"].to_numpy("float64")) for f in frames]
        ts, close = (np.concatenate(c) for c in zip(*held, strict=True))
        held.clear()
        order = np.argsort(ts, kind="stable")
        ts, close = ts[order], close[order]
        if int(ts[0].astype("int64")) <= last:
            raise LateTick(f"{key}: a bar at {ts[0]} after a later one")
        closes = np.concatenate([carried, close])
        made = window_features(closes, len(carried), window)
        for k in range(0, len(ts), _LATE_ROWS):
            part = slice(k, k + _LATE_ROWS)
            out = pd.DataFrame({"series": key[0], "timestamp": ts[part], "close": close[part], **{c: v[part] for c, v in made.items()}})
            yield out.astype({c: object for c in made}).where(out.notna(), None)
        state.update((closes[-window:].tolist(), int(ts[-1].astype("int64"))))

    return bars.select("series", "timestamp", "close").groupBy("series").applyInPandasWithState(run, _FEATURE_OUT, _FEATURE_STATE + ", last long", "append", "NoTimeout")


def replay(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now, with its state in ``checkpoint``, and read what it wrote; a second run goes
    on where the first stopped."""
    ship(stream.sparkSession)
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def compare_runs(recorded: DataFrame, replayed: DataFrame) -> DataFrame:
    """Rows that only one of two runs has."""
    a = recorded.exceptAll(replayed).withColumn("only_in", F.lit("recorded"))
    return a.union(replayed.exceptAll(recorded).withColumn("only_in", F.lit("replayed")))


def chain_breaks(journal: DataFrame, order: str, digest: str, previous: str, w) -> DataFrame:
    """Entries of a hash-chained journal whose link does not match the entry before."""
    return journal.withColumn("__p", F.lag(digest).over(w)).where(F.col("__p").isNotNull() & ~F.col(previous).eqNullSafe(F.col("__p"))).drop("__p")


def record(stream: DataFrame, path: str, checkpoint: str):
    """Append every batch's events to a table as they come; a batch that is run again replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
