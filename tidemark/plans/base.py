"""What the registered queries share: the tick view of ``events``, hourly bars, returns, and rounding for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import ordering
from tidemark.operators.bars import resample_ticks
from tidemark.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Doubles are compared to so many decimals.
DIGITS = 6
SERIES = ["series"]


def add(name: str, query: Callable, sql: str | None, keys: list[str], doubles: list[str] = ()) -> None:
    """Register a query that returns ``keys`` as they are and ``doubles`` rounded, and its SQL."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = query(spark, sf_dir)
        return df.select(*[F.col(f"`{c}`") for c in keys], *[(F.round(F.col(f"`{c}`").cast("double"), DIGITS) + 0.0).alias(c) for c in doubles])

    QUERIES[name] = run
    if sql is not None:
        cols = ", ".join([*[f'"{c}"' for c in keys], *[f'round("{c}"::DOUBLE, {DIGITS}) + 0.0 AS "{c}"' for c in doubles]])
        with_, _, last = sql.strip().rpartition("\n--\n")
        ORACLES[name] = f"{with_ + chr(10) if with_ else ''}SELECT {cols} FROM ({last})".replace("week(timestamp)", WEEK_SQL)


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (1 + F.col("event_id") % 3) * 0.01
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("series"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), "user_id",
        F.col("value").alias("mid"), (F.col("value") - k).alias("bid"), (F.col("value") + k).alias("ask"), (k * 2).alias("spread"), F.lit(1.0).alias("volume"),
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of every series."""
    return resample_ticks(ticks(spark, sf_dir), "1h", series=SERIES)


def in_blocks(df: DataFrame, back: int, ahead: int = 0, block_rows: int = 512) -> DataFrame:
    """Bars numbered and cut into overlapping blocks by day. Small blocks, so that small data cross them too."""
    return ordering.blocks(df, SERIES, ["timestamp"], F.to_date("timestamp"), back, ahead, block_rows)


def BW():  # noqa: N802
    """The window of a block of bars."""
    return ordering.block_window(SERIES)


def T0():  # noqa: N802
    """A bar's start in Unix seconds."""
    return F.unix_timestamp("timestamp").alias("t")


def week(ts: str = "timestamp"):
    """Weeks (from Monday) since 1969-12-29, which ascend over the years too."""
    return F.floor((F.unix_date(F.to_date(ts)) + 3) / 7).cast("long")


#: `week` as SQL, in which ``week(timestamp)`` stands for it.
WEEK_SQL = "((date_diff('day', DATE '1970-01-01', timestamp::DATE) + 3) // 7)"


def on_bars(columns: Callable[[], dict], back: int, ahead: int = 0, source: Callable = bars):
    """A query that adds window columns to bars, by overlapping blocks."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        b = in_blocks(source(spark, sf_dir), back, ahead)
        return ordering.own_rows(b.select("*", *[c.alias(n) for n, c in columns().items()])).withColumn("t", F.unix_timestamp("timestamp"))

    return run


def returns(spark: SparkSession, sf_dir: str, log_return: Callable = S.log_return) -> DataFrame:
    """Bars with the log return ``r``, exact across blocks."""
    b = in_blocks(bars(spark, sf_dir), 1)
    return ordering.own_rows(b.withColumn("r", log_return(F.col("close"), F.lag("close").over(BW()))))


def ratio_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`returns` that are infinite or NaN, as in SQL, where a close is zero."""
    return returns(spark, sf_dir, S.log_ratio)


TICKS_SQL = """
ticks AS (
  SELECT event_type AS series, event_id AS seq, ts, user_id, value AS mid, value - k AS bid, value + k AS ask, k * 2 AS spread, 1.0::DOUBLE AS volume
  FROM (SELECT *, (1 + event_id % 3) * 0.01::DOUBLE AS k FROM events)
)"""
BARS_SQL = (
    TICKS_SQL
    + """,
bars AS (
  SELECT series, date_trunc('hour', ts) AS timestamp, epoch(date_trunc('hour', ts))::BIGINT AS t, arg_min(mid, row(ts, seq)) AS open, max(mid) AS high,
    min(mid) AS low, arg_max(mid, row(ts, seq)) AS close, count(*) AS tick_count, sum(volume) AS volume, avg(spread) AS mean_spread,
    median(spread) AS median_spread, min(spread) AS min_spread, max(spread) AS max_spread, arg_min(bid, row(ts, seq)) AS first_bid,
    arg_max(bid, row(ts, seq)) AS last_bid, arg_min(ask, row(ts, seq)) AS first_ask, arg_max(ask, row(ts, seq)) AS last_ask
  FROM ticks GROUP BY ALL
)"""
)
RETURNS_SQL = (
    BARS_SQL
    + """,
returns AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY series ORDER BY timestamp)) AS r,
  row_number() OVER (PARTITION BY series ORDER BY timestamp) - 1 AS i FROM bars)"""
)


def with_(sql: str, *ctes: str) -> str:
    """SQL whose last part, after the common tables, is the query."""
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n--\n" + sql
