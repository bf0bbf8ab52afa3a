"""Row checks, first-match cleaning, gaps and quality figures of ticks and bars."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import ordering as O
from tidemark.operators.bars import micros_of, parse_timeframe
from tidemark.operators.selection import with_quantiles

#: The checks, in the order in which the first failing one names the reason.
CHECKS = (
    "missing_timestamp", "unparseable_timestamp", "missing_quote", "non_finite_price", "non_positive_price",
    "price_out_of_range", "ask_below_bid", "negative_spread", "extreme_spread", "invalid_volume", "non_monotonic",
    "duplicate_row", "duplicate_timestamp",
)


@dataclass(frozen=True)
class TickRules:
    min_price: float = 0.0
    max_price: float = 1e9
    max_spread: float = 1e9
    gap_seconds: float = 3600.0


def _is(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))


def _bad_number(c: Column) -> Column:
    return _is(F.isnan(c) | (F.abs(c) == float("inf")))


def flag_ticks(
    ticks: DataFrame, rules: TickRules = TickRules(), *, series: list[str] | None = None, ts: str = "ts", seq: str = "seq",
    raw_ts: str | None = None, bid: str = "bid", ask: str = "ask", volume: str | None = "volume", bucket_rows: int = O.BLOCK_ROWS,
) -> DataFrame:
    """``ticks`` with a boolean for every check. A row is compared with the row just before it in source order; of equal
    times and of equal rows the first in source order is not a duplicate. ``seq`` is a number; the row before is looked for
    in spans of ``bucket_rows`` of it."""
    series = series or []
    beside = O.with_previous(ticks, series, [seq], F.floor(F.col(seq).cast("double") / bucket_rows), ts, "__previous")
    t, b, a = F.col(ts), F.col(bid), F.col(ask)
    raw = F.col(raw_ts) if raw_ts else t.cast("string")
    blank = F.trim(F.coalesce(raw, F.lit(""))) == ""
    finite = ~_bad_number(b) & ~_bad_number(a)
    first = lambda *keys: F.row_number().over(W.partitionBy(*series, *keys).orderBy(seq)) > 1
    vol = F.col(volume) if volume else F.lit(None).cast("double")
    flags = {
        "missing_timestamp": blank,
        "unparseable_timestamp": ~blank & t.isNull(),
        "missing_quote": b.isNull() | a.isNull(),
        "non_finite_price": ~finite,
        "non_positive_price": finite & _is((b <= 0) | (a <= 0)),
        "price_out_of_range": finite & _is((b < rules.min_price) | (b > rules.max_price) | (a < rules.min_price) | (a > rules.max_price)),
        "ask_below_bid": finite & _is(a < b),
        "negative_spread": finite & _is(a - b < 0),
        "extreme_spread": finite & _is(a - b > rules.max_spread),
        "invalid_volume": _bad_number(vol) | _is(vol < 0),
        "non_monotonic": _is(t < F.col("__previous")),
        "duplicate_row": t.isNotNull() & first(t, b, a, vol),
        "duplicate_timestamp": t.isNotNull() & first(t),
    }
    return beside.select(*ticks.columns, *[flags[c].alias(c) for c in CHECKS])


def flag_counts(flagged: DataFrame) -> DataFrame:
    """``check, rows``: rows that fail each check (a row may fail several), and ``any``."""
    any_ = reduce(Column.__or__, [F.col(c) for c in CHECKS])
    sums = flagged.agg(*[F.sum(F.col(c).cast("long")).alias(c) for c in CHECKS], F.sum(any_.cast("long")).alias("any"))
    return sums.unpivot([], [*CHECKS, "any"], "check", "rows").select("check", F.coalesce("rows", F.lit(0)).alias("rows"))


def bad_examples(flagged: DataFrame, seq: str, most: int) -> DataFrame:
    """Up to ``most`` first rows for every check."""
    long = flagged.select("*", F.explode(F.array(*[F.when(F.col(c), c) for c in CHECKS])).alias("check")).where("check IS NOT NULL")
    rank = F.row_number().over(W.partitionBy("check").orderBy(seq))
    return long.withColumn("example", rank).where(F.col("example") <= most).drop(*CHECKS)


def drop_reason(enabled: list[str]) -> Column:
    """The first enabled check that fails, or null."""
    out = None
    for c in (c for c in CHECKS if c in enabled):
        out = F.when(F.col(c), c) if out is None else out.when(F.col(c), c)
    return out if out is not None else F.lit(None).cast("string")


def clean(flagged: DataFrame, enabled: list[str]) -> tuple[DataFrame, DataFrame]:
    """Kept rows without flags, and the audit ``reason, rows`` whose sum with the kept rows is the input."""
    marked = flagged.withColumn("reason", drop_reason(enabled))
    audit = marked.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("rows"))
    return marked.where("reason IS NULL").drop(*CHECKS, "reason"), audit


def tick_gaps(ticks: DataFrame, seconds: float, *, series: list[str], ts: str = "ts", seq: str = "seq") -> DataFrame:
    """Steps between neighbours in time longer than so many seconds."""
    beside = O.with_previous(ticks, series, [ts, seq], F.to_date(ts), ts, "gap_start")
    step = (micros_of(F.col(ts)) - micros_of(F.col("gap_start"))) / 1e6
    return beside.select(*series, "gap_start", F.col(ts).alias("gap_end"), step.alias("seconds")).where(F.col("seconds") > seconds)


def iso_weekday(ts: Column) -> Column:
    """Monday 1 to Sunday 7."""
    return F.weekday(ts) + 1


@dataclass(frozen=True)
class Schedule:
    """Weekly close and open (ISO weekdays) and the daily break of an instrument's clock."""

    close_day: int = 5
    open_day: int = 1
    break_start: str = "00:00"
    break_end: str = "01:00"
    #: Ticks never fall on the break's very edges.
    tick_slack_minutes: int = 5


def _minutes(clock: str) -> int:
    return int(clock[:2]) * 60 + int(clock[3:5])


def classify_gap(start: Column, end: Column, schedule: Schedule = Schedule(), ticks: bool = False) -> Column:
    """``weekend`` (close day to open day, under four days), ``holiday_weekend`` (up to a week, over a Saturday, ending on
    the open day), ``daily_break`` or ``holiday_or_unknown``. With ``ticks``, edges within some minutes of the break's
    are the break too."""
    s = schedule
    hours = (micros_of(end) - micros_of(start)) / 3_600_000_000
    opens = iso_weekday(end) == s.open_day
    saturday = F.pmod(6 - iso_weekday(start), F.lit(7)) <= F.datediff(end, start)
    seconds = lambda t: F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)
    first, last = _minutes(s.break_start), _minutes(s.break_end)
    closed = F.lit(True) if first == 0 else seconds(start) >= (first - 1) * 60
    daily = (hours <= 24) & closed & (seconds(end) <= last * 60)
    if ticks:
        slack = s.tick_slack_minutes * 60_000_000
        length = ((last - first) % 1440 or 1440) * 60_000_000
        for day in (start, end):
            opening = micros_of(F.date_trunc("day", day)) + first * 60_000_000
            daily = daily | ((F.abs(micros_of(start) - opening) <= slack) & (F.abs(micros_of(end) - opening - length) <= slack))
    return (
        F.when((iso_weekday(start) == s.close_day) & opens & (hours < 96), "weekend")
        .when(opens & (hours <= 168) & saturday, "holiday_weekend").when(daily, "daily_break").otherwise("holiday_or_unknown")
    )


def bar_gaps(bars: DataFrame, timeframe: str, *, series: list[str], ts: str = "timestamp") -> DataFrame:
    """Missing slots between neighbouring bars."""
    step = parse_timeframe(timeframe)
    w = W.partitionBy(*series).orderBy(ts)
    delta = micros_of(F.col(ts)) - micros_of(F.lag(ts).over(w))
    out = bars.select(*series, F.lag(ts).over(w).alias("gap_start"), F.col(ts).alias("gap_end"), (F.floor(delta / step) - 1).cast("long").alias("missing"))
    return out.where(F.col("missing") > 0)


def coverage(bars: DataFrame, timeframe: str, *, series: list[str], ts: str = "timestamp") -> DataFrame:
    """Bars present, slots expected between the first and the last, and their ratio."""
    step = parse_timeframe(timeframe)
    span = ((micros_of(F.max(ts)) - micros_of(F.min(ts))) / step).cast("long") + 1
    return bars.groupBy(*series).agg(F.count("*").alias("bars"), span.alias("expected")).withColumn("ratio", F.col("bars") / F.col("expected"))


def bar_quality(bars: DataFrame, *, series: list[str], low_quantile: float = 0.05) -> DataFrame:
    """Figures of bar quality. The low tick count is the lower of the two neighbours of its quantile."""
    base = bars.groupBy(*series).agg(
        F.count("*").alias("bars"), F.avg("tick_count").alias("mean_ticks"), F.min("tick_count").alias("min_ticks"), F.max("tick_count").alias("max_ticks"),
        F.sum((F.col("high") == F.col("low")).cast("long")).alias("zero_range"),
    )
    out = with_quantiles(base, bars, series, {"ticks": (F.col("tick_count"), {"median_ticks": 0.5, "low_ticks": low_quantile})})
    return out.withColumn("low_ticks", F.floor("low_ticks").cast("long"))


def core_stats(ticks: DataFrame, *, ts: str = "ts") -> DataFrame:
    """Rows, span, distinct days and months, and times held by more than one row."""
    days = ticks.agg(
        F.count("*").alias("rows"), F.min(ts).alias("first"), F.max(ts).alias("last"),
        F.count_distinct(F.to_date(ts)).alias("days"), F.count_distinct(F.date_trunc("month", ts)).alias("months"),
    )
    shared = ticks.groupBy(ts).count().where("count > 1").agg(F.count("*").alias("shared_times"), F.coalesce(F.sum("count"), F.lit(0)).alias("shared_rows"))
    return days.crossJoin(F.broadcast(shared))  # one row each


def spread_stats(ticks: DataFrame, spread: Column, exact: bool = True) -> DataFrame:
    """Mean, bounds and quantiles of the spread."""
    s = ticks.select(spread.alias("s"))
    named = {f"p{int(p * 100)}": p for p in (0.5, 0.9, 0.99)}
    rough = [] if exact else [F.percentile_approx("s", p, 10_000).alias(n) for n, p in named.items()]
    out = s.agg(F.avg("s").alias("mean"), F.min("s").alias("min"), F.max("s").alias("max"), *rough)
    return with_quantiles(out, s, [], {"s": (F.col("s"), named)}) if exact else out


def null_counts(df: DataFrame) -> DataFrame:
    """``column, nulls``."""
    sums = df.agg(*[F.coalesce(F.sum(F.col(c).isNull().cast("long")), F.lit(0)).alias(c) for c in df.columns])
    return sums.unpivot([], df.columns, "column", "nulls")


def reconcile(source_rows: int, written: int, dropped: dict[str, int], malformed: int) -> dict:
    """Whether every source row is accounted for."""
    total = written + sum(dropped.values()) + malformed
    return {"source": source_rows, "accounted": total, "difference": source_rows - total, "ok": total == source_rows}


def assert_feature_schema(columns: list[str], registry: dict[str, dict], live_safe_only: bool = False) -> None:
    """Refuse unregistered, outcome and (if asked) not live-safe columns."""
    unknown = [c for c in columns if c not in registry]
    outcome = [c for c in columns if c.startswith(("fwd_", "target_"))]
    unsafe = [c for c in columns if live_safe_only and c in registry and not registry[c].get("live_safe", False)]
    for what, found in (("unregistered", unknown), ("outcome", outcome), ("not live-safe", unsafe)):
        if found:
            raise ValueError(f"{what} columns: {', '.join(sorted(found))}")


def assert_no_forward_columns(df: DataFrame, context: str = "features") -> None:
    found = [c for c in df.columns if c.startswith("fwd_")]
    if found:
        raise ValueError(f"{context} must not hold outcomes: {', '.join(found)}")
