"""Ticks to bars: calendar buckets that keep gaps, time zones, sessions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT_MS = {"ms": 1, "s": 1_000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}


def parse_timeframe(text: str) -> int:
    """Microseconds of a duration such as ``5m``."""
    digits = text.rstrip("msdh")
    unit = text[len(digits) :]
    if not digits.isdigit() or int(digits) <= 0 or unit not in UNIT_MS:
        raise ValueError(f"not a timeframe: {text!r}")
    return int(digits) * UNIT_MS[unit] * 1_000


def validate_timeframes(frames: list[str]) -> list[int]:
    """Microseconds of frames that divide a day into whole parts."""
    out = []
    for f in frames:
        micros = parse_timeframe(f)
        if 86_400_000_000 % micros:
            raise ValueError(f"{f} does not divide a day")
        out.append(micros)
    return out


def micros_of(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def bar_start(ts: Column, timeframe: str, closed: str = "left") -> Column:
    """Start of the half-open bar that holds a time; with ``closed='right'`` bars are (t, t + D]."""
    step = parse_timeframe(timeframe)
    m = micros_of(ts) - (1 if closed == "right" else 0)
    return F.timestamp_micros(m - F.pmod(m, F.lit(step)))


def resample_ticks(
    ticks: DataFrame,
    timeframe: str,
    *,
    series: list[str] | None = None,
    ts: str = "ts",
    seq: str = "seq",
    price: str = "mid",
    label: str = "open",
    closed: str = "left",
    min_ticks: int = 1,
) -> DataFrame:
    """Bars of the ticks. First and last follow (time, sequence); a bar without ticks is absent; ``label='close'`` stamps
    a bar with its end after grouping. Columns ``bid, ask, spread, volume`` are summed up where they exist."""
    series = series or []
    order = F.struct(F.col(ts), F.col(seq))
    p = F.col(price)
    aggs = [
        F.min_by(p, order).alias("open"),
        F.max(p).alias("high"),
        F.min(p).alias("low"),
        F.max_by(p, order).alias("close"),
        F.count("*").alias("tick_count"),
    ]
    if "volume" in ticks.columns:
        aggs.append(F.sum("volume").alias("volume"))
    if "spread" in ticks.columns:
        aggs += [
            F.avg("spread").alias("mean_spread"),
            F.percentile("spread", 0.5).alias("median_spread"),
            F.min("spread").alias("min_spread"),
            F.max("spread").alias("max_spread"),
        ]
    for side in ("bid", "ask"):
        if side in ticks.columns:
            aggs += [F.min_by(side, order).alias(f"first_{side}"), F.max_by(side, order).alias(f"last_{side}")]
    aggs += [F.min(ts).alias("first_tick_timestamp"), F.max(ts).alias("last_tick_timestamp")]
    bars = ticks.groupBy(*series, bar_start(F.col(ts), timeframe, closed).alias("timestamp")).agg(*aggs)
    bars = bars.where(F.col("tick_count") >= min_ticks) if min_ticks > 1 else bars
    if label == "close":
        bars = bars.withColumn("timestamp", F.timestamp_micros(micros_of(F.col("timestamp")) + parse_timeframe(timeframe)))
    return bars


@dataclass(frozen=True)
class ClockRule:
    """How a source's wall clock relates to UTC: ``naive``, ``fixed_offset``, ``iana`` or ``anchored_dst`` (a zone's wall
    clock plus a shift)."""

    mode: str = "naive"
    offset_hours: float = 0.0
    zone: str = "UTC"
    shift_hours: float = 0.0


def to_utc(local: Column, rule: ClockRule) -> Column:
    """UTC instant of a wall-clock time; the earlier of two for an ambiguous time, null for one that does not exist."""
    t = local.cast("timestamp")
    if rule.mode == "naive":
        return t
    if rule.mode == "fixed_offset":
        return F.timestamp_micros(micros_of(t) - int(rule.offset_hours * 3_600_000_000))
    shift = int(rule.shift_hours * 3_600_000_000) if rule.mode == "anchored_dst" else 0
    wall = F.timestamp_micros(micros_of(t) - shift)
    utc = F.to_utc_timestamp(wall, rule.zone)
    return F.when(F.from_utc_timestamp(utc, rule.zone) == wall, utc)


def utc_offset_hours(local: Column, rule: ClockRule) -> Column:
    """Hours by which the wall clock is ahead of UTC at a time."""
    return (micros_of(local) - micros_of(to_utc(local, rule))) / 3_600_000_000


def assign_session(ts: Column, sessions: list[tuple[str, str, str]], otherwise: str = "unclassified") -> Column:
    """Name of the first session [start, end) that holds the time of day; a session may wrap midnight."""
    minute = F.hour(ts) * 60 + F.minute(ts)
    at = lambda s: int(s[:2]) * 60 + int(s[3:])
    out = None
    for name, start, end in sessions:
        a, b = at(start), at(end)
        inside = (minute >= a) & (minute < b) if a < b else (minute >= a) | (minute < b)
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out.otherwise(otherwise) if out is not None else F.lit(otherwise)


def session_gap(ts: Column, previous: Column, timeframe: str, multiple: float = 1.5) -> Column:
    """True where the step from the previous bar is longer than so many bars, and for the first bar."""
    return F.coalesce(micros_of(ts) - micros_of(previous) > multiple * parse_timeframe(timeframe), F.lit(True))


def quarter_block(ts: Column) -> Column:
    return F.year(ts) * 4 + F.quarter(ts) - 1


def month_block(ts: Column) -> Column:
    return F.year(ts) * 12 + F.month(ts) - 1


def weekend_gap(ts: Column, previous: Column, hours: float) -> Column:
    """True where more than so many hours passed since the previous row; false for the first."""
    return F.coalesce(micros_of(ts) - micros_of(previous) > hours * 3_600_000_000, F.lit(False))


def span_contains(flag: Column, horizon: int, window) -> Column:
    """Whether a flag is set in the rows t+1 to t+h."""
    return F.coalesce(F.max(flag.cast("int")).over(window.rowsBetween(1, horizon)) == 1, F.lit(False))


def regular_grid(bars: DataFrame, timeframe: str, series: list[str], ts: str = "timestamp") -> DataFrame:
    """Every slot between a series' first and last bar, with nulls where there is no bar; nothing is filled in."""
    step = parse_timeframe(timeframe)
    span = bars.groupBy(*series).agg(micros_of(F.min(ts)).alias("__a"), micros_of(F.max(ts)).alias("__b"))
    slots = span.select(*series, F.explode(F.sequence("__a", "__b", F.lit(step))).alias("__m")).select(*series, F.timestamp_micros("__m").alias(ts))
    return slots.join(bars, [*series, ts], "left")


def build_bars(ticks: DataFrame, timeframe: str, path: str, **options) -> int:
    """Bars by year in Parquet; their number after they were read back and held against what was to be written."""
    bars = resample_ticks(ticks, timeframe, **options).withColumn("year", F.year("timestamp"))
    bars.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path)
    back = ticks.sparkSession.read.parquet(path)
    years = [r[0] for r in bars.select("year").distinct().collect()]
    written = back.where(F.col("year").isin(years)).agg(F.sum("tick_count"), F.count("*")).first()
    wanted = bars.agg(F.sum("tick_count"), F.count("*")).first()
    if tuple(written) != tuple(wanted):
        raise RuntimeError(f"bars do not read back as written: {tuple(written)}, {tuple(wanted)}")
    return wanted[1]
