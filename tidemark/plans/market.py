"""Registered queries: sources, validation, bars, scalar math, joins, windows and outcomes."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import bars as B
from tidemark.operators import joins as J
from tidemark.operators import ordering as O
from tidemark.operators import scans as SC
from tidemark.operators import validate as V
from tidemark.operators import windows as WN
from tidemark.plans.base import BARS_SQL, BW, RETURNS_SQL, SERIES, TICKS_SQL, T0, add, bars, in_blocks, on_bars, ratio_returns, returns, ticks, with_
from tidemark.session import shared_dir, table
from tidemark.sources import store as ST
from tidemark.sources import ticks as TK

C = F.col

# Bars.
BAR = ["open", "high", "low", "close", "volume", "mean_spread", "median_spread", "min_spread", "max_spread", "first_bid", "last_bid", "first_ask", "last_ask"]
add("bars_hourly", lambda s, d: bars(s, d).select("*", T0()), with_("SELECT * FROM bars", BARS_SQL), ["series", "t", "tick_count"], BAR)


def _resampled(label="open", closed="left", min_ticks=1, frame="15m"):
    return lambda s, d: B.resample_ticks(ticks(s, d), frame, series=SERIES, label=label, closed=closed, min_ticks=min_ticks).select("*", T0())


_RS = "SELECT series, {t} AS t, arg_min(mid, row(ts, seq)) AS open, max(mid) AS high, min(mid) AS low, arg_max(mid, row(ts, seq)) AS close, count(*) AS tick_count FROM ticks GROUP BY ALL"
_Q = "(epoch_us(ts) {sub} - (epoch_us(ts) {sub}) % 900000000) // 1000000"
add("bars_15m_label_close", _resampled("close"), with_(_RS.format(t=_Q.format(sub="") + " + 900"), TICKS_SQL), ["series", "t", "tick_count"], BAR[:4])
add("bars_15m_right_closed", _resampled(closed="right"), with_(_RS.format(t=_Q.format(sub="- 1")), TICKS_SQL), ["series", "t", "tick_count"], BAR[:4])
add("bars_15m_min_ticks", _resampled(min_ticks=2), with_(_RS.format(t=_Q.format(sub="")) + " HAVING count(*) >= 2", TICKS_SQL), ["series", "t", "tick_count"], BAR[:4])


def _clock(spark, sf_dir):
    rule = B.ClockRule("anchored_dst", zone="America/New_York", shift_hours=7)
    days = table(spark, sf_dir, "lineitem").select((C("l_shipdate") + F.expr("INTERVAL 12 HOURS")).alias("local")).distinct()
    return days.select(F.unix_timestamp("local").alias("local_t"), F.unix_timestamp(B.to_utc(C("local"), rule)).alias("utc_t"), B.utc_offset_hours(C("local"), rule).alias("offset"))


add(
    "clock_anchored_dst", _clock,
    "SELECT epoch(local)::BIGINT AS local_t, epoch(timezone('America/New_York', local - INTERVAL 7 HOUR))::BIGINT AS utc_t, "
    "(epoch(local) - epoch(timezone('America/New_York', local - INTERVAL 7 HOUR))) / 3600.0 AS \"offset\" "
    "FROM (SELECT DISTINCT l_shipdate::TIMESTAMP + INTERVAL 12 HOUR AS local FROM lineitem)",
    ["local_t", "utc_t"], ['offset'],
)

_SESS = [("asia", "22:00", "07:00"), ("europe", "07:00", "13:30"), ("us", "13:00", "20:00")]


def _calendar(spark, sf_dir):
    w = BW()
    b = in_blocks(bars(spark, sf_dir), 1, 3)
    prev = F.lag("timestamp").over(w)
    first = b.select("*", B.session_gap(C("timestamp"), prev, "1h").alias("gap"), B.weekend_gap(C("timestamp"), prev, 2).alias("long_gap"))
    out = first.select("*", B.span_contains(C("long_gap"), 3, w).alias("ahead_gap"))
    return O.own_rows(out).select(
        "series", T0(), B.assign_session(C("timestamp"), _SESS).alias("session"), "gap", "long_gap", "ahead_gap",
        B.quarter_block(C("timestamp")).alias("quarter_block"), B.month_block(C("timestamp")).alias("month_block"), V.iso_weekday(C("timestamp")).alias("weekday"),
    )


add(
    "calendar_sessions_gaps", _calendar,
    with_("""SELECT series, t, CASE WHEN hour(timestamp) >= 22 OR hour(timestamp) < 7 THEN 'asia' WHEN hour(timestamp) * 60 + minute(timestamp) < 810 THEN 'europe'
      WHEN hour(timestamp) < 20 THEN 'us' ELSE 'unclassified' END AS session, coalesce(gap, true) AS gap, coalesce(long_gap, false) AS long_gap,
      coalesce(max(long_gap::INT) OVER (PARTITION BY series ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) = 1, false) AS ahead_gap,
      (year(timestamp) * 4 + quarter(timestamp) - 1)::INT AS quarter_block, (year(timestamp) * 12 + month(timestamp) - 1)::INT AS month_block, isodow(timestamp)::INT AS weekday
      FROM (SELECT *, t - lag(t) OVER w > 5400 AS gap, t - lag(t) OVER w > 7200 AS long_gap FROM bars WINDOW w AS (PARTITION BY series ORDER BY t))""", BARS_SQL),
    ["series", "t", "session", "gap", "long_gap", "ahead_gap", "quarter_block", "month_block", "weekday"],
)


# Defects are made from the clean events, alike here and in SQL.
def defects(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(C("event_type").alias("series"), C("event_id").alias("seq"), C("ts").cast("timestamp").alias("ts"), C("value").alias("v"))
    more = e.union(e.where("seq % 113 = 0").select("series", (C("seq") + 0.25).cast("double"), "ts", "v")).withColumn("seq", C("seq").cast("double"))
    m = lambda k: C("seq") % k == 0
    return more.select(
        "series", "seq", F.when(m(97), None).when(m(89), C("ts") - F.expr("INTERVAL 2 DAYS")).otherwise(C("ts")).alias("ts"),
        F.when(m(101), "").when(m(97), "not a time").otherwise("ok").alias("raw"),
        F.when(m(83), None).when(m(79), -1.0).otherwise(C("v")).alias("bid"),
        F.when(m(73), C("v") - 1).when(m(71), C("v") + 100).when(m(67), float("nan")).otherwise(C("v") + 0.02).alias("ask"),
        F.when(m(61), -5.0).otherwise(1.0).alias("volume"),
    )


def flagged(spark, sf_dir):
    d = defects(spark, sf_dir).withColumn("raw", F.when(C("raw") == "", "").when(C("ts").isNull(), "not a time").otherwise("ok"))
    return V.flag_ticks(d, V.TickRules(min_price=0.05, max_price=400.0, max_spread=50.0), series=SERIES, raw_ts="raw")


DEFECTS_SQL = """
e AS (SELECT event_type AS series, event_id::DOUBLE AS seq, ts, value AS v FROM events),
more AS (SELECT * FROM e UNION ALL SELECT series, seq + 0.25, ts, v FROM e WHERE seq % 113 = 0),
def AS (
  SELECT series, seq, CASE WHEN seq % 97 = 0 THEN NULL WHEN seq % 89 = 0 THEN ts - INTERVAL 2 DAY ELSE ts END AS ts, seq % 101 = 0 AS blank,
    CASE WHEN seq % 83 = 0 THEN NULL WHEN seq % 79 = 0 THEN -1.0 ELSE v END AS bid,
    CASE WHEN seq % 73 = 0 THEN v - 1 WHEN seq % 71 = 0 THEN v + 100 WHEN seq % 67 = 0 THEN 'nan'::DOUBLE ELSE v + 0.02::DOUBLE END AS ask,
    CASE WHEN seq % 61 = 0 THEN -5.0 ELSE 1.0 END::DOUBLE AS volume
  FROM more
),
flags AS (
  SELECT *, blank AS missing_timestamp, NOT blank AND ts IS NULL AS unparseable_timestamp, bid IS NULL OR ask IS NULL AS missing_quote,
    coalesce(isnan(ask), false) AS non_finite_price, NOT coalesce(isnan(ask), false) AND coalesce(bid <= 0 OR ask <= 0, false) AS non_positive_price,
    NOT coalesce(isnan(ask), false) AND coalesce(bid < 0.05 OR bid > 400 OR ask < 0.05 OR ask > 400, false) AS price_out_of_range,
    NOT coalesce(isnan(ask), false) AND coalesce(ask < bid, false) AS ask_below_bid, NOT coalesce(isnan(ask), false) AND coalesce(ask - bid < 0, false) AS negative_spread,
    NOT coalesce(isnan(ask), false) AND coalesce(ask - bid > 50, false) AS extreme_spread, volume < 0 AS invalid_volume,
    coalesce(ts < lag(ts) OVER (PARTITION BY series ORDER BY seq), false) AS non_monotonic,
    ts IS NOT NULL AND row_number() OVER (PARTITION BY series, ts, bid, ask, volume ORDER BY seq) > 1 AS duplicate_row,
    ts IS NOT NULL AND row_number() OVER (PARTITION BY series, ts ORDER BY seq) > 1 AS duplicate_timestamp
  FROM def
)"""
_SUMS = " UNION ALL ".join(f"SELECT '{c}' AS \"check\", count(*) FILTER (WHERE {c}) AS rows FROM flags" for c in V.CHECKS)
_ANY = " OR ".join(V.CHECKS)
add("validation_flag_counts", lambda s, d: V.flag_counts(flagged(s, d)), with_(f"{_SUMS} UNION ALL SELECT 'any', count(*) FILTER (WHERE {_ANY}) FROM flags", DEFECTS_SQL), ["check", "rows"])
_EN = [c for c in V.CHECKS if c != "duplicate_timestamp"]
_CASE = "CASE " + " ".join(f"WHEN {c} THEN '{c}'" for c in _EN) + " ELSE 'kept' END"
add("cleaning_audit", lambda s, d: V.clean(flagged(s, d), _EN)[1], with_(f"SELECT {_CASE} AS reason, count(*) AS rows FROM flags GROUP BY 1", DEFECTS_SQL), ["reason", "rows"])
add("cleaned_ticks", lambda s, d: V.clean(flagged(s, d), _EN)[0].select("series", "seq", F.unix_timestamp("ts").alias("t"), "bid", "ask"),
    with_(f"SELECT series, seq, epoch(date_trunc('second', ts))::BIGINT AS t, bid, ask FROM flags WHERE {_CASE} = 'kept'", DEFECTS_SQL), ["series", "t"], ["seq", "bid", "ask"])
add("validation_examples", lambda s, d: V.bad_examples(flagged(s, d), "seq", 3).select("check", "example", "seq"),
    with_("SELECT \"check\", row_number() OVER (PARTITION BY \"check\" ORDER BY seq)::INT AS example, seq FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"check\", seq FROM flags WHERE {c}" for c in V.CHECKS) + ") QUALIFY example <= 3", DEFECTS_SQL),
    ["check", "example"], ["seq"])


def _reconciled(spark, sf_dir):
    kept, audit = V.clean(flagged(spark, sf_dir), _EN)
    total = flagged(spark, sf_dir).agg(F.count("*").alias("source"))
    a = audit.agg(F.sum(F.when(C("reason") == "kept", C("rows"))).alias("written"), F.sum(F.when(C("reason") != "kept", C("rows"))).alias("dropped"))
    return total.crossJoin(F.broadcast(a)).select("*", (C("source") - C("written") - C("dropped")).alias("difference"))


add("reconciliation", _reconciled, with_(f"SELECT count(*) AS source, count(*) FILTER (WHERE {_CASE} = 'kept') AS written, count(*) FILTER (WHERE {_CASE} <> 'kept') AS dropped, 0::BIGINT AS difference FROM flags", DEFECTS_SQL), ["source", "written", "dropped", "difference"])
_GAPS = TICKS_SQL + ",\ngaps AS (SELECT *, (epoch_us(ts) - epoch_us(p)) / 1e6 AS seconds, hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts)) AS e FROM (SELECT *, lag(ts) OVER (PARTITION BY series ORDER BY ts, seq) AS p FROM ticks) WHERE epoch_us(ts) - epoch_us(p) > {} * 1e6)"
_KIND = """CASE WHEN isodow(p) = 5 AND isodow(ts) = 1 AND seconds < 96 * 3600 THEN 'weekend' WHEN isodow(ts) = 1 AND seconds <= 168 * 3600 AND (13 - isodow(p)) % 7 <= ts::DATE - p::DATE THEN 'holiday_weekend'
  WHEN seconds <= 86400 AND e <= 3600 {more} THEN 'daily_break' ELSE 'holiday_or_unknown' END"""
add("tick_gaps", lambda s, d: V.tick_gaps(ticks(s, d), 3600, series=SERIES).select("series", F.unix_timestamp("gap_start").alias("start_t"), "seconds", V.classify_gap(C("gap_start"), C("gap_end")).alias("kind")),
    with_(f"SELECT series, epoch(date_trunc('second', p))::BIGINT AS start_t, seconds, {_KIND.format(more='')} AS kind FROM gaps", _GAPS.format(3600)), ["series", "start_t", "kind"], ["seconds"])
add("tick_gaps_with_slack", lambda s, d: V.tick_gaps(ticks(s, d), 1800, series=SERIES).select("series", F.unix_timestamp("gap_start").alias("start_t"), V.classify_gap(C("gap_start"), C("gap_end"), V.Schedule(break_start="22:00", break_end="22:40", tick_slack_minutes=25), True).alias("kind")),
    with_("""SELECT series, epoch(date_trunc('second', p))::BIGINT AS start_t, CASE WHEN isodow(p) = 5 AND isodow(ts) = 1 AND seconds < 96 * 3600 THEN 'weekend' WHEN isodow(ts) = 1 AND seconds <= 168 * 3600 AND (13 - isodow(p)) % 7 <= ts::DATE - p::DATE THEN 'holiday_weekend'
      WHEN seconds <= 86400 AND hour(p) * 60 + minute(p) >= 1319 AND e <= 81600 OR list_bool_or([abs(epoch_us(p) - epoch_us(d) - 79200000000) <= 1500000000 AND abs(epoch_us(ts) - epoch_us(d) - 81600000000) <= 1500000000 for d in [date_trunc('day', p)::TIMESTAMP, date_trunc('day', ts)::TIMESTAMP]]) THEN 'daily_break' ELSE 'holiday_or_unknown' END AS kind FROM gaps""", _GAPS.format(1800)), ["series", "start_t", "kind"])  # fmt: skip
add("bar_gaps", lambda s, d: V.bar_gaps(bars(s, d), "1h", series=SERIES).select("series", F.unix_timestamp("gap_start").alias("start_t"), "missing"),
    with_("SELECT series, p AS start_t, (t - p) // 3600 - 1 AS missing FROM (SELECT *, lag(t) OVER (PARTITION BY series ORDER BY t) AS p FROM bars) WHERE (t - p) // 3600 > 1", BARS_SQL), ["series", "start_t", "missing"])
add("bar_coverage", lambda s, d: V.coverage(bars(s, d), "1h", series=SERIES),
    with_("SELECT series, count(*) AS bars, (max(t) - min(t)) // 3600 + 1 AS expected, count(*) / ((max(t) - min(t)) // 3600 + 1) AS ratio FROM bars GROUP BY 1", BARS_SQL), ["series", "bars", "expected"], ["ratio"])
add("bar_quality", lambda s, d: V.bar_quality(bars(s, d), series=SERIES),
    with_("""SELECT series, count(*) AS bars, avg(tick_count) AS mean_ticks, median(tick_count) AS median_ticks, min(tick_count) AS min_ticks, max(tick_count) AS max_ticks,
      floor(quantile_cont(tick_count, 0.05))::BIGINT AS low_ticks, count(*) FILTER (WHERE high = low) AS zero_range FROM bars GROUP BY 1""", BARS_SQL),
    ["series", "bars", "min_ticks", "max_ticks", "low_ticks", "zero_range"], ["mean_ticks", "median_ticks"])
add("tick_core_stats", lambda s, d: V.core_stats(ticks(s, d)).select("rows", F.unix_timestamp("first").alias("first_t"), F.unix_timestamp("last").alias("last_t"), "days", "months", "shared_times", "shared_rows"),
    with_("""SELECT count(*) AS rows, epoch(date_trunc('second', min(ts)))::BIGINT AS first_t, epoch(date_trunc('second', max(ts)))::BIGINT AS last_t, count(DISTINCT ts::DATE) AS days,
      count(DISTINCT date_trunc('month', ts)) AS months, (SELECT count(*) FROM (SELECT ts FROM ticks GROUP BY ts HAVING count(*) > 1)) AS shared_times,
      (SELECT coalesce(sum(c), 0)::BIGINT FROM (SELECT count(*) AS c FROM ticks GROUP BY ts HAVING count(*) > 1)) AS shared_rows FROM ticks""", TICKS_SQL),
    ["rows", "first_t", "last_t", "days", "months", "shared_times", "shared_rows"])
add("tick_spread_stats", lambda s, d: V.spread_stats(ticks(s, d), C("spread")),
    with_("SELECT avg(spread) AS mean, min(spread) AS min, max(spread) AS max, quantile_cont(spread, 0.5) AS p50, quantile_cont(spread, 0.9) AS p90, quantile_cont(spread, 0.99) AS p99 FROM ticks", TICKS_SQL), [], ["mean", "min", "max", "p50", "p90", "p99"])
add("null_counts", lambda s, d: V.null_counts(defects(s, d).select("series", "ts", "bid", "ask", "volume")),
    with_(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS nulls FROM def" for c in ("series", "ts", "bid", "ask", "volume")), DEFECTS_SQL), ["column", "nulls"])

# Sources and stores.
_A, _Z = dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 12, 6)


def _store(spark, sf_dir):
    t = ticks(spark, sf_dir).withColumn("timestamp", C("ts")).withColumn("year", F.year("ts")).withColumn("month", F.month("ts"))
    return ST.DataStore(spark, {"ticks_view": t, "bars_1h": bars(spark, sf_dir)}, max_rows=1_000_000_000)


add("range_load", lambda s, d: _store(s, d).load("ticks_view", _A, _Z, ["series", "seq", "timestamp", "mid"], order=["timestamp", "seq"]).select("series", "seq", "mid"),
    with_("SELECT series, seq, mid FROM ticks WHERE ts >= '2024-01-05' AND ts < '2024-01-12 06:00'", TICKS_SQL), ["series", "seq"], ["mid"])
add("tick_span", lambda s, d: _store(s, d).span("ticks_view").select(F.unix_timestamp("first").alias("first_t"), F.unix_timestamp("last").alias("last_t")),
    with_("SELECT epoch(date_trunc('second', min(ts)))::BIGINT AS first_t, epoch(date_trunc('second', max(ts)))::BIGINT AS last_t FROM ticks", TICKS_SQL), ["first_t", "last_t"])
_CUBE = "SELECT series, hour(timestamp) AS hour, GROUPING(series) AS gs, count(*) AS n, avg(close) AS mean_close FROM {} WHERE tick_count >= {} GROUP BY GROUPING SETS ((series, hour(timestamp)), (series), ())"
add("sql_grouping_sets", lambda s, d: _store(s, d).sql(_CUBE.format("bars_1h", ":least"), least=2).withColumns({"hour": C("hour").cast("long"), "gs": C("gs").cast("long")}),
    with_(_CUBE.format("bars", 2).replace("hour(timestamp) AS hour", "hour(timestamp)::BIGINT AS hour"), BARS_SQL), ["series", "hour", "gs", "n"], ["mean_close"])
_SETS = "SELECT DISTINCT series, hour(timestamp) AS h FROM {b} WHERE tick_count > 2 INTERSECT SELECT series, hour(timestamp) FROM {b} WHERE close > 100 EXCEPT SELECT series, hour(timestamp) FROM {b} WHERE close < 1"
add("sql_set_operations", lambda s, d: _store(s, d).sql(_SETS.format(b="bars_1h")).withColumn("h", C("h").cast("long")), with_("SELECT series, h::BIGINT AS h FROM (" + _SETS.format(b="bars") + ")", BARS_SQL), ["series", "h"])


def _upsert(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    old = e.where("event_id % 2 = 0").select(C("event_id").alias("id"), C("value").alias("v"), F.lit("old").alias("from"))
    new = e.where("event_id % 3 = 0").select(C("event_id").alias("id"), (C("value") * 2).alias("v"), F.lit("new").alias("from"))
    return ST.upsert(old, new, ["id"])


add("ledger_upsert", _upsert,
    "SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN value * 2 ELSE value END AS v, CASE WHEN event_id % 3 = 0 THEN 'new' ELSE 'old' END AS \"from\" FROM events WHERE event_id % 2 = 0 OR event_id % 3 = 0",
    ["id", "from"], ["v"])


def _stacked(spark, sf_dir):
    b = bars(spark, sf_dir).select("series", T0(), "close")
    return ST.stack_tables([b.where("series = 'click'"), b.where("series <> 'click'").select("series", "t", (C("close") > 100).alias("big"))])


add("stack_tables", _stacked, with_("SELECT series, t, CASE WHEN series = 'click' THEN close END AS close, CASE WHEN series <> 'click' THEN close > 100 END AS big FROM bars", BARS_SQL), ["series", "t", "big"], ["close"])
add("source_index", lambda s, d: TK.source_index(ticks(s, d).select(F.date_format("ts", "yyyy-MM-dd").alias("k"), F.col("seq").cast("string").alias("value")), C("k")).select("key", "lines"),
    with_("SELECT strftime(ts, '%Y-%m-%d') AS key, count(*) AS lines FROM ticks GROUP BY 1", TICKS_SQL), ["key", "lines"])
add("ordering_report", lambda s, d: TK.ordering_report(defects(s, d).where("ts IS NOT NULL"), "ts", "seq", SERIES).select("series", "seq"),
    with_("SELECT series, seq FROM (SELECT *, max(ts) OVER (PARTITION BY series ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hi FROM def WHERE ts IS NOT NULL) WHERE ts < hi", DEFECTS_SQL), ["series"], ["seq"])
add("partition_digest", lambda s, d: TK.table_digest(ticks(s, d), "seq", ["ts", "mid"], SERIES), None, ["series", "rows", "digest"])


def _tick_set(spark, sf_dir):
    """All events as raw tick files, brought into a committed set and verified from its files."""
    from tidemark.operators.validate import TickRules
    from tidemark.sources.commits import PLACING, TickSet

    root = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    raw = ticks(spark, sf_dir).where("ts IS NOT NULL").select(F.concat_ws(",", F.date_format("ts", "yyyyMMdd HH:mm:ss.SSS"), C("bid").cast("string"), C("ask").cast("string"), F.lit("1")).alias("value"))
    raw.write.text(f"{root}/raw")
    ticks_set = TickSet(spark, f"{root}/set")
    ticks_set.update(f"{root}/raw", TK.TickFormat(), ["DateTime", "Bid", "Ask", "Volume"], TickRules(min_price=-1e9), PLACING)
    found = ticks_set.verify()
    rows = [(m, f["rows"], f["stray"], f["disorder"], f["overlap"], found.passed) for m, f in sorted(found.months.items())]  # a row a month
    return spark.createDataFrame(rows, "month string, rows long, stray long, disorder long, overlap long, passed boolean")


add("tick_set_months", _tick_set,
    with_("SELECT strftime(ts, '%Y-%m') AS month, count(*) AS rows, 0::BIGINT AS stray, 0::BIGINT AS disorder, 0::BIGINT AS overlap, true AS passed FROM ticks WHERE ts IS NOT NULL GROUP BY 1", TICKS_SQL),
    ["month", "rows", "stray", "disorder", "overlap", "passed"])
add("table_profile", lambda s, d: ST.profile(ticks(s, d).select("series", "seq", "mid")).select("column", "type", "rows", "nulls"),
    with_("SELECT * FROM (VALUES ('series', 'string'), ('seq', 'bigint'), ('mid', 'double')) v(\"column\", type), (SELECT count(*) AS rows, 0::BIGINT AS nulls FROM ticks)", TICKS_SQL), ["column", "type", "rows", "nulls"])

# Scalar math.
_L = lambda h: F.lag("close", h).over(BW())
add("returns_multi", on_bars(lambda: {"simple_1": S.simple_return(C("close"), _L(1)), "log_1": S.log_return(C("close"), _L(1)), "log_5": S.log_return(C("close"), _L(5)), "fwd_3": WN.forward_return(C("close"), BW(), 3), "fwd_simple_2": WN.forward_return(C("close"), BW(), 2, "simple")}, 5, 3),
    with_("""SELECT series, t, close / lag(close) OVER w - 1 AS simple_1, ln(close / lag(close) OVER w) AS log_1, ln(close / lag(close, 5) OVER w) AS log_5, ln(lead(close, 3) OVER w / close) AS fwd_3,
      lead(close, 2) OVER w / close - 1 AS fwd_simple_2 FROM bars WINDOW w AS (PARTITION BY series ORDER BY t)""", BARS_SQL), ["series", "t"], ["simple_1", "log_1", "log_5", "fwd_3", "fwd_simple_2"])  # fmt: skip


def _cumulative(spark, sf_dir):
    r = returns(spark, sf_dir).select("series", "timestamp", F.coalesce("r", F.lit(0.0)).alias("r"))
    sums = {"up": ("sum", C("r")), "up_simple": ("sum", F.log1p(F.expm1("r") / 10))}
    out = SC.running(r, SERIES, ["timestamp"], F.to_date("timestamp"), sums, 512)
    return out.select("series", T0(), (F.exp("up") - 1).alias("cum_log"), (F.exp("up_simple") - 1).alias("cum_simple"))


add("returns_cumulative", _cumulative,
    with_("SELECT series, t, exp(sum(coalesce(r, 0)) OVER w) - 1 AS cum_log, exp(sum(ln(1 + coalesce((exp(r) - 1) / 10, 0))) OVER w) - 1 AS cum_simple FROM returns WINDOW w AS (PARTITION BY series ORDER BY t)", RETURNS_SQL), ["series", "t"], ["cum_log", "cum_simple"])


def _prepared(spark, sf_dir):
    b = in_blocks(bars(spark, sf_dir), 1)
    gap = B.session_gap(C("timestamp"), F.lag("timestamp").over(BW()), "1h")
    r = O.own_rows(b.select("*", gap.alias("gap"), S.log_return(C("close"), F.lag("close").over(BW())).alias("raw")))
    kept = F.when(~C("gap"), C("raw"))
    return r.select("series", T0(), kept.alias("r"), F.abs(kept).alias("r_abs"), (kept * kept).alias("r_sq"))


add("returns_prepared", _prepared, with_("""SELECT series, t, r, abs(r) AS r_abs, r * r AS r_sq FROM (SELECT series, t, CASE WHEN t - lag(t) OVER w <= 5400 THEN r END AS r FROM returns WINDOW w AS (PARTITION BY series ORDER BY t))""", RETURNS_SQL), ["series", "t"], ["r", "r_abs", "r_sq"])


def _ou_math(spark, sf_dir):
    x = table(spark, sf_dir, "events").select("event_id", (C("value") / 400 - 0.1).alias("b"), (C("value") / 100).alias("x"))
    th = S.theta_from_b(C("b"), 0.5)
    sd = F.lit(0.3)
    return x.select("event_id", th.alias("theta"), S.half_life_bars(C("b")).alias("half_life"), S.stationary_std(sd, th).alias("stat_std"), S.expected_value(C("x"), F.lit(1.0), th, 3).alias("expected"),
                    S.decay_ratio(th, 3).alias("decay"), S.innovation_variance(th, sd, 0.5).alias("innov"), S.wrap_phase(C("x") * 7).alias("phase"), S.signed_log(C("x") - 2).alias("slog"),
                    S.effect_size(C("b") / 3).alias("effect"), S.half_open_bin(C("x"), [0.0, 0.5, 1.0, 2.0, 4.0]).alias("bin"))


add("scalar_ou_math", _ou_math, """SELECT event_id, theta, half_life, 0.3 / sqrt(2 * theta) AS stat_std, 1 + (x - 1) * exp(-theta * 3) AS expected, exp(-theta * 3) AS decay, 0.09 * (1 - exp(-2 * theta * 0.5)) / (2 * theta) AS innov,
  x * 7 + pi() - floor((x * 7 + pi()) / (2 * pi())) * 2 * pi() - pi() AS phase, sign(x - 2) * ln(1 + abs(x - 2)) AS slog,
  CASE WHEN abs(b / 3) < 0.01 THEN 'negligible' WHEN abs(b / 3) < 0.05 THEN 'very small' WHEN abs(b / 3) < 0.1 THEN 'small' WHEN abs(b / 3) < 0.2 THEN 'moderate' ELSE 'large' END AS effect,
  CASE WHEN x >= 0 AND x < 0.5 THEN 0 WHEN x >= 0.5 AND x < 1 THEN 1 WHEN x >= 1 AND x < 2 THEN 2 WHEN x >= 2 AND x < 4 THEN 3 END::INT AS bin
  FROM (SELECT event_id, b, x, CASE WHEN b > 0 AND b < 1 THEN -ln(b) / 0.5 END AS theta, CASE WHEN b > 0 AND b < 1 THEN -ln(2) / ln(b) END AS half_life FROM (SELECT event_id, value / 400 - 0.1 AS b, value / 100 AS x FROM events))""",
    ["event_id", "effect", "bin"], ["theta", "half_life", "stat_std", "expected", "decay", "innov", "phase", "slog"])
add("time_features", lambda s, d: bars(s, d).select("series", T0(), *[c.alias(k) for k, c in S.time_features(C("timestamp")).items()]),
    with_("""SELECT series, t, sin(hour(timestamp) * 2 * pi() / 24) AS hour_sin, cos(hour(timestamp) * 2 * pi() / 24) AS hour_cos, sin((isodow(timestamp) - 1) * 2 * pi() / 7) AS weekday_sin,
      cos((isodow(timestamp) - 1) * 2 * pi() / 7) AS weekday_cos FROM bars""", BARS_SQL), ["series", "t"], ["hour_sin", "hour_cos", "weekday_sin", "weekday_cos"])  # fmt: skip

# Windows.
_ROLL = lambda: {
    "mean_20": WN.rolling_mean(C("r"), BW(), 20), "mean_excl": WN.rolling_mean(C("r"), BW(), 20, 10, False), "var_20": WN.rolling_variance(C("r"), BW(), 20, 15), "std_pop": WN.rolling_std(C("r"), BW(), 20, ddof=0),
    "rv_12": WN.realized_volatility(C("r"), BW(), 12), "z_24": WN.rolling_zscore(C("r"), BW(), 24), "max_8": WN.rolling_extreme(C("high"), BW(), 8), "min_8": WN.rolling_extreme(C("low"), BW(), 8, "min"),
    "sum_6": WN.trailing_sum(C("r"), BW(), 6), "ac_1": WN.rolling_autocorrelation(C("r"), BW(), 30, 1), "corr_24": WN.rolling_corr(C("r"), C("tick_count").cast("double"), BW(), 24), "cz_24": WN.causal_zscore(C("r"), BW(), 24, 2.0),
}


def _f(n, cur=0):
    return f"OVER (PARTITION BY series ORDER BY t ROWS BETWEEN {n - 1 + cur} PRECEDING AND {'CURRENT ROW' if not cur else '1 PRECEDING'})"


add("rolling_statistics", on_bars(_ROLL, 40, source=returns), with_(f"""SELECT series, t,
  CASE WHEN count(r) {_f(20)} >= 20 THEN avg(r) {_f(20)} END AS mean_20, CASE WHEN count(r) {_f(20, 1)} >= 10 THEN avg(r) {_f(20, 1)} END AS mean_excl,
  CASE WHEN count(r) {_f(20)} >= 15 THEN var_samp(r) {_f(20)} END AS var_20, CASE WHEN count(r) {_f(20)} >= 20 THEN stddev_pop(r) {_f(20)} END AS std_pop,
  CASE WHEN count(r) {_f(12)} >= 12 THEN sqrt(sum(r * r) {_f(12)}) END AS rv_12, CASE WHEN count(r) {_f(24)} >= 24 THEN (r - avg(r) {_f(24)}) / stddev_samp(r) {_f(24)} END AS z_24,
  CASE WHEN count(high) {_f(8)} >= 8 THEN max(high) {_f(8)} END AS max_8, CASE WHEN count(low) {_f(8)} >= 8 THEN min(low) {_f(8)} END AS min_8,
  CASE WHEN count(r) {_f(6)} >= 6 THEN sum(r) {_f(6)} END AS sum_6, CASE WHEN count(CASE WHEN r IS NOT NULL THEN r1 END) {_f(29)} >= 29 THEN corr(r, r1) {_f(29)} END AS ac_1,
  CASE WHEN count(r) {_f(24)} >= 24 THEN corr(r, tick_count) {_f(24)} END AS corr_24,
  CASE WHEN count(r) {_f(24)} >= 22 AND r IS NOT NULL THEN greatest(-2, least(2, (r - avg(r) {_f(24)}) / stddev_samp(r) {_f(24)})) END AS cz_24
  FROM (SELECT *, lag(r) OVER (PARTITION BY series ORDER BY t) AS r1 FROM returns)""", RETURNS_SQL), ["series", "t"], ["mean_20", "mean_excl", "var_20", "std_pop", "rv_12", "z_24", "max_8", "min_8", "sum_6", "ac_1", "corr_24", "cz_24"])  # fmt: skip
_MOM = lambda: {"skew_30": WN.rolling_skewness(C("r"), BW(), 30), "kurt_30": WN.rolling_kurtosis(C("r"), BW(), 30)}
add("rolling_shape", on_bars(_MOM, 40, source=returns), with_(f"SELECT series, t, CASE WHEN count(r) {_f(30)} >= 30 THEN skewness(r) {_f(30)} END AS skew_30, CASE WHEN count(r) {_f(30)} >= 30 THEN kurtosis(r) {_f(30)} END AS kurt_30 FROM returns", RETURNS_SQL), ["series", "t"], ["skew_30", "kurt_30"])
_PCT = lambda: {"pct_16": WN.rolling_percentile(C("close"), BW(), 16)}
add("rolling_percentile", on_bars(_PCT, 20), with_(f"""SELECT a.series, a.t, CASE WHEN a.i >= 15 THEN (count(*) FILTER (WHERE b.close < a.close) + 0.5 * count(*) FILTER (WHERE b.close = a.close)) / count(*) END AS pct_16
  FROM returns a JOIN returns b ON a.series = b.series AND b.i BETWEEN a.i - 15 AND a.i GROUP BY a.series, a.t, a.i, a.close""", RETURNS_SQL), ["series", "t"], ["pct_16"])  # fmt: skip


def _ols(spark, sf_dir):
    b = in_blocks(bars(spark, sf_dir), 70).withColumn("y", F.ln("close"))
    fit = WN.rolling_ols(C("y"), BW(), 32, C(O.INDEX).cast("double"))
    o = b.select("*", *[c.alias(k) for k, c in fit.items()])
    o = o.withColumn("z", WN.rolling_zscore(C("residual"), BW(), 20, 15))
    return O.own_rows(o).select("*", T0())


OLS_SQL = RETURNS_SQL + """,
ols AS (
  SELECT *, y - fitted AS residual, sqrt(greatest(0, syy - sxy * sxy / sxx) / 30) AS residual_std, 1 - greatest(0, syy - sxy * sxy / sxx) / syy AS r_squared FROM (
    SELECT *, m + slope * 15.5 AS fitted, m - slope * 15.5 AS intercept FROM (
      SELECT series, t, i, r, close, ln(close) AS y, CASE WHEN i >= 31 THEN regr_slope(ln(close), i) OVER w END AS slope, CASE WHEN i >= 31 THEN avg(ln(close)) OVER w END AS m,
        regr_syy(ln(close), i) OVER w AS syy, regr_sxy(ln(close), i) OVER w AS sxy, regr_sxx(ln(close), i) OVER w AS sxx
      FROM returns WINDOW w AS (PARTITION BY series ORDER BY t ROWS BETWEEN 31 PRECEDING AND CURRENT ROW)))
)"""
_OLSC = ["slope", "intercept", "fitted", "residual", "residual_std", "r_squared"]
add("rolling_ols", _ols, with_("SELECT *, CASE WHEN count(residual) OVER w >= 15 THEN (residual - avg(residual) OVER w) / stddev_samp(residual) OVER w END AS z FROM (SELECT series, t, slope, intercept, fitted, residual, CASE WHEN i >= 31 THEN residual_std END AS residual_std, CASE WHEN i >= 31 THEN r_squared END AS r_squared FROM ols) WINDOW w AS (PARTITION BY series ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)", OLS_SQL), ["series", "t"], [*_OLSC, "z"])


def ou_frame(spark, sf_dir):
    b = in_blocks(bars(spark, sf_dir), 64).withColumn("x", F.ln("close"))
    fit = WN.rolling_ar1(C("x"), BW(), 32)
    o = b.select("*", *[c.alias(k) for k, c in fit.items()])
    named = {k: C(k) for k in fit}
    o = o.select("*", *[c.alias(k) for k, c in WN.ou_columns(C("x"), named).items()])
    prev = lambda c: F.lag(c).over(BW())
    return O.own_rows(o.withColumn("surprise", C("x") - (prev("ar_a") + prev("ar_b") * prev("x")))).select("*", T0())


AR_SQL = RETURNS_SQL + """,
pairs AS (SELECT series, t, i, ln(close) AS x, lag(ln(close)) OVER (PARTITION BY series ORDER BY t) AS l FROM returns),
ar AS (
  SELECT *, CASE WHEN i >= 31 THEN greatest(0, syy - sxy * sxy / sxx) / 29 END AS ar_innovation FROM (
    SELECT *, CASE WHEN i >= 31 THEN regr_slope(x, l) OVER w END AS ar_b, CASE WHEN i >= 31 THEN regr_intercept(x, l) OVER w END AS ar_a,
      regr_syy(x, l) OVER w AS syy, regr_sxy(x, l) OVER w AS sxy, regr_sxx(x, l) OVER w AS sxx
    FROM pairs WINDOW w AS (PARTITION BY series ORDER BY t ROWS BETWEEN 30 PRECEDING AND CURRENT ROW))
),
ou AS (
  SELECT *, CASE WHEN i < 31 THEN 'insufficient_data' WHEN ar_b <= 0 THEN 'non_positive' WHEN ar_b > 1 + 1e-9 THEN 'explosive' WHEN abs(ar_b - 1) <= 1e-9 THEN 'unit_root'
    WHEN -ln(2) / ln(ar_b) > 10000 THEN 'near_unit_root' ELSE 'valid' END AS ou_state FROM ar
)"""
add("rolling_ar1_ou", ou_frame, with_("""SELECT series, t, ou_state, ar_a, ar_b, ar_innovation, th AS ou_theta, mu AS ou_mu, sg AS ou_sigma, (x - mu) / (sg / sqrt(2 * th)) AS ou_z,
  x - (lag(ar_a) OVER w + lag(ar_b) OVER w * lag(x) OVER w) AS surprise FROM (SELECT *, sqrt(ar_innovation * 2 * th / (1 - ar_b * ar_b)) AS sg FROM (SELECT *, CASE WHEN ou_state = 'valid' THEN -ln(ar_b) END AS th,
  CASE WHEN ou_state = 'valid' THEN ar_a / (1 - ar_b) END AS mu FROM ou)) WINDOW w AS (PARTITION BY series ORDER BY t)""", AR_SQL),
    ["series", "t", "ou_state"], ["ar_a", "ar_b", "ar_innovation", "ou_theta", "ou_mu", "ou_sigma", "ou_z", "surprise"])

# Features and outcomes.
_FEAT = lambda: {
    **WN.return_features(C("close"), C("high"), C("low"), C("r"), BW(), (1, 5), (20,)), **WN.volatility_features(C("open"), C("high"), C("low"), C("close"), C("r"), BW(), 12, 24),
    "acf_abs_1": WN.autocorrelation_features(C("r"), BW(), 24, (1,))["acf_abs_1"], **{k: v for k, v in WN.microstructure_features(C("mean_spread"), C("close"), C("tick_count"), BW(), 24).items()},
}
add("feature_families", on_bars(_FEAT, 60, source=ratio_returns), with_(f"""SELECT series, t, ln(close / lag(close) OVER w) AS ret_1, ln(close / lag(close, 5) OVER w) AS ret_5, CASE WHEN count(r) {_f(20)} = 20 THEN r / stddev_samp(r) {_f(20)} END AS ret_z_20,
  CASE WHEN i >= 19 THEN (close - min(low) {_f(20)}) / (max(high) {_f(20)} - min(low) {_f(20)}) END AS range_pos_20, CASE WHEN count(r) {_f(12)} = 12 THEN ln(sqrt(sum(r * r) {_f(12)} / 12)) END AS log_rv_12,
  CASE WHEN count(r) {_f(24)} = 24 THEN sqrt(sum(r * r) {_f(12)} / 12) / sqrt(sum(r * r) {_f(24)} / 24) END AS rv_ratio, CASE WHEN i >= 11 THEN sqrt(sum(ln(high / low) ** 2 / (4 * ln(2))) {_f(12)} / 12) END AS parkinson_12,
  CASE WHEN count(r1) {_f(24)} >= 24 THEN corr(abs(r), abs(r1)) {_f(24)} END AS acf_abs_1, mean_spread / close AS spread_rel, CASE WHEN i >= 23 THEN tick_count / avg(tick_count) {_f(24)} END AS activity, mean_spread - lag(mean_spread) OVER w AS spread_change
  FROM (SELECT *, lag(r) OVER (PARTITION BY series ORDER BY t) AS r1 FROM returns) WINDOW w AS (PARTITION BY series ORDER BY t)""", RETURNS_SQL),
    ["series", "t"], ["ret_1", "ret_5", "ret_z_20", "range_pos_20", "log_rv_12", "rv_ratio", "parkinson_12", "acf_abs_1", "spread_rel", "activity", "spread_change"])
_TGT = lambda: WN.build_targets(BW(), C("close"), C("high"), C("low"), C("r"), (1, 5))


def _a(h):
    return f"OVER (PARTITION BY series ORDER BY t ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"


add("outcome_targets", on_bars(lambda: {k: v.cast("double") for k, v in _TGT().items()}, 1, 6, source=ratio_returns), with_("SELECT series, t, " + ", ".join(f"""(ln(lead(close, {h}) OVER w / close))::FLOAT AS target_return_{h}, abs(ln(lead(close, {h}) OVER w / close))::FLOAT AS target_abs_return_{h},
  (CASE WHEN count(r) {_a(h)} = {h} THEN sqrt(sum(r * r) {_a(h)}) END)::FLOAT AS target_volatility_{h}, (CASE WHEN count(high) {_a(h)} = {h} THEN ln(max(high) {_a(h)} / close) END)::FLOAT AS target_max_up_{h},
  (CASE WHEN count(low) {_a(h)} = {h} THEN ln(min(low) {_a(h)} / close) END)::FLOAT AS target_max_down_{h}""" for h in (1, 5)) + " FROM returns WINDOW w AS (PARTITION BY series ORDER BY t)", RETURNS_SQL), ["series", "t"], [f"target_{f}_{h}" for h in (1, 5) for f in ("return", "abs_return", "volatility", "max_up", "max_down")])  # fmt: skip


def _residual_outcomes(spark, sf_dir):
    o = in_blocks(_ols(spark, sf_dir).select("series", "timestamp", C("residual").alias("eps"), C("residual_std").alias("sd")).where("eps IS NOT NULL"), 1, 8)
    e, s, w = C("eps"), C("sd"), BW()
    cols = {
        "change_3": WN.residual_change(e, s, w, 3), "reduction_3": WN.residual_reduction(e, s, w, 3), "shrinks_3": WN.residual_shrinks(e, w, 3), "ou_reduction_3": WN.ou_deviation_reduction(e, F.lit(0.01), s, w, 3),
        "cross_6": WN.zero_crossing(e, w, 6).cast("double"), "worse_6": WN.gets_worse(e, w, 6).cast("double"), "adverse_6": WN.adverse_excursion(e, w, 6), "back_6": WN.reversion_time(e, F.lit(0.0), 0.5, w, 6).cast("double"),
    }
    return O.own_rows(o.select("*", *[c.alias(k) for k, c in cols.items()], WN.has_future(w, 6).alias("whole"))).where("whole").select("*", T0())


_RES = ["change_3", "reduction_3", "shrinks_3", "ou_reduction_3", "cross_6", "worse_6", "adverse_6", "back_6"]
_lead = lambda c: ", ".join(f"lead({c}, {k}) OVER w AS l{k}" for k in range(1, 7))
_first = lambda cond: "coalesce(list_min(list_filter([" + ", ".join(f"CASE WHEN {cond.format(v=f'l{k}')} THEN {k} END" for k in range(1, 7)) + "], lambda x: x IS NOT NULL)), 0)"
add("residual_outcomes", _residual_outcomes, with_(f"""SELECT series, t, (l3 - eps) / sd AS change_3, (abs(eps) - abs(l3)) / sd AS reduction_3, (abs(l3) < abs(eps))::INT AS shrinks_3, (abs(eps - 0.01) - abs(l3 - 0.01)) / sd AS ou_reduction_3,
  {_first("sign({v}) <> sign(eps)")} AS cross_6, (greatest(abs(l1), abs(l2), abs(l3), abs(l4), abs(l5), abs(l6)) > abs(eps))::INT AS worse_6,
  greatest(0, CASE WHEN eps >= 0 THEN greatest(l1, l2, l3, l4, l5, l6) - eps ELSE eps - least(l1, l2, l3, l4, l5, l6) END) AS adverse_6, {_first("abs({v}) <= 0.5 * abs(eps)")} AS back_6
  FROM (SELECT *, {_lead('eps')} FROM (SELECT series, t, residual AS eps, residual_std AS sd FROM ols WHERE residual IS NOT NULL) WINDOW w AS (PARTITION BY series ORDER BY t)) WHERE l6 IS NOT NULL""", OLS_SQL), ["series", "t"], _RES)  # fmt: skip

# Joins.


def _aligned(spark, sf_dir):
    b = bars(spark, sf_dir)
    f = b.where("tick_count >= 3").select("series", "timestamp", (C("high") - C("low")).alias("span"))
    return J.align_to_bars(f, b, ["series", "timestamp"], "spans").select("*", T0())


add("join_align_to_bars", _aligned, with_("SELECT series, t, CASE WHEN tick_count >= 3 THEN high - low END AS span FROM bars", BARS_SQL), ["series", "t"], ["span"])


def _outer(spark, sf_dir):
    b = bars(spark, sf_dir).select("series", T0(), "close", "tick_count")
    a = b.where("tick_count % 2 = 0").select("series", "t", C("close").alias("p_a"))
    c = b.where("tick_count > 2").select("series", "t", (C("close") * 2).alias("p_b"))
    return J.outer_on_time([a, c], ["series", "t"])


add("join_full_outer", _outer, with_("SELECT series, t, CASE WHEN tick_count % 2 = 0 THEN close END AS p_a, CASE WHEN tick_count > 2 THEN close * 2 END AS p_b FROM bars WHERE tick_count % 2 = 0 OR tick_count > 2", BARS_SQL), ["series", "t"], ["p_a", "p_b"])
add("join_unmatched", lambda s, d: J.unmatched(bars(s, d).where("tick_count >= 2").select("series", T0()), bars(s, d).where("tick_count <= 3").select("series", T0()), ["series", "t"]),
    with_("SELECT series, t, CASE WHEN tick_count > 3 THEN 'left' ELSE 'right' END AS only_in FROM bars WHERE tick_count > 3 OR tick_count < 2", BARS_SQL), ["series", "t", "only_in"])


def _asof(spark, sf_dir):
    t = ticks(spark, sf_dir)
    left = t.where("series = 'purchase'").select("seq", "ts", "user_id", "mid")
    right = t.where("series = 'click'").select("ts", "user_id", C("seq").alias("cseq"), C("mid").alias("cmid"))
    return J.asof(left, right, "ts", ["user_id"], ["cseq", "cmid"], 86_400 * 3)


add("join_asof", _asof, with_("SELECT l.seq, r.cseq AS asof_cseq, r.cmid AS asof_cmid FROM (SELECT * FROM ticks WHERE series = 'purchase') l ASOF LEFT JOIN (SELECT ts, user_id, seq AS cseq, mid AS cmid FROM ticks WHERE series = 'click') r ON l.user_id = r.user_id AND l.ts >= r.ts", TICKS_SQL), ["seq", "asof_cseq"], ["asof_cmid"])


def _first_after(spark, sf_dir):
    t = ticks(spark, sf_dir)
    e = t.select("series", C("seq").alias("order_id"), C("ts").alias("arrival"), (C("ts") + F.expr("INTERVAL 45 MINUTES")).alias("expiry"))
    return J.first_after(e, t.select("series", "ts", "bid", "ask"), "arrival", "expiry", "ts", SERIES, 3600).select("series", "order_id", F.unix_timestamp("fill_ts").alias("fill_t"), "fill_bid", "fill_ask")


add("join_first_quote_after", _first_after, with_("""SELECT e.series, e.seq AS order_id, epoch(date_trunc('second', min(q.ts)))::BIGINT AS fill_t, arg_min(q.bid, row(q.ts, q.bid)) AS fill_bid, arg_min(q.ask, row(q.ts, q.bid)) AS fill_ask
  FROM ticks e LEFT JOIN ticks q ON q.series = e.series AND q.ts > e.ts AND q.ts < e.ts + INTERVAL 45 MINUTE GROUP BY 1, 2""", TICKS_SQL), ["series", "order_id", "fill_t"], ["fill_bid", "fill_ask"])  # fmt: skip
add("join_purge", lambda s, d: J.purge(ticks(s, d).select("seq", (C("ts") + F.expr("INTERVAL 6 HOURS")).alias("label_end"), (C("ts") + F.expr("INTERVAL 1 HOURS") * (C("seq") % 9)).alias("published")), "label_end", "published", F.lit(dt.datetime(2024, 1, 10))).select("seq"),
    with_("SELECT seq FROM ticks WHERE ts + INTERVAL 6 HOUR < '2024-01-10' AND ts + INTERVAL 1 HOUR * (seq % 9) < '2024-01-10'", TICKS_SQL), ["seq"])


def _intervals(spark, sf_dir):
    t = ticks(spark, sf_dir).select("seq", F.unix_timestamp("ts").alias("s"), (F.unix_timestamp("ts") + 3600).alias("e"))
    folds = spark.createDataFrame([(1704500000, 1704600000), (1705500000, 1705700000)], "s long, e long")
    return J.purge_intervals(t, folds, "s", "e")


add("join_purge_intervals", _intervals, with_("SELECT seq FROM (SELECT seq, epoch(date_trunc('second', ts))::BIGINT AS s FROM ticks) WHERE NOT (s <= 1704600000 AND s + 3600 >= 1704500000) AND NOT (s <= 1705700000 AND s + 3600 >= 1705500000)", TICKS_SQL), ["seq"])


def _pair(spark, sf_dir):
    b = bars(spark, sf_dir).select("series", T0(), F.lit("ret").alias("target"), F.lit(5).alias("horizon"), "close", "tick_count")
    return J.load_pair({"a": b.where("tick_count > 1").withColumn("p", C("close") / 500), "b": b.withColumn("p", C("tick_count") / 50.0)}, ["series", "t"], ["target", "horizon"])


add("join_load_pair", _pair, with_("SELECT series, t, 'ret' AS target, 5::INT AS horizon, close / 500 AS p_a, tick_count / 50.0 AS p_b FROM bars WHERE tick_count > 1", BARS_SQL), ["series", "t", "target", "horizon"], ["p_a", "p_b"])


def _segments(spark, sf_dir):
    b = bars(spark, sf_dir)
    return J.segment_table(b.where("tick_count > 2"), "series", b.groupBy("series").agg(F.count("*").alias("total")), [F.avg("close").alias("mean_close")])


add("join_segment_totals", _segments, with_("SELECT series, count(*) AS total, count(*) FILTER (WHERE tick_count > 2) AS rows, avg(close) FILTER (WHERE tick_count > 2) AS mean_close, count(*) FILTER (WHERE tick_count > 2) / count(*) AS covered FROM bars GROUP BY 1", BARS_SQL), ["series", "total", "rows"], ["mean_close", "covered"])
add("join_compare_labels", lambda s, d: J.compare_labels(bars(s, d).select("series", T0(), (C("tick_count") % 3).alias("k")), bars(s, d).where("close > 50").select("series", T0(), (C("close") > 100).cast("int").alias("k")), ["series", "t"], "k"),
    with_("SELECT series, t, tick_count % 3 AS label_a, (close > 100)::INT AS label_b FROM bars WHERE close > 50", BARS_SQL), ["series", "t", "label_a", "label_b"])


def _event_order(spark, sf_dir):
    t = ticks(spark, sf_dir)
    q = t.select("series", "ts", F.lit(1).alias("kind"), "seq", "bid")
    c = t.select("series", "ts", F.lit(0).alias("kind"), "seq", C("mid").alias("signal"))
    e = J.event_order([q, c], "ts", "kind", "seq")
    totals = {"n": ("count", F.lit(1)), "standing": ("last", C("signal"))}
    return SC.running(e, SERIES, ["event_key"], F.date_trunc("hour", "ts"), totals, 4_096).select("series", "seq", "kind", C("n").cast("int").alias("n"), "standing")


add("join_event_order", _event_order, with_("""SELECT series, seq, kind::INT AS kind, row_number() OVER (PARTITION BY series ORDER BY ts, kind, seq)::INT AS n, last_value(sig IGNORE NULLS) OVER (PARTITION BY series ORDER BY ts, kind, seq) AS standing
  FROM (SELECT series, ts, 1 AS kind, seq, NULL::DOUBLE AS sig FROM ticks UNION ALL SELECT series, ts, 0, seq, mid FROM ticks)""", TICKS_SQL), ["series", "seq", "kind", "n"], ["standing"])  # fmt: skip
