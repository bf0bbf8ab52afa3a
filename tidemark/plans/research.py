"""Registered queries: distributions, calendar profiles, conditional studies, information coefficients, agreement and
multiple testing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import aggregates as A
from tidemark.operators import ordering as O
from tidemark.operators import ranking as K
from tidemark.operators import selection as Q
from tidemark.operators import windows as WN
from tidemark.plans.base import BARS_SQL, BW, RETURNS_SQL, SERIES, T0, TICKS_SQL, add, bars, in_blocks, returns, ticks, week, with_
from tidemark.plans.market import AR_SQL, OLS_SQL, _ols, ou_frame
from tidemark.session import small_side

C = F.col

_QS = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
_QN = [A.qname(q) for q in _QS]
add("describe_distribution", lambda s, d: A.describe_distribution(returns(s, d), "r", SERIES, _QS),
    with_("SELECT series, count(r) AS n, avg(r) AS mean, stddev_samp(r) AS std, min(r) AS min, max(r) AS max, skewness(r) AS skew, kurtosis(r) AS kurtosis, " + ", ".join(f"quantile_cont(r, {q}) AS {n}" for q, n in zip(_QS, _QN, strict=True)) + " FROM returns GROUP BY 1", RETURNS_SQL),
    ["series", "n"], ["mean", "std", "min", "max", "skew", "kurtosis", *_QN])
add("gaussian_tails", lambda s, d: A.gaussian_tails(returns(s, d), "r", SERIES, (1, 2, 3)),
    with_("""SELECT series, n, sigma, count(*) FILTER (WHERE abs(r - m) > sigma * s) AS hits, count(*) FILTER (WHERE abs(r - m) > sigma * s) / n AS rate FROM
      (SELECT *, avg(r) OVER (PARTITION BY series) AS m, stddev_samp(r) OVER (PARTITION BY series) AS s, count(r) OVER (PARTITION BY series) AS n FROM returns WHERE r IS NOT NULL), (SELECT unnest([1, 2, 3]) AS sigma) GROUP BY 1, 2, 3""", RETURNS_SQL),
    ["series", "n", "sigma", "hits"], ["rate"])
add("normality_tests", lambda s, d: A.normality(returns(s, d), "r", SERIES).withColumn("p", C("jb_p")),
    with_("SELECT series, n, n / 6 * (s * s + k * k / 4) AS jarque_bera, exp(-n / 12 * (s * s + k * k / 4)) AS p FROM (SELECT series, count(r)::DOUBLE AS n, skewness(r) * (count(r) - 2) / sqrt(count(r) * (count(r) - 1)) AS s, kurtosis_pop(r) AS k FROM returns GROUP BY 1)", RETURNS_SQL),
    ["series"], ["n", "jarque_bera", "p"])


def _extremes(spark, sf_dir):
    r = returns(spark, sf_dir)
    cut = Q.exact_quantiles(r, SERIES, {"cut": F.abs("r")}, (0.95,)).select("series", C("cut")[0].alias("cut"))
    return r.join(small_side(cut), "series", "left").withColumn("far", F.abs("r") >= C("cut"))


_EXT = RETURNS_SQL + ",\next AS (SELECT *, abs(r) >= quantile_cont(abs(r), 0.95) OVER (PARTITION BY series) AS far FROM returns)"
_PROF = "count(r) AS n, avg(r) AS mean, median(r) AS median, stddev_samp(r) AS std, avg(abs(r)) AS mean_abs, min(r) AS min, max(r) AS max, avg(far::INT) AS extreme_share, quantile_cont(mean_spread, 0.95) AS spread_p95"
_PC = ["mean", "median", "std", "mean_abs", "min", "max", "extreme_share", "spread_p95"]
for _name, _key, _sqlkey in (("hourly", lambda: F.hour("timestamp"), "hour(timestamp)"), ("weekday", lambda: F.weekday("timestamp") + 1, "isodow(timestamp)")):
    add(f"{_name}_profile", lambda s, d, k=_key: A.return_profile(_extremes(s, d), {"part": k().cast("long")}, "r", "mean_spread", C("far")),
        with_(f"SELECT {_sqlkey}::BIGINT AS part, {_PROF} FROM ext WHERE r IS NOT NULL GROUP BY 1", _EXT), ["part", "n"], _PC)


def _session_profile(spark, sf_dir):
    from tidemark.operators.bars import assign_session

    return A.return_profile(_extremes(spark, sf_dir), {"session": assign_session(C("timestamp"), [("night", "22:00", "06:00"), ("day", "06:00", "18:00")])}, "r", "mean_spread", C("far"))


add("session_profile", _session_profile, with_(f"SELECT CASE WHEN hour(timestamp) >= 22 OR hour(timestamp) < 6 THEN 'night' WHEN hour(timestamp) < 18 THEN 'day' ELSE 'unclassified' END AS session, {_PROF} FROM ext WHERE r IS NOT NULL GROUP BY 1", _EXT), ["session", "n"], _PC)


def _spread(spark, sf_dir):
    t = ticks(spark, sf_dir)
    wide = Q.exact_quantiles(t, [], {"cut": C("spread")}, (0.9,)).select(C("cut")[0].alias("cut"))  # one row
    t = t.withColumn("hour", F.hour("ts").cast("long"))
    out = t.crossJoin(F.broadcast(wide)).groupBy("series", "hour").agg(F.count("*").alias("n"), F.avg("spread").alias("mean"), F.avg((C("spread") >= C("cut")).cast("double")).alias("wide"))
    return Q.with_quantiles(out, t, ["series", "hour"], {"spread": (C("spread"), {"p95": 0.95})})


add("spread_profile", _spread, with_("SELECT series, hour(ts)::BIGINT AS hour, count(*) AS n, avg(spread) AS mean, quantile_cont(spread, 0.95) AS p95, avg((spread >= (SELECT quantile_cont(spread, 0.9) FROM ticks))::INT) AS wide FROM ticks GROUP BY 1, 2", TICKS_SQL), ["series", "hour", "n"], ["mean", "p95", "wide"])


def _corrs(spark, sf_dir):
    b = in_blocks(returns(spark, sf_dir).drop("__x"), 24)
    v = O.own_rows(b.withColumn("vol", WN.rolling_std(C("r"), BW(), 24))).select(C("mean_spread").alias("spread"), "vol", F.abs("r").alias("abs_r"), C("tick_count").cast("double").alias("ticks"))
    return A.correlations(v, [("spread", "vol"), ("spread", "abs_r"), ("spread", "ticks")])


add("spread_correlations", _corrs, with_("""SELECT a, b, n, c AS corr FROM (SELECT count(vol) AS nv, corr(mean_spread, vol) AS cv, count(r) AS nr, corr(CASE WHEN r IS NOT NULL THEN mean_spread END, abs(r)) AS cr, count(*) AS nt, corr(mean_spread, tick_count) AS ct FROM
  (SELECT *, CASE WHEN count(r) OVER w = 24 THEN stddev_samp(r) OVER w END AS vol FROM returns WINDOW w AS (PARTITION BY series ORDER BY t ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))) x,
  LATERAL (SELECT unnest(['spread', 'spread', 'spread']) AS a, unnest(['vol', 'abs_r', 'ticks']) AS b, unnest([nv, nr, nt]) AS n, unnest([cv, cr, ct]) AS c)""", RETURNS_SQL), ["a", "b", "n"], ["corr"])  # fmt: skip
def _activity(b):
    out = b.groupBy("series").agg(F.count("*").alias("bars"), F.avg("tick_count").alias("mean"), F.stddev_samp("tick_count").alias("std"))
    return Q.with_quantiles(out, b, SERIES, {"ticks": (C("tick_count"), {"median": 0.5, "p95": 0.95})})


add("activity_profile", lambda s, d: _activity(bars(s, d)),
    with_("SELECT series, count(*) AS bars, avg(tick_count) AS mean, median(tick_count) AS median, quantile_cont(tick_count, 0.95) AS p95, stddev_samp(tick_count) AS std FROM bars GROUP BY 1", BARS_SQL), ["series", "bars"], ["mean", "median", "p95", "std"])


def _stability(spark, sf_dir):
    r = in_blocks(_extremes(spark, sf_dir), 1)
    r = O.own_rows(r.withColumn("lagged", F.lag("r").over(BW())))
    return A.yearly_stability(r, week(), "r", "lagged", C("far"))


add("period_stability", _stability, with_("SELECT week(timestamp)::BIGINT AS period, count(r) AS n, avg(r) AS mean, stddev_samp(r) AS std, skewness(r) AS skew, kurtosis(r) AS kurtosis, corr(r, l) AS acf1, avg(far::INT) AS extreme_share FROM (SELECT *, lag(r) OVER (PARTITION BY series ORDER BY t) AS l FROM ext) WHERE r IS NOT NULL GROUP BY 1", _EXT), ["period", "n"], ["mean", "std", "skew", "kurtosis", "acf1", "extreme_share"])


def _conditional(spark, sf_dir):
    r = returns(spark, sf_dir).where("r IS NOT NULL").select("series", "timestamp", "r")
    b = in_blocks(r, 0, 4)
    up = {h: F.sum("r").over(BW().rowsBetween(1, h)) for h in (1, 4)}
    o = O.own_rows(b.select("*", *[F.when(WN.has_future(BW(), h), c).alias(f"f{h}") for h, c in up.items()]))
    return A.conditional_returns(o, "r", (0.05, 0.1), (0.9, 0.95), {1: "f1", 4: "f4"})


add("conditional_returns", _conditional, with_("""SELECT bucket, horizon::INT AS horizon, count(y) AS n, avg(y) AS mean, median(y) AS median, stddev_samp(y) AS std, avg((y > 0)::INT) AS p_up, avg((y * turn > 0)::INT) AS reversal, stddev_samp(y) / sqrt(count(y)) AS se
  FROM (SELECT *, CASE WHEN bucket LIKE '<%' THEN 1 ELSE -1 END AS turn FROM (SELECT r, unnest(['<=q0.05', '<=q0.1', '>=q0.9', '>=q0.95']) AS bucket, unnest([r <= a, r <= b, r >= c, r >= e]) AS hit, f1, f4 FROM (
    SELECT *, quantile_cont(r, 0.05) OVER () AS a, quantile_cont(r, 0.1) OVER () AS b, quantile_cont(r, 0.9) OVER () AS c, quantile_cont(r, 0.95) OVER () AS e FROM (
      SELECT r, lead(r) OVER (PARTITION BY series ORDER BY t) AS f1, CASE WHEN count(*) OVER w = 4 THEN sum(r) OVER w END AS f4 FROM returns WHERE r IS NOT NULL WINDOW w AS (PARTITION BY series ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING)))) WHERE hit),
  LATERAL (SELECT unnest([1, 4]) AS horizon, unnest([f1, f4]) AS y) WHERE y IS NOT NULL GROUP BY 1, 2""", RETURNS_SQL), ["bucket", "horizon", "n"], ["mean", "median", "std", "p_up", "reversal", "se"])  # fmt: skip


def _reversion(spark, sf_dir):
    o = in_blocks(_ols(spark, sf_dir).where("residual IS NOT NULL").select("series", "timestamp", "residual"), 0, 1)
    o = O.own_rows(o.withColumn("change", F.lead("residual").over(BW()) - C("residual")))
    return A.reversion_coefficient(o, "residual", "change", SERIES)


add("residual_reversion", _reversion, with_("SELECT series, regr_count(c, residual)::BIGINT AS n, regr_slope(c, residual) AS slope, regr_intercept(c, residual) AS intercept, regr_r2(c, residual) AS r2 FROM (SELECT *, lead(residual) OVER (PARTITION BY series ORDER BY t) - residual AS c FROM ols WHERE residual IS NOT NULL) GROUP BY 1", OLS_SQL), ["series", "n"], ["slope", "intercept", "r2"])


def _decay(spark, sf_dir):
    o = _ols(spark, sf_dir).where("z IS NOT NULL").select("series", "timestamp", "z")
    o = in_blocks(o, 0, 4)
    o = O.own_rows(o.select("*", F.lead("z", 1).over(BW()).alias("z1"), F.lead("z", 4).over(BW()).alias("z4")))
    return A.toward_zero(o, "z", {1: "z1", 4: "z4"}, [-3.0, -2.0, -1.0, 0.0, 1.0, 2.0, 3.0])


_Z = OLS_SQL + ",\nzs AS (SELECT * FROM (SELECT series, t, CASE WHEN count(residual) OVER w >= 15 THEN (residual - avg(residual) OVER w) / stddev_samp(residual) OVER w END AS z FROM ols WINDOW w AS (PARTITION BY series ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) WHERE z IS NOT NULL)"
add("residual_decay", _decay, with_("""SELECT floor(z + 3)::INT AS bin, horizon::INT AS horizon, count(*) AS n, avg(z) AS mean_z, avg(y) AS mean_later, avg((abs(y) < abs(z))::INT) AS toward FROM
  (SELECT *, lead(z, 1) OVER w AS z1, lead(z, 4) OVER w AS z4 FROM zs WINDOW w AS (PARTITION BY series ORDER BY t)), LATERAL (SELECT unnest([1, 4]) AS horizon, unnest([z1, z4]) AS y) WHERE y IS NOT NULL AND z >= -3 AND z < 3 GROUP BY 1, 2""", _Z), ["bin", "horizon", "n"], ["mean_z", "mean_later", "toward"])  # fmt: skip
def _ou_states(o):
    keys = ["series", "ou_state"]
    return Q.with_quantiles(o.groupBy(*keys).agg(F.count("*").alias("n")), o, keys, {"h": (C("ou_half_life"), {"half_life": 0.5})})


add("ou_classification", lambda s, d: _ou_states(ou_frame(s, d)),
    with_("SELECT series, ou_state, count(*) AS n, median(CASE WHEN ou_state = 'valid' THEN -ln(2) / ln(ar_b) END) AS half_life FROM ou GROUP BY 1, 2", AR_SQL), ["series", "ou_state", "n"], ["half_life"])


def _segment_fits(spark, sf_dir):
    b = in_blocks(bars(spark, sf_dir).withColumn("x", F.ln("close")), 1)
    b = O.own_rows(b.withColumn("l", F.lag("x").over(BW())))
    return b.groupBy("series", week().alias("period")).agg(F.regr_count("x", "l").alias("n"), F.regr_slope("x", "l").alias("b"), F.regr_intercept("x", "l").alias("a"))


add("segment_ar1_fits", _segment_fits, with_("SELECT series, week(timestamp)::BIGINT AS period, regr_count(x, l)::BIGINT AS n, regr_slope(x, l) AS b, regr_intercept(x, l) AS a FROM (SELECT series, timestamp, ln(close) AS x, lag(ln(close)) OVER (PARTITION BY series ORDER BY t) AS l FROM bars) GROUP BY 1, 2", BARS_SQL), ["series", "period", "n"], ["b", "a"])


def _eras(spark, sf_dir):
    n = O.number_rows(bars(spark, sf_dir), SERIES, ["timestamp"], F.to_date("timestamp"), "i")
    tot = n.groupBy("series").agg(F.count("*").alias("total"))
    e = n.join(tot, "series").withColumn("era", F.least(F.floor(C("i") * 4 / C("total")), F.lit(3)).cast("int"))
    recent = n.agg(F.max("timestamp").alias("last"))
    e = e.crossJoin(F.broadcast(recent)).withColumn("recent", C("timestamp") > C("last") - F.expr("INTERVAL 7 DAYS"))
    return e.groupBy("series", "era", "recent").agg(F.count("*").alias("n"), F.avg("close").alias("mean_close"))


add("era_and_recent", _eras, with_("SELECT series, least(i * 4 // n, 3)::INT AS era, timestamp > (SELECT max(timestamp) FROM bars) - INTERVAL 7 DAY AS recent, count(*) AS n, avg(close) AS mean_close FROM (SELECT *, count(*) OVER (PARTITION BY series) AS n FROM returns) GROUP BY 1, 2, 3", RETURNS_SQL), ["series", "era", "recent", "n"], ["mean_close"])


def _buckets(spark, sf_dir):
    return A.quantile_buckets(bars(spark, sf_dir).select("series", T0(), "close"), "close", 5, SERIES).groupBy("series", "bucket").agg(F.count("*").alias("n"), F.avg("close").alias("mean"))


add("quantile_buckets", _buckets, with_("""SELECT series, bucket, count(*) AS n, avg(close) AS mean FROM (SELECT series, close, ((close > a)::INT + (close > b)::INT + (close > c)::INT + (close > d)::INT) AS bucket FROM (SELECT *,
  quantile_cont(close, 0.2) OVER p AS a, quantile_cont(close, 0.4) OVER p AS b, quantile_cont(close, 0.6) OVER p AS c, quantile_cont(close, 0.8) OVER p AS d FROM bars WINDOW p AS (PARTITION BY series))) GROUP BY 1, 2""", BARS_SQL), ["series", "bucket", "n"], ["mean"])  # fmt: skip


def _circular(spark, sf_dir):
    return A.circular(ticks(spark, sf_dir).withColumn("a", (F.unix_timestamp("ts") % 86400) / 86400.0 * 2 * np.pi), "a", SERIES)


add("circular_statistics", _circular, with_("SELECT series, n, atan2(s, c) AS mean_angle, sqrt(s * s + c * c) AS resultant, n * (s * s + c * c) AS rayleigh_z FROM (SELECT series, count(*) AS n, avg(sin(a)) AS s, avg(cos(a)) AS c FROM (SELECT series, (epoch(date_trunc('second', ts))::BIGINT % 86400) / 86400.0 * 2 * pi() AS a FROM ticks) GROUP BY 1)", TICKS_SQL), ["series", "n"], ["mean_angle", "resultant", "rayleigh_z"])

# Information coefficients.


def scored(spark, sf_dir):
    """Rank scores of two features and one outcome."""
    b = in_blocks(returns(spark, sf_dir), 24, 1)
    f = O.own_rows(b.select("series", "timestamp", O.INDEX, O.BLOCK, O.OWN, "r", WN.rolling_mean(C("r"), BW(), 6).alias("mom"), WN.rolling_std(C("r"), BW(), 24).alias("vol"), F.lead("r").over(BW()).alias("y")))
    return A.rank_scores_of(f, ["mom", "vol", "y"], SERIES, ["series", "timestamp"])


SCORED_SQL = RETURNS_SQL + """,
f AS (
  SELECT series, t, timestamp, CASE WHEN count(r) OVER a = 6 THEN avg(r) OVER a END AS mom, CASE WHEN count(r) OVER b = 24 THEN stddev_samp(r) OVER b END AS vol, lead(r) OVER w AS y
  FROM returns WINDOW w AS (PARTITION BY series ORDER BY t), a AS (PARTITION BY series ORDER BY t ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), b AS (PARTITION BY series ORDER BY t ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)
),
u AS (
  SELECT series, t, timestamp, """ + ", ".join(f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY series, {c} IS NULL ORDER BY {c}) - 1 + (count(*) OVER (PARTITION BY series, {c}) + 1) / 2.0 - 0.5) / count({c}) OVER (PARTITION BY series) END AS u_{c}" for c in ("mom", "vol", "y")) + """ FROM f
),
long AS (SELECT series, week(timestamp)::INT AS month, 'mom' AS feature, u_mom AS x, u_y AS y FROM u UNION ALL SELECT series, week(timestamp)::INT, 'vol', u_vol, u_y FROM u),
mm AS (SELECT month, feature, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(y * y) AS syy, sum(x * y) AS sxy FROM long WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2)"""
add("rank_scores", lambda s, d: scored(s, d).select("series", T0(), "u_mom", "u_vol", "u_y"), with_("SELECT series, t, u_mom, u_vol, u_y FROM u", SCORED_SQL), ["series", "t"], ["u_mom", "u_vol", "u_y"])


def weekly_moments(spark, sf_dir):
    """Weeks stand in for months, of which these data have one."""
    m = A.period_moments(scored(spark, sf_dir), week().cast("int"), ["u_mom", "u_vol"], ["u_y"])
    return m.withColumnRenamed("period", "month").withColumn("feature", F.substring("feature", 3, 9))


_CORR = "(sxy - sx * sy / n) / sqrt((sxx - sx * sx / n) * (syy - sy * sy / n))"
_SUM = "sum(n)::BIGINT AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(syy) AS syy, sum(sxy) AS sxy"
add("ic_month_moments", weekly_moments, with_("SELECT * FROM mm", SCORED_SQL), ["month", "feature", "n"], ["sx", "sy", "sxx", "syy", "sxy"])
add("ic_pooled", lambda s, d: A.sum_moments(weekly_moments(s, d), ["feature"]).select("feature", "n", A.correlation_of_sums().alias("ic")), with_(f"SELECT feature, n, {_CORR} AS ic FROM (SELECT feature, {_SUM} FROM mm GROUP BY 1)", SCORED_SQL), ["feature", "n"], ["ic"])
add("ic_by_period", lambda s, d: weekly_moments(s, d).select("feature", "month", "n", A.correlation_of_sums().alias("ic")), with_(f"SELECT feature, month, n, CASE WHEN n > 2 THEN {_CORR} END AS ic FROM mm", SCORED_SQL), ["feature", "month", "n"], ["ic"])
add("ic_with_errors", lambda s, d: A.ic_with_errors(weekly_moments(s, d), 2), with_(f"""SELECT feature, big AS n, ic, months, sqrt(greatest(v, 0)) / big AS se, ic / (sqrt(greatest(v, 0)) / big) AS z FROM (
  SELECT feature, big, ic, count(*) AS months, sum(u * u) + 2 * (2 / 3.0) * coalesce(sum(u * u1), 0) + 2 * (1 / 3.0) * coalesce(sum(u * u2), 0) AS v FROM (
    SELECT *, lag(u) OVER w AS u1, lag(u, 2) OVER w AS u2 FROM (
      SELECT mm.feature, month, big, ic, (sxy - mx * sy - my * sx + n * mx * my) / (dx * dy) - ic * ((sxx - 2 * mx * sx + n * mx * mx) / (dx * dx) + (syy - 2 * my * sy + n * my * my) / (dy * dy)) / 2 AS u
      FROM mm JOIN (SELECT feature, n AS big, sx / n AS mx, sy / n AS my, sqrt(sxx / n - (sx / n) ** 2) AS dx, sqrt(syy / n - (sy / n) ** 2) AS dy, {_CORR} AS ic FROM (SELECT feature, {_SUM} FROM mm GROUP BY 1)) p USING (feature))
    WINDOW w AS (PARTITION BY feature ORDER BY month)) GROUP BY 1, 2, 3)""", SCORED_SQL), ["feature", "n", "months"], ["ic", "se", "z"])  # fmt: skip
add("ic_rolling", lambda s, d: A.rolling_ics(weekly_moments(s, d), 3, 2), with_(f"SELECT feature, month, held, n::BIGINT AS n, {_CORR} AS ic FROM (SELECT feature, month, count(*) OVER w AS held, " + ", ".join(f"sum({c}) OVER w AS {c}" for c in ("n", "sx", "sy", "sxx", "syy", "sxy")) + " FROM mm WINDOW w AS (PARTITION BY feature ORDER BY month RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING)) WHERE held >= 2", SCORED_SQL), ["feature", "month", "held", "n"], ["ic"])
add("ic_eras", lambda s, d: A.era_ics(weekly_moments(s, d), 2), with_(f"SELECT feature, era::INT AS era, n, {_CORR} AS ic FROM (SELECT feature, era, {_SUM} FROM (SELECT *, ntile(2) OVER (PARTITION BY feature ORDER BY month) AS era FROM mm) GROUP BY 1, 2)", SCORED_SQL), ["feature", "era", "n"], ["ic"])


def _consistency(spark, sf_dir):
    m = weekly_moments(spark, sf_dir)
    return A.sign_consistency(m.select("feature", "target", A.correlation_of_sums().alias("ic")), A.sum_moments(m, ["feature", "target"]).select("feature", "target", A.correlation_of_sums().alias("ic")))


add("ic_sign_consistency", _consistency, with_(f"SELECT feature, count(ic) AS years, avg((sign(ic) = sign(pooled))::INT) AS consistency FROM (SELECT feature, {_CORR} AS ic FROM mm) JOIN (SELECT feature, {_CORR} AS pooled FROM (SELECT feature, {_SUM} FROM mm GROUP BY 1)) USING (feature) GROUP BY 1", SCORED_SQL), ["feature", "years"], ["consistency"])


def _decay_summary(spark, sf_dir):
    """Correlation by lag, its peak and half life, and the slope of ln|ic|."""
    b = in_blocks(returns(spark, sf_dir), 6)
    lagged = b.select("r", O.OWN, *[F.lag(F.abs("r"), k).over(BW()).alias(f"x{k}") for k in range(1, 7)])
    lags = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), C(f"x{k}").alias("x")) for k in range(1, 7)])).alias("l")
    own = lagged.where(O.OWN).select("r", lags).select("l.*", F.abs("r").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    ic = own.groupBy("k").agg(S.corr("x", "y").alias("ic"))
    peak = ic.agg(F.max_by("k", F.abs("ic")).alias("peak"), F.regr_slope(F.ln(F.abs("ic")), "k").alias("slope"))
    return ic.crossJoin(F.broadcast(peak))


add("ic_decay", _decay_summary, with_("""SELECT k::INT AS k, ic, (arg_max(k, abs(ic)) OVER ())::INT AS peak, regr_slope(ln(abs(ic)), k) OVER () AS slope FROM (SELECT k, corr(x, y) AS ic FROM (SELECT abs(r) AS y, unnest([1, 2, 3, 4, 5, 6]) AS k,
  unnest([lag(abs(r), 1) OVER w, lag(abs(r), 2) OVER w, lag(abs(r), 3) OVER w, lag(abs(r), 4) OVER w, lag(abs(r), 5) OVER w, lag(abs(r), 6) OVER w]) AS x FROM returns WINDOW w AS (PARTITION BY series ORDER BY t)) WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1)""", RETURNS_SQL), ["k", "peak"], ["ic", "slope"])  # fmt: skip


def _mi(spark, sf_dir):
    f = scored(spark, sf_dir)
    return A.mutual_information(A.joint_counts(f.select("series", A.rank_bin(C("u_vol"), 6).alias("a"), A.rank_bin(C("u_y"), 6).alias("b")), "a", "b", SERIES), SERIES)


_MI = SCORED_SQL + """,
jc AS (SELECT series, least(floor(u_vol * 6), 5) AS a, least(floor(u_y * 6), 5) AS b, count(*) AS c FROM u WHERE u_vol IS NOT NULL AND u_y IS NOT NULL GROUP BY ALL),
mi AS (SELECT series, n, plug - (cells - rows - cols + 1) / (2 * n) AS mi, hx, hy FROM (SELECT series, any_value(n) AS n, sum(c / n * ln(c * n / (r * k))) AS plug, count(*) AS cells, count(DISTINCT a) AS rows, count(DISTINCT b) AS cols,
  any_value(hx) AS hx, any_value(hy) AS hy FROM (SELECT *, sum(c) OVER (PARTITION BY series) AS n, sum(c) OVER (PARTITION BY series, a) AS r, sum(c) OVER (PARTITION BY series, b) AS k FROM jc)
  JOIN (SELECT series, -sum(p * ln(p)) AS hx FROM (SELECT series, sum(c) / sum(sum(c)) OVER (PARTITION BY series) AS p FROM jc GROUP BY series, a) GROUP BY 1) USING (series)
  JOIN (SELECT series, -sum(p * ln(p)) AS hy FROM (SELECT series, sum(c) / sum(sum(c)) OVER (PARTITION BY series) AS p FROM jc GROUP BY series, b) GROUP BY 1) USING (series) GROUP BY 1))"""
add("mutual_information", _mi, with_("SELECT series, n::BIGINT AS n, mi, hx, hy, mi / least(hx, hy) AS nmi FROM mi", _MI), ["series", "n"], ["mi", "hx", "hy", "nmi"])
add("conditional_mutual_information", lambda s, d: A.conditional_mutual_information(_mi(s, d)), with_("SELECT sum(n)::BIGINT AS n, sum(mi * n) / sum(n) AS cmi FROM mi", _MI), ["n"], ["cmi"])
add("causal_condition_moments", lambda s, d: _conditioned(s, d), with_("""SELECT cond, count(*) AS n, sum(u_mom) AS sx, sum(u_y) AS sy, sum(u_mom * u_y) AS sxy FROM (SELECT u.*, (prev > q1)::INT + (prev > q2)::INT AS cond FROM u JOIN (SELECT series, t, vol AS prev FROM f) USING (series, t)
  JOIN (SELECT series, quantile_cont(vol, 1 / 3.0) AS q1, quantile_cont(vol, 2 / 3.0) AS q2 FROM f GROUP BY 1) USING (series) WHERE prev IS NOT NULL) WHERE u_mom IS NOT NULL AND u_y IS NOT NULL GROUP BY 1""", SCORED_SQL), ["cond", "n"], ["sx", "sy", "sxy"])  # fmt: skip


def _conditioned(spark, sf_dir):
    f = A.quantile_buckets(scored(spark, sf_dir), "vol", 3, SERIES, "cond")
    m = A.month_moments(f, "timestamp", ["u_mom"], ["u_y"], ["cond"])
    return A.sum_moments(m, ["cond"]).where("cond IS NOT NULL")


def _expanding(spark, sf_dir):
    r = returns(spark, sf_dir)
    q = Q.expanding_quantiles(r, "r", week(), (0.05, 0.95), 20)
    j = r.withColumn("period", week()).join(small_side(q), "period", "left")
    return j.select("series", T0(), S.clip(C("r"), C("q")[0], C("q")[1]).alias("clipped"), F.when(C("q").isNotNull(), C("r")).alias("r"))


add("winsorize_causal", lambda s, d: _expanding(s, d).where("r IS NOT NULL").select("series", "t", "clipped"), with_("""SELECT series, t, greatest(least(r, hi), lo) AS clipped FROM (SELECT *, week(timestamp) AS p FROM returns) JOIN
  (SELECT p.p, count(v.r) AS h, quantile_cont(v.r, 0.05) AS lo, quantile_cont(v.r, 0.95) AS hi FROM (SELECT DISTINCT week(timestamp) AS p FROM returns) p JOIN (SELECT week(timestamp) AS p, r FROM returns WHERE r IS NOT NULL) v ON v.p < p.p GROUP BY 1) USING (p)
  WHERE h >= 20 AND r IS NOT NULL""", RETURNS_SQL), ["series", "t"], ["clipped"])  # fmt: skip

# Quality, drift, agreement, runs.
add("missing_shares", lambda s, d: A.missing_shares(scored(s, d).withColumn("week", week()), ["mom", "vol"], [[], ["series"], ["week"]]),
    with_("""SELECT "column", series, week::INT AS week, count(*) AS n, avg(gone::INT) AS share FROM (SELECT series, week(timestamp) AS week, unnest(['mom', 'vol']) AS "column", unnest([mom IS NULL, vol IS NULL]) AS gone FROM f) GROUP BY GROUPING SETS (("column"), ("column", series), ("column", week))""", SCORED_SQL), ["column", "series", "week", "n"], ["share"])
add("drift_ks_wasserstein", lambda s, d: A.ks_and_wasserstein(returns(s, d).where("series = 'view'"), returns(s, d).where("series = 'click'"), "r", 50),
    with_("""SELECT list_max([abs(len(list_filter(qa, lambda e: e <= v)) - len(list_filter(qb, lambda e: e <= v))) / 50.0 for v in list_concat(qa, qb)]) AS ks, list_sum([abs(p[1] - p[2]) for p in list_zip(qa, qb)]) / 50 AS wasserstein
      FROM (SELECT quantile_cont(CASE WHEN series = 'view' THEN r END, [""" + ", ".join(f"{(k + 0.5) / 50}" for k in range(50)) + "]) AS qa, quantile_cont(CASE WHEN series = 'click' THEN r END, [" + ", ".join(f"{(k + 0.5) / 50}" for k in range(50)) + "]) AS qb FROM returns)", RETURNS_SQL), [], ["ks", "wasserstein"])  # fmt: skip


def labelled(spark, sf_dir):
    b = bars(spark, sf_dir)
    return b.select("series", "timestamp", F.when(C("tick_count") > 6, -1).otherwise((C("tick_count") % 3)).cast("int").alias("state"), (C("close") > 100).cast("int").alias("other"), "close")


_LAB = BARS_SQL + ",\nlab AS (SELECT series, t, timestamp, CASE WHEN tick_count > 6 THEN -1 ELSE tick_count % 3 END::INT AS state, (close > 100)::INT AS other, close FROM bars)"
add("state_transitions", lambda s, d: A.transition_counts(labelled(s, d), "state", W.partitionBy("series").orderBy("timestamp")), with_('SELECT state AS "from", nxt AS "to", count(*) AS n FROM (SELECT state, lead(state) OVER (PARTITION BY series ORDER BY t) AS nxt FROM lab) WHERE state >= 0 AND nxt >= 0 GROUP BY 1, 2', _LAB), ["from", "to", "n"])
_RUNS = _LAB + """,
runs AS (SELECT series, run, any_value(state) AS label, count(*) AS length, run = min(run) OVER (PARTITION BY series) OR run = max(run) OVER (PARTITION BY series) AS censored
  FROM (SELECT *, sum(ch) OVER (PARTITION BY series ORDER BY t) AS run FROM (SELECT *, coalesce((state <> lag(state) OVER (PARTITION BY series ORDER BY t))::INT, 1) AS ch FROM lab)) GROUP BY 1, 2)"""
add("state_run_lengths", lambda s, d: A.run_lengths(labelled(s, d), "state", SERIES, ["timestamp"], F.to_date("timestamp"), 512).select("series", C("run").cast("long").alias("run"), "label", "length", "censored"), with_("SELECT series, run::BIGINT AS run, label, length, censored FROM runs WHERE label >= 0", _RUNS), ["series", "run", "label", "length", "censored"])
add("state_durations", lambda s, d: A.duration_summary(A.run_lengths(labelled(s, d), "state", SERIES, ["timestamp"], F.to_date("timestamp"), 512)), with_("""SELECT label, count(*) AS runs, count(*) FILTER (WHERE censored) AS censored, sum(length) / sum(sum(length)) OVER () AS share, avg(CASE WHEN NOT censored THEN length END) AS mean, median(CASE WHEN NOT censored THEN length END) AS median,
  quantile_cont(CASE WHEN NOT censored THEN length END, 0.9) AS p90, max(CASE WHEN NOT censored THEN length END) AS max FROM runs WHERE label >= 0 GROUP BY 1""", _RUNS), ["label", "runs", "censored", "max"], ["share", "mean", "median", "p90"])  # fmt: skip
add("regime_age", lambda s, d: WN.with_runs(labelled(s, d), "state", SERIES, ["timestamp"], F.to_date("timestamp"), 512).select("series", T0(), C("run").cast("long").alias("run"), C("age").cast("long").alias("age")),
    with_("SELECT series, t, run::BIGINT AS run, row_number() OVER (PARTITION BY series, run ORDER BY t) AS age FROM (SELECT *, sum(ch) OVER (PARTITION BY series ORDER BY t) AS run FROM (SELECT *, coalesce((state <> lag(state) OVER (PARTITION BY series ORDER BY t))::INT, 1) AS ch FROM lab))", _LAB), ["series", "t", "run", "age"])
add("label_agreement", lambda s, d: A.agreement(A.contingency(labelled(s, d), "state", "other")), with_("""SELECT n::BIGINT AS n, (ij - i * j / (n * (n - 1) / 2)) / ((i + j) / 2 - i * j / (n * (n - 1) / 2)) AS ari, mi / ((hx + hy) / 2) AS nmi, sqrt((phi - 1) / (least(rows, cols) - 1)) AS cramers_v FROM
  (SELECT sum(c) AS n, sum(c * (c - 1) / 2) AS ij, sum(c / n * ln(c * n / (r * k))) AS mi, sum(c * c / (r * k)) AS phi, count(DISTINCT a) AS rows, count(DISTINCT b) AS cols FROM ct),
  (SELECT sum(r * (r - 1) / 2) AS i, -sum(r / n * ln(r / n)) AS hx FROM (SELECT DISTINCT a, r, n FROM ct)), (SELECT sum(k * (k - 1) / 2) AS j, -sum(k / n * ln(k / n)) AS hy FROM (SELECT DISTINCT b, k, n FROM ct))""",
    _LAB + ",\nct AS (SELECT a, b, c::DOUBLE AS c, sum(c) OVER (PARTITION BY a)::DOUBLE AS r, sum(c) OVER (PARTITION BY b)::DOUBLE AS k, sum(c) OVER ()::DOUBLE AS n FROM (SELECT state AS a, other AS b, count(*) AS c FROM lab GROUP BY 1, 2))"), ["n"], ["ari", "nmi", "cramers_v"])
add("eta_squared", lambda s, d: A.eta_squared(labelled(s, d), "close", "state"), with_("SELECT sum(n)::BIGINT AS n, sum(n * (m - g) ** 2) / (sum(n * (m - g) ** 2) + sum(n * v)) AS eta_squared FROM (SELECT count(*) AS n, avg(close) AS m, var_pop(close) AS v FROM lab GROUP BY state), (SELECT avg(close) AS g FROM lab)", _LAB), ["n"], ["eta_squared"])
add("state_frequency_pivot", lambda s, d: A.frequency_table(labelled(s, d), week(), "state", [0, 1, 2]), with_("SELECT week(timestamp)::BIGINT AS period, count(*) FILTER (WHERE state >= 0) AS n, " + ", ".join(f"count(*) FILTER (WHERE state = {k}) / count(*) FILTER (WHERE state >= 0) AS share_{k}" for k in range(3)) + " FROM lab GROUP BY 1", _LAB), ["period", "n"], ["share_0", "share_1", "share_2"])


def _outcome_by_state(spark, sf_dir):
    b = in_blocks(labelled(spark, sf_dir), 0, 4)
    b = b.select("state", O.OWN, *[WN.forward_return(C("close"), BW(), h).alias(f"y{h}") for h in (1, 4)])
    o = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), C(f"y{h}").alias("y")) for h in (1, 4)])).alias("o")
    return b.where(O.OWN).select("state", o).where("o.y IS NOT NULL AND state >= 0").groupBy("state", "o.horizon").agg(F.count("*").alias("n"), F.avg("o.y").alias("mean"), F.stddev_samp("o.y").alias("std"))


add("state_outcomes", _outcome_by_state, with_("SELECT state, horizon::INT AS horizon, count(*) AS n, avg(y) AS mean, stddev_samp(y) AS std FROM (SELECT state, unnest([1, 4]) AS horizon, unnest([ln(lead(close) OVER w / close), ln(lead(close, 4) OVER w / close)]) AS y FROM lab WINDOW w AS (PARTITION BY series ORDER BY t)) WHERE y IS NOT NULL AND state >= 0 GROUP BY 1, 2", _LAB), ["state", "horizon", "n"], ["mean", "std"])

# Scoring.
add("decile_table", lambda s, d: A.decile_table(scored(s, d), "u_vol", "y", 10), with_("SELECT least(floor(u_vol * 10), 9)::INT AS bucket, count(*) AS n, avg(y) AS mean FROM u JOIN (SELECT series, t, y FROM f) USING (series, t) WHERE u_vol IS NOT NULL AND y IS NOT NULL GROUP BY 1", SCORED_SQL), ["bucket", "n"], ["mean"])


def predictions(spark, sf_dir):
    return returns(spark, sf_dir).where("r IS NOT NULL").select("series", T0(), (1 / (1 + F.exp(-C("close") / 100 + 1))).alias("p"), (C("r") > 0).cast("int").alias("up"), (C("close") / 100).alias("f"), C("r").alias("y"))


_PRED = RETURNS_SQL + ",\npred AS (SELECT series, t, 1 / (1 + exp(-close / 100 + 1)) AS p, (r > 0)::INT AS up, close / 100 AS f, r AS y FROM returns WHERE r IS NOT NULL)"
add("classification_metrics", lambda s, d: A.classification_metrics(predictions(s, d), "p", "up", 0.5, SERIES), with_("""SELECT series, n, log_loss, brier, (su - np * (np + 1) / 2) / (np * (n - np)) AS auc, accuracy, precision, recall, ece, 1 - log_loss / ln(2) AS skill FROM (SELECT series, count(*) AS n, avg(-CASE WHEN up = 1 THEN ln(p) ELSE ln(1 - p) END) AS log_loss,
  avg((p - up) ** 2) AS brier, avg(((p >= 0.5) = (up = 1))::INT) AS accuracy, count(*) FILTER (WHERE p >= 0.5 AND up = 1) / count(*) FILTER (WHERE p >= 0.5) AS precision, count(*) FILTER (WHERE p >= 0.5 AND up = 1) / count(*) FILTER (WHERE up = 1) AS recall,
  count(*) FILTER (WHERE up = 1) AS np, sum(rk) FILTER (WHERE up = 1) AS su FROM (SELECT *, rank() OVER (PARTITION BY series ORDER BY p) + (count(*) OVER (PARTITION BY series, p) - 1) / 2.0 AS rk FROM pred) GROUP BY 1)
  JOIN (SELECT series, sum(n * abs(m - q)) / sum(n) AS ece FROM (SELECT series, least(floor(p * 10), 9) AS b, count(*) AS n, avg(p) AS m, avg(up) AS q FROM pred GROUP BY 1, 2) GROUP BY 1) USING (series)""", _PRED), ["series", "n"], ["log_loss", "brier", "auc", "accuracy", "precision", "recall", "ece", "skill"])  # fmt: skip
add("reliability_bins", lambda s, d: A.reliability(predictions(s, d), "p", "up", SERIES), with_("SELECT series, least(floor(p * 10), 9)::INT AS bin, count(*) AS n, avg(p) AS mean_p, avg(up) AS rate FROM pred GROUP BY 1, 2", _PRED), ["series", "bin", "n"], ["mean_p", "rate"])
add("regression_metrics", lambda s, d: A.regression_metrics(predictions(s, d), "f", "y", 0.0, SERIES), with_("""SELECT series, count(*) AS n, avg(abs(f - y)) AS mae, sqrt(avg((f - y) ** 2)) AS rmse, avg(f - y) AS bias, 1 - avg((f - y) ** 2) / var_pop(y) AS r2, corr(f, y) AS pearson, corr(rf, ry) AS spearman, 1 - avg((f - y) ** 2) / avg(y * y) AS skill
  FROM (SELECT *, rank() OVER (PARTITION BY series ORDER BY f) + (count(*) OVER (PARTITION BY series, f) - 1) / 2.0 AS rf, rank() OVER (PARTITION BY series ORDER BY y) + (count(*) OVER (PARTITION BY series, y) - 1) / 2.0 AS ry FROM pred) GROUP BY 1""", _PRED), ["series", "n"], ["mae", "rmse", "bias", "r2", "pearson", "spearman", "skill"])  # fmt: skip


def _performance(spark, sf_dir):
    d = returns(spark, sf_dir).where("r IS NOT NULL").groupBy("timestamp").agg(F.avg(F.tanh("r") / 50).alias("s"))  # all series alike
    return A.performance(d, "s", W.orderBy("timestamp"), 24 * 365)


add("performance", _performance, with_("""SELECT count(*) AS n, exp(sum(ln(1 + s))) - 1 AS total_return, stddev_samp(s) * sqrt(8760) AS volatility, avg(s) * sqrt(8760) / stddev_samp(s) AS sharpe, min(e / greatest(1, pk) - 1) AS max_drawdown FROM
  (SELECT *, max(e) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS pk FROM (SELECT t, s, exp(sum(ln(1 + s)) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING)) AS e FROM (SELECT t, avg((exp(2 * r) - 1) / (exp(2 * r) + 1) / 50) AS s FROM returns WHERE r IS NOT NULL GROUP BY t)))""", RETURNS_SQL), ["n"], ["total_return", "volatility", "sharpe", "max_drawdown"])  # fmt: skip
add("pnl_concentration", lambda s, d: A.concentration(returns(s, d).where("r IS NOT NULL"), "r", 20), with_("SELECT count(*) AS trades, sum(r) AS total, sum(CASE WHEN r > 0 THEN r END) AS gains, sum(r * r) / sum(abs(r)) ** 2 AS herfindahl, (SELECT sum(r) FROM (SELECT r FROM returns WHERE r IS NOT NULL ORDER BY r DESC LIMIT 20)) AS best FROM returns WHERE r IS NOT NULL", RETURNS_SQL), ["trades"], ["total", "gains", "herfindahl", "best"])

# Ordering, thinning, multiple testing.


def _pvalues(spark, sf_dir):
    r = returns(spark, sf_dir).where("r IS NOT NULL").groupBy("series", F.hour("timestamp").cast("long").alias("hour")).agg(F.count("*").alias("n"), (F.abs(F.avg("r")) / F.stddev_samp("r")).alias("eff"))
    return r.withColumn("p", F.exp(-C("n") * C("eff") * C("eff") / 2))


_PV = RETURNS_SQL + ",\npv AS (SELECT series, hour(timestamp) AS hour, exp(-count(*) * (abs(avg(r)) / stddev_samp(r)) ** 2 / 2) AS p FROM returns WHERE r IS NOT NULL GROUP BY 1, 2)"
add("benjamini_hochberg", lambda s, d: K.benjamini_hochberg(_pvalues(s, d), "p", SERIES), with_("SELECT series, hour, p, least(1, min(raw) OVER (PARTITION BY series ORDER BY p DESC)) AS q FROM (SELECT *, p * count(p) OVER (PARTITION BY series) / rank() OVER (PARTITION BY series ORDER BY p) AS raw FROM pv)", _PV), ["series", "hour"], ["p", "q"])
add("holm", lambda s, d: K.holm(_pvalues(s, d), "p", "hour", SERIES), with_("SELECT series, hour, adjusted, adjusted <= 0.05 AS rejected FROM (SELECT series, hour, max(s) OVER (PARTITION BY series ORDER BY p, hour ROWS UNBOUNDED PRECEDING) AS adjusted FROM (SELECT *, least(1, (count(*) OVER (PARTITION BY series) - row_number() OVER (PARTITION BY series ORDER BY p, hour) + 1) * p) AS s FROM pv))", _PV), ["series", "hour", "rejected"], ["adjusted"])
add("status_rules", lambda s, d: _pvalues(s, d).select("series", "hour", K.status_rules([(C("p") < 0.2, "strong"), (C("p") < 0.5, "weak")], "none").alias("status")), with_("SELECT series, hour, CASE WHEN p < 0.2 THEN 'strong' WHEN p < 0.5 THEN 'weak' ELSE 'none' END AS status FROM pv", _PV), ["series", "hour", "status"])
add("top_by_relevance", lambda s, d: K.top_by(bars(s, d).select("series", T0(), "close").withColumn("tie", F.concat_ws("-", "series", "t")), "close", 25, "tie"), with_("SELECT series, t, close FROM bars ORDER BY close DESC, series || '-' || t LIMIT 25", BARS_SQL), ["series", "t"], ["close"])
add("even_sample", lambda s, d: K.even_sample(O.number_rows(bars(s, d).where("series = 'view'"), SERIES, ["timestamp"], F.to_date("timestamp"), "i"), "i", 700, 100).select("series", T0(), "i"), with_("SELECT series, t, i FROM returns WHERE series = 'view' AND i % 7 = 0", RETURNS_SQL), ["series", "t", "i"])
add("number_rows", lambda s, d: O.number_rows(ticks(s, d), SERIES, ["ts", "seq"], F.to_date("ts"), "i").select("series", "seq", "i"), with_("SELECT series, seq, row_number() OVER (PARTITION BY series ORDER BY ts, seq) - 1 AS i FROM ticks", TICKS_SQL), ["series", "seq", "i"])


def _ids(spark, sf_dir):
    t = ticks(spark, sf_dir)
    known = t.where("user_id < 50").select("user_id").distinct().withColumn("id", C("user_id") + 1)
    return K.assign_ids(known, t, "user_id")


add("append_only_ids", _ids, with_("SELECT user_id, user_id + 1 AS id FROM (SELECT DISTINCT user_id FROM ticks WHERE user_id < 50) UNION ALL SELECT user_id, (SELECT max(user_id) + 1 FROM ticks WHERE user_id < 50) + row_number() OVER (ORDER BY user_id) FROM (SELECT DISTINCT user_id FROM ticks WHERE user_id >= 50)", TICKS_SQL), ["user_id", "id"])


def _dups(t):
    t = t.select("seq", (C("seq") % 7).alias("rk"))
    p = t.where("seq % 10 = 0").select(C("seq").alias("a"), (C("seq") + 3).alias("b"))
    return K.near_duplicates_out(t, p, "seq", "rk")


add("near_duplicates_out", lambda s, d: _dups(ticks(s, d)), with_("SELECT seq, seq % 7 AS rk FROM ticks WHERE NOT (seq % 10 = 0 AND seq + 3 IN (SELECT seq FROM ticks) AND seq % 7 > (seq + 3) % 7) AND NOT (seq % 10 = 3 AND seq - 3 IN (SELECT seq FROM ticks) AND seq % 7 > (seq - 3) % 7)", TICKS_SQL), ["seq", "rk"])
