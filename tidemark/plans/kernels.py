"""Registered queries: ordered kernels, models, event simulation and streams."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import models as M
from tidemark.functions import series as SR
from tidemark.functions import simulate as SM
from tidemark.functions import spectral as SP
from tidemark.operators import execution as EX
from tidemark.operators import grouped as G
from tidemark.operators import hmm as H
from tidemark.operators import learning as L
from tidemark.operators import moments as MO
from tidemark.functions import scalar as S
from tidemark.operators import ordering as O
from tidemark.operators import resampling as RS
from tidemark.operators import risk as RK
from tidemark.operators import scans as SC
from tidemark.operators import selection as Q
from tidemark.operators import wavelets as WV
from tidemark.operators import windows as WN
from tidemark.plans.base import BARS_SQL, BW, RETURNS_SQL, SERIES, T0, TICKS_SQL, add, bars, in_blocks, returns, ticks, week, with_
from tidemark.session import shared_dir, small_side, table, written
from tidemark.streaming import bars as SB

C = F.col


def _rows(spark, sf_dir):
    return returns(spark, sf_dir).where("r IS NOT NULL").select("series", "timestamp", "close", "r")


def _kernel(fn, schema, back=None, source=_rows, order=("timestamp",)):
    """A query that runs a kernel over series, or over blocks of them if it looks back a fixed number of rows."""

    def run(spark, sf_dir):
        df = source(spark, sf_dir)
        if back is None:
            return G.per_series(df, SERIES, list(order), fn, schema)
        return G.per_block(df, SERIES, ["timestamp"], F.to_date("timestamp"), back, fn, schema, 512).withColumn("t", F.unix_timestamp("timestamp"))

    return run


def _acf(spark, sf_dir):
    r = _rows(spark, sf_dir)
    m = r.groupBy("series").agg(F.avg("r").alias("m"), F.count("*").alias("n"), (F.var_pop("r") * F.count("*")).alias("ss"))
    d = in_blocks(r.join(m, "series").withColumn("d", C("r") - C("m")), 6)
    lagged = d.select("series", "n", "ss", O.OWN, *[(C("d") * F.lag("d", k).over(BW())).alias(f"p{k}") for k in range(1, 7)])
    s = lagged.where(O.OWN).groupBy("series", "n", "ss").agg(*[F.sum(f"p{k}").alias(f"p{k}") for k in range(1, 7)])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), (C(f"p{k}") / C("ss")).alias("acf")) for k in range(1, 7)])).alias("x")
    out = s.select("series", "n", rows).select("series", "n", "x.*")
    q = C("n") * (C("n") + 2) * F.sum(C("acf") ** 2 / (C("n") - C("lag"))).over(W.partitionBy("series").orderBy("lag"))
    return out.select("*", q.alias("ljung_box"), (F.lit(1.959963984540054) / F.sqrt("n")).alias("band"))


add("autocorrelation_ljung_box", _acf, with_("""SELECT series, n, lag::INT AS lag, acf, n * (n + 2) * sum(acf * acf / (n - lag)) OVER (PARTITION BY series ORDER BY lag) AS ljung_box, 1.959963984540054 / sqrt(n) AS band FROM (
  SELECT series, lag, any_value(n) AS n, sum(p) / any_value(ss) AS acf FROM (SELECT series, n, ss, unnest([1, 2, 3, 4, 5, 6]) AS lag, unnest([d * lag(d, 1) OVER w, d * lag(d, 2) OVER w, d * lag(d, 3) OVER w, d * lag(d, 4) OVER w, d * lag(d, 5) OVER w, d * lag(d, 6) OVER w]) AS p
  FROM (SELECT *, r - avg(r) OVER (PARTITION BY series) AS d, count(*) OVER (PARTITION BY series) AS n, var_pop(r) OVER (PARTITION BY series) * count(*) OVER (PARTITION BY series) AS ss FROM returns WHERE r IS NOT NULL) WINDOW w AS (PARTITION BY series ORDER BY t)) GROUP BY 1, 2)""", RETURNS_SQL),
    ["series", "n", "lag"], ["acf", "ljung_box", "band"])


def _day():
    return F.to_date("timestamp")


add("stationarity_tests", lambda s, d: MO.stationarity(_rows(s, d).withColumn("x", F.ln("close")), SERIES, ["timestamp"], _day(), "x", block_rows=512), None, ["series", "n", "adf_lags", "kpss_lags", "verdict"], ["adf", "adf_p", "kpss", "kpss_p"])
add("stationarity_by_period", lambda s, d: MO.stationarity(_rows(s, d).withColumn("week", week()), [*SERIES, "week"], ["timestamp"], _day(), "r", least=61, block_rows=512), None, ["series", "week", "n", "verdict"], ["adf"])
add("ewma_volatility", lambda s, d: SC.ewma(_rows(s, d), SERIES, ["timestamp"], F.to_date("timestamp"), "r", 0.94, 20, 512).withColumn("t", F.unix_timestamp("timestamp")),
    with_("""SELECT series, t, lagged, current FROM (WITH RECURSIVE s AS (SELECT series, t, r, row_number() OVER (PARTITION BY series ORDER BY t) AS k FROM returns WHERE r IS NOT NULL),
      seed AS (SELECT series, var_samp(r) FILTER (WHERE k <= 20) AS v, avg(r * r) FILTER (WHERE k <= 50) AS c FROM s GROUP BY 1),
      l AS (SELECT series, 21::BIGINT AS k, v FROM seed UNION ALL SELECT l.series, l.k + 1, 0.94 * l.v + 0.06 * s.r * s.r FROM l JOIN s ON s.series = l.series AND s.k = l.k),
      m AS (SELECT series, 50::BIGINT AS k, c FROM seed UNION ALL SELECT m.series, m.k + 1, 0.94 * m.c + 0.06 * s.r * s.r FROM m JOIN s ON s.series = m.series AND s.k = m.k + 1)
      SELECT s.series, s.t, sqrt(l.v) AS lagged, m.c AS current FROM s LEFT JOIN l USING (series, k) LEFT JOIN m USING (series, k))""", RETURNS_SQL), ["series", "t"], ["lagged", "current"])  # fmt: skip
add("variance_recursion", lambda s, d: SC.variance_path(_rows(s, d), SERIES, ["timestamp"], F.to_date("timestamp"), "r", 0.01, 0.1, 0.85, 1.0, 512).withColumn("t", F.unix_timestamp("timestamp")),
    with_("""SELECT series, t, h FROM (WITH RECURSIVE s AS (SELECT series, t, r, row_number() OVER (PARTITION BY series ORDER BY t) AS k FROM returns WHERE r IS NOT NULL),
      v AS (SELECT DISTINCT series, 1::BIGINT AS k, 1.0::DOUBLE AS h FROM s UNION ALL SELECT v.series, v.k + 1, 0.01 + 0.1 * s.r * s.r + 0.85 * v.h FROM v JOIN s ON s.series = v.series AND s.k = v.k) SELECT s.series, s.t, v.h FROM s JOIN v USING (series, k))""", RETURNS_SQL), ["series", "t"], ["h"])  # fmt: skip


def _gap():
    return F.unix_timestamp("timestamp") - F.unix_timestamp("__before") > 3600


add("local_level_filter", lambda s, d: SC.local_level(_rows(s, d).withColumn("y", F.ln("close")), SERIES, ["timestamp"], F.to_date("timestamp"), "y", 0.05, 0.5, _gap(), 512).withColumn("t", F.unix_timestamp("timestamp")),
    with_("""SELECT series, t, level, variance FROM (WITH RECURSIVE s AS (SELECT series, t, ln(close) AS y, row_number() OVER (PARTITION BY series ORDER BY t) AS k, t - lag(t) OVER (PARTITION BY series ORDER BY t) AS gap FROM returns WHERE r IS NOT NULL),
      f AS (SELECT series, k, t, y AS level, 0.5::DOUBLE AS variance FROM s WHERE k = 1 UNION ALL
        SELECT s.series, s.k, s.t, CASE WHEN s.gap > 3600 THEN s.y ELSE f.level + (f.variance + 0.05) / (f.variance + 0.55) * (s.y - f.level) END, CASE WHEN s.gap > 3600 THEN 0.5 ELSE 0.5 * (f.variance + 0.05) / (f.variance + 0.55) END
        FROM f JOIN s ON s.series = f.series AND s.k = f.k + 1) SELECT * FROM f)""", RETURNS_SQL), ["series", "t"], ["level", "variance"])  # fmt: skip
_SPEC = ["entropy", "flatness", "centroid", "dominant_period", "amplitude", "phase", "band_2_6", "band_6_16", "band_16_64"]
add("rolling_spectrum", _kernel(lambda f: pd.DataFrame(SP.rolling_spectrum(f["r"].to_numpy(), 64)), ", ".join(f"{c} double" for c in _SPEC), 63), None, ["series", "t"], _SPEC)
_WAVE = ["share_1", "share_2", "share_3", "entropy", "dominant"]
add("rolling_wavelet", _kernel(lambda f: pd.DataFrame(SP.rolling_wavelet(f["r"].to_numpy(), 64, "haar", 3)), ", ".join(f"{c} double" for c in _WAVE), 80), None, ["series", "t"], _WAVE)


def _haar(f):
    w, full = SP.causal_modwt(f["r"].to_numpy(), "haar", 2)
    return pd.DataFrame({f"w{k + 1}": np.where(full[k], w[k], np.nan) for k in range(2)})


add("causal_modwt_haar", _kernel(_haar, "w1 double, w2 double", 3), with_("SELECT series, t, (r - lag(r) OVER w) / 2 AS w1, (r + lag(r) OVER w - lag(r, 2) OVER w - lag(r, 3) OVER w) / 4 AS w2 FROM returns WHERE r IS NOT NULL WINDOW w AS (PARTITION BY series ORDER BY t)", RETURNS_SQL), ["series", "t"], ["w1", "w2"])
add("wavelet_multiresolution", lambda s, d: WV.multiresolution(_rows(s, d).withColumn("x", F.ln("close")), SERIES, ["timestamp"], _day(), "x", "sym4", 3, 512).select("*", T0()), None, ["series", "t"], ["d0", "d1", "d2", "d3"])
add("circular_modwt_haar", lambda s, d: WV.circular_modwt(_rows(s, d), SERIES, ["timestamp"], _day(), "r", "haar", 2, 512).select("*", T0()),
    with_("""SELECT a.series, a.t, (a.r - b.r) / 2 AS w1, (a.r + b.r - c.r - d.r) / 4 AS w2, (a.r + b.r + c.r + d.r) / 4 AS v FROM n a
      JOIN n b ON b.series = a.series AND b.k = (a.k - 1 + 4 * a.n) % a.n JOIN n c ON c.series = a.series AND c.k = (a.k - 2 + 4 * a.n) % a.n JOIN n d ON d.series = a.series AND d.k = (a.k - 3 + 4 * a.n) % a.n""",
      RETURNS_SQL, "n AS (SELECT series, t, r, row_number() OVER (PARTITION BY series ORDER BY t) - 1 AS k, count(*) OVER (PARTITION BY series) AS n FROM returns WHERE r IS NOT NULL)"), ["series", "t"], ["w1", "w2", "v"])
add("cwt_ridges", lambda s, d: WV.ridges(_rows(s, d), SERIES, ["timestamp"], _day(), "r", list(np.geomspace(4, 64, 16)), 2.0, 12, 512), None, ["series", "start", "end", "length"], ["scale", "ratio"])
add("spectral_extrapolation", _kernel(lambda f: pd.DataFrame(SP.extrapolation_errors(np.log(f["close"].to_numpy()), np.arange(63, len(f), 16), 64, 3, (1, 4)), columns=["horizon", "windows", "rmse", "naive"]), "horizon long, windows long, rmse double, naive double"), None, ["series", "horizon", "windows"], ["rmse", "naive"])
add("bootstrap_mean_ci", lambda s, d: RS.bootstrap_mean(_rows(s, d), SERIES, ["series", "timestamp"], "r", 200), None, ["series"], ["mean", "low", "high"])


def _halves():
    return F.floor(C(O.INDEX) * 2 / C("__rows"))


add("block_bootstrap", lambda s, d: RS.block_bootstrap(_rows(s, d), SERIES, ["timestamp"], _day(), _halves(), "r", 20, 5, 200, block_rows=512), None, ["series"], ["mean", "low", "high"])
add("change_points", _kernel(lambda f: pd.DataFrame({"start": SR.pelt_mean(np.log(f["close"].to_numpy()))}), "start long"), None, ["series", "start"])


def _null_tests(f):
    x, y = f["r"].abs().to_numpy()[:-1], f["r"].abs().to_numpy()[1:]
    real = np.corrcoef(x, y)[0, 1]
    s, p = SR.circular_shift_null(x, y, 100, 0.1, 7), SR.permutation_null(x, y, 100, 7)
    return pd.DataFrame({"real": [real], "shift_p": [(1 + (np.abs(s) >= abs(real)).sum()) / 101], "permutation_p": [(1 + (np.abs(p) >= abs(real)).sum()) / 101]})


add("null_tests", _kernel(_null_tests, "real double, shift_p double, permutation_p double"), None, ["series"], ["real", "shift_p", "permutation_p"])
add("surrogate_controls", _kernel(lambda f: pd.DataFrame([(k, float(np.std(SR.surrogate(k, f["r"].to_numpy(), 7)))) for k in ("random_walk", "shuffled", "block_bootstrap", "white_noise", "ar_noise")], columns=["kind", "std"]), "kind string, std double"), None, ["series", "kind"], ["std"])


add("segmented_hac", lambda s, d: MO.lag_regression(_rows(s, d), SERIES, ["timestamp"], _day(), "r", 3600, 5, 512), with_("""SELECT series, any_value(slope) AS slope, any_value(ols_se) AS ols_se, sqrt(greatest(sum(v * v) + 2 * (""" + " + ".join(f"{1 - k / 6} * coalesce(sum(CASE WHEN t - t{k} = {k * 3600} THEN v * v{k} END), 0)" for k in range(1, 6)) + """), 0)) AS hac_se
  FROM (SELECT series, t, slope, ols_se, v, """ + ", ".join(f"lag(v, {k}) OVER w AS v{k}, lag(t, {k}) OVER w AS t{k}" for k in range(1, 6)) + """ FROM (SELECT series, t, slope, sqrt((syy - slope * sxy) / greatest(n - 2, 1) * n / det) AS ols_se, (y - a - slope * l) * (n * l - sl) / det AS v FROM p JOIN
    (SELECT series, slope, a, syy, sxy, n, sl, n * sll - sl * sl AS det FROM (SELECT series, regr_slope(y, l) AS slope, regr_intercept(y, l) AS a, regr_syy(y, l) AS syy, regr_sxy(y, l) AS sxy, count(*)::DOUBLE AS n, sum(l) AS sl, sum(l * l) AS sll FROM p WHERE l IS NOT NULL GROUP BY 1)) USING (series) WHERE l IS NOT NULL)
  WINDOW w AS (PARTITION BY series ORDER BY t)) GROUP BY 1""", RETURNS_SQL + ",\np AS (SELECT series, t, r AS y, lag(r) OVER (PARTITION BY series ORDER BY t) AS l FROM returns WHERE r IS NOT NULL)"), ["series"], ["slope", "ols_se", "hac_se"])  # fmt: skip
add("theil_sen", _kernel(lambda f: pd.DataFrame({"slope": SR.rolling_theil_sen(np.log(f["close"].to_numpy()), 64)}), "slope double", 63),
    with_("""SELECT w.series, w.t, CASE WHEN any_value(w.i) >= 64 THEN median((b.y - a.y) / (b.i - a.i)) END AS slope FROM s w LEFT JOIN s a ON a.series = w.series AND a.i BETWEEN w.i - 63 AND w.i AND w.i >= 64
  LEFT JOIN s b ON b.series = w.series AND b.i > a.i AND b.i <= w.i GROUP BY ALL""", RETURNS_SQL + ",\ns AS (SELECT series, t, ln(close) AS y, row_number() OVER (PARTITION BY series ORDER BY t) AS i FROM returns WHERE r IS NOT NULL)"), ["series", "t"], ["slope"])  # fmt: skip

# Models.
_FE = ["mom", "vol", "act"]


def design(spark, sf_dir):
    """Features, outcome and row number within the series, of all series."""
    r = in_blocks(returns(spark, sf_dir), 24, 1)
    f = r.select("series", "timestamp", O.INDEX, O.BLOCK, O.OWN, "r", WN.rolling_mean(C("r"), BW(), 6).alias("mom"), WN.rolling_std(C("r"), BW(), 24).alias("vol"), F.ln("tick_count").alias("act"), F.lead("r").over(BW()).alias("y"))
    return f.where(O.OWN).withColumn("i", C(O.INDEX)).drop(O.INDEX, O.BLOCK, O.OWN).where("vol IS NOT NULL AND y IS NOT NULL").withColumn("up", (C("y") > 0).cast("double"))


def _log_size(spark, sf_dir):
    """Log size of returns with the row's number and its series' rows."""
    rows = _rows(spark, sf_dir).select("series", "timestamp", F.ln(F.abs("r") + 1e-3).alias("x"))
    numbered = written(O.number_rows(rows, SERIES, ["timestamp"], _day(), "i"))
    return O.beside(numbered, numbered.groupBy(*SERIES).agg(F.count("*").alias("n")), SERIES)


def _packed(df):
    return H.pack(df, SERIES, ["timestamp"], _day(), ["x"], F.unix_timestamp("timestamp"), 512)


def _hmm(spark, sf_dir):
    """Fitted and scaled on the first two thirds of each series, filtered forward over all of it."""
    rows = _log_size(spark, sf_dir)
    seen = C("i") < F.floor(C("n") * 2 / 3)
    q = small_side(Q.exact_quantiles(rows.where(seen), SERIES, {"q": C("x")}, (0.25, 0.5, 0.75), held=True))
    spread = (C("q")[2] - C("q")[0]) / 1.349
    z = (C("x") - C("q")[1]) / F.when(spread > 0, spread).otherwise(1.0)
    scaled = O.beside(rows, q, SERIES).withColumn("x", F.greatest(F.lit(-5.0), F.least(F.lit(5.0), z)))
    model = H.Model(_packed(scaled.where(seen)), SERIES, 2, 1)
    return model.filtered(model.fit("diag", 20), _packed(scaled)).select("series", "t", C("state").cast("long").alias("state"), C("p")[1].alias("p1"))


def _viterbi(spark, sf_dir):
    model = H.Model(_packed(_log_size(spark, sf_dir)), SERIES, 2, 1)
    params = model.fit("full", 20)
    found = model.smoothed(params).groupBy("series").agg(F.avg("path").alias("share"), F.avg((C("state") == C("path")).cast("double")).alias("agree"))
    return O.beside(found, params.select("series", C("ll").alias("log_likelihood")), SERIES)


add("hmm_causal_filter", _hmm, None, ["series", "t", "state"], ["p1"])
add("hmm_viterbi_smoothing", _viterbi, None, ["series"], ["share", "agree", "log_likelihood"])
add("kmeans_states", lambda s, d: L.kmeans_states(design(s, d), _FE, 3).groupBy("state").agg(F.count("*").alias("n"), F.avg("vol").alias("vol")), None, ["state", "n"], ["vol"])
add("mixture_states", lambda s, d: L.mixture_states(design(s, d), _FE, 2).groupBy("state").agg(F.count("*").alias("n"), F.avg(C("posterior")[0]).alias("p0")), None, ["state", "n"], ["p0"])
add("principal_components", lambda s, d: L.principal_components(design(s, d), design(s, d), _FE, 2).select("series", "i", F.abs("pc_1").alias("a1"), F.abs("pc_2").alias("a2")), None, ["series", "i"], ["a1", "a2"])


def _linear(spark, sf_dir):
    q, c, n = G.gram_sums(design(spark, sf_dir), _FE, "y")
    r = M.ridge(q, c, 0.1)
    path = M.lasso_path(q, c)
    cond, vif = M.collinearity(q)
    rows = [(f, n, float(c[k]), float(r[k]), float(path[-1][1][k]), float(vif[k]), cond) for k, f in enumerate(_FE)]
    return spark.createDataFrame(rows, "feature string, n long, corr double, ridge double, lasso double, vif double, condition double")


add("linear_on_gram", _linear, None, ["feature", "n"], ["corr", "ridge", "lasso", "vif", "condition"])


def _selection(spark, sf_dir):
    from tidemark.operators.ranking import ic_ranking_order as order
    from tidemark.operators.ranking import mrmr

    d = design(spark, sf_dir)
    corr = np.abs(G.pairwise_correlation(d, [*_FE, "y"]))
    rel, red = corr[:-1, -1], corr[:-1, :-1]
    pick, by_ic = mrmr(rel, red, 3), order(rel, 3)
    lab = M.clusters(red, 0.5)
    return spark.createDataFrame([(f, pick.index(k), by_ic.index(k), int(lab[k]), float(rel[k])) for k, f in enumerate(_FE)], "feature string, mrmr long, ic_rank long, cluster long, relevance double")


add("feature_selection", _selection, None, ["feature", "mrmr", "ic_rank", "cluster"], ["relevance"])
_DES = RETURNS_SQL + """,
des AS (SELECT * FROM (SELECT t, i, CASE WHEN count(r) OVER a = 6 THEN avg(r) OVER a END AS mom, CASE WHEN count(r) OVER b = 24 THEN stddev_samp(r) OVER b END AS vol, ln(tick_count) AS act, lead(r) OVER (PARTITION BY series ORDER BY t) AS y
  FROM returns WINDOW a AS (PARTITION BY series ORDER BY t ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), b AS (PARTITION BY series ORDER BY t ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)) WHERE vol IS NOT NULL AND y IS NOT NULL)"""


def _pairwise(spark, sf_dir):
    c = G.pairwise_correlation(design(spark, sf_dir), [*_FE, "y"])
    names = [*_FE, "y"]
    return spark.createDataFrame([(names[i], names[j], float(c[i, j])) for i in range(4) for j in range(i + 1, 4)], "a string, b string, corr double")


add("pairwise_correlation", _pairwise, with_(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr FROM des" for k, a in enumerate([*_FE, "y"]) for b in [*_FE, "y"][k + 1 :]), _DES), ["a", "b"], ["corr"])


def _walk(spark, sf_dir):
    d = design(spark, sf_dir)
    n = d.agg(F.max("i")).first()[0] + 1
    folds = M.walk_forward_folds(n, n // 6, 2, 1, 2)
    out = None
    for f in folds:
        for kind in ("constant", "logistic_l2", "boosted"):
            p = L.run_fold(d, "i", f, _FE, "up", kind, "classification").select("fold", F.lit(kind).alias("kind"), "i", "p", "up")
            out = p if out is None else out.union(p)
    return out.groupBy("fold", "kind").agg(F.count("*").alias("n"), F.avg((C("p") - C("up")) ** 2).alias("brier"), F.avg(C("p")).alias("mean_p"))


add("walk_forward_models", _walk, None, ["fold", "kind", "n"], ["brier", "mean_p"])


def _ols_model(spark, sf_dir):
    d = design(spark, sf_dir)
    return L.predict(L.fit(d, _FE, "y", "ols", "regression"), d, "regression").agg(F.count("*").alias("n"), S.corr("p", "y").alias("corr"), F.avg("p").alias("mean"))


add("regression_model", _ols_model, None, ["n"], ["corr", "mean"])


def _ensemble(spark, sf_dir):
    d = returns(spark, sf_dir).where("r IS NOT NULL").select("series", T0(), C("r").alias("y"), (C("close") / 500).alias("p1"), F.when(C("tick_count") > 2, C("tick_count") / 20.0).alias("p2"), F.lit(0.4).alias("p3"))
    w = {"p1": 0.5, "p2": 0.3, "p3": 0.2}
    num = sum((F.coalesce(C(k) * v, F.lit(0.0)) for k, v in w.items()), F.lit(0.0))
    den = sum((F.when(C(k).isNotNull(), v).otherwise(0.0) for k, v in w.items()), F.lit(0.0))
    held = F.array_compact(F.array(*w))
    n = F.size(held)
    ordered = F.array_sort(held)
    med = (F.element_at(ordered, F.floor((n + 1) / 2).cast("int")) + F.element_at(ordered, F.floor((n + 2) / 2).cast("int"))) / 2
    mean = F.aggregate(held, F.lit(0.0), lambda s, x: s + x) / n
    sd = F.sqrt(F.aggregate(held, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / n)
    return d.select("series", "t", (num / den).alias("weighted"), med.alias("median"), sd.alias("std"), (F.array_max(held) - F.array_min(held)).alias("range"))


add("ensemble_combinations", _ensemble, with_("SELECT series, t, (0.5 * p1 + coalesce(0.3 * p2, 0) + 0.2 * p3) / (0.7 + CASE WHEN p2 IS NULL THEN 0 ELSE 0.3 END) AS weighted, list_median([x for x in [p1, p2, p3] if x IS NOT NULL]) AS median, list_stddev_pop([x for x in [p1, p2, p3] if x IS NOT NULL]) AS std, greatest(p1, p2, p3) - least(p1, p2, p3) AS range FROM (SELECT series, t, close / 500 AS p1, CASE WHEN tick_count > 2 THEN tick_count / 20.0 END::DOUBLE AS p2, 0.4::DOUBLE AS p3 FROM returns WHERE r IS NOT NULL)", RETURNS_SQL), ["series", "t"], ["weighted", "median", "std", "range"])
add("ensemble_weights", _kernel(lambda f: _weights(f), "day long, w1 double, w2 double"), None, ["series", "day"], ["w1", "w2"])


def _weights(f):
    t = f["timestamp"].astype("datetime64[s]").astype("int64").to_numpy()
    r = f["r"].to_numpy()
    loss = np.c_[(r - np.r_[0, r[:-1]] * -0.5) ** 2, (r - r.mean() * 0) ** 2]
    days = np.unique(t // 86_400)
    w = M.dynamic_weights(t // 86_400, (t + 7_200) // 86_400, loss, r**2 * 1.5, days, 10, 30)
    return pd.DataFrame({"day": days, "w1": w[:, 0], "w2": w[:, 1]})


add("ensemble_diversity", _kernel(lambda f: pd.DataFrame(M.diversity(1 / (1 + np.exp(-np.c_[f["close"] / 100 - 1, f["r"], -f["r"]])), (f["r"] > 0).to_numpy().astype(int))), "i long, j long, q double, disagreement double, corr double"), None, ["series", "i", "j"], ["q", "disagreement", "corr"])
add("garch_fit", _kernel(lambda f: pd.DataFrame([M.fit_garch([f["r"].to_numpy()], 100, 60)])[["omega", "alpha", "beta"]], "omega double, alpha double, beta double"), None, ["series"], ["omega", "alpha", "beta"])


def _filters(f):
    t = f["timestamp"].astype("datetime64[s]").astype("int64").to_numpy()
    y = np.log(f["close"].to_numpy())
    level, var = M.local_level(y, np.r_[True, np.diff(t) > 3600], 0.05, 0.5)
    err = y - np.r_[y[0], level[:-1]]
    width, rate = M.delayed_intervals(err, np.arange(len(y)) + 3, 0.1, 0.01, 200, 50)
    up, down, alarm = M.cusum((err - err.mean()) / err.std(), 0.5, 5.0)
    return pd.DataFrame({"t": t, "level": level, "variance": var, "width": width, "rate": rate, "up": up, "down": down, "alarm": alarm})


add("level_intervals_cusum", _kernel(_filters, "t long, level double, variance double, width double, rate double, up double, down double, alarm boolean"), None, ["series", "t", "alarm"], ["level", "variance", "width", "rate", "up", "down"])

# Event simulation.


def _sim_ticks(spark, sf_dir):
    return ticks(spark, sf_dir).select("series", C("ts").alias("timestamp"), "seq", "bid", "ask", "mid")


def _execution(spark, sf_dir, scenarios):
    side = F.when((C("mid") > 100) & ~F.isnan("mid"), -1).otherwise(1)  # every tick is an order
    rules = SM.ExecutionRules(latency=1, expiry=7200, max_gap=14_400, holding=3 * 3600, commission=0.01)
    return EX.Execution(_sim_ticks(spark, sf_dir).withColumn("side", side), SERIES, {n: (s, rules) for n, s in scenarios.items()})


_STRESS = {"base": SM.Scenario(), "wide": SM.Scenario(spread=3.0), "slow": SM.Scenario(latency=600.0), "outage": SM.Scenario(outage=(1704500000.0, 1704800000.0)), "missed": SM.Scenario(missed=0.3)}
_BASE = {"base": SM.Scenario()}
add("execution_fills", lambda s, d: _execution(s, d, _BASE).fills(), None, ["series", "kind", "order", "side"], ["ts", "price"])
add("execution_marks", lambda s, d: _execution(s, d, _BASE).marks(), None, ["series", "position"], ["ts", "equity", "drawdown"])
add("execution_stress", lambda s, d: _execution(s, d, _STRESS).totals(), None, ["series", "scenario", "events", "opened"], ["equity"])


def _risk(spark, sf_dir):
    t, seq = F.unix_timestamp("timestamp"), C("seq")
    rows = _sim_ticks(spark, sf_dir).select("series", "timestamp", "seq", t.alias("t"), F.concat(F.lit("i"), F.floor(seq / 2)).alias("intent"), (1.0 + seq % 3).alias("size"),
        F.lit(0.0).alias("exposure"), (10_000 + C("mid") / 10).alias("equity"), (seq % 3 == 0).alias("observed"))
    limits = {"max_size": 3.0, "max_daily_loss": 50.0, "max_drawdown": 0.02, "max_rate": 3, "stale_after": 90_000}
    return RK.decisions(rows, SERIES, ["timestamp", "seq"], F.floor(C("t") / 86_400), t="t", intent="intent", size="size", exposure="exposure", equity="equity", observed="observed", **limits)


add("risk_decisions", _risk, None, ["series", "seq", "ok", "reason"])
add("intent_states", _kernel(lambda f: pd.DataFrame({"t": f["timestamp"].astype("datetime64[s]").astype("int64"), "state": SM.intent_states(np.where(np.abs(f["r"]) > 1, f["r"], 0), 3, 2)}), "t long, state string"), None, ["series", "t", "state"])


def _decisions(spark, sf_dir):
    side, reason = SM.decide(C("r"), C("mean_spread"), 0.3, 0.045)
    return returns(spark, sf_dir).select("series", T0(), reason.alias("reason"), side.alias("side"))


add("policy_decisions", _decisions, with_("SELECT series, t, reason, CASE WHEN reason = 'ok' THEN sign(r)::INT ELSE 0 END AS side FROM (SELECT *, CASE WHEN r IS NULL THEN 'no_forecast' WHEN mean_spread > 0.045 THEN 'wide_spread' WHEN abs(r) < 0.3 THEN 'weak_signal' ELSE 'ok' END AS reason FROM returns)", RETURNS_SQL), ["series", "t", "reason", "side"])


def _stressed(t):
    bid, ask = SM.Scenario(spread=3.0).widen(C("bid"), C("ask"))
    return t.select("series", "seq", bid.alias("bid"), ask.alias("ask"))


add("stress_quotes", lambda s, d: _stressed(ticks(s, d)), with_("SELECT series, seq, mid - spread * 1.5 AS bid, mid + spread * 1.5 AS ask FROM ticks", TICKS_SQL), ["series", "seq"], ["bid", "ask"])


def _allocation(spark, sf_dir):
    r = returns(spark, sf_dir).where("series IN ('view', 'click', 'error')").groupBy("timestamp").pivot("series", ["view", "click", "error"]).agg(F.first("r")).dropna()
    names = ["view", "click", "error"]
    row = r.agg(*[F.covar_samp(a, b) for a in names for b in names]).first()
    w = M.minimum_variance(np.array(list(row), float).reshape(3, 3))
    return spark.createDataFrame([(n, float(x)) for n, x in zip(names, w, strict=True)], "series string, weight double")


add("minimum_variance", _allocation, None, ["series"], ["weight"])


def _folds(spark, sf_dir):
    r = returns(spark, sf_dir).where("r IS NOT NULL").groupBy(week().alias("fold")).agg(F.count("*").alias("trades"), F.sum("r").alias("pnl"))
    w = W.orderBy("fold")
    eq = r.select("*", (10_000 + F.sum("pnl").over(w)).alias("equity"))
    return eq.select("*", (C("equity") / F.greatest(F.lit(10_000.0), F.max("equity").over(w)) - 1).alias("drawdown"))


add("aggregate_folds", _folds, with_("SELECT *, equity / greatest(10000, max(equity) OVER (ORDER BY fold)) - 1 AS drawdown FROM (SELECT fold, trades, pnl, 10000 + sum(pnl) OVER (ORDER BY fold) AS equity FROM (SELECT week(timestamp)::BIGINT AS fold, count(*) AS trades, sum(r) AS pnl FROM returns WHERE r IS NOT NULL GROUP BY 1))", RETURNS_SQL), ["fold", "trades"], ["pnl", "equity", "drawdown"])

# Streams over the event table, run to the end of what is there.


def _stream(spark, sf_dir):
    plain = table(spark, sf_dir, "events")
    e = spark.readStream.schema(plain.schema).parquet(f"{sf_dir.rstrip('/')}/events.parquet*")
    return e.select(C("event_type").alias("series"), C("event_id").alias("seq"), C("ts").cast("timestamp").alias("ts"), C("value").alias("mid"))


def _shared(spark):
    """A fresh folder that all executors share."""
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def _replayed(make):
    def run(spark, sf_dir):
        at = _shared(spark)
        return SB.replay(make(_stream(spark, sf_dir)), f"{at}/out", f"{at}/state")

    return run


add("stream_bars", lambda s, d: _replayed(lambda t: SB.stream_bars(t, "1h", "10 minutes"))(s, d).select("*", T0()),
    with_("SELECT series, t, tick_count, open, high, low, close FROM bars WHERE t + 3600 <= (SELECT epoch(max(ts)) FROM ticks) - 600", BARS_SQL), ["series", "t", "tick_count"], ["open", "high", "low", "close"])
add("stream_late_split", _replayed(lambda t: SB.split_late(t.withColumn("ts", F.when(C("seq") % 50 == 0, C("ts") - F.expr("INTERVAL 5 HOURS")).otherwise(C("ts"))), "1h", 600)),
    with_("""SELECT series, seq, CASE WHEN epoch_us(ts) - epoch_us(ts) % 3600000000 + 3600000000 <= max(epoch_us(ts)) OVER (PARTITION BY series ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 600000000 THEN 'late' ELSE 'ok' END AS status
      FROM (SELECT series, seq, CASE WHEN seq % 50 = 0 THEN ts - INTERVAL 5 HOUR ELSE ts END AS ts FROM ticks)""", TICKS_SQL), ["series", "seq", "status"])  # fmt: skip
add("stream_deduplicated", _replayed(lambda t: t.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2)))).withWatermark("ts", "1 hour").dropDuplicates(["series", "seq", "ts"]).drop("k")),
    with_("SELECT series, seq, mid FROM ticks", TICKS_SQL), ["series", "seq"], ["mid"])


def _stream_features(spark, sf_dir):
    at = _shared(spark)
    SB.replay(SB.stream_bars(_stream(spark, sf_dir), "1h", "10 minutes"), f"{at}/bars", f"{at}/s1")
    b = spark.read.parquet(f"{at}/bars")
    f = spark.readStream.schema(b.schema).parquet(f"{at}/bars")
    return SB.replay(SB.stream_features(f, 6), f"{at}/features", f"{at}/s2").select("*", T0())


add("stream_features", _stream_features, with_("SELECT series, t, close, ln(close / lag(close) OVER (PARTITION BY series ORDER BY t)) AS r, mean, std, (close - mean) / nullif(std, 0) AS z FROM (SELECT *, CASE WHEN count(*) OVER w = 6 THEN avg(close) OVER w END AS mean, CASE WHEN count(*) OVER w = 6 THEN stddev_samp(close) OVER w END AS std FROM bars WHERE t + 3600 <= (SELECT epoch(max(ts)) FROM ticks) - 600 WINDOW w AS (PARTITION BY series ORDER BY t ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))", BARS_SQL), ["series", "t"], ["close", "r", "mean", "std", "z"])


def _ingested(spark, sf_dir):
    t = _stream(spark, sf_dir)
    # Polls of 50 rows that each repeat the last second of the poll before.
    poll = F.explode(F.when(C("seq") % 50 == 49, F.array(F.floor(C("seq") / 50), F.floor(C("seq") / 50) + 1)).otherwise(F.array(F.floor(C("seq") / 50)))).alias("batch")
    rows = t.select(F.lit("all").alias("series"), poll, "seq", "ts", (C("mid") - 0.01).alias("bid"), (C("mid") + 0.01).alias("ask"), (C("ts") + F.expr("INTERVAL 1 SECOND") * F.when(C("seq") % 500 == 3, -10).otherwise(1)).alias("received"))
    at = _shared(spark)
    return SB.ingest(rows, f"{at}/out", f"{at}/state").groupBy("seq", "status").agg(F.count("*").alias("n"))


add("stream_ingest_overlap", _ingested, with_("SELECT seq, CASE WHEN seq % 500 = 3 THEN 'future' ELSE 'new' END AS status, 1::BIGINT AS n FROM ticks UNION ALL SELECT seq, 'repeat', 1 FROM ticks WHERE seq % 50 = 49", TICKS_SQL), ["seq", "status", "n"])


def _equal(spark, sf_dir):
    """Bars by which of the two runs has them: only one, or both."""
    run = _replayed(lambda t: SB.stream_bars(t, "1h", "10 minutes"))(spark, sf_dir)
    batch = bars(spark, sf_dir).where(F.unix_timestamp("timestamp") + 3600 <= F.lit(_last(spark, sf_dir)) - 600).select(*run.columns)
    parted = SB.compare_runs(run, batch).select("only_in", *run.columns)
    return parted.union(run.intersectAll(batch).select(F.lit("neither").alias("only_in"), *run.columns)).select("*", T0())


add("stream_equals_batch", _equal, with_("SELECT 'neither' AS only_in, series, t, tick_count, open, high, low, close FROM bars WHERE t + 3600 <= (SELECT epoch(max(ts)) FROM ticks) - 600", BARS_SQL),
    ["only_in", "series", "t", "tick_count"], ["open", "high", "low", "close"])


def _last(spark, sf_dir):
    return ticks(spark, sf_dir).agg(F.max(F.unix_micros("ts")) / 1e6).first()[0]
