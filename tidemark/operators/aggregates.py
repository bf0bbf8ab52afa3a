"""Distribution, calendar, conditional and information statistics as partial/final aggregations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import ordering as O
from tidemark.operators.bars import month_block
from tidemark.operators.selection import exact_quantiles, with_quantiles
from tidemark.operators.validate import iso_weekday
from tidemark.session import small_side, written

#: Quantiles of a distribution report.
QUANTILES = (0.001, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.975, 0.99, 0.999)


def qname(q: float) -> str:
    return "q" + f"{q:g}".replace("0.", "")


def corrected_skew(x, n) -> Column:
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0)))


def corrected_kurtosis(x, n) -> Column:
    return F.when(n > 3, ((n + 1) * F.kurtosis(x) + 6) * (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0)))


def describe_distribution(df: DataFrame, x: str, by: list[str], quantiles=QUANTILES) -> DataFrame:
    """Moments (bias corrected) and linear quantiles of a column."""
    n = F.count(x)
    df = written(df.select(*by, x))
    out = df.groupBy(*by).agg(
        n.alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"),
        corrected_skew(x, n).alias("skew"), corrected_kurtosis(x, n).alias("kurtosis"),
    )
    return with_quantiles(out, df, by, {"x": (F.col(x), {qname(p): p for p in quantiles})}, held=True)


def gaussian_tails(df: DataFrame, x: str, by: list[str], levels=(1, 2, 3, 4)) -> DataFrame:
    """Share of values beyond k standard deviations against the Gaussian share."""
    base = df.where(F.col(x).isNotNull())
    m = base.groupBy(*by).agg(F.avg(x).alias("m"), F.stddev_samp(x).alias("s"), F.count(x).alias("n"))
    joined = base.join(F.broadcast(m) if not by else m, by or None, "cross" if not by else "inner")
    hits = joined.groupBy(*by).agg(F.first("n").alias("n"), *[F.sum((F.abs(F.col(x) - F.col("m")) > k * F.col("s")).cast("long")).alias(f"h{k}") for k in levels])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("sigma"), F.col(f"h{k}").alias("hits"), F.lit(math.erfc(k / math.sqrt(2))).alias("gaussian")) for k in levels]))
    out = hits.select(*by, "n", rows.alias("r")).select(*by, "n", "r.*")
    return out.select("*", (F.col("hits") / F.col("n")).alias("rate"), (F.col("hits") / F.col("n") / F.col("gaussian")).alias("ratio"))


def normality(df: DataFrame, x: str, by: list[str]) -> DataFrame:
    """Jarque-Bera and D'Agostino K2 with p-values (chi-square of two degrees)."""
    n = F.count(x).cast("double")
    a = df.groupBy(*by).agg(n.alias("n"), F.skewness(x).alias("s"), F.kurtosis(x).alias("k"))
    c = lambda v: F.col(v)
    jb = c("n") / 6 * (c("s") ** 2 + c("k") ** 2 / 4)
    n_ = c("n")
    y = c("s") * F.sqrt((n_ + 1) * (n_ + 3) / (6.0 * (n_ - 2)))
    beta2 = 3.0 * (n_**2 + 27 * n_ - 70) * (n_ + 1) * (n_ + 3) / ((n_ - 2) * (n_ + 5) * (n_ + 7) * (n_ + 9))
    w2 = -1 + F.sqrt(2 * (beta2 - 1))
    alpha = F.sqrt(2.0 / (w2 - 1))
    zs = F.asinh(y / alpha) / F.sqrt(0.5 * F.ln(w2))
    e = 3.0 * (n_ - 1) / (n_ + 1)
    var = 24.0 * n_ * (n_ - 2) * (n_ - 3) / ((n_ + 1) ** 2 * (n_ + 3) * (n_ + 5))
    xk = (c("k") + 3 - e) / F.sqrt(var)
    b1 = 6.0 * (n_**2 - 5 * n_ + 2) / ((n_ + 7) * (n_ + 9)) * F.sqrt(6.0 * (n_ + 3) * (n_ + 5) / (n_ * (n_ - 2) * (n_ - 3)))
    aa = 6.0 + 8.0 / b1 * (2.0 / b1 + F.sqrt(1 + 4.0 / b1**2))
    t = (1 - 2.0 / aa) / (1 + xk * F.sqrt(2.0 / (aa - 4)))
    zk = (1 - 2.0 / (9 * aa) - F.signum(t) * F.pow(F.abs(t), F.lit(1.0 / 3))) / F.sqrt(2.0 / (9 * aa))
    k2 = zs**2 + zk**2
    return a.where("n >= 20").select(*by, "n", jb.alias("jarque_bera"), F.exp(-jb / 2).alias("jb_p"), k2.alias("k2"), F.exp(-k2 / 2).alias("k2_p"))


def return_profile(df: DataFrame, by: dict[str, Column], r: str, spread: str | None = None, extreme: Column | None = None) -> DataFrame:
    """Count, centre, spread, size and extremes of returns by calendar part or session."""
    c = F.col(r)
    aggs = [F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.avg(F.abs(c)).alias("mean_abs"), F.min(c).alias("min"), F.max(c).alias("max")]
    quantiles = {"r": (c, {"median": 0.5})}
    if extreme is not None:
        aggs.append(F.avg(F.col("__far").cast("double")).alias("extreme_share"))
    if spread:
        quantiles["spread"] = (F.col(spread), {"spread_p95": 0.95})
    far = (F.lit(None).cast("boolean") if extreme is None else extreme).alias("__far")
    rows = written(df.where(c.isNotNull()).select(*[v.alias(k) for k, v in by.items()], r, *([spread] if spread else []), far))
    return with_quantiles(rows.groupBy(*by).agg(*aggs), rows, list(by), quantiles, held=True)


def hourly(df: DataFrame, ts: str, r: str, **more) -> DataFrame:
    return return_profile(df, {"hour": F.hour(ts)}, r, **more)


def weekdays(df: DataFrame, ts: str, r: str, **more) -> DataFrame:
    return return_profile(df, {"weekday": iso_weekday(F.col(ts))}, r, **more)


def yearly_stability(df: DataFrame, period: Column, r: str, lagged: str, extreme: Column) -> DataFrame:
    """Moments, first autocorrelation and extreme share by period."""
    c = F.col(r)
    n = F.count(c)
    return df.where(c.isNotNull()).groupBy(period.alias("period")).agg(
        n.alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), corrected_skew(c, n).alias("skew"), corrected_kurtosis(c, n).alias("kurtosis"),
        S.corr(c, F.col(lagged)).alias("acf1"), F.avg(extreme.cast("double")).alias("extreme_share"),
    )


def correlations(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """``a, b, n, corr`` over rows where both are present."""
    both = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    parts = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count_if(both(a, b)).alias("n"), S.nan_null(S.corr(F.when(both(a, b), F.col(a)), F.when(both(a, b), F.col(b)))).alias("corr")) for a, b in pairs]
    return df.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def conditional_returns(rows: DataFrame, r: str, lows: tuple[float, ...], highs: tuple[float, ...], horizons: dict[int, str], z: float = 1.96, least: int = 100) -> DataFrame:
    """Outcomes after extreme returns. ``rows`` hold one series with null returns already left out, so that horizons skip
    them; ``horizons`` names the column of the outcome h rows later. Fewer than ``least`` rows give an empty table."""
    q = sorted({*lows, *highs})
    rows = written(rows.select(r, *horizons.values()))
    cut = with_quantiles(rows.agg(F.count("*").alias("total")), rows, [], {"r": (F.col(r), {qname(p): p for p in q})}, held=True)
    both = rows.crossJoin(F.broadcast(cut)).where(F.col("total") >= least)  # one row
    kinds = [(f"<=q{p:g}", F.col(r) <= F.col(qname(p)), 1) for p in lows] + [(f">=q{p:g}", F.col(r) >= F.col(qname(p)), -1) for p in highs]
    cells = F.explode(F.array(*[F.when(c, F.struct(F.lit(k).alias("bucket"), F.lit(s).alias("turn"))) for k, c, s in kinds])).alias("k")
    outcomes = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(c).alias("y")) for h, c in horizons.items()])).alias("o")
    long = both.select(cells, *horizons.values()).where("k IS NOT NULL").select("k.*", outcomes).select("bucket", "turn", "o.*").where("y IS NOT NULL")
    n, m, s = F.count("y"), F.avg("y"), F.stddev_samp("y")
    out = long.groupBy("bucket", "horizon").agg(n.alias("n"), m.alias("mean"), s.alias("std"), F.avg((F.col("y") > 0).cast("double")).alias("p_up"), F.avg((F.col("y") * F.col("turn") > 0).cast("double")).alias("reversal"))
    out = with_quantiles(out, long, ["bucket", "horizon"], {"y": (F.col("y"), {"median": 0.5})}, held=True)
    se = F.col("std") / F.sqrt("n")
    return out.select("*", se.alias("se"), (F.col("mean") - z * se).alias("ci_low"), (F.col("mean") + z * se).alias("ci_high"))


def reversion_coefficient(df: DataFrame, eps: str, change: str, by: list[str]) -> DataFrame:
    """Regression of the next change on the present residual."""
    return df.groupBy(*by).agg(F.regr_count(change, eps).alias("n"), F.regr_slope(change, eps).alias("slope"), F.regr_intercept(change, eps).alias("intercept"), F.regr_r2(change, eps).alias("r2"))


def toward_zero(df: DataFrame, z: str, later: dict[int, str], bins: list[float]) -> DataFrame:
    """By bin of z and horizon: mean later z and the share that moved toward zero."""
    rows = df.withColumn("bin", S.half_open_bin(F.col(z), bins)).where("bin IS NOT NULL")
    o = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(c).alias("y")) for h, c in later.items()])).alias("o")
    long = rows.select("bin", F.col(z).alias("z"), o).select("bin", "z", "o.*").where("y IS NOT NULL")
    return long.groupBy("bin", "horizon").agg(F.count("*").alias("n"), F.avg("z").alias("mean_z"), F.avg("y").alias("mean_later"), F.avg((F.abs("y") < F.abs("z")).cast("double")).alias("toward"))


def quantile_buckets(df: DataFrame, x: str, buckets: int, by: list[str], name: str = "bucket") -> DataFrame:
    """``df`` with the bucket by sample-quantile edges (equal values stay together), null for a missing value."""
    edges = exact_quantiles(df, by, {"__edges": F.col(x)}, tuple(k / buckets for k in range(1, buckets)))
    out = df.join(small_side(edges), by, "left") if by else df.crossJoin(F.broadcast(edges))
    return out.withColumn(name, S.edge_bucket(F.col(x), F.col("__edges"), right=False)).drop("__edges")


def equal_count_blocks(df: DataFrame, index: str, total: int, blocks: int) -> Column:
    """Chronological block of equal counts from a gapless row number."""
    return F.least(F.floor(F.col(index) * blocks / F.lit(total)), F.lit(blocks - 1)).cast("int")


def circular(df: DataFrame, angle: str, by: list[str]) -> DataFrame:
    """Circular mean, resultant length and Rayleigh test."""
    c, s, n = F.avg(F.cos(angle)), F.avg(F.sin(angle)), F.count(angle)
    a = df.groupBy(*by).agg(n.alias("n"), F.atan2(s, c).alias("mean_angle"), F.sqrt(c * c + s * s).alias("resultant"))
    z = F.col("n") * F.col("resultant") ** 2
    p = F.exp(F.sqrt(1 + 4 * F.col("n") + 4 * (F.col("n") ** 2 - (F.col("n") * F.col("resultant")) ** 2)) - (1 + 2 * F.col("n")))
    return a.select("*", z.alias("rayleigh_z"), F.least(F.lit(1.0), p).alias("rayleigh_p"))


# Information coefficients: month partial sums, then pooled correlation and errors.


def rank_scores(df: DataFrame, x: str, by: list[str], name: str) -> DataFrame:
    """``df`` with (average rank - 1/2) / n over present values; missing stays missing. The order is taken from counts of
    distinct values, so hot values are one row, and within parts of a group."""
    counts = df.where(F.col(x).isNotNull()).groupBy(*by, F.col(x).alias("__x")).agg(F.count("*").alias("__c"))
    placed = O.counts_below(counts, by, "__x", "__c")
    score = (F.col("__below") + (F.col("__c") + 1) / 2.0 - 0.5) / F.col("__n")
    ranked = placed.select(*[F.col(b).alias(f"__by_{b}") for b in by], "__x", score.alias(name))
    on = df[x] == F.col("__x")
    for b in by:
        on = on & df[b].eqNullSafe(F.col(f"__by_{b}"))
    return df.join(ranked, on, "left").select(*df.columns, name)


def rank_scores_of(df: DataFrame, columns: list[str], by: list[str], key: list[str], prefix: str = "u_") -> DataFrame:
    """`rank_scores` of several columns at once, in long form; ``key`` (which holds ``by``) tells rows apart and has no nulls."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("__col"), F.col(c).cast("double").alias("__x")) for c in columns])).alias("__s")
    long = df.select(*key, cells).select(*key, "__s.*").where(F.col("__x").isNotNull())
    counts = long.groupBy(*by, "__col", "__x").agg(F.count("*").alias("__c"))
    score = (F.col("__below") + (F.col("__c") + 1) / 2.0 - 0.5) / F.col("__n")
    ranks = O.counts_below(counts, [*by, "__col"], "__x", "__c").select(*by, "__col", "__x", score.alias("__score"))
    wide = long.join(ranks, [*by, "__col", "__x"]).groupBy(*key).pivot("__col", columns).agg(F.first("__score"))
    return df.join(wide.withColumnsRenamed({c: f"{prefix}{c}" for c in columns}), key, "left")


def month_moments(df: DataFrame, ts: str, features: list[str], targets: list[str], extra: list[str] = ()) -> DataFrame:
    """Partial sums n, sx, sy, sxx, syy, sxy by month, feature and target (and other keys)."""
    return period_moments(df, month_block(F.col(ts)), features, targets, extra).withColumnRenamed("period", "month")


def period_moments(df: DataFrame, period: Column, features: list[str], targets: list[str], extra: list[str] = ()) -> DataFrame:
    """`month_moments` by any period that ascends with time."""
    f = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in features])).alias("f")
    t = F.explode(F.array(*[F.struct(F.lit(c).alias("target"), F.col(c).cast("double").alias("y")) for c in targets])).alias("t")
    long = df.select(period.alias("period"), *extra, f, *targets).select("period", *extra, "f.*", t).select("period", *extra, "feature", "x", "t.*")
    x, y = F.col("x"), F.col("y")
    return long.where(x.isNotNull() & y.isNotNull()).groupBy("period", *extra, "feature", "target").agg(
        F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy")
    )


def sum_moments(months: DataFrame, by: list[str]) -> DataFrame:
    return months.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])


def correlation_of_sums() -> Column:
    """Correlation from summed moments; null for two rows or fewer or no variance."""
    n = F.col("n")
    vx, vy = F.col("sxx") - F.col("sx") ** 2 / n, F.col("syy") - F.col("sy") ** 2 / n
    r = (F.col("sxy") - F.col("sx") * F.col("sy") / n) / F.sqrt(vx * vy)
    return F.when((n > 2) & (vx > 0) & (vy > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def ic_with_errors(months: DataFrame, lags: int = 3) -> DataFrame:
    """Pooled coefficient per feature and target with a Newey-West error of month influence sums, z and p."""
    keys = ["feature", "target"]
    n = F.col("n")
    pooled = sum_moments(months, keys).select(
        *keys, n.alias("rows_all"), (F.col("sx") / n).alias("mx"), (F.col("sy") / n).alias("my"),
        F.sqrt(F.col("sxx") / n - (F.col("sx") / n) ** 2).alias("dx"), F.sqrt(F.col("syy") / n - (F.col("sy") / n) ** 2).alias("dy"), correlation_of_sums().alias("ic"),
    )
    m = months.join(pooled, keys)
    mx, my, dx, dy, ic = (F.col(c) for c in ("mx", "my", "dx", "dy", "ic"))
    zxy = (F.col("sxy") - mx * F.col("sy") - my * F.col("sx") + n * mx * my) / (dx * dy)
    zxx = (F.col("sxx") - 2 * mx * F.col("sx") + n * mx * mx) / (dx * dx)
    zyy = (F.col("syy") - 2 * my * F.col("sy") + n * my * my) / (dy * dy)
    # Influence of a month on the correlation, to first order.
    m = m.withColumn("u", zxy - ic * (zxx + zyy) / 2)
    w = W.partitionBy(*keys).orderBy("month")
    terms = m.select(*keys, "rows_all", "ic", "u", *[(F.col("u") * F.lag("u", k).over(w)).alias(f"u{k}") for k in range(1, lags + 1)])
    var = F.sum(F.col("u") ** 2)
    for k in range(1, lags + 1):
        var = var + 2 * (1 - k / (lags + 1)) * F.coalesce(F.sum(f"u{k}"), F.lit(0.0))
    out = terms.groupBy(*keys, "rows_all", "ic").agg(F.count("*").alias("months"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("s"))
    se = F.col("s") / F.col("rows_all")
    z = F.when(se > 0, F.col("ic") / se)
    return out.select(*keys, F.col("rows_all").alias("n"), "ic", "months", se.alias("se"), z.alias("z"), normal_two_sided(z).alias("p"), (F.col("ic") - 1.959963984540054 * se).alias("ci_low"), (F.col("ic") + 1.959963984540054 * se).alias("ci_high"))


def normal_two_sided(z: Column) -> Column:
    """P(|N| > |z|), by a continued fraction's series in elementary functions (relative error below 2e-7)."""
    x = F.abs(z) / math.sqrt(2.0)
    t = 1.0 / (1.0 + 0.5 * x)
    # Coefficients of a published rational Chebyshev fit of erfc.
    c = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    poly = F.lit(c[-1])
    for k in reversed(c[:-1]):
        poly = poly * t + k
    return F.when(z.isNotNull(), t * F.exp(-x * x + poly))


def rolling_ics(months: DataFrame, window: int, min_months: int) -> DataFrame:
    """Coefficient of the trailing months m-w to m-1 for every month."""
    keys = ["feature", "target"]
    w = W.partitionBy(*keys).orderBy("month").rangeBetween(-window, -1)
    sums = months.select(*keys, "month", F.count("*").over(w).alias("held"), *[F.sum(c).over(w).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    return sums.where(F.col("held") >= min_months).select(*keys, "month", "held", "n", correlation_of_sums().alias("ic"))


def era_ics(months: DataFrame, eras: int = 3) -> DataFrame:
    """Coefficient by equal parts of the active months."""
    w = W.partitionBy("feature", "target").orderBy("month")
    return sum_moments(months.withColumn("era", F.ntile(eras).over(w)), ["feature", "target", "era"]).select("feature", "target", "era", "n", correlation_of_sums().alias("ic"))


def sign_consistency(yearly: DataFrame, pooled: DataFrame) -> DataFrame:
    """Share of years whose coefficient has the pooled sign."""
    j = yearly.join(pooled.select("feature", "target", F.col("ic").alias("pooled")), ["feature", "target"]).where("ic IS NOT NULL")
    return j.groupBy("feature", "target").agg(F.count("*").alias("years"), F.avg((F.signum("ic") == F.signum("pooled")).cast("double")).alias("consistency"))


# Information theory on rank bins.


def rank_bin(u: Column, bins: int) -> Column:
    return F.when(u.isNotNull(), F.least(F.floor(u * bins), F.lit(bins - 1)).cast("int"))


def joint_counts(df: DataFrame, bx: str, by_: str, groups: list[str] = ()) -> DataFrame:
    return df.where(F.col(bx).isNotNull() & F.col(by_).isNotNull()).groupBy(*groups, F.col(bx).alias("bx"), F.col(by_).alias("by")).agg(F.count("*").alias("c"))


def mutual_information(counts: DataFrame, groups: list[str] = (), least: int = 10) -> DataFrame:
    """Plug-in information less the Miller-Madow bias, entropies and information over the smaller entropy."""
    groups = list(groups)
    row = W.partitionBy(*groups, "bx")
    col = W.partitionBy(*groups, "by")
    c = counts.select("*", F.sum("c").over(row).alias("r"), F.sum("c").over(col).alias("k"), F.row_number().over(row.orderBy("by")).alias("ri"), F.row_number().over(col.orderBy("bx")).alias("ki"))
    one_r, one_k = F.col("ri") == 1, F.col("ki") == 1
    xlx = lambda v: F.col(v) * F.ln(F.col(v))
    a = c.groupBy(*groups).agg(
        F.sum("c").alias("n"), F.sum(xlx("c")).alias("sc"), F.sum(F.when(one_r, xlx("r"))).alias("sr"), F.sum(F.when(one_k, xlx("k"))).alias("sk"),
        F.count("*").alias("cells"), F.count_if(one_r).alias("rows"), F.count_if(one_k).alias("cols"),
    )
    n = F.col("n")
    plug = (F.col("sc") - F.col("sr") - F.col("sk")) / n + F.ln(n)
    bias = (F.col("cells") - F.col("rows") - F.col("cols") + 1) / (2 * n)
    hx, hy = F.ln(n) - F.col("sr") / n, F.ln(n) - F.col("sk") / n
    mi = F.when(n >= least, plug - bias)
    return a.select(*groups, "n", mi.alias("mi"), hx.alias("hx"), hy.alias("hy"), F.try_divide(mi, F.least(hx, hy)).alias("nmi"))


def conditional_mutual_information(per_group: DataFrame) -> DataFrame:
    """Information of groups weighted by their rows."""
    return per_group.where("mi IS NOT NULL").agg(F.sum("n").alias("n"), (F.sum(F.col("mi") * F.col("n")) / F.sum("n")).alias("cmi"))


# Quality and drift.


def missing_shares(df: DataFrame, columns: list[str], sets: list[list[str]]) -> DataFrame:
    """Share of missing values overall and by keys, in one pass over grouping sets."""
    keys = sorted({k for s in sets for k in s})
    long = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).isNull().alias("gone")) for c in columns])).alias("m")).select(*keys, "m.*")
    grouped = long.groupingSets([[F.col("column"), *[F.col(k) for k in s]] for s in sets], "column", *keys)
    return grouped.agg(F.count("*").alias("n"), F.avg(F.col("gone").cast("double")).alias("share"))


def ks_and_wasserstein(a: DataFrame, b: DataFrame, x: str, grid: int = 200) -> DataFrame:
    """Kolmogorov-Smirnov distance and first Wasserstein distance of two samples on the quantile grid of both."""
    q = tuple((k + 0.5) / grid for k in range(grid))
    qa, qb = (exact_quantiles(d, [], {n: F.col(x)}, q) for d, n in ((a, "qa"), (b, "qb")))
    both = qa.crossJoin(F.broadcast(qb))  # one row each
    w1 = F.aggregate(F.zip_with("qa", "qb", lambda s, t: F.abs(s - t)), F.lit(0.0), lambda s, v: s + v) / grid
    # Share of one grid at most each point of both grids.
    share = lambda c, v: F.size(F.filter(F.col(c), lambda e: e <= v)) / float(grid)
    ks = F.array_max(F.transform(F.concat("qa", "qb"), lambda v: F.abs(share("qa", v) - share("qb", v))))
    return both.select(ks.alias("ks"), w1.alias("wasserstein"))


# Labels: transitions, runs and agreement.


def transition_counts(df: DataFrame, label: str, w) -> DataFrame:
    """Consecutive (from, to) counts; a label of -1 on either side is left out."""
    nxt = F.lead(label).over(w)
    return df.select(F.col(label).alias("from"), nxt.alias("to")).where("`from` >= 0 AND `to` >= 0").groupBy("from", "to").agg(F.count("*").alias("n"))


def run_lengths(df: DataFrame, label: str, series: list[str], order: list[str], bucket: Column, block_rows: int = O.BLOCK_ROWS) -> DataFrame:
    """Maximal constant runs; -1 breaks a run and is left out; runs that touch an end of the series are censored.

    A run's length is the distance to the next run's first row, found in its block or else from the blocks' first starts,
    so no window holds a whole series. ``bucket`` must ascend with the order."""
    starts = F.coalesce(F.col(label) != F.lag(label).over(O.block_window(series)), F.lit(True))
    rows = O.blocks(df, series, order, bucket, 1, 0, block_rows).select("*", starts.alias("__starts")).where(O.OWN)
    keys = [*series, O.BLOCK]
    by_block = rows.groupBy(*keys).agg(
        F.count_if("__starts").alias("__runs"), F.min(F.when(F.col("__starts"), F.col(O.INDEX))).alias("__first"), F.max(O.INDEX).alias("__last")
    )
    w = W.partitionBy(*series, F.lit(0))
    whole = by_block.select(
        *keys, F.coalesce(F.sum("__runs").over(w.orderBy(O.BLOCK).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
        F.min("__first").over(w.orderBy(O.BLOCK).rowsBetween(1, W.unboundedFollowing)).alias("__later"), (F.max("__last").over(w) + 1).alias("__total"),
    )
    own = W.partitionBy(*keys).orderBy(O.INDEX)
    runs = rows.where("__starts").select(
        *keys, F.col(O.INDEX).alias("__at"), F.col(label).alias("label"), F.struct(*order).alias("start"),
        F.row_number().over(own).alias("__rn"), F.lead(O.INDEX).over(own).alias("__next"),
    )
    end = F.coalesce("__next", "__later", "__total")
    return O.beside(runs, whole, keys).select(
        *series, (F.col("__before") + F.col("__rn")).alias("run"), "label", (end - F.col("__at")).alias("length"), "start",
        ((F.col("__at") == 0) | (end == F.col("__total"))).alias("censored"),
    ).where("label >= 0")


def duration_summary(runs: DataFrame) -> DataFrame:
    free = ~F.col("censored")
    length = F.when(free, F.col("length"))
    total = F.sum(F.sum("length")).over(W.partitionBy())
    out = runs.groupBy("label").agg(
        F.count("*").alias("runs"), F.count_if("censored").alias("censored"), (F.sum("length") / total).alias("share"), F.avg(length).alias("mean"), F.max(length).alias("max"),
    )
    return with_quantiles(out, runs, ["label"], {"length": (length, {"median": 0.5, "p90": 0.9})})


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("bx"), F.col(b).alias("by")).agg(F.count("*").alias("c"))


def agreement(table: DataFrame) -> DataFrame:
    """Adjusted Rand index, normalised mutual information (arithmetic mean) and Cramer's V of a contingency table."""
    row, col, all_ = W.partitionBy("bx"), W.partitionBy("by"), W.partitionBy()
    t = table.select("*", F.sum("c").over(row).alias("r"), F.sum("c").over(col).alias("k"), F.sum("c").over(all_).alias("n"), F.row_number().over(row.orderBy("by")).alias("ri"), F.row_number().over(col.orderBy("bx")).alias("ki"))
    two = lambda v: F.col(v) * (F.col(v) - 1) / 2.0
    xlx = lambda v: F.col(v) * F.ln(F.col(v))
    one_r, one_k = F.col("ri") == 1, F.col("ki") == 1
    a = t.agg(
        F.max("n").alias("n"), F.sum(two("c")).alias("ij"), F.sum(F.when(one_r, two("r"))).alias("i"), F.sum(F.when(one_k, two("k"))).alias("j"),
        F.sum(xlx("c")).alias("sc"), F.sum(F.when(one_r, xlx("r"))).alias("sr"), F.sum(F.when(one_k, xlx("k"))).alias("sk"),
        F.sum(F.col("c") ** 2 / (F.col("r") * F.col("k"))).alias("phi"), F.count_if(one_r).alias("rows"), F.count_if(one_k).alias("cols"),
    )
    n, i, j = F.col("n"), F.col("i"), F.col("j")
    expected = i * j / (n * (n - 1) / 2.0)
    ari = F.try_divide(F.col("ij") - expected, (i + j) / 2 - expected)
    mi = (F.col("sc") - F.col("sr") - F.col("sk")) / n + F.ln(n)
    hx, hy = F.ln(n) - F.col("sr") / n, F.ln(n) - F.col("sk") / n
    v = F.sqrt((F.col("phi") - 1) / F.nullif(F.least("rows", "cols") - 1, F.lit(0)))
    return a.select("n", ari.alias("ari"), F.try_divide(mi, (hx + hy) / 2).alias("nmi"), v.alias("cramers_v"))


def eta_squared(df: DataFrame, x: str, label: str) -> DataFrame:
    """Between-group share of variance."""
    g = df.where(F.col(x).isNotNull() & F.col(label).isNotNull()).groupBy(label).agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.var_pop(x).alias("v"))
    t = g.agg(F.sum("n").alias("N"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"), F.sum(F.col("n") * F.col("v")).alias("within"), F.sum(F.col("n") * F.col("m") ** 2).alias("q"))
    between = F.col("q") - F.col("N") * F.col("mean") ** 2
    return t.select(F.col("N").alias("n"), F.try_divide(between, between + F.col("within")).alias("eta_squared"))


def frequency_table(df: DataFrame, period: Column, label: str, labels: list[int]) -> DataFrame:
    """Share of each label by period, one column a label."""
    g = df.groupBy(period.alias("period")).pivot(label, labels).count()
    total = sum((F.coalesce(F.col(str(k)), F.lit(0)) for k in labels), F.lit(0))
    return g.select("period", total.alias("n"), *[F.try_divide(F.coalesce(F.col(str(k)), F.lit(0)), total).alias(f"share_{k}") for k in labels])


# Scoring of predictions.


def decile_table(df: DataFrame, score: str, outcome: str, q: int = 10) -> DataFrame:
    """Mean outcome by score bucket (ties stay together); empty for fewer than 10 q rows. ``score`` holds rank scores."""
    both = df.where(F.col(score).isNotNull() & F.col(outcome).isNotNull())
    b = both.withColumn("bucket", rank_bin(F.col(score), q))
    g = b.groupBy("bucket").agg(F.count("*").alias("n"), F.avg(outcome).alias("mean"))
    return g.withColumn("__t", F.sum("n").over(W.partitionBy())).where(F.col("__t") >= 10 * q).drop("__t")


def classification_metrics(df: DataFrame, p: str, y: str, base_rate: float, by: list[str] = (), bins: int = 10, least: int = 100) -> DataFrame:
    """Log loss, Brier, AUC (by rank sums), accuracy, precision, recall, calibration error and skill against the base
    rate. Groups of fewer than ``least`` rows have their count only."""
    by = list(by)
    rows = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(p).alias("p"), F.col(y).cast("double").alias("y"))
    ranked = rank_scores(rows, "p", by, "u")
    c = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col("p")))
    hit = F.col("p") >= 0.5
    pos = F.col("y") == 1
    loss = -F.when(pos, F.ln(c)).otherwise(F.ln(1 - c))
    base = -F.when(pos, math.log(base_rate)).otherwise(math.log(1 - base_rate))
    a = ranked.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(loss).alias("log_loss"), F.avg((F.col("p") - F.col("y")) ** 2).alias("brier"), F.avg(base).alias("base_loss"),
        F.avg((hit == pos).cast("double")).alias("accuracy"), F.try_divide(F.count_if(hit & pos), F.count_if(hit)).alias("precision"), F.try_divide(F.count_if(hit & pos), F.count_if(pos)).alias("recall"),
        F.count_if(pos).alias("np"), F.sum(F.when(pos, F.col("u"))).alias("su"), S.nan_null(S.corr("u", "y")).alias("rank_ic"),
    )
    n, np_ = F.col("n"), F.col("np")
    auc = F.try_divide(F.col("su") * n + 0.5 * np_ - np_ * (np_ + 1) / 2, np_ * (n - np_))
    cal = reliability(rows, "p", "y", by, bins).groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("rate"))) / F.sum("n")).alias("ece"))
    out = a.join(cal, by) if by else a.crossJoin(F.broadcast(cal))
    ok = n >= least
    cols = {"log_loss": F.col("log_loss"), "brier": F.col("brier"), "auc": auc, "accuracy": F.col("accuracy"), "precision": F.col("precision"), "recall": F.col("recall"), "ece": F.col("ece"), "rank_ic": F.col("rank_ic"), "skill": 1 - F.col("log_loss") / F.col("base_loss")}
    return out.select(*by, "n", *[F.when(ok, v).alias(k) for k, v in cols.items()])


def reliability(df: DataFrame, p: str, y: str, by: list[str] = (), bins: int = 10) -> DataFrame:
    """Mean forecast against frequency in bins of equal width."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("rate"))


def regression_metrics(df: DataFrame, f: str, y: str, base: float = 0.0, by: list[str] = (), least: int = 100) -> DataFrame:
    """Errors, R2, bias, Pearson and rank correlation, and skill against a constant."""
    by = list(by)
    rows = df.where(F.col(f).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(f).alias("f"), F.col(y).alias("y"))
    ranked = rank_scores(rank_scores(rows, "f", by, "uf"), "y", by, "uy")
    e = F.col("f") - F.col("y")
    a = ranked.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), F.var_pop("y").alias("vy"), F.avg(e * e).alias("mse"),
        F.avg((F.col("y") - base) ** 2).alias("base_mse"), S.nan_null(S.corr("f", "y")).alias("pearson"), S.nan_null(S.corr("uf", "uy")).alias("spearman"),
    )
    ok = F.col("n") >= least
    cols = {"mae": F.col("mae"), "rmse": F.col("rmse"), "bias": F.col("bias"), "r2": 1 - F.try_divide(F.col("mse"), F.col("vy")), "pearson": F.col("pearson"), "spearman": F.col("spearman"), "skill": 1 - F.try_divide(F.col("mse"), F.col("base_mse"))}
    return a.select(*by, "n", *[F.when(ok, v).alias(k) for k, v in cols.items()])


def drawdown(df: DataFrame, equity: Column, w) -> dict[str, Column]:
    """Running peak and fall from it."""
    peak = F.max(equity).over(w.rowsBetween(W.unboundedPreceding, 0))
    return {"peak": peak, "drawdown": equity / peak - 1}


def performance(df: DataFrame, r: str, w, periods_a_year: float) -> DataFrame:
    """Total and annual return, volatility, Sharpe ratio and the largest drawdown of one ordered series of simple returns."""
    grown = df.withColumn("__e", F.exp(F.sum(F.log1p(r)).over(w.rowsBetween(W.unboundedPreceding, 0))))
    d = grown.withColumn("__d", F.col("__e") / F.greatest(F.lit(1.0), F.max("__e").over(w.rowsBetween(W.unboundedPreceding, 0))) - 1)
    n = F.count(r)
    return d.agg(
        n.alias("n"), (F.exp(F.sum(F.log1p(r))) - 1).alias("total_return"), (F.exp(F.sum(F.log1p(r)) * periods_a_year / n) - 1).alias("annual_return"),
        (F.stddev_samp(r) * math.sqrt(periods_a_year)).alias("volatility"), F.try_divide(F.avg(r) * math.sqrt(periods_a_year), F.stddev_samp(r)).alias("sharpe"), F.min("__d").alias("max_drawdown"),
    )


def concentration(trades: DataFrame, pnl: str, top: int = 10) -> DataFrame:
    """Share of the gains and of the total that the largest trades make up."""
    best = trades.orderBy(F.col(pnl).desc()).limit(top).agg(F.sum(pnl).alias("best"))
    a = trades.agg(F.count("*").alias("trades"), F.sum(pnl).alias("total"), F.sum(F.when(F.col(pnl) > 0, F.col(pnl))).alias("gains"), (F.sum(F.col(pnl) ** 2) / F.sum(F.abs(pnl)) ** 2).alias("herfindahl"))
    return a.crossJoin(F.broadcast(best)).select("*", F.try_divide("best", "gains").alias("best_of_gains"), F.try_divide("best", "total").alias("best_of_total"))


# Summaries and drift.


def reversal_summary(analysis: DataFrame) -> DataFrame:
    """Buckets of conditional returns condensed by side and horizon, weighted by rows."""
    side = F.when(F.col("bucket").startswith("<"), "low").otherwise("high")
    w = lambda c: F.sum(F.col(c) * F.col("n")) / F.sum("n")
    return analysis.groupBy(side.alias("side"), "horizon").agg(F.count("*").alias("buckets"), w("reversal").alias("reversal"), w("mean").alias("mean"))


def half_life_summary(df: DataFrame, x: str, ceiling: float, by: list[str]) -> DataFrame:
    """Half-lives with those above a ceiling counted as censored and left out of the figures."""
    inside = F.when(F.col(x) <= ceiling, F.col(x))
    out = df.groupBy(*by).agg(F.count(x).alias("n"), F.count_if(F.col(x) > ceiling).alias("censored"), F.avg(inside).alias("mean"))
    return with_quantiles(out, df, by, {"x": (inside, {"median": 0.5})})


def phase_buckets(df: DataFrame, angle: str, outcome: str, sectors: int) -> DataFrame:
    """Mean outcome by sector of an angle in [-pi, pi)."""
    k = F.least(F.floor((F.col(angle) + math.pi) / (2 * math.pi) * sectors + 1e-9), F.lit(sectors - 1)).cast("int")
    rows = df.where(F.col(angle).isNotNull() & F.col(outcome).isNotNull())
    return rows.groupBy(k.alias("sector")).agg(F.count("*").alias("n"), F.avg(outcome).alias("mean"), F.stddev_samp(outcome).alias("std"))


def drift_by_period(df: DataFrame, period: Column, x: str, grid: int = 50) -> DataFrame:
    """Distances of each period's quantile grid from that of all rows."""
    q = tuple((k + 0.5) / grid for k in range(grid))
    rows = written(df.select(period.alias("period"), x))
    own = rows.groupBy("period").agg(F.count(x).alias("n")).join(exact_quantiles(rows, ["period"], {"q": F.col(x)}, q, held=True), "period")
    j = own.crossJoin(F.broadcast(exact_quantiles(rows, [], {"g": F.col(x)}, q, held=True)))  # one row
    share = lambda c, v: F.size(F.filter(F.col(c), lambda e: e <= v)) / float(grid)
    w1 = F.aggregate(F.zip_with("q", "g", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, v: s + v) / grid
    ks = F.array_max(F.transform(F.concat("q", "g"), lambda v: F.abs(share("q", v) - share("g", v))))
    return j.select("period", "n", w1.alias("wasserstein"), ks.alias("ks"))


def population_stability(reference: DataFrame, other: DataFrame, x: str, buckets: int = 10, floor: float = 1e-6) -> DataFrame:
    """Population stability index of one sample against the quantile buckets of another."""
    edges = exact_quantiles(reference, [], {"e": F.col(x)}, tuple(k / buckets for k in range(1, buckets)))
    both = reference.select(F.col(x).alias("x"), F.lit(0).alias("s")).union(other.select(F.col(x).alias("x"), F.lit(1).alias("s"))).where("x IS NOT NULL")
    k = both.crossJoin(F.broadcast(edges)).select("s", S.edge_bucket(F.col("x"), F.col("e")).alias("k"))  # one row of edges
    n = k.groupBy("k").agg(F.count_if(F.col("s") == 0).alias("a"), F.count_if(F.col("s") == 1).alias("b"))
    all_ = W.partitionBy()
    share = lambda c: F.greatest(F.col(c) / F.sum(c).over(all_), F.lit(floor))
    p = n.select(share("a").alias("a"), share("b").alias("b"))
    return p.agg(F.sum((F.col("b") - F.col("a")) * F.ln(F.col("b") / F.col("a"))).alias("psi"))


def loss_comparison(df: DataFrame, candidate: str, baseline: str, by: list[str]) -> DataFrame:
    """Matched loss differences of two models on the same rows, with a normal z."""
    d = F.col(candidate) - F.col(baseline)
    rows = df.where(F.col(candidate).isNotNull() & F.col(baseline).isNotNull())
    a = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(d).alias("mean_difference"), F.stddev_samp(d).alias("sd"), F.avg((d < 0).cast("double")).alias("better_share"))
    return a.withColumn("z", F.try_divide(F.col("mean_difference") * F.sqrt("n"), F.col("sd")))
