"""Regressions on a series' own past, and its unit-root tests, from sums that merge.

Everything these need of a long series is sums of products of a row with the rows shortly before it. Blocks with the rows
before them (`ordering.blocks`) give the sums of their own rows; the sums of a series' blocks are added up by Spark, and what
is solved in the end is a small table a series. No task holds a series."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.models import nnls
from tidemark.functions.special import dickey_fuller_p, kpss_p
from tidemark.operators import ordering as O
from tidemark.session import ship, small_side, written

NUMBERS = T.ArrayType(T.DoubleType())


def summed(blocks: DataFrame, by: list[str], arrays: list[str]) -> DataFrame:
    """Arrays added up element by element over the rows of a group; arrays of a group are of one length."""
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("__k"), F.col(a).alias("__a")) for k, a in enumerate(arrays)])).alias("__s")
    long = blocks.select(*by, cells).select(*by, "__s.__k", F.posexplode("__s.__a").alias("__i", "__v"))
    sums = long.groupBy(*by, "__k", "__i").agg(F.sum("__v").alias("__v"))
    of = lambda k: F.array_sort(F.collect_list(F.when(F.col("__k") == k, F.struct("__i", "__v"))))
    out = sums.groupBy(*by).agg(*[of(k).alias(a) for k, a in enumerate(arrays)])
    return out.select(*by, *[F.transform(a, lambda s: s["__v"]).alias(a) for a in arrays])


def solved(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients, unscaled covariance and residual squares of the regression of a Gram matrix's first column on its
    others."""
    g, c = gram[1:, 1:], gram[1:, 0]
    d = np.sqrt(np.maximum(np.diag(g), 1e-300))
    inverse = np.linalg.pinv(g / np.outer(d, d), hermitian=True) / np.outer(d, d)
    beta = inverse @ c
    return beta, inverse, float(gram[0, 0] - 2 * beta @ c + beta @ g @ beta)


def adf_lags(n: int) -> int:
    """Most lags of the augmented Dickey-Fuller regression of ``n`` values."""
    return max(0, min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2))


def kpss_lags(n: int) -> int:
    """Lags that the automatic choice of the KPSS test looks at."""
    return int(n ** (2 / 9))


def _lagged(e: np.ndarray, d: np.ndarray, at: np.ndarray, lags: int) -> np.ndarray:
    """Columns of the Dickey-Fuller regression of rows ``at``: the difference, the level before, differences before, one."""
    return np.column_stack([d[at], e[at - 1], *[d[at - j] for j in range(1, lags + 1)], np.ones(len(at))])


def adf_of_sums(gram: np.ndarray, head: np.ndarray, n: int) -> tuple[float, float, int]:
    """Statistic, p and lags: lags by AIC on the rows that all lag counts share, whose sums ``gram`` has; the rows before
    them, which the chosen lag count adds, are in ``head``."""
    top = adf_lags(n)
    rows = n - 1 - top

    def of(lags: int) -> np.ndarray:
        on = [0, 1, *range(2, 2 + lags), len(gram) - 1]
        return gram[np.ix_(on, on)]

    def criterion(lags: int) -> float:
        sse = solved(of(lags))[2]
        return rows * math.log(max(sse, 1e-300) / rows) + 2 * (lags + 2)

    best = min(range(top + 1), key=criterion)
    d = np.concatenate([[0.0], np.diff(head)])
    early = _lagged(head, d, np.arange(best + 1, min(top + 1, len(head))), best)
    whole, rows = of(best) + early.T @ early, rows + len(early)
    beta, inverse, sse = solved(whole)
    stat = float(beta[0] / math.sqrt(sse / max(1, rows - len(beta)) * inverse[0, 0]))
    return stat, dickey_fuller_p(stat, "c"), best


def kpss_of_sums(walk: float, products: np.ndarray, n: int) -> tuple[int, float | None, float | None]:
    """Lags, and statistic and p if ``products`` (sums of products of residuals by distance) reach that far."""
    few = kpss_lags(n)
    own = products / n
    s0 = own[0] + 2 * own[1 : few + 1].sum()
    s1 = 2 * (np.arange(1, few + 1) * own[1 : few + 1]).sum()
    lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
    if lags >= len(products):
        return lags, None, None
    var = own[0] + 2 * (own[1 : lags + 1] * (1 - np.arange(1, lags + 1) / (lags + 1))).sum()
    stat = float(walk / n**2 / var)
    return lags, stat, kpss_p(stat, "c")


def stationarity(df: DataFrame, series: list[str], order: list[str], bucket: Column, x: str, alpha: float = 0.05, least: int = 20, reach: int | None = None, block_rows: int = O.BLOCK_ROWS) -> DataFrame:
    """``series, n, adf, adf_p, adf_lags, kpss, kpss_p, kpss_lags, verdict`` of all finite values of each series, with a
    constant in both tests; ``too_short`` with fewer than ``least`` values, ``constant`` where they are all the same. The first
    pass sums products of residuals up to ``reach`` rows apart; a test that asks for more gets a second one."""
    finite = F.col(x).isNotNull() & ~F.isnan(x) & (F.abs(F.col(x)) < float("inf"))
    rows = written(df.where(finite).select(*series, *order, F.col(x).cast("double").alias("__x")))
    sizes = rows.groupBy(*series).agg(F.count("*").alias("n"), F.avg("__x").alias("__mean"), (F.min("__x") == F.max("__x")).alias("__flat"))
    sizes = written(sizes.withColumn("verdict", F.when(F.col("n") < least, "too_short").when(F.col("__flat"), "constant")))
    most = sizes.where("verdict IS NULL").agg(F.max("n")).first()[0]
    out = "adf double, adf_p double, adf_lags long, kpss double, kpss_p double, kpss_lags long"
    fields = T._parse_datatype_string(out).fields
    if not most:
        return sizes.select(*series, "n", *[F.lit(None).cast(f.dataType).alias(f.name) for f in fields], "verdict")
    ship(df.sparkSession)

    def of_blocks(distances: int, want: DataFrame) -> DataFrame:
        """Gram sums, sums of products by distance, and what the running sum's squares need, by block."""
        back = max(distances, adf_lags(most) + 1)
        cut = O.blocks(O.beside(rows, small_side(want.select(*series, "n", "__mean")), series), series, order, bucket, back, 0, block_rows)
        keys = [*series, O.BLOCK]
        kinds = T.StructType([*[cut.schema[k] for k in keys], *[T.StructField(c, NUMBERS) for c in ("gram", "products", "walk", "head")]])

        def kernel(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values(O.INDEX)
            n, own, index = int(frame["n"].iloc[0]), frame[O.OWN].to_numpy(), frame[O.INDEX].to_numpy()
            if not own.any():  # rows that stand before the end of a series only
                return pd.DataFrame(columns=kinds.names, dtype=object)
            e = frame["__x"].to_numpy() - frame["__mean"].iloc[0]
            top = adf_lags(n)
            at = np.flatnonzero(own & (index > top))
            z = _lagged(e, np.concatenate([[0.0], np.diff(e)]), at, top)
            mine = np.flatnonzero(own)
            products = np.zeros(min(distances, n - 1) + 1)
            for k in range(len(products)):
                to = mine[index[mine] >= k]
                products[k] = e[to] @ e[to - k]
            s = np.cumsum(e[mine])
            head = e[own & (index <= top)]
            line = frame.iloc[:1][keys]
            return line.assign(gram=[(z.T @ z).ravel()], products=[products], walk=[[len(s), s[-1], s.sum(), s @ s]], head=[head])

        return written(cut.groupBy(*keys).applyInPandas(kernel, kinds))

    def finish(blocks: DataFrame) -> DataFrame:
        before = W.partitionBy(*series, F.lit(0)).orderBy(O.BLOCK).rowsBetween(W.unboundedPreceding, -1)
        from_ = F.coalesce(F.sum(F.col("walk")[1]).over(before), F.lit(0.0))
        walked = blocks.select(*series, (F.col("walk")[0] * from_ * from_ + 2 * from_ * F.col("walk")[2] + F.col("walk")[3]).alias("w"))
        walk = walked.groupBy(*series).agg(F.sum("w").alias("walk"))
        heads = blocks.where(F.size("head") > 0).groupBy(*series).agg(F.array_sort(F.collect_list(F.struct(O.BLOCK, "head"))).alias("h"))
        heads = heads.select(*series, F.flatten(F.transform("h", lambda b: b["head"])).alias("head"))
        whole = O.beside(O.beside(O.beside(summed(blocks, series, ["gram", "products"]), walk, series), heads, series), sizes.select(*series, "n"), series)

        def solve(frames):
            for frame in frames:
                found = []
                for r in frame.to_dict("records"):
                    side = math.isqrt(len(r["gram"]))
                    adf = adf_of_sums(np.array(r["gram"]).reshape(side, side), np.array(r["head"]), r["n"])
                    lags, stat, p = kpss_of_sums(r["walk"], np.array(r["products"]), r["n"])
                    found.append((*adf, stat, p, lags))
                made = pd.DataFrame(found, columns=[f.name for f in fields])
                yield pd.concat([frame[[*series, "n"]].reset_index(drop=True), made.astype({c: object for c in ("kpss", "kpss_p")}).where(made.notna(), None)], axis=1)

        return whole.mapInPandas(solve, T.StructType([*[sizes.schema[s] for s in series], sizes.schema["n"], *fields]))

    want = sizes.where("verdict IS NULL")
    first = written(finish(of_blocks(max(kpss_lags(most), int(2 * most ** (1 / 3)) if reach is None else reach), want)))
    done = first.where("kpss IS NOT NULL")
    far = first.where("kpss IS NULL")
    further = far.agg(F.max("kpss_lags")).first()[0]
    if further is not None:
        again = O.beside(want, far.select(*series), series)
        done = done.unionByName(finish(of_blocks(further, again)))
    a, k = F.col("adf_p") < alpha, F.col("kpss_p") < alpha
    verdict = F.when(a & ~k, "stationary").when(~a & k, "unit_root").when(a & k, "conflicting").otherwise("inconclusive")
    left = sizes.where("verdict IS NOT NULL").select(*series, "n", *[F.lit(None).cast(f.dataType).alias(f.name) for f in fields], "verdict")
    return done.select(*series, "n", *[f.name for f in fields], verdict.alias("verdict")).unionByName(left)


def lag_regression(df: DataFrame, series: list[str], order: list[str], bucket: Column, x: str, seconds: int, lags: int, block_rows: int = O.BLOCK_ROWS) -> DataFrame:
    """``series, n, intercept, slope, ols_se, hac_se`` of each value on the one before. The Newey-West error counts products
    of scores ``k`` rows apart only where their times are ``k`` times ``seconds`` apart. Two passes of sums, all in Spark's
    own expressions."""
    ts = order[0]
    cut = written(O.blocks(df.select(*series, *order, F.col(x).alias("y")), series, order, bucket, lags + 1, 0, block_rows))
    w = O.block_window(series)
    pairs = cut.withColumn("l", F.lag("y").over(w))
    own = pairs.where(F.col(O.OWN) & F.col("l").isNotNull())
    y, l = F.col("y"), F.col("l")  # noqa: E741
    n, sl, sll = F.count("*"), F.sum(l), F.sum(l * l)
    det = n * sll - sl * sl
    sse = F.regr_syy(y, l) - F.regr_slope(y, l) * F.regr_sxy(y, l)
    ols = own.groupBy(*series).agg(
        n.alias("n"), F.regr_slope(y, l).alias("slope"), F.regr_intercept(y, l).alias("intercept"),
        (-sl / det).alias("c0"), (n / det).alias("c1"), F.sqrt(sse / F.greatest(n - 2, F.lit(1)) * n / det).alias("ols_se"),
    )
    fitted = O.beside(pairs, small_side(ols), series)
    # A row's share in the slope's error; the error's variance is the sum of these shares' products.
    share = (y - F.col("intercept") - F.col("slope") * l) * (F.col("c0") + F.col("c1") * l)
    scored = fitted.select(*series, ts, O.BLOCK, O.INDEX, O.OWN, share.alias("v"))
    true = lambda k: F.unix_timestamp(ts) - F.unix_timestamp(F.lag(ts, k).over(w)) == k * seconds
    products = [F.col("v") ** 2, *[F.when(true(k), 2 * (1 - k / (lags + 1)) * F.col("v") * F.lag("v", k).over(w)) for k in range(1, lags + 1)]]
    sums = scored.select(*series, O.OWN, *[p.alias(f"p{k}") for k, p in enumerate(products)]).where(O.OWN).groupBy(*series)
    total = sum((F.coalesce(F.sum(f"p{k}"), F.lit(0.0)) for k in range(lags + 1)), F.lit(0.0))
    hac = sums.agg(F.sqrt(F.greatest(total, F.lit(0.0))).alias("hac_se"))
    return O.beside(ols, hac, series).select(*series, "n", "intercept", "slope", "ols_se", "hac_se")


def har_nonnegative(df: DataFrame, series: list[str], order: list[str], bucket: Column, v: str, spans: tuple[int, ...], names: list[str], block_rows: int = O.BLOCK_ROWS) -> DataFrame:
    """``series, term, coefficient, n``: the next value on a constant and trailing means over ``spans``, with coefficients of
    at least 0, solved on the sums of products."""
    cut = O.blocks(df.select(*series, *order, F.col(v).alias("v")), series, order, bucket, max(spans) - 1, 1, block_rows)
    w = O.block_window(series)
    means = [F.avg("v").over(w.rowsBetween(1 - s, 0)).alias(f"m{k}") for k, s in enumerate(spans)]
    d = cut.select(*series, O.OWN, O.INDEX, F.lead("v").over(w).alias("y"), F.lit(1.0).alias("one"), *means)
    d = d.where(F.col(O.OWN) & (F.col(O.INDEX) >= max(spans) - 1) & F.col("y").isNotNull())
    cols = ["y", "one", *[f"m{k}" for k in range(len(spans))]]
    cells = [F.sum(F.col(a) * F.col(b)) for a in cols for b in cols]
    sums = d.groupBy(*series).agg(F.count("*").alias("n"), F.array(*cells).alias("gram"))
    ship(df.sparkSession)

    def solve(frames):
        for frame in frames:
            out = []
            for r in frame.to_dict("records"):
                g = np.array(r["gram"]).reshape(len(cols), len(cols))
                scale = np.sqrt(np.maximum(np.diag(g)[1:], 1e-300))
                values, vectors = np.linalg.eigh(g[1:, 1:] / np.outer(scale, scale))
                root = np.sqrt(np.maximum(values, 1e-15 * values.max()))
                # A matrix with the same products, so the same least squares.
                a = root[:, None] * vectors.T
                b = (vectors.T @ (g[1:, 0] / scale)) / root
                for term, c in zip(names, nnls(a, b) / scale, strict=True):
                    out.append((*[r[s] for s in series], term, float(c), r["n"]))
            yield pd.DataFrame(out, columns=[*series, "term", "coefficient", "n"])

    return sums.mapInPandas(solve, T.StructType([*[sums.schema[s] for s in series], *T._parse_datatype_string("term string, coefficient double, n long").fields]))
