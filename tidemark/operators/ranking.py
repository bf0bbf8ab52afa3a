"""Ordering, thinning, multiple testing and greedy selection."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def stable_sort(df: DataFrame, ts: str, seq: str) -> DataFrame:
    """By time, equal times in source order."""
    return df.orderBy(ts, seq)


def even_sample(df: DataFrame, index: str, total: int, most: int) -> DataFrame:
    """About ``most`` rows evenly spread over a gapless row number, the first included."""
    step = max(1, -(-total // most))
    return df.where(F.col(index) % step == 0)


def benjamini_hochberg(df: DataFrame, p: str, family: list[str], name: str = "q") -> DataFrame:
    """Step-up q-values over present p-values: p m / rank, then the smallest of all larger p, at most 1."""
    part = W.partitionBy(*family, F.lit(0))
    ok = F.col(p).isNotNull() & ~F.isnan(p)
    m = F.count(F.when(ok, 1)).over(part)
    rank = F.count(F.when(ok, 1)).over(part.orderBy(p).rangeBetween(W.unboundedPreceding, 0))
    raw = df.withColumn("__raw", F.when(ok, F.col(p) * m / rank))
    back = part.orderBy(F.col(p).desc()).rangeBetween(W.unboundedPreceding, 0)
    return raw.withColumn(name, F.when(ok, F.least(F.lit(1.0), F.min("__raw").over(back)))).drop("__raw")


def holm(df: DataFrame, p: str, key: str, family: list[str], alpha: float = 0.05) -> DataFrame:
    """Step-down adjusted p-values; a family with a missing p is unavailable as a whole."""
    part = W.partitionBy(*family, F.lit(0))
    order = part.orderBy(p, key)
    m, i = F.count("*").over(part), F.row_number().over(order)
    gone = F.max((F.col(p).isNull() | F.isnan(p)).cast("int")).over(part) == 1
    step = df.withColumn("__s", F.least(F.lit(1.0), (m - i + 1) * F.col(p))).withColumn("__gone", gone)
    adj = F.max("__s").over(order.rowsBetween(W.unboundedPreceding, 0))
    out = step.withColumn("adjusted", F.when(~F.col("__gone"), adj)).drop("__s", "__gone")
    return out.withColumn("rejected", F.col("adjusted") <= alpha)


def status_rules(rules: list[tuple[Column, str]], otherwise: str) -> Column:
    """The status of the first rule that holds."""
    out = None
    for cond, status in rules:
        c = F.coalesce(cond, F.lit(False))
        out = F.when(c, status) if out is None else out.when(c, status)
    return out.otherwise(otherwise)


def assign_ids(known: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Append-only key -> id: known keys keep theirs, new ones follow in key order."""
    new = keys.select(key).distinct().join(known, key, "left_anti")
    start = known.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__m"))
    numbered = new.withColumn("__r", F.row_number().over(W.orderBy(key))).crossJoin(F.broadcast(start))
    return known.select(key, "id").union(numbered.select(key, (F.col("__m") + F.col("__r")).cast("long")))


def top_by(df: DataFrame, score: str, k: int, tie: str) -> DataFrame:
    return df.orderBy(F.col(score).desc(), tie).limit(k)


def mrmr(relevance: np.ndarray, corr: np.ndarray, k: int, lam: float = 1.0, scheme: str = "difference", limit: float = 1.0, eps: float = 1e-12) -> list[int]:
    """Greedy choice by relevance less (or over) the mean redundancy with what is chosen; candidates correlated above
    ``limit`` with a chosen one are passed over. Works on a feature-by-feature matrix, whose size is the registry's."""
    left, chosen = list(np.argsort(-relevance, kind="stable")), []
    while left and len(chosen) < k:
        red = {j: float(corr[j, chosen].mean()) if chosen else 0.0 for j in left}
        open_ = [j for j in left if not chosen or corr[j, chosen].max() <= limit]
        if not open_:
            break
        score = (lambda j: relevance[j] - lam * red[j]) if scheme == "difference" else (lambda j: relevance[j] / (red[j] + eps))
        best = max(open_, key=score)
        chosen.append(int(best))
        left.remove(best)
    return chosen


def quarter_resamples(quarters: list[int], count: int, fraction: float, seed: int) -> list[list[int]]:
    """Seeded subsets of calendar quarters."""
    rng = np.random.default_rng(seed)
    n = max(1, round(fraction * len(quarters)))
    return [sorted(rng.choice(quarters, n, replace=False).tolist()) for _ in range(count)]


def near_duplicates_out(df: DataFrame, pairs: DataFrame, key: str, rank: str) -> DataFrame:
    """``df`` without rows for which a better-ranked row is a near duplicate (``pairs``: a, b)."""
    r = df.select(key, rank)
    sides = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    worse = sides.join(r.withColumnsRenamed({key: "a", rank: "ra"}), "a").join(r.withColumnsRenamed({key: "b", rank: "rb"}), "b").where((F.col("ra") > F.col("rb")) | ((F.col("ra") == F.col("rb")) & (F.col("a") > F.col("b"))))
    return df.join(worse.select(F.col("a").alias(key)).distinct(), key, "left_anti")


def ic_ranking_order(relevance: np.ndarray, k: int) -> list[int]:
    """The k most relevant candidates, best first."""
    return np.argsort(-relevance, kind="stable")[:k].tolist()
