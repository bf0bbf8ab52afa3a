"""Recursions over long series without a task that holds one.

A series is cut into blocks of rows (`ordering`). A block's recursion, whatever state it starts from, is one map of a few
numbers; maps are made block by block, composed along the series (one small row a block) into every block's start, and the
blocks are then run from their starts. Composing is exact, so where blocks are cut does not change the result beyond
rounding. A step says what its maps are: `Affine` for s = a s' + b, `Moebius` for s = (p s' + q) / (u s' + v)."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import ordering as O
from tidemark.session import ship, written


class Step(Protocol):
    """A recursion of one or more states. ``columns`` are what a row's map is made of, ``names`` the states."""

    columns: list[str]
    names: list[str]

    def first(self) -> list[float]: ...

    def block_map(self, x: dict[str, np.ndarray]) -> list[float]: ...

    def advance(self, state: Sequence[float], block: Sequence[float]) -> list[float]: ...

    def run(self, x: dict[str, np.ndarray], state: Sequence[float]) -> dict[str, np.ndarray]: ...


class Affine:
    """s = a s' + b for each named pair of columns. A row with a = 0 starts anew whatever came before; before the first such
    row, and after one whose b is missing, there is no state; a missing a leaves the state as it is."""

    def __init__(self, pairs: dict[str, tuple[str, str]]):
        self.pairs, self.names = pairs, list(pairs)
        self.columns = sorted({c for p in pairs.values() for c in p})

    @staticmethod
    def _step(s: float, ab: tuple[float, float]) -> float:
        a, b = ab
        return b if a == 0 else s if a != a else a * s + b

    def _rows(self, x: dict[str, np.ndarray], name: str):
        a, b = (x[c].tolist() for c in self.pairs[name])
        return zip(a, b, strict=True)

    def first(self) -> list[float]:
        return [float("nan")] * len(self.names)

    def block_map(self, x: dict[str, np.ndarray]) -> list[float]:
        out: list[float] = []
        for n in self.names:
            a = x[self.pairs[n][0]]
            *_, shift = accumulate(self._rows(x, n), self._step, initial=0.0)
            out += [float(np.prod(np.where(np.isnan(a), 1.0, a))), shift]
        return out

    def advance(self, state: Sequence[float], block: Sequence[float]) -> list[float]:
        return [b if a == 0 else a * s + b for s, a, b in zip(state, block[::2], block[1::2], strict=True)]

    def run(self, x: dict[str, np.ndarray], state: Sequence[float]) -> dict[str, np.ndarray]:
        return {n: np.array(list(accumulate(self._rows(x, n), self._step, initial=s))[1:]) for n, s in zip(self.names, state, strict=True)}


class Moebius:
    """s = (p s' + q) / (u s' + v), by products of the 2 by 2 matrices of four columns; u = p = 0 starts anew."""

    def __init__(self, name: str, columns: tuple[str, str, str, str]):
        self.names, self.columns = [name], list(columns)

    @staticmethod
    def _apply(s: float, m: Sequence[float]) -> float:
        p, q, u, v = m
        return q / v if p == 0 and u == 0 else (p * s + q) / (u * s + v)

    def first(self) -> list[float]:
        return [float("nan")]

    def block_map(self, x: dict[str, np.ndarray]) -> list[float]:
        m = np.stack([x[c] for c in self.columns], 1).reshape(-1, 2, 2)
        while len(m) > 1:  # later rows act on the left; pairs multiply at once
            odd = m[-1:] if len(m) % 2 else m[:0]
            m = np.matmul(m[1::2], m[: len(m) - len(odd) : 2])
            m = np.concatenate([m / np.abs(m).max((1, 2), keepdims=True), odd])
        return m[0].ravel().tolist()

    def advance(self, state: Sequence[float], block: Sequence[float]) -> list[float]:
        return [self._apply(state[0], block)]

    def run(self, x: dict[str, np.ndarray], state: Sequence[float]) -> dict[str, np.ndarray]:
        rows = zip(*(x[c].tolist() for c in self.columns), strict=True)
        return {self.names[0]: np.array(list(accumulate(rows, self._apply, initial=state[0]))[1:])}


def scan(rows: DataFrame, series: list[str], keep: list[str], step: Step) -> DataFrame:
    """``rows``, which hold each row once with its number and block (`ordering.blocks` where it is a block's own), with the
    states of a step after each row; missing where there is none."""
    ship(rows.sparkSession)
    keys = [*series, O.BLOCK]
    held = written(rows.select(*keys, O.INDEX, *keep, *[F.col(c).cast("double").alias(c) for c in step.columns if c not in keep]))
    by = [held.schema[k] for k in keys]
    numbers = T.ArrayType(T.DoubleType())

    def columns(frame: pd.DataFrame) -> dict[str, np.ndarray]:
        return {c: frame[c].to_numpy("float64") for c in step.columns}

    def block(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(O.INDEX)
        return frame.iloc[:1][keys].assign(map=[step.block_map(columns(frame))])

    def carry(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(O.BLOCK)
        starts = list(accumulate(frame["map"], step.advance, initial=step.first()))[:-1]
        return frame[keys].assign(start=starts)

    def run(frame: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(O.INDEX)
        out = frame[[*keys, O.INDEX, *keep]].copy()
        for name, s in step.run(columns(frame), list(start["start"].iloc[0])).items():
            out[name] = s
        return out.astype({n: object for n in step.names}).where(out.notna(), None)

    maps = held.groupBy(*keys).applyInPandas(block, T.StructType([*by, T.StructField("map", numbers)]))
    starts = maps.groupBy(*series).applyInPandas(carry, T.StructType([*by, T.StructField("start", numbers)]))
    schema = T.StructType([*by, held.schema[O.INDEX], *[held.schema[c] for c in keep], *[T.StructField(n, T.DoubleType()) for n in step.names]])
    return held.groupBy(*keys).cogroup(starts.groupBy(*keys)).applyInPandas(run, schema)


def _cut(df: DataFrame, series: list[str], order: list[str], bucket: Column, columns, block_rows: int) -> DataFrame:
    """Own rows of blocks with more columns, which may look at the row before."""
    return O.blocks(df, series, order, bucket, 1, 0, block_rows).select("*", *columns(O.block_window(series))).where(O.OWN)


def ewma(
    df: DataFrame, series: list[str], order: list[str], bucket: Column, x: str, lam: float, warmup: int, block_rows: int = O.BLOCK_ROWS
) -> DataFrame:
    """``series, order, x`` with two exponential averages of the squares of ``x``, which has no missing values. ``lagged`` is
    the volatility of what came before the row, from the sample variance of the first ``warmup`` values; ``current`` takes
    the row in and starts from the mean of the first ceil(3 / (1 - lam)) squares."""
    some = int(np.ceil(round(3 / (1 - lam), 9)))
    i = F.col(O.INDEX)

    def seeded(cut: DataFrame) -> DataFrame:
        early = cut.where(i < max(warmup, some)).groupBy(*series)
        seeds = early.agg(F.var_samp(F.when(i < warmup, F.col(x))).alias("__v"), F.avg(F.when(i < some, F.col(x) ** 2)).alias("__m"))
        return O.beside(cut, seeds, series)

    def rows(at: int, seed: str, value: Column, a: str, b: str) -> list[Column]:
        none = F.lit(None).cast("double")
        return [F.when(i <= at, 0.0).otherwise(lam).alias(a), F.when(i < at, none).when(i == at, F.col(seed)).otherwise((1 - lam) * value).alias(b)]

    cut = _cut(df.select(*series, *order, x), series, order, bucket, lambda w: [F.lag(x).over(w).alias("__before")], block_rows)
    cut = seeded(cut).select("*", *rows(warmup, "__v", F.col("__before") ** 2, "__a1", "__b1"), *rows(some - 1, "__m", F.col(x) ** 2, "__a2", "__b2"))
    out = scan(cut, series, [*order, x], Affine({"lagged": ("__a1", "__b1"), "current": ("__a2", "__b2")}))
    return out.select(*series, *order, x, F.sqrt("lagged").alias("lagged"), "current")


def variance_path(
    df: DataFrame, series: list[str], order: list[str], bucket: Column, x: str, omega: float, alpha: float, beta: float, first: float, block_rows: int = O.BLOCK_ROWS
) -> DataFrame:
    """``series, order`` with h = omega + alpha x'^2 + beta h', where x' and h' are the row's before, from ``first``."""
    before = lambda w: [F.lag(x).over(w).alias("__before")]
    cut = _cut(df.select(*series, *order, x), series, order, bucket, before, block_rows)
    at_first = F.col(O.INDEX) == 0
    shock = F.coalesce(F.col("__before"), F.lit(0.0)) ** 2
    cut = cut.select("*", F.when(at_first, 0.0).otherwise(beta).alias("__a"), F.when(at_first, first).otherwise(omega + alpha * shock).alias("__b"))
    return scan(cut, series, order, Affine({"h": ("__a", "__b")})).select(*series, *order, "h")


def local_level(
    df: DataFrame, series: list[str], order: list[str], bucket: Column, y: str, q: float, r: float, gap: Column, block_rows: int = O.BLOCK_ROWS
) -> DataFrame:
    """``series, order, y`` with the filtered ``level`` and its ``variance`` of a random walk (steps of variance ``q``) seen
    with noise of variance ``r``. A row whose ``gap`` to the row before (``ts`` of which is ``__before``) is true starts
    anew; a missing value only adds uncertainty. The variance, p -> r (p + q) / (p + q + r), is a Moebius recursion; the
    level with the gains it gives, an affine one."""
    ts = order[0]
    cut = _cut(df.select(*series, *order, y), series, order, bucket, lambda w: [F.lag(ts).over(w).alias("__before")], block_rows)
    seen = F.col(y).isNotNull()
    cut = O.beside(cut, cut.groupBy(*series).agg(F.min(F.when(seen, F.col(O.INDEX))).alias("__first")), series)
    anew = ((F.col(O.INDEX) == F.col("__first")) | F.coalesce(gap, F.lit(False))) & seen
    four = {"__p": (0.0, r, 1.0), "__q": (r, r * q, q), "__u": (0.0, 1.0, 0.0), "__v": (1.0, q + r, 1.0)}
    cut = cut.select("*", *[F.when(anew, a).when(seen, b).otherwise(c).alias(n) for n, (a, b, c) in four.items()])
    p = scan(cut, series, [*order, y], Moebius("variance", ("__p", "__q", "__u", "__v")))
    gain = F.col("variance") / r
    p = p.select("*", F.when(F.col(y).isNotNull(), F.when(gain >= 1, 0.0).otherwise(1 - gain)).alias("__a"), F.when(F.col(y).isNotNull(), gain * F.col(y)).alias("__b"))
    out = scan(p, series, [*order, y, "variance"], Affine({"level": ("__a", "__b")}))
    return out.select(*series, *order, y, "level", "variance")


def running(df: DataFrame, series: list[str], order: list[str], bucket: Column, totals: dict[str, tuple[str, Column]], block_rows: int = O.BLOCK_ROWS) -> DataFrame:
    """``df`` with running totals: each name's kind is ``sum``, ``max``, ``min``, ``last`` (the last present value so far)
    or ``count`` of a column up to and with the row. Blocks' totals are carried over the blocks of a series; no window holds
    more than a block."""
    kinds = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count, "last": lambda c: F.last(c, True)}
    marked = O.blocks(df.select("*", *[c.alias(f"__in_{n}") for n, (_, c) in totals.items()]), series, order, bucket, 0, 0, block_rows)
    keys = [*series, O.BLOCK]
    ends = marked.groupBy(*keys).agg(*[(F.max_by(f"__in_{n}", F.when(F.col(f"__in_{n}").isNotNull(), F.col(O.INDEX))) if k == "last" else kinds[k](f"__in_{n}")).alias(f"__end_{n}") for n, (k, _) in totals.items()])
    before = W.partitionBy(*series, F.lit(0)).orderBy(O.BLOCK).rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(*keys, *[(F.sum if k in ("sum", "count") else kinds[k])(f"__end_{n}").over(before).alias(f"__from_{n}") for n, (k, _) in totals.items()])
    w = O.block_window(series).rowsBetween(W.unboundedPreceding, 0)

    def total(name: str, kind: str) -> Column:
        own, old = kinds[kind](f"__in_{name}").over(w), F.col(f"__from_{name}")
        if kind == "sum":
            return F.when(own.isNull(), old).otherwise(own + F.coalesce(old, F.lit(0)))
        if kind == "count":
            return own + F.coalesce(old, F.lit(0))
        return F.coalesce(own, old) if kind == "last" else (F.greatest if kind == "max" else F.least)(own, old)

    return O.beside(marked, carried, keys).select(*df.columns, *[total(n, k).alias(n) for n, (k, _) in totals.items()])
