"""Hidden Markov models of long series, by products of transfer matrices in two semirings.

A series is packed into blocks of rows. What a block does to the state before it is one matrix, the product of its rows'
matrices: of probabilities for filtering and smoothing, of largest log scores for the best path. Matrices of blocks are
composed along the series (one small row a block) into every block's start and end, from which the blocks are run alone.
Within a block, chunks of ``CHUNK`` rows are run side by side by the same rule. Baum-Welch adds up a few sums a block and
round. No task holds a series."""

from __future__ import annotations


from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.models import log_gaussian
from tidemark.operators import ordering as O
from tidemark.session import BROADCAST_ROWS, ship, small_side, written

CHUNK = 256
NUMBERS = T.ArrayType(T.DoubleType())


def _rows(log_b: np.ndarray, transition: np.ndarray, first: bool) -> tuple[np.ndarray, float]:
    """A matrix a row, scaled, and the logarithm of the scales. A series' first row comes without a transition."""
    top = log_b.max(1)
    b = np.exp(log_b - top[:, None])
    m = transition[None] * b[:, None, :]
    if first:
        m[0] = np.diag(b[0])
    return m, float(top.sum())


def _best_rows(log_b: np.ndarray, transition: np.ndarray, first: bool) -> np.ndarray:
    m = np.log(transition + 1e-300)[None] + log_b[:, None, :]
    if first:
        m[0] = np.where(np.eye(len(transition), dtype=bool), log_b[0], -np.inf)
    return m


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.matmul(a, b)
    return out / out.max((-2, -1), keepdims=True)


def _best_times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[..., :, :, None] + b[..., None, :, :]).max(-2)


def _product(m: np.ndarray, times) -> np.ndarray:
    """Product of matrices along the first axis but one batch axis: ``m`` is rows by batch by states by states."""
    while len(m) > 1:
        odd = m[-1:] if len(m) % 2 else m[:0]
        m = np.concatenate([times(m[: len(m) - len(odd) : 2], m[1::2]), odd])
    return m[0]


def transfer(log_b: np.ndarray, transition: np.ndarray, first: bool) -> np.ndarray:
    """What a block does to probabilities before it, up to a factor."""
    return _product(_rows(log_b, transition, first)[0][:, None], _times)[0]


def best_transfer(log_b: np.ndarray, transition: np.ndarray, first: bool) -> np.ndarray:
    """Largest log score from each state before a block to each at its end."""
    return _product(_best_rows(log_b, transition, first)[:, None], _best_times)[0]


def _chunked(m: np.ndarray, neutral: np.ndarray) -> np.ndarray:
    """Rows' matrices as place in the chunk by chunk, filled up with neutral ones."""
    n, k = len(m), m.shape[1]
    chunks = -(-n // CHUNK)
    fill = np.broadcast_to(neutral, (chunks * CHUNK - n, k, k))
    return np.concatenate([m, fill]).reshape(chunks, CHUNK, k, k).swapaxes(0, 1)


def forward(log_b: np.ndarray, transition: np.ndarray, start: np.ndarray, first: bool) -> tuple[np.ndarray, float]:
    """Probabilities of the states after each row given the rows so far, and the block's log-likelihood."""
    m, scale = _rows(log_b, transition, first)
    c = _chunked(m, np.eye(m.shape[1]))
    whole = _product(c, _times)
    s = np.empty((c.shape[1], m.shape[1]))
    s[0] = start
    for k in range(1, len(s)):
        s[k] = s[k - 1] @ whole[k - 1]
        s[k] /= s[k].sum()
    out, total = np.empty((*c.shape[:2], m.shape[1])), 0.0
    for j in range(CHUNK):
        s = np.einsum("nk,nkl->nl", s, c[j])
        size = s.sum(1, keepdims=True)
        total += float(np.log(size).sum())
        s = s / size
        out[j] = s
    return out.swapaxes(0, 1).reshape(-1, m.shape[1])[: len(log_b)], total + scale


def backward(log_b: np.ndarray, transition: np.ndarray, end: np.ndarray, first: bool) -> np.ndarray:
    """What the rows after each row say of its states, up to a factor."""
    m, _ = _rows(log_b, transition, first)
    c = _chunked(m, np.eye(m.shape[1]))
    whole = _product(c, _times)
    s = np.empty((c.shape[1], m.shape[1]))
    s[-1] = end
    for k in range(len(s) - 2, -1, -1):
        s[k] = whole[k + 1] @ s[k + 1]
        s[k] /= s[k].sum()
    out = np.empty((*c.shape[:2], m.shape[1]))
    for j in range(CHUNK - 1, -1, -1):
        out[j] = s
        s = np.einsum("nkl,nl->nk", c[j], s)
        s = s / s.sum(1, keepdims=True)
    return out.swapaxes(0, 1).reshape(-1, m.shape[1])[: len(log_b)]


def best_path(log_b: np.ndarray, transition: np.ndarray, start: np.ndarray, end: int, first: bool) -> np.ndarray:
    """The best states of a block's rows that end in ``end``, given the scores before the block."""
    m = _best_rows(log_b, transition, first)
    k = m.shape[1]
    neutral = np.where(np.eye(k, dtype=bool), 0.0, -np.inf)
    c = _chunked(m, neutral)
    whole = _product(c, _best_times)
    s = np.empty((c.shape[1], k))
    s[0] = start
    for j in range(1, len(s)):
        s[j] = (s[j - 1][:, None] + whole[j - 1]).max(0)
    back = np.empty((*c.shape[:2], k), np.int64)
    for j in range(CHUNK):
        step = s[:, :, None] + c[j]
        back[j] = step.argmax(1)
        s = step.max(1)
    came = back.swapaxes(0, 1).reshape(-1, k)[: len(log_b)].tolist()
    path = [end]
    for row in reversed(came[1:]):
        path.append(row[path[-1]])
    return np.array(path[::-1])


class Parameters:
    """A model as one array of doubles: prior, transition, means and covariances."""

    def __init__(self, prior: np.ndarray, transition: np.ndarray, means: np.ndarray, covs: np.ndarray):
        self.prior, self.transition, self.means, self.covs = prior, transition, means, covs

    @classmethod
    def of(cls, flat, states: int, dim: int) -> Parameters:
        cuts = np.cumsum([states, states * states, states * dim])
        a, b, c, d = np.split(np.asarray(flat, float), cuts)
        return cls(a, b.reshape(states, states), c.reshape(states, dim), d.reshape(states, dim, dim))

    def flat(self) -> list[float]:
        return np.concatenate([v.ravel() for v in (self.prior, self.transition, self.means, self.covs)]).tolist()

    def ordered(self) -> Parameters:
        """States in order of their first mean."""
        by = np.argsort(self.means[:, 0], kind="stable")
        return Parameters(self.prior[by], self.transition[np.ix_(by, by)], self.means[by], self.covs[by])


def pack(df: DataFrame, series: list[str], order: list[str], bucket: Column, features: list[str], t: Column, block_rows: int = O.BLOCK_ROWS) -> DataFrame:
    """Blocks of rows as one row each: ``first`` (the series' first block), the features in order, and ``t``, a long that
    stands for each row in results. Rows with a missing feature are left out."""
    rows = df.dropna(subset=features).select(*series, *order, *[F.col(f).cast("double").alias(f"__f{k}") for k, f in enumerate(features)], t.cast("long").alias("__t"))
    cut = O.blocks(rows, series, order, bucket, 0, 0, block_rows)
    one = F.struct(O.INDEX, "__t", F.array(*[f"__f{k}" for k in range(len(features))]).alias("x"))
    lists = cut.groupBy(*series, O.BLOCK).agg(F.array_sort(F.collect_list(one)).alias("r"))
    return written(lists.select(*series, O.BLOCK, (F.col(O.BLOCK) == 0).alias("first"), F.transform("r", lambda r: r["__t"]).alias("t"), F.flatten(F.transform("r", lambda r: r["x"])).alias("x")))


def _densities(row: dict, states: int, dim: int) -> tuple[Parameters, np.ndarray, np.ndarray]:
    """A block's model, rows and the log densities of its rows in each state."""
    p, x = Parameters.of(row["params"], states, dim), np.asarray(row["x"], float).reshape(-1, dim)
    return p, x, log_gaussian(x, p.means, p.covs)


class Model:
    """Hidden Markov models, one a series, of packed blocks."""

    def __init__(self, packed: DataFrame, series: list[str], states: int, dim: int):
        ship(packed.sparkSession)
        self.packed, self.series, self.states, self.dim = packed, series, states, dim
        self.keys = [packed.schema[s] for s in series]
        self.block = packed.schema[O.BLOCK]
        blocks = packed.agg(F.count("*"), F.count_if(F.col(O.BLOCK) == 0)).first()
        #: Whether one small row a block, and one a series, are few enough to be sent to every executor.
        self.few_blocks, self.few = (n <= BROADCAST_ROWS for n in blocks)

    def _blockwise(self, rows: DataFrame) -> DataFrame:
        """Rows of one a block, for joins."""
        return F.broadcast(rows) if self.few_blocks else rows

    def _held(self, params: DataFrame) -> tuple[DataFrame, bool]:
        """Parameters evaluated once, and whether all series are done."""
        if self.few:
            found = params.toArrow()
            return F.broadcast(params.sparkSession.createDataFrame(found, params.schema)), all(found["done"].to_pylist())
        out = written(params)
        return out, not out.where("NOT done").limit(1).count()

    def _with(self, params: DataFrame, packed: DataFrame | None = None) -> DataFrame:
        return O.beside(self.packed if packed is None else packed, params.select(*self.series, "params"), self.series)

    def _each(self, df: DataFrame, kernel, fields: str) -> DataFrame:
        """``kernel`` of every block's row, as records."""
        schema, series = T.StructType([*self.keys, self.block, *T._parse_datatype_string(fields).fields]), self.series

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for row in frame.to_dict("records"):  # a block at a time
                    yield pd.DataFrame([{**{s: row[s] for s in series}, O.BLOCK: row[O.BLOCK], **kernel(row)}], columns=schema.names)

        return df.mapInPandas(run, schema)

    def carried(self, params: DataFrame, packed: DataFrame | None = None) -> DataFrame:
        """Every block's ``start`` (probabilities before it) and ``end`` (what the rows after it say)."""

        states, dim, series = self.states, self.dim, self.series

        def matrix(row: dict) -> dict:
            p, _, log_b = _densities(row, states, dim)
            return {"m": transfer(log_b, p.transition, bool(row["first"])).ravel(), "params": row["params"]}

        maps = self._each(self._with(params, packed), matrix, "m array<double>, params array<double>")

        def carry(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values(O.BLOCK)
            m = [np.reshape(v, (states, states)) for v in frame["m"]]
            starts, ends = [Parameters.of(frame["params"].iloc[0], states, dim).prior], [np.full(states, 1 / states)]
            for a in m[:-1]:
                s = starts[-1] @ a
                starts.append(s / s.sum())
            for a in reversed(m[1:]):
                e = a @ ends[-1]
                ends.append(e / e.sum())
            return frame[[*series, O.BLOCK]].assign(start=starts, end=ends[::-1])

        return maps.groupBy(*series).applyInPandas(carry, T.StructType([*self.keys, self.block, T.StructField("start", NUMBERS), T.StructField("end", NUMBERS)]))

    def started(self) -> DataFrame:
        """First parameters from sums alone: states spread over each feature's mean plus and minus its deviation."""
        feature = F.posexplode("x").alias("__i", "v")
        long = self.packed.select(*self.series, feature).withColumn("__i", F.col("__i") % self.dim)
        sums = long.groupBy(*self.series, "__i").agg(F.avg("v").alias("m"), F.var_pop("v").alias("v"))
        lists = sums.groupBy(*self.series).agg(F.array_sort(F.collect_list(F.struct("__i", "m", "v"))).alias("f"))
        k, d, series = self.states, self.dim, self.series

        def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                out = []
                for f in frame["f"]:
                    mean, var = np.array([r["m"] for r in f]), np.maximum([r["v"] for r in f], 1e-12)
                    z = 1.2 * (2 * (np.arange(k) + 0.5) / k - 1)
                    stay = 0.9 if k > 1 else 1.0
                    transition = np.full((k, k), (1 - stay) / max(1, k - 1)) + np.eye(k) * (stay - (1 - stay) / max(1, k - 1))
                    out.append(Parameters(np.full(k, 1 / k), transition, mean + z[:, None] * np.sqrt(var), np.repeat(np.diag(var)[None], k, 0)).flat())
                yield frame[series].assign(params=out, ll=-np.inf, done=False)

        return lists.mapInPandas(first, self._params())

    def _params(self) -> T.StructType:
        return T.StructType([*self.keys, *T._parse_datatype_string("params array<double>, ll double, done boolean").fields])

    def _round(self, params: DataFrame, kind: str, reg: float, pseudo: float, tol: float) -> DataFrame:
        states, dim, series = self.states, self.dim, self.series
        carried = self._blockwise(self.carried(params))

        def sums(row: dict) -> dict:
            """Responsibilities by state with first and second moments, transitions, likelihood, rows, and the first row's."""
            p, x, log_b = _densities(row, states, dim)
            first = bool(row["first"])
            start = np.asarray(row["start"])
            a, ll = forward(log_b, p.transition, start, first)
            b = backward(log_b, p.transition, np.asarray(row["end"]), first)
            g = a * b
            g /= g.sum(1, keepdims=True)
            before = np.vstack([start[None], a[:-1]])
            pair = before[:, :, None] * p.transition[None] * (np.exp(log_b - log_b.max(1, keepdims=True)) * b)[:, None, :]
            pair /= pair.sum((1, 2), keepdims=True)
            moved = pair[1:].sum(0) if first else pair.sum(0)
            outer = np.einsum("nk,ni,nj->kij", g, x, x)
            parts = [g.sum(0), g.T @ x, outer, moved, [ll, len(x)], g[0] if first else np.zeros(states)]
            return {"__sums": np.concatenate([np.ravel(v) for v in parts])}

        stats = self._each(O.beside(self._with(params), carried, [*series, O.BLOCK]), sums, "__sums array<double>")
        old = O.beside(stats, params.select(*series, "params", F.col("ll").alias("before"), "done"), series)

        def maximise(frame: pd.DataFrame) -> pd.DataFrame:
            line = frame.iloc[:1]
            if bool(line["done"].iloc[0]):
                return line[series].assign(params=list(line["params"]), ll=line["before"], done=True)
            k, d = states, dim
            s = np.sum([np.asarray(v) for v in frame.sort_values(O.BLOCK)["__sums"]], 0)
            n, sx, sxx, moved, rest, begin = np.split(s, np.cumsum([k, k * d, k * d * d, k * k, 2]))
            n, moved = n + 1e-12, moved.reshape(k, k) + pseudo * np.eye(k)
            means = sx.reshape(k, d) / n[:, None]
            covs = sxx.reshape(k, d, d) / n[:, None, None] - means[:, :, None] * means[:, None, :]
            if kind == "tied":
                covs = np.repeat(((n[:, None, None] * covs).sum(0) / n.sum())[None], k, 0)
            if kind == "diag":
                covs = np.array([np.diag(np.maximum(np.diag(c), 0.0)) for c in covs])
            new = Parameters(begin / begin.sum(), moved / moved.sum(1, keepdims=True), means, covs + reg * np.eye(d))
            ll, rows = rest
            done = bool(ll - line["before"].iloc[0] < tol * rows)
            return line[series].assign(params=[new.flat()], ll=ll, done=done)

        return old.groupBy(*series).applyInPandas(maximise, self._params())

    def fit(self, kind: str = "full", rounds: int = 60, tol: float = 1e-5, reg: float = 1e-4, pseudo: float = 1.0) -> DataFrame:
        """``series, params, ll, done`` by Baum-Welch; series that gain less than ``tol`` a row stay as they are."""
        params, done = self._held(self.started())
        for _ in range(rounds):
            params, done = self._held(self._round(params, kind, reg, pseudo, tol))
            if done:
                break
        k, d = self.states, self.dim

        def ordered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                yield frame.assign(params=[Parameters.of(p, k, d).ordered().flat() for p in frame["params"]])

        return self._held(params.mapInPandas(ordered, self._params()))[0]

    def _unpacked(self, df: DataFrame, columns: list[str]) -> DataFrame:
        """A row for each packed one."""
        return df.select(*self.series, F.explode(F.arrays_zip("t", *columns)).alias("__r")).select(*self.series, "__r.*")

    def filtered(self, params: DataFrame, packed: DataFrame | None = None) -> DataFrame:
        """``series, t, state, p``: probabilities of the states given the rows so far. Causal."""
        states, dim = self.states, self.dim
        df = O.beside(self._with(params, packed), small_side(self.carried(params, packed)), [*self.series, O.BLOCK])

        def run(row: dict) -> dict:
            p, _, log_b = _densities(row, states, dim)
            a, _ = forward(log_b, p.transition, np.asarray(row["start"]), bool(row["first"]))
            return {"t": row["t"], "state": a.argmax(1), "p": list(a)}

        return self._unpacked(self._each(df, run, "t array<long>, state array<int>, p array<array<double>>"), ["state", "p"])

    def smoothed(self, params: DataFrame) -> DataFrame:
        """``series, t, state, p, path``: probabilities given all rows, and the best path. Not causal."""
        series, states, dim = self.series, self.states, self.dim

        def matrix(row: dict) -> dict:
            p, _, log_b = _densities(row, states, dim)
            return {"m": best_transfer(log_b, p.transition, bool(row["first"])).ravel(), "params": row["params"]}

        maps = self._each(self._with(params), matrix, "m array<double>, params array<double>")

        def trace(frame: pd.DataFrame) -> pd.DataFrame:
            """Scores before each block, then the state each block ends in, from the last block back."""
            frame = frame.sort_values(O.BLOCK)
            m = [np.reshape(v, (states, states)) for v in frame["m"]]
            scores = [np.log(Parameters.of(frame["params"].iloc[0], states, dim).prior + 1e-300)]
            for a in m:
                s = (scores[-1][:, None] + a).max(0)
                scores.append(s - s.max())
            ends = [int(scores[-1].argmax())]
            for a, s in zip(reversed(m[1:]), reversed(scores[1:-1]), strict=True):
                ends.append(int((s + a[:, ends[-1]]).argmax()))
            return frame[[*series, O.BLOCK]].assign(score=scores[:-1], last=ends[::-1])

        traced = maps.groupBy(*series).applyInPandas(trace, T.StructType([*self.keys, self.block, T.StructField("score", NUMBERS), T.StructField("last", T.IntegerType())]))
        both = [*series, O.BLOCK]
        df = O.beside(O.beside(self._with(params), self._blockwise(self.carried(params)), both), self._blockwise(traced), both)

        def run(row: dict) -> dict:
            p, _, log_b = _densities(row, states, dim)
            first = bool(row["first"])
            a, _ = forward(log_b, p.transition, np.asarray(row["start"]), first)
            g = a * backward(log_b, p.transition, np.asarray(row["end"]), first)
            g /= g.sum(1, keepdims=True)
            path = best_path(log_b, p.transition, np.asarray(row["score"]), int(row["last"]), first)
            return {"t": row["t"], "state": g.argmax(1), "p": list(g), "path": path}

        return self._unpacked(self._each(df, run, "t array<long>, state array<int>, p array<array<double>>, path array<int>"), ["state", "p", "path"])
