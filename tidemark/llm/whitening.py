"""Embedding whitening by one-sided Jacobi SVD over blockwise TSQR.

Every component of a vector is scaled to a whole number. One pass adds up rows and sums a dimension (exact integers). A
second compresses the centred rows, block by block, to a triangle R a partition; triangles merge in rounds of ``FAN_IN``
until one is left, which stands for all rows (R'R is their scatter). Plane rotations then make R's columns orthogonal: the
accumulated rotations are the components and the columns' lengths, over the root of the rows, the standard deviations, which
Jacobi's method gives to full relative accuracy, small ones included. A third pass measures how far the covariance of the
whitened rows is from the identity; the last one writes them. What passes through the driver is one triangle and sums, whose
size depends on the dimension alone (``MAX_DIM``). Partitions keep one triangle each, never their rows.

Defined results: vectors that are null, hold a null, NaN or infinite entry or one beyond ``LIMIT`` once scaled take no part,
nor do those of another length than the most frequent one (ties: the longer) and those without entries; null ids take
part and stay null; repeated rows count each for itself; components without variance (their deviation is rounding beside the
greatest) have no whitened form and are left out, so that equal rows or one row give no rows; an empty table gives an empty
table; only the columns named are read. Each component's largest entry is positive.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ship, tidy, written

#: Triangles merged by one task; rows of a block; greatest dimension; greatest scaled entry (doubles hold it exactly).
FAN_IN, BLOCK, MAX_DIM, LIMIT = 16, 4_096, 2_048, 2**51
#: Columns are orthogonal when their cosine is below this; sweeps there may be.
ORTHOGONAL, SWEEPS = 1e-15, 60
#: A deviation below this share of the greatest, times the dimension, is rounding.
NO_VARIANCE = 4 * np.finfo(float).eps
LONG_MAX = 2**63 - 1


def scaled_rows(column: pa.ListArray, dim: int | None, scale: int, offset: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a batch that take part (those of length ``dim``; of every length if None) and, for one length, their
    scaled entries as a matrix of longs. Without a length the matrix has the rows' lengths."""
    n = len(column)
    ends = column.offsets.to_numpy(zero_copy_only=False)
    lens = np.diff(ends)
    flat = column.values.slice(int(ends[0]), int(ends[-1] - ends[0]))
    x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    with np.errstate(invalid="ignore", over="ignore"):
        x = np.floor(x * scale)
    bad = ~(np.abs(x) < LIMIT)
    before = np.concatenate([[0], np.cumsum(bad)])
    at = ends - ends[0]
    fit = (before[at[1:]] == before[at[:-1]]) & (lens > 0)
    if column.null_count:
        fit &= column.is_valid().to_numpy(zero_copy_only=False)
    if dim is None:
        return np.flatnonzero(fit), lens[fit]
    rows = np.flatnonzero(fit & (lens == dim))
    if len(rows) == n:
        q = x.reshape(n, dim)
    else:
        q = x[at[:-1][rows][:, None] + np.arange(dim)]
    return rows, q.astype(np.int64) + offset


def _triangle(r: np.ndarray | None, block: np.ndarray) -> np.ndarray:
    """R of the rows that ``r`` stands for and of ``block``."""
    return np.linalg.qr(block if r is None else np.vstack([r, block]), mode="r")


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values of ``r``, falling, and its right singular vectors as columns, by one-sided Jacobi rotations of
    disjoint pairs of columns (a round robin makes every pair meet once a sweep)."""
    d = r.shape[1]
    u, v = np.array(r, float), np.eye(d)
    even = d + d % 2
    ring = np.arange(even)
    for _ in range(SWEEPS):
        most = 0.0
        for _ in range(even - 1):
            a, b = ring[: even // 2], ring[even // 2 :][::-1]
            on = (a < d) & (b < d)
            p, q = a[on], b[on]
            x, y = u[:, p], u[:, q]
            alpha, beta, gamma = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            scale = np.sqrt(alpha) * np.sqrt(beta)
            cosine = np.abs(gamma) / np.where(scale > 0, scale, 1.0)
            most = max(most, float(cosine.max(initial=0.0)))
            turn = cosine > ORTHOGONAL
            if turn.any():
                p, q, x, y = p[turn], q[turn], x[:, turn], y[:, turn]
                zeta = (beta[turn] - alpha[turn]) / (2 * gamma[turn])
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                c = 1 / np.hypot(1.0, t)
                s = c * t
                u[:, p], u[:, q] = c * x - s * y, s * x + c * y
                vp, vq = v[:, p], v[:, q]
                v[:, p], v[:, q] = c * vp - s * vq, s * vp + c * vq
            ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
        if most <= ORTHOGONAL * d:
            break
    sigma = np.sqrt((u * u).sum(0))
    by = np.argsort(-sigma, kind="stable")
    sigma, v = sigma[by], v[:, by]
    return sigma, v * np.where(v[np.abs(v).argmax(0), np.arange(d)] < 0, -1.0, 1.0)


class Fit:
    """Rows, exact sums, components (columns) with their deviations, and shares of the variance."""

    def __init__(self, n: int, sums: list[int], sigma: np.ndarray, vectors: np.ndarray, components: int):
        self.n, self.sums = n, sums
        trace = float((sigma**2).sum())
        live = sigma > NO_VARIANCE * len(sums) * sigma[0]
        kept = min(components, int(live.sum()))
        self.deviation = sigma[:kept] / np.sqrt(n)
        self.vectors = vectors[:, :kept]
        self.explained = sigma[:kept] ** 2 / trace if trace else sigma[:0]
        self.base, self.rest = centre(n, sums)
        # n * x - S is n * (x - base) - n * rest; integers that fit a long are exact in one.
        self.shift = np.array([n * b - s for b, s in zip(self.base.tolist(), sums, strict=True)], object)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.base) - self.rest) @ self.vectors / self.deviation

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """Exact sums of (n * x - S) ** 2 of the rows, as longs; beyond a long's range its greatest value."""
        y = x - self.base
        big = self.n * int(np.abs(y).max(initial=0)) + max(map(abs, self.shift.tolist()), default=0)
        if big * big * len(self.sums) <= LONG_MAX:
            z = self.n * y + self.shift.astype(np.int64)
            return (z * z).sum(1)
        exact = [sum((self.n * int(a) + b) ** 2 for a, b in zip(row, self.shift, strict=True)) for row in y.tolist()]
        return np.array([min(e, LONG_MAX) for e in exact], np.int64)


def centre(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Means as a whole number and an exact rest of at most a half, so that centring loses nothing."""
    base = [(2 * s + n) // (2 * n) for s in sums]
    return np.array(base, np.int64), np.array([(s - n * b) / n for s, b in zip(sums, base, strict=True)])


def _merged(triangles: DataFrame, dim: int) -> np.ndarray:
    """One triangle of many, ``FAN_IN`` to a task and round."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[k] = _triangle(held.get(k), np.frombuffer(raw).reshape(-1, dim))
        for k, r in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([r.tobytes()], pa.binary())], names=["part", "r"])

    while (n := triangles.count()) > FAN_IN:
        groups = -(-n // FAN_IN)
        dealt = triangles.select((F.col("part") / FAN_IN).cast("long").alias("part"), "r").repartition(groups, "part")
        triangles = written(dealt.mapInArrow(tidy(merge), "part long, r binary"))
    r = None
    for row in triangles.orderBy("part").collect():
        r = _triangle(r, np.frombuffer(row["r"]).reshape(-1, dim))
    return r


def fit(df: DataFrame, vector: str = "embedding", components: int = 32, scale: int = 64, offset: int = 1_000_000) -> tuple[int, Fit | None]:
    """The dimension and what all rows of it are whitened by; nothing where no row takes part."""
    ship(df.sparkSession)
    vectors = df.select(F.col(f"`{vector}`").cast("array<double>").alias("x"))

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, int] = {}
        for batch in batches:
            for length, count in zip(*np.unique(scaled_rows(batch.column(0), None, scale, 0)[1], return_counts=True), strict=True):
                found[int(length)] = found.get(int(length), 0) + int(count)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(list(found.values()), pa.int64())], names=["dim", "n"])

    counted = vectors.mapInArrow(tidy(lengths), "dim int, n long").groupBy("dim").agg(F.sum("n").alias("n"))
    most = counted.orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    if not most:
        return 0, None
    dim, n = most[0]
    if dim > MAX_DIM:
        raise ValueError(f"vectors of {dim} entries; at most {MAX_DIM} are whitened")

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dim, object)
        for batch in batches:
            q = scaled_rows(batch.column(0), dim, scale, 0)[1]
            for k in range(0, len(q), BLOCK):  # of 4,096 entries below 2**51 the sum is below 2**63
                total += q[k : k + BLOCK].sum(0).astype(object)
        sums = pa.array([str(s) for s in total.tolist()], pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), sums], names=["at", "s"])

    added = vectors.mapInArrow(tidy(add_up), "at int, s string").groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    sums = [int(r["s"]) + n * offset for r in added.orderBy("at").collect()]
    base, rest = centre(n, sums)

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        r = None
        for batch in batches:
            q = scaled_rows(batch.column(0), dim, scale, offset)[1]
            for k in range(0, len(q), BLOCK):
                r = _triangle(r, (q[k : k + BLOCK] - base) - rest)
        if r is not None:
            part = pa.array([TaskContext.get().partitionId()], pa.int64())
            yield pa.RecordBatch.from_arrays([part, pa.array([r.tobytes()], pa.binary())], names=["part", "r"])

    r = _merged(written(vectors.mapInArrow(tidy(compress), "part long, r binary")), dim)
    return dim, Fit(n, sums, *jacobi(r), components)


def identity_error(df: DataFrame, vector: str, dim: int, own: Fit, scale: int, offset: int) -> float:
    """The largest absolute entry of the whitened rows' covariance (divisor n, centred) minus the identity."""
    k = own.vectors.shape[1]

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            w = own.whitened(scaled_rows(batch.column(0), dim, scale, offset)[1])
            total[:k] += w.T @ w
            total[k] += w.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], names=["at", "s"])

    vectors = df.select(F.col(f"`{vector}`").cast("array<double>").alias("x"))
    rows = vectors.mapInArrow(tidy(moments), "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).orderBy("at").collect()
    total = np.array([r["s"] for r in rows]).reshape(k + 1, k) / own.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max(initial=0.0))


def whiten(
    df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = 32, scale: int = 64, offset: int = 1_000_000
) -> DataFrame:
    """A row for each vector that takes part and each component up to ``components``: ``vec_id, component`` (from 1), ``n,
    deviation`` (exact sum of (n * x - S) ** 2), ``whitened, explained, identity_error``."""
    spark = df.sparkSession
    types = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    ids = df.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("x"))
    schema = f"vec_id {ids.schema[0].dataType.simpleString()}, {types}"
    dim, own = fit(df, vector, components, scale, offset)
    if own is None or not len(own.deviation):
        return spark.createDataFrame([], schema)
    error = identity_error(df, vector, dim, own, scale, offset)
    held, k = spark.sparkContext.broadcast(own), len(own.deviation)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            rows, q = scaled_rows(batch.column(1), dim, scale, offset)
            for start in range(0, len(rows), BLOCK):
                part, x = rows[start : start + BLOCK], q[start : start + BLOCK]
                m = len(part)
                cols = [
                    batch.column(0).take(pa.array(np.repeat(part, k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, own.n)),
                    pa.array(np.repeat(own.deviations(x), k)),
                    pa.array(own.whitened(x).ravel()),
                    pa.array(np.tile(own.explained, m)),
                    pa.array(np.full(m * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return ids.mapInArrow(tidy(project), schema)
