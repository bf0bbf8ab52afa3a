"""Exact top-k inner product search by norm-bucketed retrieval.

Vectors are scaled to integers and cut, in order of length, into ranges of about ``RANGE`` vectors that no single length
or vector can fill. The first thresholds come from the ``SEEDS`` longest vectors, which are broadcast. A query goes to
the ranges whose greatest length its threshold allows, and to no other; in one pass over all ranges, a task holds one
range and takes the queries that come to it in blocks of ``BLOCK``. It walks its range in buckets of ``BUCKET`` vectors.
For each query and bucket the local cosine threshold is the query's k-th best score so far over the product of the
query's and the bucket's greatest length: above 1 the bucket is skipped; from ``COORDINATE_FROM`` on, candidates must lie
in the feasible region of the query's ``FOCUS`` largest coordinates, found through the bucket's sorted coordinate lists;
below it, the bucket's vectors are cut by length. What is left is verified by its integer product. A task returns k rows
a query and range at most. Queries are never gathered at the driver.

Defined results: vectors that are null, or hold a null, NaN or infinite component (also once scaled, which takes doubles
near the end of their range), and rows without an id take no part; all others do: components are kept as doubles, which
hold every such integer exactly, and products that doubles would round are made of whole numbers. A product beyond the
range of a long is the nearest long; only vectors of one dimension are compared; repeated candidate rows count each for
itself; repeated query rows count once if their vectors agree and are separate queries if not; a candidate with the
query's own id is left out; an empty table gives an empty table; only the columns named are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import ship, tidy, written

#: Vectors of a bucket and of a range, queries worked on at a time, vectors that give the first thresholds.
BUCKET, RANGE, BLOCK, SEEDS = 2_048, 16_384, 4_096, 2_048
#: Ranges there may be; of more vectors ranges are longer. Their lengths go to the driver and out again.
MOST_RANGES = 65_536
#: Local cosine threshold from which coordinates are pruned, and how many of a query's.
COORDINATE_FROM, FOCUS = 0.6, 5


def scaled(df: DataFrame, vec_id: str, vector: str, scale: int, asked) -> DataFrame:
    """``id, dim, length, q, asked``: the integer vectors that take part, as doubles."""
    own = df.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("x"), asked.alias("asked"))
    fit = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * scale) < float("inf")))
    # From 2**53 on every double is a whole number.
    whole = lambda v: F.when(F.abs(v * scale) < float(2**53), F.floor(v * scale).cast("double")).otherwise(v * scale)
    q = own.where(F.col("id").isNotNull() & F.col("x").isNotNull() & fit).select("id", F.transform("x", whole).alias("q"), "asked")
    square = F.aggregate("q", F.lit(0.0), lambda s, v: s + v * v)
    return q.select("id", F.size("q").alias("dim"), F.sqrt(square).alias("length"), "q", F.coalesce("asked", F.lit(False)).alias("asked"))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of the rows of ``a`` and of ``b``, whole numbers held as doubles: by floating point where that is
    exact, else by integers; cut to the range of a long."""
    big = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if big < 2**53:
        return np.rint(a @ b.T).astype(np.int64)
    if big < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    low, high = -(2**63), 2**63 - 1
    exact = [np.array([int(v) for v in x.ravel()], object).reshape(x.shape) for x in (a, b)]
    return np.array([[min(max(int(v), low), high) for v in row] for row in exact[0] @ exact[1].T], np.int64).reshape(len(a), len(b))


def below(scores: np.ndarray) -> np.ndarray:
    """Floats that no score of at least that height is under, also where floats are coarser than whole numbers."""
    f = scores.astype(np.float64)
    return np.where(np.abs(f) < 2**50, f, f - np.abs(f) * 1e-12)


class Bucket:
    """Vectors of one dimension, longest first, with sorted coordinate lists made when first asked for."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, lengths: np.ndarray):
        self.ids, self.q, self.lengths = ids, q, lengths
        self.sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def unit(self, f: int) -> np.ndarray:
        return self.q[:, f] / np.maximum(self.lengths, 1e-12)

    def within(self, f: int, low: float, high: float) -> np.ndarray:
        """Vectors whose coordinate ``f``, as a share of their length, is in a range."""
        if f not in self.sorted:
            u = self.unit(f)
            by = np.argsort(u)
            self.sorted[f] = u[by], by
        u, by = self.sorted[f]
        return by[np.searchsorted(u, low) : np.searchsorted(u, high, side="right")]


class Asked:
    """Queries of one dimension with the best they have found so far."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k
        self.lengths = np.sqrt((q.astype(np.float64) ** 2).sum(1))
        self.floor = np.full(len(ids), -np.inf)
        self.best = (np.zeros(0, np.int64),) * 3

    def take(self, row: np.ndarray, score: np.ndarray, vec: np.ndarray) -> None:
        """Keep the k best of what is held and what is new, and raise the thresholds."""
        on = (score >= self.floor[row]) & (vec != self.ids[row])
        row, score, vec = (np.concatenate([a, b[on]]) for a, b in zip(self.best, (row, score, vec), strict=True))
        by = np.lexsort((vec, ~score, row))
        row, score, vec = row[by], score[by], vec[by]
        start = np.searchsorted(row, row)
        keep = np.arange(len(row)) - start < self.k
        self.best = row, score, vec = row[keep], score[keep], vec[keep]
        full = np.arange(len(row)) - np.searchsorted(row, row) == self.k - 1
        self.floor[row[full]] = np.maximum(self.floor[row[full]], below(score[full]))

    def scan(self, bucket: Bucket) -> None:
        if not len(bucket.ids):
            return
        longest = bucket.lengths[0]
        # Scores are whole numbers: half a unit of slack, and a share of large ones, covers all rounding below.
        need = np.where(self.floor > 0, self.floor * (1 - 1e-12) - 0.5, -np.inf)
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where(need > 0, need / (self.lengths * longest), -1.0)
        open_ = ~(cosine > 1 + 1e-9)
        fine = np.flatnonzero(open_ & (cosine >= COORDINATE_FROM))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for r in fine.tolist():
            c, u = min(float(cosine[r]), 1.0), self.q[r] / self.lengths[r]
            focus = np.argsort(-np.abs(u))[:FOCUS]
            spans = []
            for f in focus.tolist():
                mid, half = u[f] * c, np.sqrt(max(0.0, (1 - u[f] ** 2) * (1 - c**2)))
                low = -1.0 if -u[f] > c else mid - half  # the region's edge is the sphere's where the pole is inside
                high = 1.0 if u[f] > c else mid + half
                spans.append((f, low - 1e-9, high + 1e-9))
            at = bucket.within(*spans[0])
            for f, low, high in spans[1:]:
                u_f = bucket.q[at, f] / np.maximum(bucket.lengths[at], 1e-12)
                at = at[(u_f >= low) & (u_f <= high)]
            if len(at):
                found.append((np.full(len(at), r), product(bucket.q[at], self.q[r : r + 1])[:, 0], bucket.ids[at]))
        coarse = np.flatnonzero(open_ & ~(cosine >= COORDINATE_FROM))
        if len(coarse):
            # By length: the vectors that could reach the least demanding of these queries, then each query's own cut.
            with np.errstate(divide="ignore", invalid="ignore"):
                least = np.where(need[coarse] > 0, need[coarse] / self.lengths[coarse], -np.inf)
            cut = np.searchsorted(-bucket.lengths, -least * (1 - 1e-9), side="right")
            n = int(cut.max())
            scores = product(self.q[coarse], bucket.q[:n])
            hit = (scores >= self.floor[coarse][:, None]) & (np.arange(n) < cut[:, None])
            a, b = np.nonzero(hit)
            found.append((coarse[a], scores[a, b], bucket.ids[b]))
        if found:
            self.take(*(np.concatenate(x) for x in zip(*found, strict=True)))


def _matrix(column, dim: int) -> np.ndarray:
    """A list column of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def _spans(dims: np.ndarray, parts: np.ndarray) -> Iterator[tuple[int, int]]:
    new = np.flatnonzero((dims[1:] != dims[:-1]) | (parts[1:] != parts[:-1])) + 1
    return zip([0, *new.tolist()], [*new.tolist(), len(dims)], strict=True)


def top_k(
    df: DataFrame, queries, vec_id: str = "vec_id", vector: str = "embedding", k: int = 5, scale: int = 256, range_rows: int = RANGE
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row of ``df`` where ``queries`` (a condition) holds, its ``k`` largest
    integer products with all other rows, ties to the smaller id."""
    spark = df.sparkSession
    ship(spark)
    every = written(scaled(df, vec_id, vector, scale, queries))
    n = every.count()
    pieces = max(1, min(-(-n // range_rows), MOST_RANGES))
    spread = [F.col("dim"), F.col("length").desc(), F.xxhash64("id")]
    ranges = written(every.repartitionByRange(pieces, *spread).withColumn("part", F.spark_partition_id()))
    longest = ranges.groupBy("dim", "part").agg(F.max("length").alias("most")).orderBy("dim", "part").collect()  # a row a range
    seeds = ranges.orderBy(F.col("length").desc(), "id").limit(SEEDS).select("id", "q").collect()
    known: dict[int, tuple] = {}
    for dim in {r["dim"] for r in longest}:
        own = [r for r in longest if r["dim"] == dim]
        seeded = [r for r in seeds if len(r["q"]) == dim]
        q = np.array([r["q"] for r in seeded], np.float64).reshape(len(seeded), dim)
        known[dim] = np.array([r["part"] for r in own]), np.array([r["most"] for r in own]), np.array([r["id"] for r in seeded], np.int64), q
    shared = spark.sparkContext.broadcast(known)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries with their first threshold and the ranges, a run from the longest on, that could hold better ones."""
        for batch in batches:
            dims = batch.column(1).to_numpy()
            floor, first, last = np.full(len(dims), -np.inf), np.zeros(len(dims), np.int32), np.zeros(len(dims), np.int32)
            for dim in np.unique(dims).tolist():
                parts, most, ids, seed = shared.value[dim]
                for at in np.array_split(np.flatnonzero(dims == dim), max(1, int((dims == dim).sum()) // BLOCK)):
                    own = Asked(batch.column(0).to_numpy()[at], _matrix(batch.column(2).take(pa.array(at)), dim), k)
                    own.scan(Bucket(ids, seed, np.sqrt((seed**2).sum(1))))
                    need = np.where(own.floor > 0, own.floor * (1 - 1e-9) - 0.5, -np.inf)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        least = np.where(need > 0, need / own.lengths, -np.inf)
                    end = np.searchsorted(-most, -least * (1 - 1e-9), side="right")
                    floor[at], first[at], last[at] = own.floor, parts[0], parts[np.maximum(end, 1) - 1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floor), pa.array(first), pa.array(last)], names=["id", "dim", "q", "floor", "first", "last"])

    asked = ranges.where("asked").select("id", "dim", "q").distinct()
    routed = asked.mapInArrow(tidy(route), "id long, dim int, q array<double>, floor double, first int, last int")
    visits = routed.select("dim", F.explode(F.sequence("first", "last")).alias("part"), F.lit(True).alias("asks"), "id", "q", F.col("floor").alias("length"))
    rows = ranges.select("dim", "part", F.lit(False).alias("asks"), "id", "q", "length").union(visits)
    ready = rows.repartition("dim", "part").sortWithinPartitions("dim", "part", "asks", F.col("length").desc())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        place, held, waiting = None, [], []

        def answers() -> Iterator[pa.RecordBatch]:
            """What the queries that wait find in the range at hand."""
            if waiting and held:
                ids, q, floor = (np.concatenate(x) for x in zip(*waiting, strict=True))
                own = Asked(ids, q, k)
                own.floor = floor
                for part in held:
                    own.scan(part)
                row, score, vec = own.best
                # A query is its id and vector; of one id there may be several.
                name = np.array([xxhash.xxh64_intdigest(v.tobytes()) >> 1 for v in q], np.int64)[row]
                cols = [ids[row], np.full(len(row), place[0], np.int32), name, vec, score]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, cols)), names=["query_id", "dim", "name", "vec_id", "score"])
            waiting.clear()

        for batch in batches:
            dims, parts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b in _spans(dims, parts) if len(dims) else ():
                if place != (dims[a], parts[a]):
                    yield from answers()
                    place = (dims[a], parts[a])
                    held.clear()
                own = batch.slice(a, b - a)
                asks = own.column(2).to_numpy(zero_copy_only=False)
                ids, lengths = own.column(3).to_numpy(), own.column(5).to_numpy()
                q = _matrix(own.column(4), int(dims[a]))
                cut = int((~asks).sum())
                held.extend(Bucket(ids[s : min(s + BUCKET, cut)], q[s : min(s + BUCKET, cut)], lengths[s : min(s + BUCKET, cut)]) for s in range(0, cut, BUCKET))
                for s in range(cut, len(ids), BLOCK):
                    waiting.append((ids[s : s + BLOCK], q[s : s + BLOCK], lengths[s : s + BLOCK].copy()))
                    if sum(len(w[0]) for w in waiting) >= BLOCK:
                        yield from answers()
        yield from answers()

    found = ready.mapInArrow(tidy(run), "query_id long, dim int, name long, vec_id long, score long")
    order = W.partitionBy("dim", "name", "query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
