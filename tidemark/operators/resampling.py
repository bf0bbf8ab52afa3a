"""Bootstrap intervals from sums that merge.

A replicate does not draw rows; every row (or block of rows) draws how often it is in each replicate, from a Poisson law
whose numbers come from a hash of its key, the replicate and the seed. So a row's weights are the same wherever it is read,
each partition keeps two sums a replicate, and adding them up gives the same replicates for any partitioning, but for the
rounding of sums."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import ordering as O
from tidemark.session import ship

#: Rows whose weights are held at a time.
CHUNK = 8_192


def _mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers mixed (a published finaliser, fixed values)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def poisson_weights(keys: np.ndarray, rate: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """A Poisson count of each key and replicate, by inversion of hashed uniform numbers."""
    b = _mixed(np.arange(replicates, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    bits = _mixed(_mixed(keys.astype(np.int64).view(np.uint64))[:, None] + b[None, :])
    u = (bits >> np.uint64(11)).astype(np.float64) * 2.0**-53
    out = np.zeros(u.shape, np.int32)
    p = np.exp(-rate)[:, None]
    k, below = 0, p.copy()
    while (over := u >= below).any():
        out += over
        k += 1
        p = p * rate[:, None] / k
        below = below + p
        if float(p.max()) < 1e-18 and k > float(rate.max()):
            break
    return out


def replicate_sums(df: DataFrame, by: list[str], key: str, total: str, size: str, rate: str, replicates: int, seed: int) -> DataFrame:
    """``by, replicate, total, size``: sums of two columns of each replicate. Groups of a partition are held together, two
    numbers a replicate each; ``key`` is a long that tells a group's rows apart."""
    ship(df.sparkSession)
    lead = len(by)
    rows = df.select(*by, F.col(key).cast("long").alias("__key"), *[F.col(c).cast("double").alias(f"__{k}") for k, c in enumerate((total, size, rate))])
    schema = T.StructType([*[df.schema[b] for b in by], *T._parse_datatype_string("replicate int, total double, size double").fields])

    def emit(held: dict) -> Iterator[pa.RecordBatch]:
        for group, sums in held.items():
            cols = [pa.array([g] * replicates, t) for g, t in zip(group, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.arange(replicates, dtype=np.int32)), pa.array(sums[0]), pa.array(sums[1])], names=schema.names)

    types: list[pa.DataType] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            types[:] = [batch.column(k).type for k in range(lead)]
            groups = list(zip(*[batch.column(k).to_pylist() for k in range(lead)], strict=True)) if lead else [()] * batch.num_rows
            names = {g: k for k, g in enumerate(dict.fromkeys(groups))}
            of = np.fromiter((names[g] for g in groups), np.int64, len(groups))
            keys, t, m, rate = (batch.column(lead + k).to_numpy() for k in range(4))
            for g, k in names.items():
                at = np.flatnonzero(of == k)
                sums = held.setdefault(g, np.zeros((2, replicates)))
                for c in range(0, len(at), CHUNK):
                    part = at[c : c + CHUNK]
                    w = poisson_weights(keys[part], rate[part], replicates, seed)
                    sums += np.stack([t[part], m[part]]) @ w
            if len(held) > 1_000:  # sums of many groups go on to Spark's own aggregation
                yield from emit(held)
                held = {}
        yield from emit(held)

    sums = rows.mapInArrow(run, schema)
    return sums.groupBy(*by, "replicate").agg(F.sum("total").alias("total"), F.sum("size").alias("size"))


def _interval(df: DataFrame, sums: DataFrame, by: list[str], mean: DataFrame, level: float) -> DataFrame:
    """Mean of all rows and the percentile interval of the replicates' means."""
    low, high = (1 - level) / 2, (1 + level) / 2
    bounds = sums.where("size > 0").groupBy(*by).agg(F.percentile(F.col("total") / F.col("size"), F.array(F.lit(low), F.lit(high))).alias("__q"))  # a value a replicate
    return O.beside(mean, bounds, by).select(*by, "mean", F.col("__q")[0].alias("low"), F.col("__q")[1].alias("high"))


def bootstrap_mean(df: DataFrame, by: list[str], key: list[str], x: str, replicates: int = 500, level: float = 0.95, seed: int = 7) -> DataFrame:
    """``by, mean, low, high``: mean of all finite values with a percentile interval; for shares, as means of flags.
    ``key`` are the columns that tell the rows of a group apart."""
    finite = F.col(x).isNotNull() & ~F.isnan(x) & (F.abs(F.col(x)) < float("inf"))
    rows = df.where(finite).select(*by, F.xxhash64(*key).alias("key"), F.col(x).cast("double").alias("x"), F.lit(1.0).alias("one"))
    sums = replicate_sums(rows, by, "key", "x", "one", "one", replicates, seed)
    return _interval(df, sums, by, rows.groupBy(*by).agg(F.avg("x").alias("mean")), level)


def block_bootstrap(
    df: DataFrame, series: list[str], order: list[str], bucket: Column, segment: Column, x: str, block: int, horizon: int, replicates: int = 500, level: float = 0.95, seed: int = 7, block_rows: int = O.BLOCK_ROWS
) -> DataFrame:
    """``series, mean, low, high`` from moving blocks inside segments. Every place where a block may start is in a replicate
    as often as a Poisson law says whose mean makes up the segment's rows. ``segment`` may use the row's number
    (``ordering.INDEX``) and its series' rows (``__rows``) and must ascend in time. A block shorter than the horizon is
    refused; series with a segment shorter than a block are left out."""
    if block < horizon:
        raise ValueError(f"blocks of {block} rows are shorter than the horizon of {horizon}")
    numbered = O.number_rows(df.select(*series, *order, F.col(x).cast("double").alias("x")), series, order, bucket)
    sizes = numbered.groupBy(*series).agg(F.count("*").alias("__rows"))
    cut = O.blocks(df.select(*series, *order, F.col(x).cast("double").alias("x")), series, order, bucket, 0, block - 1, block_rows)
    cut = O.beside(cut, sizes, series).withColumn("__segment", segment)
    ahead = O.block_window(series).rowsBetween(0, block - 1)
    sums = cut.select(*series, O.OWN, O.INDEX, "__segment", "x", F.sum("x").over(ahead).alias("total"), F.count("*").over(ahead).alias("n"), F.last("__segment").over(ahead).alias("__to"))
    own = sums.where(O.OWN)
    parts = own.groupBy(*series, "__segment").agg(F.count("*").alias("__m"))
    short = parts.groupBy(*series).agg(F.min("__m").alias("__least")).where(F.col("__least") >= block).select(*series)
    starts = own.where((F.col("n") == block) & F.col("__to").eqNullSafe(F.col("__segment")))
    rate = F.ceil(F.col("__m") / F.lit(float(block))) / (F.col("__m") - block + 1)
    drawn = O.beside(O.beside(starts, parts, [*series, "__segment"]), short, series)
    drawn = drawn.select(*series, F.xxhash64(*series, O.INDEX).alias("key"), "total", F.lit(float(block)).alias("size"), rate.alias("rate"))
    mean = O.beside(own.groupBy(*series).agg(F.avg("x").alias("mean")), short, series)
    return _interval(df, replicate_sums(drawn, series, "key", "total", "size", "rate", replicates, seed), series, mean, level)
