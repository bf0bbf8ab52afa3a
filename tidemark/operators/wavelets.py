"""Wavelet transforms of whole series, and ridges of their power, without a task that holds a series.

A filter of fixed length needs fixed numbers of rows before and after a block: blocks are transformed with these rows around
them by the FFT and keep their own. Ridges are chains of links between neighbouring rows; blocks give pieces of chains, and
the pieces that touch a seam are joined along the series, a few small rows a block."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import spectral as SP
from tidemark.operators import ordering as O
from tidemark.operators.selection import with_quantiles
from tidemark.session import ship, written

#: A Morlet wavelet is cut at so many times its scale, where it is 1e-14 of its height.
MORLET_REACH = 8
#: Rows nearer to an end of the series than this times the scale are in the cone of influence.
CONE = math.sqrt(2)


def _keys(df: DataFrame, names: list[str]) -> list[T.StructField]:
    return [df.schema[s] for s in names]


def _convolved(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    size = 1 << (len(x) + len(taps)).bit_length()
    return np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(taps, size), size)[: len(x) + len(taps) - 1]


def circular_filters(
    df: DataFrame, series: list[str], order: list[str], bucket: Column, value: str, filters: dict[str, tuple[np.ndarray, int]], block_rows: int = O.BLOCK_ROWS
) -> DataFrame:
    """``series, order`` and for each name the sum over l of ``taps[l]`` times the value ``ahead - l`` rows on, in a series
    whose end goes on with its start; ``filters`` names (taps, ahead). Missing values count as 0. Rows near an end are copied
    beyond the other one, as often round as a filter longer than the series needs."""
    back = max(0, *(len(t) - 1 - a for t, a in filters.values()))
    ahead = max(0, *(a for _, a in filters.values()))
    rows = max(block_rows, back, ahead, 1)
    numbered = O.number_rows(df.select(*series, *order, value), series, order, bucket)
    counted = O.beside(numbered, numbered.groupBy(*series).agg(F.count("*").alias("__n")), series)
    i, n = F.col(O.INDEX), F.col("__n")
    turns = F.sequence(F.ceil((-back - i) / n), F.floor((n + ahead - 1 - i) / n))
    placed = counted.withColumn("__turn", F.explode(turns)).withColumn("__at", i + F.col("__turn") * n)
    home, within = F.floor(F.col("__at") / rows), F.pmod(F.col("__at"), F.lit(rows))
    none = F.lit(None).cast("long")
    homes = F.array_compact(F.array(home, F.when(within >= rows - back, home + 1).otherwise(none), F.when(within < ahead, home - 1).otherwise(none)))
    cut = placed.withColumn("__home", home).withColumn(O.BLOCK, F.explode(homes)).where((F.col(O.BLOCK) >= 0) & (F.col(O.BLOCK) * rows < n))
    cut = cut.withColumn(O.OWN, (F.col("__turn") == 0) & (F.col("__home") == F.col(O.BLOCK)))
    full = T.StructType([*_keys(df, [*series, *order]), *(T.StructField(c, T.DoubleType()) for c in filters)])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("__at").reset_index(drop=True)
        x = np.nan_to_num(frame[value].to_numpy(dtype=float))
        own = np.flatnonzero(frame[O.OWN].to_numpy())
        out = frame.loc[own, [*series, *order]].reset_index(drop=True)
        for name, (taps, a) in filters.items():
            out[name] = _convolved(x, taps)[own + a]
        return out[full.names]

    ship(df.sparkSession)
    return cut.groupBy(*series, O.BLOCK).applyInPandas(run, full)


def circular_modwt(df: DataFrame, series: list[str], order: list[str], bucket: Column, value: str, wavelet: str, levels: int, block_rows: int = O.BLOCK_ROWS) -> DataFrame:
    """``series, order`` with ``w1`` to ``wJ`` and ``v``: periodic coefficients; their squares add up to the series' squares."""
    details, smooth = SP.modwt_filters(wavelet, levels)
    named = {**{f"w{j + 1}": (f, 0) for j, f in enumerate(details)}, "v": (smooth, 0)}
    return circular_filters(df, series, order, bucket, value, named, block_rows)


def multiresolution(df: DataFrame, series: list[str], order: list[str], bucket: Column, value: str, wavelet: str, levels: int, block_rows: int = O.BLOCK_ROWS) -> DataFrame:
    """``series, order`` with ``d0`` to ``dJ``: zero-phase components, the last one smooth, that add up to the series."""
    details, smooth = SP.modwt_filters(wavelet, levels)
    named = {f"d{j}": (np.convolve(f, f[::-1]), len(f) - 1) for j, f in enumerate([*details, smooth])}
    return circular_filters(df, series, order, bucket, value, named, block_rows)


def scalogram(df: DataFrame, series: list[str], order: list[str], bucket: Column, value: str, scales: list[float], block_rows: int = O.BLOCK_ROWS) -> DataFrame:
    """``series, order, row`` (from 0), ``rows`` of the series and ``power``, an array over ``scales``: the Morlet power of
    the values less their mean. Missing values count as the mean. Not causal. Scales below 4 are refused: their wavelet
    reaches beyond half the sampling rate, and cut off there it has no fixed length."""
    if min(scales) < 4:
        raise ValueError("scales must be at least 4")
    reach = math.ceil(MORLET_REACH * max(scales))
    cut = O.blocks(df.select(*series, *order, value), series, order, bucket, reach, reach, block_rows)
    means = df.groupBy(*series).agg(F.avg(value).alias("__mean"), F.count("*").alias("rows"))
    full = T.StructType([*_keys(df, [*series, *order]), T.StructField("row", T.LongType()), T.StructField("rows", T.LongType()), T.StructField("power", T.ArrayType(T.DoubleType()))])
    widths = np.array(scales, dtype=float)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(O.INDEX).reset_index(drop=True)
        x = np.nan_to_num((frame[value] - frame["__mean"]).to_numpy(dtype=float))
        own = np.flatnonzero(frame[O.OWN].to_numpy())
        out = frame.loc[own, [*series, *order, O.INDEX, "rows"]].rename(columns={O.INDEX: "row"})
        out["power"] = pd.Series(SP.morlet_power(x, widths)[:, own].T.tolist(), index=out.index, dtype=object)
        return out[full.names]

    ship(df.sparkSession)
    return O.beside(cut, means, series).groupBy(*series, O.BLOCK).applyInPandas(run, full)


def peaks(power: DataFrame, series: list[str], scales: list[float], power_ratio: float) -> DataFrame:
    """``series, row, peaks`` (``scale`` number, ``power``, ``ratio``) of a scalogram: outside the cone of influence, at
    least ``power_ratio`` times the exact median of their scale outside it, and no lower than at the scales beside."""
    edge = F.least(F.col("row"), F.col("rows") - 1 - F.col("row"))
    inside = [edge >= CONE * s for s in scales]
    at = [F.get("power", F.lit(j)) for j in range(len(scales))]
    groups = power.groupBy(*series).agg(F.count("*").alias("__rows"))
    medians = with_quantiles(groups, power, series, {f"s{j}": (F.when(ok, p), {f"__m{j}": 0.5}) for j, (ok, p) in enumerate(zip(inside, at, strict=True))}).drop("__rows")
    found = []
    for j, (ok, p) in enumerate(zip(inside, at, strict=True)):
        m = F.col(f"__m{j}")
        here = ok & (m > 0) & (p >= power_ratio * m)
        for k in (j - 1, j + 1):
            if 0 <= k < len(scales):
                here = here & (p >= at[k])
        found.append(F.when(here, F.struct(F.lit(j).alias("scale"), p.alias("power"), (p / m).alias("ratio"))))
    return O.beside(power, medians, series).select(*series, "row", F.array_compact(F.array(*found)).alias("peaks"))


def links(before: dict[int, float], here: dict[int, float]) -> dict[int, int]:
    """The scale at the row before that each peak goes on from, if any: the strongest peak chooses first, the nearest scale
    at most one away, of two the stronger and then the smaller; each is chosen once."""
    free, out = dict(before), {}
    for k in sorted(here, key=lambda k: (-here[k], k)):
        near = [(abs(j - k), -p, j) for j, p in free.items() if abs(j - k) <= 1]
        if near:
            out[k] = min(near)[2]
            del free[out[k]]
    return out


def ridges(df: DataFrame, series: list[str], order: list[str], bucket: Column, value: str, scales: list[float], power_ratio: float = 1.0, min_length: int = 2, block_rows: int = O.BLOCK_ROWS) -> DataFrame:
    """``series, start, end`` (rows from 0), ``length, scale`` (mean) and ``ratio`` (mean power over the median): paths of
    `peaks` from row to row that move by one scale at most (`links`) and have at least ``min_length`` rows."""
    held = written(scalogram(df, series, order, bucket, value, scales, block_rows))
    found = written(peaks(held, series, scales, power_ratio))
    home = F.floor(F.col("row") / block_rows)
    last = F.when(F.col("row") % block_rows == block_rows - 1, home + 1)
    cut = found.withColumn("__home", home).withColumn(O.BLOCK, F.explode(F.array_compact(F.array(home, last))))
    sums = {"start": T.LongType(), "end": T.LongType(), "length": T.LongType(), "scale": T.DoubleType(), "ratio": T.DoubleType()}
    keys = _keys(df, series)
    piece = T.StructType([*keys, T.StructField(O.BLOCK, T.LongType()), T.StructField("from", T.LongType()), T.StructField("to", T.LongType()), *(T.StructField(c, t) for c, t in sums.items())])
    whole = T.StructType([*keys, *(T.StructField(c, t) for c, t in sums.items())])

    def pieces(frame: pd.DataFrame) -> pd.DataFrame:
        """Chains within a block; ``from`` is the scale before the block that a chain goes on from, ``to`` its scale at the
        block's last row."""
        frame = frame.sort_values("row")
        block = int(frame[O.BLOCK].iloc[0])
        before: dict[int, float] = {}
        going: dict[int, list] = {}
        done = []
        for row, at, list_ in zip(frame["row"], frame["__home"], frame["peaks"], strict=True):
            here = {int(p["scale"]): float(p["power"]) for p in list_}
            if at != block:  # the row before the block
                before = here
                continue
            onto, now = links(before, here), {}
            for p in list_:
                k = int(p["scale"])
                chain = going.pop(onto[k], None) if k in onto else None
                if chain is None:
                    chain = [onto.get(k), None, row, row, 0, 0.0, 0.0]
                chain[3], chain[4], chain[5], chain[6] = row, chain[4] + 1, chain[5] + k, chain[6] + float(p["ratio"])
                now[k] = chain
            done += going.values()
            going, before = now, here
        for k, chain in going.items():
            chain[1] = k
        rows = [[*frame[series].iloc[0], block, *c] for c in [*done, *going.values()]]
        out = pd.DataFrame(rows, columns=piece.names)
        return out.astype({"from": "Int64", "to": "Int64"})

    def joined(frame: pd.DataFrame) -> pd.DataFrame:
        """Chains over seams, from the pieces that touch one."""
        out, reached = [], {}
        names = list(sums)
        for b, same in frame.sort_values(O.BLOCK).groupby(O.BLOCK, sort=True):
            now = {}
            for r in same.to_dict("records"):
                chain = [r[c] for c in names]
                old = None if pd.isna(r["from"]) else reached.pop((b - 1, int(r["from"])), None)
                if old is not None:
                    chain = [old[0], chain[1], *(x + y for x, y in zip(old[2:], chain[2:], strict=True))]
                if pd.isna(r["to"]):
                    out.append(chain)
                else:
                    now[(b, int(r["to"]))] = chain
            out += reached.values()
            reached = now
        out += reached.values()
        return pd.DataFrame([[*frame[series].iloc[0], *c] for c in out], columns=whole.names)

    ship(df.sparkSession)
    made = written(cut.groupBy(*series, O.BLOCK).applyInPandas(pieces, piece))
    touches = F.col("from").isNotNull() | F.col("to").isNotNull()
    seams = made.where(touches).groupBy(*series).applyInPandas(joined, whole)
    every = made.where(~touches).select(*whole.names).unionByName(seams).where(F.col("length") >= min_length)
    return every.select(*series, "start", "end", "length", (F.col("scale") / F.col("length")).alias("scale"), (F.col("ratio") / F.col("length")).alias("ratio"))
