"""Ordered grouped maps: recursive and spectral kernels that no window can express.

`per_series` brings one series into one task, which recursion needs. Kernels over windows of fixed length run through
`per_block` on overlapping blocks instead, so that a long series is spread."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import scalar as S
from tidemark.operators import ordering as O
from tidemark.session import ship

Kernel = Callable[[pd.DataFrame], pd.DataFrame]


def _null(frame: pd.DataFrame) -> pd.DataFrame:
    """NaN and infinities become null at the border to tables."""
    num = frame.select_dtypes("floating").columns
    frame[num] = frame[num].where(np.isfinite(frame[num]))
    return frame.astype({c: object for c in num}).where(frame.notna(), None) if len(num) else frame


def per_series(df: DataFrame, series: list[str], order: list[str], kernel: Kernel, schema: str) -> DataFrame:
    """``kernel`` on each series in order; it returns the columns of ``schema`` after the series' keys."""
    full = T.StructType([df.schema[s] for s in series] + list(T._parse_datatype_string(schema).fields))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order, kind="stable").reset_index(drop=True)
        out = kernel(frame)
        for s in reversed(series):
            out.insert(0, s, frame[s].iloc[0])
        return _null(out[full.names])

    ship(df.sparkSession)
    return df.groupBy(*series).applyInPandas(run, full)


def per_block(df: DataFrame, series: list[str], order: list[str], bucket, back: int, kernel: Kernel, schema: str, block_rows: int = O.BLOCK_ROWS) -> DataFrame:
    """``kernel`` on overlapping blocks of each series; it returns a row for each of its rows, of which a block's own stay."""
    cut = O.blocks(df, series, order, bucket, back, 0, block_rows)
    full = T.StructType([df.schema[s] for s in series] + [df.schema[o] for o in order] + list(T._parse_datatype_string(schema).fields))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(O.INDEX).reset_index(drop=True)
        out = kernel(frame)
        for c in reversed([*series, *order]):
            out.insert(0, c, frame[c].to_numpy())
        return _null(out[frame[O.OWN].to_numpy()][full.names])

    ship(df.sparkSession)
    return cut.groupBy(*series, O.BLOCK).applyInPandas(run, full)


def pairwise_correlation(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Pairwise-complete correlations (missing: fewer than three rows or no variance; diagonal 1) from one aggregation;
    only a feature-by-feature table of sums reaches the driver."""
    aggs = []
    for i, a in enumerate(columns):
        for b in columns[i + 1 :]:
            ok = F.col(a).isNotNull() & F.col(b).isNotNull()
            x, y = F.when(ok, F.col(a)), F.when(ok, F.col(b))
            aggs.append(F.when(F.count_if(ok) > 2, S.corr(x, y)))
    row = df.agg(*[c.alias(f"c{k}") for k, c in enumerate(aggs)]).first() if aggs else ()
    out = np.eye(len(columns))
    values = iter(row)
    for i in range(len(columns)):
        for j in range(i + 1, len(columns)):
            v = next(values)
            out[i, j] = out[j, i] = np.nan if v is None else float(np.clip(v, -1, 1))
    return out


def gram_sums(df: DataFrame, features: list[str], target: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Correlation Gram matrix, correlations with the target and rows, from sums over complete rows."""
    rows = df.dropna(subset=[*features, target])
    cols = [*features, target]
    one = [F.sum(c) for c in cols]
    two = [F.sum(F.col(a) * F.col(b)) for i, a in enumerate(cols) for b in cols[i:]]
    s = list(rows.agg(F.count("*"), *one, *two).first())
    n, m = s[0], np.array(s[1 : 1 + len(cols)], float)
    q, it = np.zeros((len(cols), len(cols))), iter(s[1 + len(cols) :])
    for i in range(len(cols)):
        for j in range(i, len(cols)):
            q[i, j] = q[j, i] = next(it)
    cov = q / n - np.outer(m, m) / n**2
    d = np.sqrt(np.diag(cov))
    r = cov / np.outer(d, d)
    return r[:-1, :-1], r[:-1, -1], n
