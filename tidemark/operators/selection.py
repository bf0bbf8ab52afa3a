"""Exact order statistics without a sort of all rows and without a buffer of a group's values.

`exact_quantiles` cuts every group at approximate quantiles close on both sides of those asked for. Counts of the cells
between the cuts (one small histogram a group) say which cell holds which rank; only the rows of these cells, about
``4 / ACCURACY`` of a group a quantile, are counted by value and searched. The cuts decide the work, not the result.

`expanding_quantiles` finds quantiles of all earlier periods: histograms are counted once a period and added up over the
periods, so each row is counted in its own period only, however many later periods it is history of. Cells are cut again
(``FAN`` ways) until one is expected to hold at most ``CELL_ROWS`` rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.ordering import beside
from tidemark.session import ship, small_side, written

#: Accuracy of the approximate quantiles that cut groups: bounded memory a group and task.
ACCURACY = 10_000
#: Parts a cell is cut into, and the rows a last cell may be expected to hold.
FAN, CELL_ROWS = 64, 1 << 20


def _ranks(probs: tuple[float, ...], n: str) -> Column:
    """Ranks from 0 that the linear quantiles of ``n`` values need: those at or before and at or after each position."""
    position = lambda p: p * (F.col(n) - 1)
    return F.array_distinct(F.flatten(F.transform(F.lit(list(map(float, probs))), lambda p: F.array(F.floor(position(p)), F.ceil(position(p))))))


def _interpolated(probs: tuple[float, ...], n: str, at: str) -> Column:
    """Linear interpolation between the order statistics in the map ``at``, as both engines' exact quantiles do it."""

    def value(p: Column) -> Column:
        position = p * (F.col(n) - 1)
        low, high = F.col(at)[F.floor(position)], F.col(at)[F.ceil(position)]
        return F.when(low == high, low).otherwise((F.ceil(position) - position) * low + (position - F.floor(position)) * high)

    return F.transform(F.lit(list(map(float, probs))), value)


def exact_quantiles(df: DataFrame, by: list[str], columns: dict[str, Column], probs: tuple[float, ...], held: bool = False) -> DataFrame:
    """A row a group with, for each column, the array of its exact linear quantiles (null without values). Missing values do
    not count; NaN counts as the greatest value; groups without any value of any column have no row. The values are written
    once, narrow, and read three times; not if ``df`` is ``held`` already, as a table that is cheap to read."""
    cells = [F.struct(F.lit(n).alias("__c"), c.cast("double").alias("__x")) for n, c in columns.items()]
    long = df.select(*by, F.explode(F.array(*cells)).alias("__s")).select(*by, "__s.*").where(F.col("__x").isNotNull())
    long = long if held else written(long)
    keys = [*by, "__c"]
    near = sorted({min(max(p + d, 0.0), 1.0) for p in probs for d in (-2 / ACCURACY, 2 / ACCURACY)})
    cuts = long.groupBy(*keys).agg(F.count("*").alias("__n"), F.percentile_approx("__x", near, ACCURACY).alias("__cuts"))
    cut = beside(long, small_side(cuts), keys)
    cut = cut.select(*keys, "__n", "__x", F.size(F.filter("__cuts", lambda e: e < F.col("__x"))).alias("__cell"))
    group = W.partitionBy(*keys).orderBy("__cell")
    counts = cut.groupBy(*keys, "__n", "__cell").agg(F.count("*").alias("__k"))
    offset = F.coalesce(F.sum("__k").over(group.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = counts.select("*", offset.alias("__off"), _ranks(probs, "__n").alias("__ranks"))
    end = F.col("__off") + F.col("__k")
    wanted = placed.select(*keys, "__cell", "__off", F.filter("__ranks", lambda r: (r >= F.col("__off")) & (r < end)).alias("__ranks")).where(F.size("__ranks") > 0)
    inside = beside(cut.select(*keys, "__n", "__cell", "__x"), small_side(wanted), [*keys, "__cell"])
    values = inside.groupBy(*keys, "__n", "__cell", "__x").agg(F.count("*").alias("__k"), F.any_value("__off").alias("__off"), F.any_value("__ranks").alias("__ranks"))
    up = W.partitionBy(*keys, "__cell").orderBy("__x")
    below = F.col("__off") + F.coalesce(F.sum("__k").over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    found = values.select("*", below.alias("__below"))
    top = F.col("__below") + F.col("__k")
    hit = F.explode(F.filter("__ranks", lambda r: (r >= F.col("__below")) & (r < top))).alias("__rank")
    at = found.select(*keys, "__n", "__x", hit).groupBy(*keys, "__n").agg(F.map_from_entries(F.collect_list(F.struct("__rank", "__x"))).alias("__at"))
    quantiles = at.select(*keys, _interpolated(probs, "__n", "__at").alias("__q"))
    named = [F.max(F.when(F.col("__c") == n, F.struct(F.lit(0), F.col("__q"))))["__q"].alias(n) for n in columns]
    return quantiles.groupBy(*by).agg(*named)


def with_quantiles(out: DataFrame, df: DataFrame, by: list[str], columns: dict[str, tuple[Column, dict[str, float]]], held: bool = False) -> DataFrame:
    """``out``, which has a row a group, with exact quantiles of columns of ``df``: ``columns`` names each source with its
    column and the quantiles that are taken of it, by their names."""
    probs = tuple(sorted({p for _, named in columns.values() for p in named.values()}))
    q = exact_quantiles(df, by, {f"__of_{s}": c for s, (c, _) in columns.items()}, probs, held)
    named = [F.col(f"__of_{s}")[probs.index(p)].alias(n) for s, (_, own) in columns.items() for n, p in own.items()]
    right = q.select(*[F.col(b).alias(f"__by{k}") for k, b in enumerate(by)], *named)
    on = F.lit(True)
    for k, b in enumerate(by):
        on = on & F.col(b).eqNullSafe(F.col(f"__by{k}"))
    return out.join(right, on, "left").drop(*(f"__by{k}" for k in range(len(by))))


def expanding_quantiles(df: DataFrame, x: str, period: Column, probs: tuple[float, ...], least: int, fan: int = FAN, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``period, history, q``: exact linear quantiles of all present values of earlier periods, for the periods that have at
    least ``least`` of them. ``period`` must ascend with time over the years too (a week's date, not its number); its
    distinct values are calendar blocks, whose table is small beside the rows."""
    rows = written(df.select(period.alias("period"), F.col(x).cast("double").alias("v")))
    counts = rows.groupBy("period").agg(F.count("v").alias("n"))
    earlier = W.orderBy("period").rowsBetween(W.unboundedPreceding, -1)  # a row a period
    history = counts.select("period", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("history")).where(F.col("history") >= least)
    asked = history.where(F.col("history") > 0).select("period", F.explode(_ranks(probs, "history")).alias("rank")).select("*", F.col("rank").alias("left"), F.lit(0).cast("long").alias("cell"))
    values = rows.where(F.col("v").isNotNull()).withColumn("cell", F.lit(0).cast("long"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    levels = max(1, math.ceil(math.log(max(total / cell_rows, 1), fan)))
    for _ in range(levels):
        held = small_side(asked)
        needed = small_side(held.select("cell").distinct())
        values = values.join(needed, "cell", "left_semi")
        cuts = values.groupBy("cell").agg(F.percentile_approx("v", [k / fan for k in range(1, fan)], 16 * fan).alias("cuts"))
        finer = beside(values, small_side(cuts), ["cell"])
        values = finer.select("period", "v", (F.col("cell") * fan + F.size(F.filter("cuts", lambda e: e < F.col("v")))).alias("cell"))
        # Counts a period and cell, added up over the periods before each one asked for.
        own = values.groupBy("cell", "period").agg(F.count("*").alias("k")).select("cell", "period", "k", F.lit(None).cast("long").alias("rank"), F.lit(None).cast("long").alias("left"))
        children = F.explode(F.sequence(F.lit(0), F.lit(fan - 1))).alias("child")
        marks = held.select("period", "rank", "left", "cell", children).select((F.col("cell") * fan + F.col("child")).alias("cell"), "period", F.lit(0).cast("long").alias("k"), "rank", "left")
        before = W.partitionBy("cell").orderBy("period", F.col("rank").isNull()).rowsBetween(W.unboundedPreceding, -1)  # a period's marks come first
        summed = own.unionByName(marks).select("*", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("held")).where("rank IS NOT NULL")
        upto = F.sum("held").over(W.partitionBy("period", "rank").orderBy("cell"))
        asked = summed.select("*", (upto - F.col("held")).alias("below")).where((F.col("left") >= F.col("below")) & (F.col("left") < F.col("below") + F.col("held")))
        asked = asked.select("period", "rank", (F.col("left") - F.col("below")).alias("left"), "cell")
    held = small_side(asked)
    last = values.join(small_side(held.select("cell").distinct()), "cell", "left_semi").groupBy("cell", "period", "v").agg(F.count("*").alias("k"))

    def search(values: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        """The values of the ranks left over, among a cell's values of earlier periods."""
        values = values.sort_values("v", kind="stable")
        v, p, k = values["v"].to_numpy(), values["period"].to_numpy(), values["k"].to_numpy()
        found = []
        for period, same in asked.groupby("period"):
            upto = np.cumsum(np.where(p < period, k, 0))
            found.append(pd.DataFrame({"period": period, "rank": same["rank"], "v": v[np.searchsorted(upto, same["left"].to_numpy(), side="right")]}))
        return pd.concat(found) if found else pd.DataFrame({"period": [], "rank": [], "v": []})

    ship(df.sparkSession)
    kind = rows.schema["period"].dataType.simpleString()
    pairs = last.groupBy("cell").cogroup(held.groupBy("cell")).applyInPandas(search, f"period {kind}, rank long, v double")
    at = pairs.groupBy("period").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))
    return history.join(at, "period").select("period", "history", _interpolated(probs, "history", "at").alias("q"))
