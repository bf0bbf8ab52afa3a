"""Order without one big task: gapless row numbers and overlapping blocks.

A window ordered by time but not partitioned puts a whole series into one task. Here a series is numbered in two
levels (within calendar buckets, then offsets from the buckets' counts) and cut into blocks of ``block_rows`` rows; a
block also gets the ``back`` rows before it and the ``ahead`` rows after it, so that every frame of fixed length is
exact inside the block. Only rows marked as a block's own are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

BLOCK_ROWS = 65_536
INDEX, BLOCK, OWN = "__idx", "__block", "__own"


def number_rows(df: DataFrame, series: list[str], order: list[str], bucket: Column, name: str = INDEX) -> DataFrame:
    """``df`` with a gapless number from 0 in each series. ``bucket`` must ascend with the order."""
    marked = df.withColumn("__bucket", bucket)
    keys = [*series, "__bucket"]
    counts = marked.groupBy(*keys).agg(F.count("*").alias("__n"))
    before = W.partitionBy(*series, F.lit(0)).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    local = marked.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    same = [local[k].eqNullSafe(offsets[k]) for k in keys]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return local.join(offsets, on).select(*[local[c] for c in df.columns], (F.col("__off") + F.col("__rn") - 1).alias(name))


def beside(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``left`` with the other columns of ``right``, which has one row a key; null keys match, and no keys is one row."""
    if not keys:
        return left.crossJoin(F.broadcast(right))
    other = right.withColumnsRenamed({k: f"__key{i}" for i, k in enumerate(keys)})
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__key{i}"))
    return left.join(other, on).drop(*(f"__key{i}" for i in range(len(keys))))


def with_previous(df: DataFrame, series: list[str], order: list[str], bucket: Column, column: str, name: str) -> DataFrame:
    """``df`` with ``column`` of the row before in its series: the row before in its bucket, and for a bucket's first row
    the last row of the bucket before. ``bucket`` must ascend with the order."""
    marked = df.withColumn("__bucket", bucket)
    keys = [*series, "__bucket"]
    ends = marked.groupBy(*keys).agg(F.max_by(column, F.struct(*order)).alias("__end"))
    carried = ends.select(*keys, F.lag("__end").over(W.partitionBy(*series, F.lit(0)).orderBy("__bucket")).alias("__carried"))
    w = W.partitionBy(*keys).orderBy(*order)
    local = marked.select("*", F.lag(column).over(w).alias("__lag"), F.row_number().over(w).alias("__rn"))
    before = F.when(F.col("__rn") == 1, F.col("__carried")).otherwise(F.col("__lag"))
    return beside(local, carried, keys).select(*df.columns, before.alias(name))


def counts_below(counts: DataFrame, by: list[str], x: str, count: str, parts: int = 64) -> DataFrame:
    """``counts``, which has a row for each value of ``x`` in a group, with the sums of ``count`` over smaller values
    (``__below``) and over the group (``__n``). A group is cut at approximate quantiles of its values, so that no task
    orders a whole group; where the cuts fall does not change the sums."""
    at = F.col(x).cast("double")
    cuts = counts.groupBy(*by).agg(F.percentile_approx(at, [k / parts for k in range(1, parts)], 1000).alias("__cuts"))
    cell = F.size(F.filter("__cuts", lambda c: c < at))
    cut = beside(counts, cuts, by).select(*counts.columns, cell.alias("__cell"))
    sums = cut.groupBy(*by, "__cell").agg(F.sum(count).alias("__sum"))
    group = W.partitionBy(*by, F.lit(0))
    before = F.sum("__sum").over(group.orderBy("__cell").rowsBetween(W.unboundedPreceding, -1))
    offsets = sums.select(*by, "__cell", F.coalesce(before, F.lit(0)).alias("__off"), F.sum("__sum").over(group).alias("__n"))
    smaller = F.sum(count).over(W.partitionBy(*by, "__cell").orderBy(x).rowsBetween(W.unboundedPreceding, -1))
    local = cut.select("*", F.coalesce(smaller, F.lit(0)).alias("__local"))
    return beside(local, offsets, [*by, "__cell"]).select(*counts.columns, (F.col("__off") + F.col("__local")).alias("__below"), "__n")


def blocks(
    df: DataFrame, series: list[str], order: list[str], bucket: Column, back: int, ahead: int = 0, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``df`` numbered and cut into overlapping blocks; `block_window` gives the window, `own_rows` ends the work."""
    rows = max(block_rows, back, ahead, 1)
    numbered = number_rows(df, series, order, bucket)
    home = (F.col(INDEX) / rows).cast("long")
    at = F.col(INDEX) % rows
    none = F.lit(None).cast("long")
    homes = F.array_compact(
        F.array(home, F.when(at >= rows - back, home + 1).otherwise(none), F.when((at < ahead) & (home > 0), home - 1).otherwise(none))
    )
    return numbered.withColumn("__home", home).withColumn(BLOCK, F.explode(homes)).withColumn(OWN, F.col(BLOCK) == F.col("__home")).drop("__home")


def block_window(series: list[str]) -> WindowSpec:
    return W.partitionBy(*series, BLOCK).orderBy(INDEX)


def own_rows(df: DataFrame) -> DataFrame:
    return df.where(OWN).drop(INDEX, BLOCK, OWN)
