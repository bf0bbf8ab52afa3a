"""`simulate.RiskEngine` over long series, as windows over blocks of rows.

What the engine knows at a row is a running maximum, a day's first value, a last time, and the first row that halts it; an
intent's first row comes from a grouping. Only the rate limit is a recursion: of the rows that no other rule refuses, so many
are accepted within a minute. It needs the times of the last accepted rows, and of rows of one time only how many there are, so
it reads counts by time, in order and a batch at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import ordering as O
from tidemark.operators import scans
from tidemark.session import ship, written


def _accepted(counts: DataFrame, series: list[str], most: int) -> DataFrame:
    """``counts`` (``series, t, n``) with how many are accepted at each time, at most ``most`` in any 60 seconds."""
    full = T.StructType([counts.schema[k] for k in series] + [T.StructField("t", T.DoubleType()), T.StructField("taken", T.LongType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, recent = None, []
        for frame in frames:
            out = []
            for *own, t, n in frame[[*series, "t", "n"]].itertuples(index=False, name=None):
                own = [None if k != k else k for k in own]
                if own != key:
                    key, recent = own, []
                recent = [r for r in recent if t - r[0] < 60]
                taken = max(0, min(n, most - sum(c for _, c in recent)))
                if taken:
                    recent.append((t, taken))
                out.append((*own, t, taken))
            yield pd.DataFrame(out, columns=full.names)

    ship(counts.sparkSession)
    return counts.repartition(*series).sortWithinPartitions(*series, "t").mapInPandas(run, full)


def decisions(
    rows: DataFrame, series: list[str], order: list[str], day: Column, *, t: str, intent: str, size: str, exposure: str, equity: str, observed: str,
    max_size: float, max_daily_loss: float, max_drawdown: float, max_rate: int, stale_after: float, block_rows: int = O.BLOCK_ROWS,
) -> DataFrame:
    """``rows`` with ``ok`` and ``reason`` of each one's intent. Where ``observed``, the account's ``equity`` is seen first.
    ``t`` is in seconds and rises with ``order``, which must tell rows apart; ``day`` numbers the days of ``t``. An equity that
    is missing is no peak."""
    seen = F.when(F.col(observed), F.when(~F.isnan(equity), F.col(equity)))
    at = F.struct(*order)
    base = rows.withColumns({"__day": day, "__seen": seen})
    base = scans.running(base, series, order, F.col("__day"), {"__peak": ("max", F.col("__seen")), "__account": ("max", F.when(F.col(observed), F.col(t)))}, block_rows)
    base = written(base)
    starts = base.where(observed).groupBy(*series, "__day").agg(F.min_by("__seen", at).alias("__start"))
    starts = O.beside(base.select(*series, "__day").distinct(), starts.withColumn("__has", F.lit(True)), [*series, "__day"])
    firsts = base.groupBy(*series, intent).agg(F.min_by(F.struct(at.alias("at"), F.col(size).alias("size")), at).alias("__first"))
    # What halts a series first: an account seen, before the row's own intent, or an intent used again for another size.
    lost = O.beside(base.where(observed), starts, [*series, "__day"])
    why = F.when(F.col("__start") - F.col("__seen") > max_daily_loss, "daily_loss").when(F.col("__seen") / F.col("__peak") - 1 < -max_drawdown, "drawdown")
    lost = lost.select(*series, at.alias("at"), F.lit(0).alias("step"), why.alias("why")).where("why IS NOT NULL")
    known = O.beside(base, firsts, [*series, intent])
    conflict = ~F.col(size).eqNullSafe(F.col("__first.size"))
    reused = known.where(conflict).select(*series, at.alias("at"), F.lit(1).alias("step"), F.lit("reused_intent").alias("why"))
    halts = lost.unionByName(reused).groupBy(*series).agg(F.min(F.struct("at", "step", "why")).alias("__halt"))
    every = base.select(*series).distinct()
    on = F.lit(True)
    for i, s in enumerate(series):
        on = on & F.col(s).eqNullSafe(F.col(f"__of{i}"))
    halts = every.join(halts.withColumnsRenamed({s: f"__of{i}" for i, s in enumerate(series)}), on, "left").drop(*(f"__of{i}" for i in range(len(series))))
    known = O.beside(known, written(halts), series)
    halted = F.coalesce(F.struct(at.alias("at"), F.lit(1).alias("step")) > F.struct(F.col("__halt.at").alias("at"), F.col("__halt.step").alias("step")), F.lit(False)) & F.col("__halt").isNotNull()
    first = at == F.col("__first.at")
    reason = (
        F.when(conflict, "reused_intent").when(~first, "again").when(halted, F.concat(F.lit("halted_"), F.col("__halt.why")))
        .when(F.col("__account").isNull() | (F.col(t) - F.col("__account") > stale_after), "stale_account").when(F.col(exposure) + F.col(size) > max_size, "size")
    )
    judged = written(known.select(*rows.columns, F.col("__first.at").alias("__at"), reason.alias("reason")))
    free = judged.where("reason IS NULL").withColumn("__t", F.col(t).cast("double"))
    place = F.row_number().over(W.partitionBy(*series, "__t").orderBy(*order))
    taken = _accepted(free.groupBy(*series, F.col("__t").alias("t")).agg(F.count("*").alias("n")), series, max_rate).withColumnRenamed("t", "__t")
    free = O.beside(free.withColumn("__place", place), taken, [*series, "__t"])
    free = free.withColumn("reason", F.when(F.col("__place") <= F.col("taken"), "accepted").otherwise("rate")).select(*judged.columns)
    told = judged.where("reason IS NOT NULL AND reason <> 'again'").unionByName(free)
    # An intent sent again gets the answer it got first.
    again = judged.where("reason = 'again'").drop("reason")
    again = O.beside(again, told.select(*series, at.alias("__at"), "reason").join(again.select("__at").distinct(), "__at", "left_semi"), [*series, "__at"])
    return told.unionByName(again).select(*rows.columns, (F.col("reason") == "accepted").alias("ok"), "reason")
