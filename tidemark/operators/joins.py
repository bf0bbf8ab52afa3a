"""Alignment, as-of, interval and event-order joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.bars import micros_of


class AlignmentError(ValueError):
    """Rows of two tables do not belong together."""


def align_to_bars(frame: DataFrame, bars: DataFrame, keys: list[str], what: str = "table") -> DataFrame:
    """Rows of ``frame`` on the keys of ``bars``, null where it has none. Repeated keys and keys that no bar has are refused."""
    repeated = frame.groupBy(*keys).count().where("count > 1").limit(1).count()
    orphan = frame.join(bars.select(*keys), keys, "left_anti").limit(1).count()
    if repeated or orphan:
        raise AlignmentError(f"{what}: {'repeated keys' if repeated else 'rows without a bar'}")
    return bars.select(*keys).join(frame, keys, "left")


def unmatched(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one of two tables has."""
    left = a.select(*keys).distinct().withColumn("__a", F.lit(True))
    right = b.select(*keys).distinct().withColumn("__b", F.lit(True))
    return left.join(right, keys, "full").where("__a IS NULL OR __b IS NULL").select(*keys, F.when(F.col("__a").isNull(), "right").otherwise("left").alias("only_in"))


def check_alignment(features: DataFrame, targets: DataFrame, keys: list[str]) -> None:
    if unmatched(features, targets, keys).limit(1).count():
        raise AlignmentError("features and targets do not have the same rows")


def outer_on_time(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """Full outer join of prediction tables with one coalesced key."""
    return reduce(lambda a, b: a.join(b, keys, "full"), tables)


def compare_labels(a: DataFrame, b: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Two labelings side by side where both exist."""
    return a.select(*keys, F.col(label).alias("label_a")).join(b.select(*keys, F.col(label).alias("label_b")), keys)


def segment_table(df: DataFrame, by: str, totals: DataFrame, aggs: list[Column]) -> DataFrame:
    """Group figures with the bar totals of the same groups and the share of bars covered."""
    g = df.groupBy(by).agg(F.count("*").alias("rows"), *aggs)
    return totals.join(g, by, "left").withColumn("covered", F.try_divide(F.coalesce("rows", F.lit(0)), F.col("total")))


def asof(left: DataFrame, right: DataFrame, on: str, by: list[str], take: list[str], slice_seconds: int = 86_400, strict: bool = False) -> DataFrame:
    """Each left row with the latest right row at or before (``strict``: before) its time. Two-level: a window within a
    time slice, and each slice's last right row carried over the slices, so that a long key is not one task."""
    seq = "__left"
    slot = F.floor(F.unix_timestamp(F.col(on).cast("timestamp")) / slice_seconds)
    held = F.struct(*[F.col(c) for c in take])
    side = (1 if strict else -1) * F.lit(1)
    a = left.withColumn(seq, F.struct(*left.columns)).select(*by, on, seq, F.lit(None).cast(right.select(held.alias("h")).schema["h"].dataType).alias("__h"), F.lit(0).alias("__side"))
    b = right.select(*by, on, F.lit(None).cast(a.schema[seq].dataType).alias(seq), held.alias("__h"), side.alias("__side"))
    both = a.unionByName(b).withColumn("__slot", slot)
    own = W.partitionBy(*by, "__slot").orderBy(on, "__side").rowsBetween(W.unboundedPreceding, 0)
    seen = both.withColumn("__here", F.last("__h", ignorenulls=True).over(own)).where(F.col(seq).isNotNull())
    last = both.groupBy(*by, "__slot").agg(F.max_by("__h", F.when(F.col("__h").isNotNull(), F.struct(on))).alias("__last"))
    back = W.partitionBy(*by).orderBy("__slot").rowsBetween(W.unboundedPreceding, -1)
    carried = last.select(*by, "__slot", F.last("__last", ignorenulls=True).over(back).alias("__back")).where("__back IS NOT NULL")
    out = seen.join(carried, [*by, "__slot"], "left")
    best = F.coalesce("__here", "__back")
    return out.select(f"{seq}.*", *[best[c].alias(f"asof_{c}") for c in take])


def first_after(events: DataFrame, quotes: DataFrame, start: str, expiry: str, ts: str, by: list[str], slice_seconds: int) -> DataFrame:
    """Each event with the first quote strictly after ``start``, if that is before ``expiry``; of quotes at one time the
    least. Two-level as `asof`: events and quotes are ordered once, backwards, within a time slice, and an event that no
    quote of its slice follows takes the first quote of a later slice. Nothing is paired, so an interval may hold any
    number of quotes."""
    held = [c for c in quotes.columns if c not in (*by, ts)]
    kept = [c for c in events.columns if c not in by]
    width = slice_seconds * 1_000_000
    slot = F.floor(micros_of(F.col("__at")) / width)
    a = events.select(*by, *[F.col(c).alias(f"__e_{c}") for c in kept], F.col(start).alias("__at"), F.lit(False).alias("__is_quote"))
    b = quotes.dropna(subset=[*by, ts]).select(*by, F.col(ts).alias("__at"), *[F.col(c).alias(f"__q_{c}") for c in held], F.lit(True).alias("__is_quote"))
    own = F.struct(F.col("__at").alias("at"), *[F.col(f"__q_{c}").alias(c) for c in held])
    dealt = a.unionByName(b, allowMissingColumns=True).withColumn("__slot", slot).repartition(*by, "__slot")
    back = W.partitionBy(*by, "__slot").orderBy(F.desc("__at"), "__is_quote", *[F.desc(f"__q_{c}") for c in held]).rowsBetween(W.unboundedPreceding, 0)
    seen = dealt.withColumn("__here", F.last(F.when(F.col("__is_quote"), own), ignorenulls=True).over(back)).where(~F.col("__is_quote"))
    firsts = b.withColumn("__slot", slot).groupBy(*by, "__slot").agg(F.min(own).alias("__first"))
    slots = a.select(*by, slot.alias("__slot")).distinct().join(firsts, [*by, "__slot"], "full")
    later = W.partitionBy(*by).orderBy(F.desc("__slot")).rowsBetween(W.unboundedPreceding, -1)
    carried = slots.select(*by, "__slot", F.last("__first", ignorenulls=True).over(later).alias("__next")).where("__next IS NOT NULL")
    found = seen.join(carried, [*by, "__slot"], "left").withColumn("__f", F.coalesce("__here", "__next"))
    out = found.withColumn("__f", F.when(F.col("__f.at") < F.col(f"__e_{expiry}"), F.col("__f")))
    return out.select(*[F.col(c) if c in by else F.col(f"__e_{c}").alias(c) for c in events.columns], F.col("__f.at").alias("fill_ts"), *[F.col("__f")[c].alias(f"fill_{c}") for c in held])


def purge(rows: DataFrame, label_end: str, published: str, cutoff) -> DataFrame:
    """Training rows whose label interval and publication both end strictly before a cutoff."""
    return rows.where((F.col(label_end) < cutoff) & (F.col(published) < cutoff))


def purge_intervals(train: DataFrame, test: DataFrame, start: str, end: str) -> DataFrame:
    """Training rows whose [start, end] touches no test interval; test intervals are folds, a few rows."""
    t = F.broadcast(test.select(F.col(start).alias("__s"), F.col(end).alias("__e")))
    return train.join(t, (F.col(start) <= F.col("__e")) & (F.col(end) >= F.col("__s")), "left_anti")


def load_pair(parts: dict[str, DataFrame], keys: list[str], same: list[str]) -> DataFrame:
    """Constituents on identical rows; refused where the columns that must agree (target, horizon, version) do not."""
    out = None
    for name, df in parts.items():
        one = df.select(*keys, *[F.col(c).alias(f"{c}__{name}") for c in same], F.col("p").alias(f"p_{name}"))
        out = one if out is None else out.join(one, keys)
    names = list(parts)
    bad = reduce(Column.__or__, [~F.col(f"{c}__{names[0]}").eqNullSafe(F.col(f"{c}__{n}")) for c in same for n in names[1:]] or [F.lit(False)])
    if out.where(bad).limit(1).count():
        raise AlignmentError(f"constituents differ in {', '.join(same)}")
    return out.select(*keys, *[F.col(f"{c}__{names[0]}").alias(c) for c in same], *[f"p_{n}" for n in names])


def event_order(parts: list[DataFrame], ts: str, kind: str, seq: str) -> DataFrame:
    """Quotes, closes and signals as one stream in total order (time, kind, sequence)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).withColumn("event_key", F.struct(ts, kind, seq))


def forecasts_on_bars(forecasts: DataFrame, bars: DataFrame, by: list[str], at: str = "bar_open", ts: str = "timestamp") -> DataFrame:
    """Forecasts on the bars whose open time is exactly theirs."""
    return bars.join(forecasts.withColumnRenamed(at, ts), [*by, ts])
