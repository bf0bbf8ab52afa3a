"""Reading stores by range, by SQL and by version; sinks with replace-by-key."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HIVE = ("year", "month")
MANY_MONTHS = 64


class RowCapError(RuntimeError):
    """A load would return more rows than its cap."""


def check_range(start, end) -> None:
    if start is not None and end is not None and start > end:
        raise ValueError(f"range is inverted: {start} > {end}")


def range_predicate(ts: str, start, end) -> Column:
    """start <= ts < end, open where a bound is None."""
    check_range(start, end)
    out = F.lit(True)
    if start is not None:
        out = out & (F.col(ts) >= F.lit(start))
    if end is not None:
        out = out & (F.col(ts) < F.lit(end))
    return out


def partition_predicate(start: dt.datetime | None, end: dt.datetime | None) -> Column:
    """The (year, month) partitions that a half-open range can touch; years only for a long one."""
    if start is None or end is None or start >= end:
        return F.lit(True)
    last = end - dt.timedelta(microseconds=1)
    months = (last.year - start.year) * 12 + last.month - start.month + 1
    if months > MANY_MONTHS:
        return F.col("year").between(start.year, last.year)
    pairs = [divmod(start.year * 12 + start.month - 1 + k, 12) for k in range(months)]
    out = F.lit(False)
    for y in sorted({y for y, _ in pairs}):
        out = out | ((F.col("year") == y) & F.col("month").isin([m + 1 for yy, m in pairs if yy == y]))
    return out


class DataStore:
    """Tick and bar tables of one root; a DataFrame is lazy, so scans and loads are one thing but for order and cap."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame | str], ts: str = "timestamp", max_rows: int | None = None):
        self.spark, self.ts, self.max_rows = spark, ts, max_rows
        self.tables = {k: spark.read.parquet(v) if isinstance(v, str) else v for k, v in tables.items()}

    def scan(self, name: str, start=None, end=None, columns: list[str] | None = None) -> DataFrame:
        df = self.tables[name]
        if set(HIVE) <= set(df.columns):
            df = df.where(partition_predicate(start, end))
        df = df.where(range_predicate(self.ts, start, end))
        wanted = columns or [c for c in df.columns if c not in HIVE]
        missing = [c for c in wanted if c not in df.columns]
        if missing:
            raise KeyError(f"no such columns: {', '.join(missing)}")
        return df.select(*wanted)

    def load(self, name: str, start=None, end=None, columns=None, *, limit: int | None = None, allow_large: bool = False, order: list[str] | None = None) -> DataFrame:
        """Ordered rows of a half-open range; refused if they are more than the cap."""
        df = self.scan(name, start, end, columns)
        if self.max_rows is not None and not allow_large and (limit is None or limit > self.max_rows):
            found = df.count()
            if min(found, limit or found) > self.max_rows:
                raise RowCapError(f"{found} rows; the cap is {self.max_rows}")
        df = df.orderBy(*(order or [self.ts]))
        return df.limit(limit) if limit is not None else df

    def iterate(self, name: str, start: dt.datetime, end: dt.datetime, chunk: dt.timedelta, columns=None):
        """(start, end, DataFrame) for every time chunk of a range."""
        check_range(start, end)
        while start < end:
            stop = min(start + chunk, end)
            yield start, stop, self.scan(name, start, stop, columns)
            start = stop

    def span(self, name: str) -> DataFrame:
        """First and last time, from Parquet statistics where Spark can push the aggregate down."""
        return self.tables[name].agg(F.min(self.ts).alias("first"), F.max(self.ts).alias("last"))

    def sql(self, text: str, **args) -> DataFrame:
        """Free SQL over all tables as views, with named parameters: joins, grouping sets, set operations, windows."""
        for name, df in self.tables.items():
            df.createOrReplaceTempView(name)
        return self.spark.sql(text, args=args or None)


def upsert(old: DataFrame | None, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` in place of the rows of ``old`` that have its keys."""
    if old is None:
        return new
    on = [old[k].eqNullSafe(new[k]) for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return old.join(new.select(*keys), cond, "left_anti").unionByName(new, allowMissingColumns=True)


def fingerprint(settings: dict) -> str:
    return hashlib.blake2b(json.dumps(settings, sort_keys=True, default=str).encode(), digest_size=12).hexdigest()


class VersionedStore:
    """Tables under ``root/name/version``; a pointer table says which version is current. Versions are never changed, so
    readers keep what they opened."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def write(self, name: str, df: DataFrame, settings: dict, partition_by: list[str] | None = None) -> str:
        version = f"{fingerprint(settings)}-{uuid.uuid4().hex[:8]}"
        writer = df.write
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(f"{self.root}/{name}/{version}")
        rows = self.spark.read.parquet(f"{self.root}/{name}/{version}").count()
        note = [(version, fingerprint(settings), rows, json.dumps(settings, sort_keys=True, default=str), dt.datetime.now(dt.timezone.utc).timestamp())]
        self.spark.createDataFrame(note, "version string, fingerprint string, rows long, settings string, at double").write.mode("append").json(f"{self.root}/{name}/_versions")
        return version

    def current(self, name: str, settings: dict | None = None) -> str:
        """The newest version; with settings, refused if it was made with others."""
        notes = self.spark.read.schema("version string, fingerprint string, at double").json(f"{self.root}/{name}/_versions")
        row = notes.orderBy(F.col("at").desc()).first()
        if row is None or settings is not None and row["fingerprint"] != fingerprint(settings):
            raise LookupError(f"{name}: no current version with these settings")
        return row["version"]

    def read(self, name: str, columns: list[str] | None = None, settings: dict | None = None) -> DataFrame:
        df = self.spark.read.parquet(f"{self.root}/{name}/{self.current(name, settings)}")
        return df.select(*columns) if columns else df


def lineage(**versions: str) -> dict:
    """Raw, tick, bar, feature and target versions behind a result, with one id for the chain."""
    return {**versions, "lineage": fingerprint(versions)}


def nan_to_null(df: DataFrame) -> DataFrame:
    """Floating NaN becomes null, once, where kernels hand over to tables."""
    num = {c for c, t in df.dtypes if t in ("double", "float")}
    return df.select(*[F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")).alias(c) if c in num else F.col(f"`{c}`") for c in df.columns])


def write_study(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """A study table as Parquet, CSV or JSON, NaN as null."""
    getattr(nan_to_null(df).write.mode("overwrite"), kind)(path)


def stack_tables(parts: list[DataFrame]) -> DataFrame:
    """All rows of tables whose columns differ; missing ones are null, numeric types widen."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def profile(df: DataFrame, sample_fraction: float = 1.0, seed: int = 7) -> DataFrame:
    """``column, type, rows, nulls, min, max, distinct`` (approximate) of a table or of a share of it."""
    d = df.sample(sample_fraction, seed) if sample_fraction < 1 else df
    parts = []
    for c, t in df.dtypes:
        col = F.col(f"`{c}`")
        parts.append(F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.count("*").alias("rows"), F.count_if(col.isNull()).alias("nulls"), F.min(col).cast("string").alias("min"), F.max(col).cast("string").alias("max"), F.approx_count_distinct(col).alias("distinct")))
    return d.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("p")).select("p.*")
