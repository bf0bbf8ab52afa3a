"""Raw delimited tick files to canonical, partitioned, verified Parquet."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.bars import ClockRule, to_utc
from tidemark.operators.scans import running

#: Header patterns, most specific first, and the canonical field each names.
HEADER_PATTERNS = (
    (r"^(date[_ ]?time|timestamp|time[_ ]?stamp)$", "timestamp"),
    (r"^(gmt|utc)[_ ]?time$", "timestamp"),
    (r"bid.*(vol|size)", "bid_volume"),
    (r"ask.*(vol|size)", "ask_volume"),
    (r"^bid", "bid"),
    (r"^(ask|offer)", "ask"),
    (r"spread", "spread"),
    (r"vol|size|qty", "volume"),
    (r"^date$", "date"),
    (r"^time$", "time"),
)
#: Timestamp formats in the order they are tried, as Spark patterns.
TIMESTAMP_FORMATS = (
    "yyyyMMdd HH:mm:ss.SSS", "yyyyMMdd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss.SSS",
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy.MM.dd HH:mm:ss.SSS",
    "yyyy.MM.dd HH:mm:ss", "dd.MM.yyyy HH:mm:ss.SSS", "yyyy/MM/dd HH:mm:ss",
)


def resolve_sources(spark: SparkSession, path: str) -> list[str]:
    """Files behind a file, folder or glob, in name order, through Spark's file systems."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    return sorted(r[0] for r in files.collect())  # names only


def sniff_dialect(sample: bytes) -> dict:
    """Delimiter, header, encoding and line ending of the first bytes of a file."""
    bom = next((e for b, e in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16")) if sample.startswith(b)), None)
    try:
        text, encoding = sample.decode(bom or "utf-8"), bom or "utf-8"
    except UnicodeDecodeError:
        text, encoding = sample.decode("latin-1"), "latin-1"
    ending = "\r\n" if "\r\n" in text else "\n"
    lines = [x for x in text.split(ending)[:-1] if x] or [text]
    def score(d):
        counts = [x.count(d) for x in lines]
        return (min(counts) if min(counts) == max(counts) else 0, sum(counts))
    delimiter = max(",;\t|", key=score)
    header = not re.search(r"\d", lines[0])
    return {"delimiter": delimiter, "header": header, "encoding": encoding, "line_ending": ending}


def detect_columns(headers: list[str]) -> dict[str, str]:
    """Canonical field -> header; each field is named once, by the first header that fits."""
    out: dict[str, str] = {}
    for h in headers:
        for pattern, field_ in HEADER_PATTERNS:
            if re.search(pattern, h.strip().lower()):
                out.setdefault(field_, h)
                break
    return out


def detect_timestamp_format(spark: SparkSession, samples: list[str]) -> str | None:
    """The first format that reads every sample."""
    if not samples:
        return None
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    ok = [F.bool_and(F.try_to_timestamp("s", F.lit(f)).isNotNull()) for f in TIMESTAMP_FORMATS]
    row = df.agg(*ok).first()
    return next((f for f, yes in zip(TIMESTAMP_FORMATS, row, strict=True) if yes), None)


@dataclass(frozen=True)
class TickFormat:
    """Declared layout of a source: canonical field -> header, and how to read times."""

    columns: dict[str, str] = field(default_factory=lambda: {"timestamp": "DateTime", "bid": "Bid", "ask": "Ask", "volume": "Volume"})
    delimiter: str = ","
    timestamp_format: str = "yyyyMMdd HH:mm:ss.SSS"
    clock: ClockRule = ClockRule()


def canonical_schema(fmt: TickFormat, with_utc: bool = True) -> T.StructType:
    """Ordered contract of the tick table; fields absent at the source are absent here."""
    out = [T.StructField("src_seq", T.LongType()), T.StructField("timestamp", T.TimestampType())]
    out += [T.StructField("timestamp_utc", T.TimestampType())] * with_utc
    out += [T.StructField(c, T.DoubleType()) for c in ("bid", "ask") if c in fmt.columns]
    out += [T.StructField(c, T.DoubleType()) for c in ("mid", "spread")] if {"bid", "ask"} <= set(fmt.columns) else []
    out += [T.StructField("volume", T.DoubleType())] * ("volume" in fmt.columns)
    out += [T.StructField("spread_source", T.DoubleType())] * ("spread" in fmt.columns)
    return T.StructType(out)


def derived(bid: Column, ask: Column) -> dict[str, Column]:
    return {"mid": (bid + ask) / 2, "spread": ask - bid}


def read_raw(spark: SparkSession, path: str | None, fmt: TickFormat, headers: list[str], lines: DataFrame | None = None) -> DataFrame:
    """All fields as strings with ``malformed`` for rows of the wrong width, the file, and a source sequence that ascends
    within it. Tick files have no quoted fields; header lines are left out. ``lines`` (``value, src_file, src_row``) may
    stand for the files of ``path``."""
    text = lines
    if text is None:
        text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("src_file"), F.monotonically_increasing_id().alias("src_row"))
    body = text.where(F.col("value") != fmt.delimiter.join(headers))
    parts = F.split("value", re.escape(fmt.delimiter))
    return body.select("src_file", "src_row", parts.alias("p")).select(
        "src_file", "src_row", (F.size("p") != len(headers)).alias("malformed"), *[F.get("p", F.lit(k)).alias(h) for k, h in enumerate(headers)]
    )


def to_canonical(raw: DataFrame, fmt: TickFormat) -> DataFrame:
    """Rename, lenient parsing (null where it fails, the raw text kept beside), derived columns and UTC."""
    c = fmt.columns
    num = lambda f: F.col(f"`{c[f]}`").try_cast("double")
    out = raw.select("*", F.col(f"`{c['timestamp']}`").alias("timestamp_raw"), F.try_to_timestamp(F.col(f"`{c['timestamp']}`"), F.lit(fmt.timestamp_format)).alias("timestamp"))
    out = out.withColumn("timestamp_utc", to_utc(F.col("timestamp"), fmt.clock))
    out = out.withColumns({f: num(f) for f in ("bid", "ask", "volume") if f in c})
    if {"bid", "ask"} <= set(c):
        out = out.withColumns(derived(F.col("bid"), F.col("ask")))
    if "spread" in c:
        out = out.withColumn("spread_source", num("spread"))
    return out


def source_index(lines: DataFrame, key: Column) -> DataFrame:
    """``key, lines, content``: lines of every partition key and an order-free content hash, a sum, in which equal lines do
    not cancel; lines without a key count under null."""
    content = F.sum(F.xxhash64("value").cast("decimal(20,0)")).cast("string")
    return lines.groupBy(key.alias("key")).agg(F.count("*").alias("lines"), content.alias("content"))


#: Source rows of one part of a running maximum or a digest.
PART_ROWS = 65_536


def ordering_report(rows: DataFrame, ts: str, seq: str, series: list[str], part_rows: int = PART_ROWS) -> DataFrame:
    """Backward jumps against the running maximum of time, which is carried over parts of a series."""
    part = F.floor(F.col(seq) / part_rows)
    high = running(rows.select(*series, seq, ts), series, [seq], part, {"high_water": ("max", F.col(ts))}, part_rows)
    return high.where(F.col(ts) < F.col("high_water"))


#: Modulus (a prime) and base of the digest polynomial.
DIGEST_PRIME, DIGEST_BASE = 2**61 - 1, 1_000_003


def table_digest(df: DataFrame, seq: str, columns: list[str], keys: list[str], part_rows: int = PART_ROWS) -> DataFrame:
    """Order-sensitive digest of every partition: values, nulls and row order enter; rows may be read in any order.

    The digest is the polynomial of the rows' hashes in order of ``seq`` (ties: of the hash) modulo a prime. Parts of
    ``part_rows`` source rows are evaluated apart, with the power of the base that stands for their rows, and joined in
    order: however rows are cut into parts the digest is the same, and no partition is numbered or sorted whole."""
    big = "decimal(38,0)"
    number = lambda c: F.lit(c).cast(big) if isinstance(c, int) else c.cast(big)
    times = lambda a, b: ((a * b) % number(DIGEST_PRIME)).cast(big)
    plus = lambda a, b: ((a + b) % number(DIGEST_PRIME)).cast(big)
    # A null differs from every text, and cells do not run into each other.
    cells = [c for name in columns for c in (F.col(name).isNull(), F.coalesce(F.col(name).cast("string"), F.lit("")))]
    h = F.pmod(F.xxhash64(*cells), F.lit(DIGEST_PRIME)) + 1
    rows = df.select(*keys, F.floor(F.col(seq) / part_rows).alias("__part"), F.struct(F.col(seq).alias("s"), h.alias("h")).alias("__r"))
    listed = rows.groupBy(*keys, "__part").agg(F.array_sort(F.collect_list("__r")).alias("__r"))
    step = lambda acc, r: plus(times(acc, number(DIGEST_BASE)), number(r["h"]))
    power = F.aggregate("__r", number(1), lambda acc, r: times(acc, number(DIGEST_BASE)))
    parts = listed.select(*keys, F.struct("__part", F.size("__r").cast("long").alias("n"), F.aggregate("__r", number(0), step).alias("d"), power.alias("p")).alias("__p"))
    joined = parts.groupBy(*keys).agg(F.sum("__p.n").alias("rows"), F.array_sort(F.collect_list("__p")).alias("__p"))
    digest = F.aggregate("__p", number(0), lambda acc, p: plus(times(acc, p["p"]), p["d"]))
    return joined.select(*keys, "rows", digest.cast("long").alias("digest"))


def dataset_version(digests: list[tuple[str, int, int]], settings: dict) -> str:
    """Changes if and only if the data or the settings do."""
    body = json.dumps([sorted(map(list, digests)), settings], sort_keys=True, default=str)
    return hashlib.blake2b(body.encode(), digest_size=16).hexdigest()


def verify_ticks(ticks: DataFrame, ts: str = "timestamp", seq: str = "src_seq") -> DataFrame:
    """Per month: rows, rows in the wrong month, duplicates, prices that contradict themselves; all but rows should be 0."""
    month = F.struct(F.year(ts), F.month(ts))
    dup = F.row_number().over(W.partitionBy(ts, "bid", "ask", seq).orderBy(F.lit(0))) > 1
    marked = ticks.select("year", "month", (month != F.struct("year", "month")).alias("stray"), dup.alias("dup"), ((F.col("ask") < F.col("bid")) | (F.col("bid") <= 0)).alias("bad"))
    one = lambda c: F.sum(F.coalesce(F.col(c), F.lit(True)).cast("long")).alias(c)
    return marked.groupBy("year", "month").agg(F.count("*").alias("rows"), one("stray"), one("dup"), one("bad"))
