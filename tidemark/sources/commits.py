"""A tick table that is brought up to date with its raw files month by month, and that readers never see half written.

A set is a folder with ``parts/`` (months as Parquet) and ``manifests/`` (numbered JSON files). The greatest manifest is the
set: it names the folder of every month. A run writes the months whose source lines changed into new folders, reads them
back, and commits by renaming one manifest into place, which fails where another run has taken the number. Until then, and
for ever if the run is killed, the manifest before stays the set. A part's folder is named by what it is made from, so a
run that is started again takes over the parts that were finished."""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import ordering as O
from tidemark.operators.validate import CHECKS, Schedule, TickRules, classify_gap, drop_reason, flag_ticks, reconcile, tick_gaps
from tidemark.sources import seek
from tidemark.sources import ticks as TK

#: A file's bytes in a source sequence: the files in name order, each with room for so many bytes.
FILE_BYTES = 1 << 44
#: Checks without which a row could not be put into a month.
PLACING = ("missing_timestamp", "unparseable_timestamp")
HEADER, UNPLACED = "header", "unplaced"


class Conflict(RuntimeError):
    """Another run committed first."""


def _hash(*parts) -> str:
    return hashlib.blake2b(json.dumps(parts, sort_keys=True, default=str).encode(), digest_size=12).hexdigest()


def source_index(lines: DataFrame, fmt: TK.TickFormat, headers: list[str]) -> DataFrame:
    """For every file and key (a month ``yyyy-MM``, ``header``, or ``unplaced`` where no time can be read): ``lines``,
    ``malformed`` (of the wrong width), ``blank`` (no text for a time), the bytes ``begin`` to ``end`` that hold all of them,
    and ``content`` and ``moment``, which change if a line does or if lines change their order."""
    cells = F.split("value", TK.re.escape(fmt.delimiter))
    raw = F.get(cells, F.lit(headers.index(fmt.columns["timestamp"])))
    ts = F.try_to_timestamp(raw, F.lit(fmt.timestamp_format))
    is_header = F.col("value") == fmt.delimiter.join(headers)
    key = F.when(is_header, HEADER).otherwise(F.coalesce(F.date_format(ts, "yyyy-MM"), F.lit(UNPLACED)))
    big = "decimal(38,0)"
    h = F.pmod(F.xxhash64("value"), F.lit(2**31 - 1)).cast(big)
    at = F.col("src_offset").cast(big)
    wide = ~is_header & (F.size(cells) != len(headers))
    marked = lines.select(
        "src_file", key.alias("key"), "src_offset", (F.col("src_offset") + F.octet_length("value") + 2).alias("__end"), h.alias("__h"), (h * at).cast(big).alias("__m"),
        wide.cast("long").alias("__wide"), (~wide & (F.trim(F.coalesce(raw, F.lit(""))) == "")).cast("long").alias("__blank"),
    )
    sums = marked.groupBy("src_file", "key").agg(
        F.count("*").alias("lines"), F.sum("__wide").alias("malformed"), F.sum("__blank").alias("blank"), F.min("src_offset").alias("begin"), F.max("__end").alias("end"),
        F.sum("__h").alias("__c"), F.sum("__m").alias("__cm"),
    )
    # Of places counted from the first line of the key, so that lines put before a month do not change it.
    moment = (F.col("__cm") - F.col("begin").cast(big) * F.col("__c")).cast("string")
    return sums.select("src_file", "key", "lines", "malformed", "blank", "begin", "end", F.col("__c").cast("string").alias("content"), moment.alias("moment"))


@dataclass
class Verification:
    """What `TickSet.verify` found; ``failures`` empty means that the set is whole."""

    months: dict[str, dict] = field(default_factory=dict)
    gaps: dict[str, int] = field(default_factory=dict)
    absent: list[str] = field(default_factory=list)
    failures: list[str] = field(default_factory=list)

    @property
    def passed(self) -> bool:
        return not self.failures


class TickSet:
    """The set at ``root``, a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # Manifests.

    def _numbers(self) -> list[int]:
        folder = self._path(f"{self.root}/manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, number: int | None = None) -> dict | None:
        """The set as committed last, or under a number."""
        numbers = self._numbers()
        if not numbers:
            return None
        path = f"{self.root}/manifests/{numbers[-1] if number is None else number:08d}.json"
        return json.loads(self.spark.read.text(path, wholetext=True).first()[0])

    def _commit(self, manifest: dict) -> None:
        final = f"{self.root}/manifests/{manifest['number']:08d}.json"
        draft = self._path(f"{self.root}/manifests/_{uuid.uuid4().hex}.draft")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        gateway = self.spark.sparkContext._gateway
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        none = gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._fs.makeQualified(draft), self._fs.makeQualified(self._path(final)), none)
        except Exception as error:
            self._fs.delete(draft, False)
            if self._fs.exists(self._path(final)):
                raise Conflict(f"manifest {manifest['number']} was committed by another run") from error
            raise

    # Reading.

    def _folders(self, months: dict[str, dict]) -> list[str]:
        return [f"{self.root}/parts/{e['folder']}/kept=true/month={m}" for m, e in months.items() if e["rows"]]

    def _rows(self, months: dict[str, dict], schema) -> DataFrame:
        paths = self._folders(months)
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def read(self, first: str | None = None, last: str | None = None) -> DataFrame:
        """Ticks of the committed months from ``first`` to ``last`` (``yyyy-MM``, both included); no other month is opened."""
        m = self.manifest()
        if m is None:
            raise ValueError(f"no set has been committed at {self.root}")
        months = {k: e for k, e in m["months"].items() if (first is None or k >= first) and (last is None or k <= last)}
        return self._rows(months, TK.T.StructType.fromJson(m["schema"]))

    # Writing.

    def update(
        self, source: str, fmt: TK.TickFormat, headers: list[str], rules: TickRules = TickRules(), enabled: list[str] | tuple[str, ...] = CHECKS,
        months_a_job: int = 12, rebuild: bool = False,
    ) -> dict:
        """Bring the set up to date with the raw files and return its manifest.

        The files are read once for their index; of the months whose lines, order of lines or settings changed only the
        bytes that hold them are read again, ``months_a_job`` months a job. Months that left the source leave the set. A
        run with nothing to do commits nothing. Rows are compared with rows of their own month (its first row with
        none), so a month comes out the same whichever others are built beside it. Rows that are dropped are kept apart
        with their reason. Every source line is accounted for, or nothing is committed."""
        lost = [c for c in PLACING if c not in enabled]
        if lost:
            raise ValueError(f"a row without a time has no month: enable {', '.join(lost)}")
        files = TK.resolve_sources(self.spark, source)
        settings = {"format": asdict(fmt), "rules": asdict(rules), "enabled": list(enabled), "headers": headers}
        index = [r.asDict() for r in source_index(seek.read_lines(self.spark, files), fmt, headers).collect()]  # a row a file and month
        plan: dict[str, list[dict]] = {}
        for r in sorted(index, key=lambda r: (r["key"], r["src_file"])):
            plan.setdefault(r["key"], []).append(r)
        prints = {k: _hash(settings, [[r["lines"], r["content"], r["moment"]] for r in rs]) for k, rs in plan.items()}
        before = self.manifest()
        had = before["months"] if before else {}
        months = {k: had[k] for k in plan if k in had and had[k]["print"] == prints[k] and not rebuild}
        aside = {k: prints[k] for k in (HEADER, UNPLACED) if k in plan}
        changed = sorted(k for k in plan if k not in months and k not in (HEADER, UNPLACED))
        if before and not changed and set(had) == set(months) and before["aside"] == aside:
            return before
        built = []
        for i in range(0, len(changed), months_a_job):
            job = changed[i : i + months_a_job]
            built += job
            months |= self._build(job, plan, prints, files, fmt, headers, rules, list(enabled), fresh=rebuild)
        unplaced = plan.get(UNPLACED, [])
        spare = {"malformed": sum(r["malformed"] for r in unplaced), "missing_timestamp": sum(r["blank"] for r in unplaced)}
        spare["unparseable_timestamp"] = sum(r["lines"] for r in unplaced) - sum(spare.values())
        dropped = {c: n for c, n in spare.items() if c != "malformed" and n}
        for e in months.values():
            for c, n in e["dropped"].items():
                dropped[c] = dropped.get(c, 0) + n
        rows = sum(e["rows"] for e in months.values())
        malformed = spare["malformed"] + sum(e["malformed"] for e in months.values())
        total = sum(r["lines"] for k, rs in plan.items() if k != HEADER for r in rs)
        digests = [(k, e["rows"], e["digest"]) for k, e in months.items()]
        manifest = {
            "number": (before["number"] if before else 0) + 1, "settings": settings, "months": dict(sorted(months.items())), "aside": aside, "built": built,
            "schema": TK.canonical_schema(fmt).jsonValue(), "rows": rows, "dropped": dropped, "malformed": malformed,
            "reconciliation": reconcile(total, rows, dropped, malformed), "version": TK.dataset_version(digests, settings),
        }
        if not manifest["reconciliation"]["ok"]:
            raise RuntimeError(f"source lines are not accounted for: {manifest['reconciliation']}")
        self._commit(manifest)
        return manifest

    def _build(self, job, plan, prints, files, fmt, headers, rules, enabled, fresh) -> dict[str, dict]:
        """Write, or take over, the part of some months, and describe it from what is read back."""
        folder = _hash([[k, prints[k]] for k in job], uuid.uuid4().hex if fresh else None)
        path = f"{self.root}/parts/{folder}"
        columns = TK.canonical_schema(fmt)
        if not self._fs.exists(self._path(f"{path}/_SUCCESS")):
            extents = [(r["src_file"], r["begin"], r["end"]) for k in job for r in plan[k]]
            self._write(seek.read_ranges(self.spark, extents), path, job, files, fmt, headers, rules, enabled)
        stored = TK.T.StructType([*columns, *(TK.T.StructField(c, TK.T.StringType()) for c in ("reason", "kept", "month"))])
        back = self.spark.read.schema(stored).option("basePath", path).parquet(path)
        counts = {(r["month"], r["reason"]): r["n"] for r in back.groupBy("month", "reason").agg(F.count("*").alias("n")).collect()}
        digests = {r["month"]: r for r in month_digests(back.where("kept = 'true'")).collect()}
        out = {}
        for k in job:
            d = digests.get(k)
            out[k] = {
                "print": prints[k], "folder": folder, "lines": sum(r["lines"] for r in plan[k]), "malformed": sum(r["malformed"] for r in plan[k]),
                "rows": d["rows"] if d else 0, "digest": d["digest"] if d else 0, "dropped": {c: n for (m, c), n in sorted(counts.items(), key=str) if m == k and c is not None},
            }
        return out

    def _write(self, lines, path, job, files, fmt, headers, rules, enabled) -> None:
        ordinal = F.array_position(F.array(*map(F.lit, files)), F.col("src_file")) - 1
        numbered = lines.select("value", "src_file", (ordinal * FILE_BYTES + F.col("src_offset")).alias("src_row"))
        parsed = TK.to_canonical(TK.read_raw(self.spark, None, fmt, headers, numbered).where("NOT malformed"), fmt).withColumnRenamed("src_row", "src_seq")
        placed = parsed.withColumn("month", F.date_format("timestamp", "yyyy-MM")).where(F.col("month").isin(job))
        volume = "volume" if "volume" in fmt.columns else None
        flagged = flag_ticks(placed, rules, series=["month"], ts="timestamp", seq="src_seq", raw_ts="timestamp_raw", volume=volume, bucket_rows=TK.PART_ROWS * 64)
        marked = flagged.withColumn("reason", drop_reason(enabled)).withColumn("kept", F.col("reason").isNull().cast("string"))
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        order = ["kept", "month", "timestamp", "src_seq"]
        rows = marked.select(*TK.canonical_schema(fmt).names, "reason", "kept", "month")
        # By ranges of time: a month may span files and does not have to fit one task. A killed job leaves no _SUCCESS.
        rows.repartitionByRange(n, *order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy("kept", "month").parquet(path)

    def tidy(self, keep: int = 2) -> list[str]:
        """Delete parts that none of the last ``keep`` manifests names, and manifests before those. Not while a run or an
        older reader is at work: they may need them."""
        numbers = self._numbers()
        needed = {e["folder"] for n in numbers[-keep:] for e in self.manifest(n)["months"].values()}
        for n in numbers[:-keep]:
            self._fs.delete(self._path(f"{self.root}/manifests/{n:08d}.json"), False)
        parts = self._path(f"{self.root}/parts")
        gone = [s.getPath() for s in self._fs.listStatus(parts) if s.getPath().getName() not in needed] if self._fs.exists(parts) else []
        for p in gone:
            self._fs.delete(p, True)
        return sorted(p.getName() for p in gone)

    # Checking.

    def verify(self, gap_seconds: float = 3600.0, schedule: Schedule = Schedule()) -> Verification:
        """Derive every figure of the set again from its files: rows and the order-sensitive digest of every month, rows in
        the wrong month, rows out of order within a file and files of a month that overlap in time, types of columns, gaps
        by kind (over months' edges too), months that the source holds and the set does not, months missing between
        the first and the last, and the sums that account for the source lines."""
        out = Verification()
        m = self.manifest()
        if m is None:
            out.failures.append("no set has been committed")
            return out
        months = m["months"]
        schema = TK.T.StructType.fromJson(m["schema"])
        missing = [k for k, e in months.items() if e["rows"] and not self._fs.exists(self._path(self._folders({k: e})[0]))]
        out.failures += [f"{k}: its files are missing" for k in missing]
        there = {k: e for k, e in months.items() if k not in missing}
        paths = self._folders(there)
        if paths:
            try:
                found = self.spark.read.option("mergeSchema", "true").parquet(*paths).schema
            except Exception as error:  # its class differs between Spark's versions
                if "CANNOT_MERGE" not in str(error):
                    raise
                out.failures.append("columns of another type: the files' schemas do not merge")
                return out
            types = {f.name: f.dataType for f in found}
            wrong = sorted(f.name for f in schema if types.get(f.name) != f.dataType)
            if wrong:
                out.failures.append(f"columns of another type or missing: {', '.join(wrong)}")
                return out
        rows = self._rows(there, schema)
        if paths:
            folder = F.regexp_extract("_metadata.file_path", r"/month=([^/]+)/[^/]+$", 1)
            rows = rows.select("*", folder.alias("month"), F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at"))
        else:
            rows = rows.select("*", F.lit("").alias("month"), F.lit("").alias("__file"), F.lit(0).cast("long").alias("__at"))
        place = F.struct("timestamp", "src_seq")
        before = O.with_previous(rows.withColumn("__place", place), ["__file"], ["__at"], F.floor(F.col("__at") / TK.PART_ROWS), "__place", "__before")
        one = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0))
        stray = F.date_format("timestamp", "yyyy-MM") != F.col("month")
        per_file = before.groupBy("month", "__file").agg(
            F.count("*").alias("n"), one(stray).alias("stray"), one(F.col("__place") < F.col("__before")).alias("disorder"), F.min("__place").alias("lo"), F.max("__place").alias("hi"),
        )
        # A month has few files; their spans of time, in order, must not overlap.
        spans = TK.W.partitionBy("month").orderBy("lo", "hi", "__file")
        spread = per_file.withColumn("overlap", F.col("lo") <= F.max("hi").over(spans.rowsBetween(TK.W.unboundedPreceding, -1)))
        figures = spread.groupBy("month").agg(F.sum("n").alias("rows"), F.sum("stray").alias("stray"), F.sum("disorder").alias("disorder"), one(F.col("overlap")).alias("overlap"), F.min("lo.timestamp").alias("first"), F.max("hi.timestamp").alias("last"))
        digests = {r["month"]: r["digest"] for r in month_digests(rows).collect()}
        for r in figures.collect():  # a row a month
            out.months[r["month"]] = {**{c: r[c] for c in ("rows", "stray", "disorder", "overlap")}, "first": str(r["first"]), "last": str(r["last"]), "digest": digests[r["month"]]}
        for k, e in there.items():
            f = out.months.get(k, {"rows": 0, "digest": 0, "stray": 0, "disorder": 0, "overlap": 0})
            out.failures += [f"{k}: {c} is {f[c]}, the manifest says {e[c]}" for c in ("rows", "digest") if f[c] != e[c]]
            out.failures += [f"{k}: {f[c]} {what}" for c, what in (("stray", "rows of another month"), ("disorder", "rows out of order"), ("overlap", "files that overlap")) if f[c]]
            if e["lines"] != e["rows"] + e["malformed"] + sum(e["dropped"].values()):
                out.failures.append(f"{k}: source lines are not accounted for")
        if TK.dataset_version([(k, e["rows"], e["digest"]) for k, e in months.items()], m["settings"]) != m["version"]:
            out.failures.append("the version does not follow from the manifest")
        if months:
            ends = [(int(k[:4]) * 12 + int(k[5:]) - 1) for k in months]
            out.absent = [k for k in (f"{i // 12:04d}-{i % 12 + 1:02d}" for i in range(min(ends), max(ends) + 1)) if k not in months]
        gaps = tick_gaps(rows, gap_seconds, series=[], ts="timestamp", seq="src_seq")
        kind = classify_gap(F.col("gap_start"), F.col("gap_end"), schedule, ticks=True)
        out.gaps = {r["kind"]: r["n"] for r in gaps.groupBy(kind.alias("kind")).agg(F.count("*").alias("n")).collect()}
        return out


def month_digests(rows: DataFrame) -> DataFrame:
    """``month, rows, digest`` of rows in order of time and source, for all columns of a set."""
    columns = [c for c in rows.columns if c not in ("reason", "kept", "month") and not c.startswith("__")]
    return TK.table_digest(rows, "src_seq", columns, ["month"], TK.PART_ROWS * 64)
