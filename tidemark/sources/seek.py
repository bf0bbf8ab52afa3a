"""Lines of large text files by byte ranges: a load of some lines reads the bytes around them, not the files.

A range owns the lines that start in it, so ranges may be cut anywhere and every line is read once. Where files are in
order of their leading field, the range of a span of that field is found by a binary search (`line_at_prefix`)."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.session import ship

NAME = "tidemark_lines"
#: Bytes of a partition, of one read of it, and of one step of a search for a line's end.
PARTITION_BYTES, READ_BYTES, STEP_BYTES = 64 << 20, 4 << 20, 1 << 12


def open_file(path: str):
    """A file of any file system that Arrow knows, for reading at any place, and its size."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:") :]
    system, inner = fs.FileSystem.from_uri(path)
    f = system.open_input_file(inner)
    return f, f.size()


def line_start(f, at: int, size: int) -> int:
    """The first place from ``at`` on where a line starts; ``size`` if there is none."""
    if at <= 0:
        return 0
    f.seek(at - 1)
    place = at - 1
    while place < size:
        block = f.read(STEP_BYTES)
        if not block:
            break
        found = block.find(b"\n")
        if found >= 0:
            return place + found + 1
        place += len(block)
    return size


def line_at_prefix(f, prefix: bytes, begin: int, size: int) -> int:
    """The start of the first line whose leading bytes are at least ``prefix``, in a file whose lines from ``begin`` on
    ascend by them; ``size`` if every line is below. Logarithmically many short reads."""
    low, high = begin, size
    while low < high:
        middle = (low + high) // 2
        start = max(line_start(f, middle, size), begin)
        if start >= high:  # no line starts between the middle and the end: the answer is at or before the middle
            high = middle
            continue
        f.seek(start)
        if f.read(len(prefix)) < prefix:
            low = start + 1
        else:
            high = start
    return max(line_start(f, low, size), begin)


@dataclass
class LineRange(InputPartition):
    """Lines of ``file`` that start in [begin, end)."""

    file: str
    begin: int
    end: int


def cut(file: str, begin: int, end: int, most: int) -> list[LineRange]:
    return [LineRange(file, at, min(at + most, end)) for at in range(begin, end, most)]


def merged(ranges: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The same bytes in ranges that do not overlap."""
    out: list[tuple[str, int, int]] = []
    for file, begin, end in sorted(r for r in ranges if r[1] < r[2]):
        if out and out[-1][0] == file and begin <= out[-1][2]:
            out[-1] = (file, out[-1][1], max(end, out[-1][2]))
        else:
            out.append((file, begin, end))
    return out


class LineReader(DataSourceReader):
    def __init__(self, options: dict):
        self.ranges = json.loads(options["ranges"]) if "ranges" in options else None
        self.files = json.loads(options.get("files", "[]"))
        self.first, self.last = options.get("from_prefix"), options.get("to_prefix")
        self.header = options.get("header_lines", "0")
        self.most = int(options.get("partition_bytes", PARTITION_BYTES))

    def partitions(self) -> list[LineRange]:
        if self.ranges is not None:
            return [p for r in merged([tuple(r) for r in self.ranges]) for p in cut(*r, self.most)]
        out = []
        for file in self.files:
            f, size = open_file(file)
            with f:
                begin = 0
                for _ in range(int(self.header)):
                    begin = line_start(f, begin + 1, size)
                low = line_at_prefix(f, self.first.encode(), begin, size) if self.first else begin
                high = line_at_prefix(f, self.last.encode(), begin, size) if self.last else size
            out += cut(file, low, high, self.most)
        return out

    def read(self, partition: LineRange) -> Iterator[pa.RecordBatch]:
        f, size = open_file(partition.file)
        with f:
            start = line_start(f, partition.begin, size)
            f.seek(start)
            rest: list[bytes] = []
            while start < partition.end:
                block = f.read(min(READ_BYTES, max(partition.end - start, STEP_BYTES)))
                if block and b"\n" not in block:  # a line longer than a read
                    rest.append(block)
                    continue
                data = b"".join([*rest, block])
                if not data:
                    break
                whole = data.rfind(b"\n") + 1 if block else len(data)
                yield self.batch(partition, data[:whole], start)
                start, rest = start + whole, [data[whole:]] if whole < len(data) else []

    def batch(self, partition: LineRange, data: bytes, at: int) -> pa.RecordBatch:
        """The lines of ``data`` that the partition owns, without their ends; bytes that are no UTF-8 are replaced."""
        ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
        if not len(ends) or ends[-1] != len(data):
            ends = np.append(ends, len(data))
        starts = np.concatenate([[0], ends[:-1]])
        n = int(np.searchsorted(starts, partition.end - at))
        starts, ends = starts[:n], ends[:n]
        places = np.concatenate([starts, ends[-1:]]).astype(np.int32)
        lines = pa.StringArray.from_buffers(n, pa.py_buffer(places), pa.py_buffer(data))
        try:
            lines.validate(full=True)
        except pa.ArrowInvalid:
            lines = pa.array([data[a:b].decode("utf-8", "replace") for a, b in zip(starts, ends, strict=True)])
        lines = pc.replace_substring_regex(lines, r"\r?\n$", "")
        return pa.record_batch([pa.array([partition.file] * n), pa.array(at + starts), lines], names=["src_file", "src_offset", "value"])


class LineSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "src_file string, src_offset bigint, value string"

    def reader(self, schema) -> LineReader:
        return LineReader(dict(self.options))


def _source(spark: SparkSession):
    ship(spark)
    spark.dataSource.register(LineSource)
    return spark.read.format(NAME)


def read_lines(
    spark: SparkSession, files: list[str], first: str | None = None, last: str | None = None, header_lines: int = 0, partition_bytes: int = PARTITION_BYTES
) -> DataFrame:
    """``src_file, src_offset, value``: the lines of ``files``, each with the byte at which it starts.

    With ``first`` or ``last``, only lines whose leading characters are at least ``first`` and below ``last``: then every
    file must be in order of its leading characters behind its header lines, which is not checked, and only
    the bytes of those lines are read. Empty files have no lines; lines may be of any length below 2 GB."""
    out = _source(spark).option("files", json.dumps(files)).option("header_lines", str(header_lines)).option("partition_bytes", str(partition_bytes))
    if first is not None:
        out = out.option("from_prefix", first)
    if last is not None:
        out = out.option("to_prefix", last)
    return out.load()


def read_ranges(spark: SparkSession, ranges: list[tuple[str, int, int]], partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """As `read_lines`, for the lines that start in given byte ranges ``(file, begin, end)``."""
    return _source(spark).option("ranges", json.dumps(ranges)).option("partition_bytes", str(partition_bytes)).load()
