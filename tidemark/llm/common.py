"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import ship  # noqa: F401

#: White space of every contract of this subpackage: space and U+0009 to U+000D.
WS_CHARS = " \t\n\x0b\x0c\r"
WS_RUN = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data directory, by any path that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; only where that is unset, as in tests, a local one is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tidemark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def durable(df: DataFrame, eager: bool = True) -> DataFrame:
    """``df`` with its lineage cut by a checkpoint in the shared folder, which survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a compressed Parquet table in the shared folder; for results that are wide or read more than once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return spark.read.parquet(path)


def release() -> None:
    """Gives memory that Python, NumPy and Arrow have freed back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim:
        trim(0)


def tidy(kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``kernel`` releasing its memory at the end: a Python worker lives on after its task, beside the next stage's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from kernel(batches)
        finally:
            release()

    return run


class Passed:
    """Columns that an operator passes through, whatever they are called.

    ``frame`` holds the columns by position under names of their own (``__kept0`` and so on), so no name inside an operator
    can clash with them; an operator's own columns may have any other name. ``passed["text"]`` is the column of that name
    (in that spelling if there is one). ``kept`` are the columns that pass through, which are all but those ``dropped`` and
    those that the names ``made`` replace in any case; ``back`` gives them their names again."""

    def __init__(self, df: DataFrame, made: tuple[str, ...] = (), dropped: tuple[str, ...] = ()):
        self.names = df.columns
        self.frame = df.toDF(*(f"__kept{k}" for k in range(len(self.names))))
        gone = {self._place(c) for c in dropped}
        low = {c.lower() for c in made}
        self._on = [k for k, c in enumerate(self.names) if c.lower() not in low and k not in gone]

    def _place(self, name: str) -> int:
        found = [k for k, c in enumerate(self.names) if c == name] or [k for k, c in enumerate(self.names) if c.lower() == name.lower()]
        if not found:
            raise ValueError(f"no column {name} among {self.names}")
        return found[0]

    def __getitem__(self, name: str):
        return F.col(f"__kept{self._place(name)}")

    def inner(self) -> tuple[DataFrame, Callable[[str], str]]:
        """All columns under names that another operator's cannot clash with, and how to find a column's name."""
        return self.frame.toDF(*(f"__doc{k}" for k in range(len(self.names)))), lambda name: f"__doc{self._place(name)}"

    @property
    def kept(self) -> list:
        return [F.col(f"__kept{k}") for k in self._on]

    @property
    def back(self) -> list:
        return [F.col(f"__kept{k}").alias(self.names[k]) for k in self._on]

    def back_with(self, name: str, column) -> list:
        """``back`` with another column in one's place."""
        at = self._place(name)
        return [(column if k == at else F.col(f"__kept{k}")).alias(self.names[k]) for k in self._on]


def strip_ws(col):
    """A string without the contract's white space at either end."""
    return F.btrim(col, F.lit(WS_CHARS))


def slices(texts: list, most: int = 2_000_000):
    """Ranges of rows of a batch holding about ``most`` characters or bytes each; no row is split."""
    start, held = 0, 0
    for k, t in enumerate(texts):
        held += len(t)
        if held >= most:
            yield start, k + 1
            start, held = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def piece_splitter(pattern: str):
    """``findall`` of a pre-token pattern. For texts whose characters the standard library's ``re`` and the ``regex`` module
    class alike (checked character by character, once), the faster of the two is taken; the pieces are the same."""
    import re

    import regex

    slow = regex.compile(pattern).findall
    plain = pattern.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d")
    if r"\p" in plain or plain == pattern:
        return slow
    chars = "".join(map(chr, range(0x3000)))
    kinds = [
        (set(re.findall(a, chars)), set(regex.findall(b, chars)))
        for a, b in ((r"[^\W\d_]", r"\p{L}"), (r"\d", r"\p{N}"), (r"\s", r"\s"), (r"[^\s\w]|_", r"[^\s\p{L}\p{N}]"))
    ]
    alike = [c for c in chars if all((c in a) == (c in b) for a, b in kinds)]
    other = re.compile("[^" + "".join(map(re.escape, alike)) + "]").search
    fast = re.compile(plain).findall
    return lambda text: slow(text) if other(text) else fast(text)


#: Bits of a filter of row numbers that is broadcast: 2 MB, whatever the table.
KEY_FILTER_BITS, KEY_SLICES = 1 << 24, 16


def _key_places(keys, bits: int):
    import numpy as np

    h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return np.stack([h & np.uint64(bits - 1), (h >> np.uint64(32)) & np.uint64(bits - 1)], 1).astype(np.int64)


def key_filter(df: DataFrame, column: str, bits: int = KEY_FILTER_BITS) -> bytes:
    """A Bloom filter of a long column, as packed bits, put together slice by slice on the executors."""
    import zlib

    import numpy as np

    names = ["part", "bits"]

    def emit(parts):
        for k, part in parts:
            cols = [pa.array([k], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    def mark(batches):
        own = np.zeros(bits, bool)
        for batch in batches:
            own[_key_places(batch.column(0).to_numpy(), bits).ravel()] = True
        if own.any():
            yield from emit(enumerate(np.packbits(own).reshape(KEY_SLICES, -1)))

    def merge(batches):
        held = {}
        for batch in batches:
            for k, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part = np.frombuffer(zlib.decompress(part), np.uint8)
                held[k] = held[k] | part if k in held else part
        yield from emit(held.items())

    ship(df.sparkSession)
    marks = df.select(F.col(column).cast("long").alias("k")).mapInArrow(tidy(mark), "part int, bits binary")
    out = bytearray(bits // 8)
    for k, part in marks.repartition(4, "part").mapInArrow(tidy(merge), "part int, bits binary").collect():
        size = bits // 8 // KEY_SLICES
        out[k * size : (k + 1) * size] = zlib.decompress(part)
    return bytes(out)


def in_key_filter(packed: bytes, keys):
    """Which keys may be in a filter: all that are, and few others while it is sparse."""
    import numpy as np

    at, plane = _key_places(keys, len(packed) * 8), np.frombuffer(packed, np.uint8)
    return ((plane[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(1)
