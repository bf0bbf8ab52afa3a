"""Token counts by a map-side two-tier lookup.

First pass: every task keeps a bounded summary of its most frequent pre-tokens, the summaries (one row a task, never a
pre-token's rows) are merged in two steps, and the library's token counts of the ``table_size`` most frequent go out
as one compact broadcast table: a blob of bytes, lengths and counts. Second pass: each text is split, pieces are looked
up in the table, then in the worker's bounded cache, and only distinct misses are encoded by the library. No pre-token
is shuffled. The table and the cache decide speed only; every count is the library's own.

Where the library's Unicode tables may class a character otherwise than the ``regex`` module (outside ``PLAIN``), the
library's own pre-tokenizer cuts the text; its pieces are looked up and encoded like all others.

Defined results: a null text is an empty one with no tokens; texts are whole; special strings count as the one token
the library makes of them by default; repeated rows count each for itself; an empty table gives an empty table; extra
columns pass through and columns of the output's names are replaced.
"""

from __future__ import annotations

import math
import os
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import Passed, piece_splitter, ship, slices, tidy

#: Entries of the broadcast table, of a task's summary, and of a task's counter before it is cut back to its summary.
TABLE_SIZE, SUMMARY_SIZE, COUNTER_SIZE = 32_768, 8_192, 200_000
#: Worker cache: entries, and characters of one entry. Only short pre-tokens are worth a place.
CACHE_SIZE, CACHE_CHARS = 1_000_000, 64
#: Ranges in which the library and the ``regex`` module class every character alike (held by a test).
PLAIN = "\x00-՗ -⁯぀-ゖ゠-ヿ一-龥가-힣"


class Counting:
    """Counts tokens of texts as one tokenizers file does."""

    def __init__(self, path: str, pattern: str):
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.pre_tokenizer = self.tokenizer.pre_tokenizer
        self.pieces_of = piece_splitter(pattern)
        self.odd = regex.compile(f"[^{PLAIN}]").search
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(regex.escape(s) for s in special)).split if special else None
        self.table_name, self.table, self.known = "", {}, {}

    def library_pieces(self, text: str) -> list[str]:
        """Pieces as the library's own pre-tokenizer cuts them."""
        return [text[a:b] for _, (a, b) in self.pre_tokenizer.pre_tokenize_str(text)] if text else []

    def split(self, text: str) -> tuple[list[str], int]:
        """Pieces of a text and its number of special strings."""
        pieces_of = self.library_pieces if self.odd(text) else self.pieces_of
        parts = self.special(text) if self.special else [text]
        if len(parts) == 1:
            return pieces_of(text), 0
        return list(chain.from_iterable(map(pieces_of, parts))), len(parts) - 1

    def lengths(self, pieces: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def use(self, name: str, table: dict[str, int]) -> None:
        """Take a broadcast table as the first tier; the worker's own finds are added to a copy of it."""
        self.table_name, self.table, self.known = name, table, dict(table)

    def count(self, texts: list[str]) -> list[int]:
        split = [self.split(t) for t in texts]
        distinct = set(chain.from_iterable(pieces for pieces, _ in split))
        missing = [p for p in distinct if p not in self.known]
        if len(self.known) + len(missing) > CACHE_SIZE + len(self.table):
            self.known = dict(self.table)
            missing = [p for p in distinct if p not in self.known]
        for k in range(0, len(missing), 4096):
            part = missing[k : k + 4096]
            self.known.update(zip(part, self.lengths(part), strict=True))
        get = self.known.__getitem__
        out = [special + sum(map(get, pieces)) for pieces, special in split]
        for p in missing:
            if len(p) > CACHE_CHARS:
                del self.known[p]
        return out


_LOADED: dict[tuple[str, str], Counting] = {}


def _counting(path: str, pattern: str) -> Counting:
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Counting(path, pattern)
    return _LOADED[path, pattern]


def cut(counts: Counter, most: int) -> Counter:
    """The ``most`` largest counts, less the largest one left out: a mergeable heavy-hitter summary (Misra and Gries).
    Whatever makes up more than 1 part in ``most`` of all occurrences stays, however the parts are merged."""
    if len(counts) <= most:
        return counts
    top = counts.most_common(most + 1)
    least = top[-1][1]
    return Counter({k: n - least for k, n in top[:-1] if n > least})


_SUMMARY = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("pieces", T.ArrayType(T.StringType())),
        T.StructField("counts", T.ArrayType(T.LongType())),
    ]
)


def frequent_pieces(df: DataFrame, path: str, pattern: str, text: str = "text", size: int = TABLE_SIZE) -> dict[str, int]:
    """The most frequent pre-tokens of all texts with their summary counts, ``size`` at most."""
    ship(df.sparkSession)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counts: Counter = Counter()
        for batch in batches:
            own = _counting(path, pattern)
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for a, b in slices(texts):
                for pieces, _ in map(own.split, texts[a:b]):
                    counts.update(pieces)
                if len(counts) > COUNTER_SIZE:
                    counts = cut(counts, COUNTER_SIZE // 4)
        top = cut(Counter({p: n for p, n in counts.items() if len(p) <= CACHE_CHARS}), SUMMARY_SIZE)
        yield from row(TaskContext.get().partitionId(), top)

    def row(part: int, top: Counter) -> Iterator[pa.RecordBatch]:
        if top:
            cols = [pa.array([part], pa.int32()), pa.array([list(top)], pa.list_(pa.string())), pa.array([list(top.values())], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=_SUMMARY.names)

    def merge(most: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: Counter = Counter()
            for batch in batches:
                for pieces, counts in zip(batch.column(1), batch.column(2), strict=True):
                    for p, n in zip(pieces.as_py(), counts.as_py(), strict=True):
                        total[p] += n
                    if len(total) > COUNTER_SIZE:
                        total = cut(total, COUNTER_SIZE // 4)
            yield from row(0, cut(total, most))

        return run

    p = Passed(df)
    tasks = p.frame.select(p[text].alias("t")).mapInArrow(tidy(summarise), _SUMMARY)
    groups = max(1, math.isqrt(tasks.rdd.getNumPartitions()))
    first = tasks.repartition(groups, "part").mapInArrow(tidy(merge(SUMMARY_SIZE * 2)), _SUMMARY)
    rows = first.repartition(1).mapInArrow(tidy(merge(size)), _SUMMARY).collect()  # one row of a bounded size
    return dict(zip(rows[0]["pieces"], rows[0]["counts"], strict=True)) if rows else {}


def compact_table(pieces: dict[str, int]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Pieces' bytes in one blob, their byte lengths and their token counts."""
    raw = [p.encode() for p in pieces]
    return b"".join(raw), np.array([len(r) for r in raw], np.uint16), np.array(list(pieces.values()), np.uint16)


def opened_table(table: tuple[bytes, np.ndarray, np.ndarray]) -> dict[str, int]:
    blob, sizes, counts = table
    ends = np.cumsum(sizes, dtype=np.int64)
    cuts = zip((ends - sizes).tolist(), ends.tolist(), counts.tolist(), strict=True)
    return {blob[a:b].decode(): n for a, b, n in cuts}


def token_counts(df: DataFrame, path: str, pattern: str, text: str = "text", size: int = TABLE_SIZE) -> DataFrame:
    """``df`` without its text, with ``n_bytes`` and ``n_tokens`` (long)."""
    spark = df.sparkSession
    top = list(frequent_pieces(df, path, pattern, text, size))
    lengths = dict(zip(top, _counting(path, pattern).lengths(top), strict=True)) if top else {}
    table, name = spark.sparkContext.broadcast(compact_table(lengths)), uuid.uuid4().hex
    p = Passed(df, ("n_bytes", "n_tokens"), (text,))
    read = p.frame.select(*p.kept, F.coalesce(F.octet_length(p[text]), F.lit(0)).cast("long").alias("n_bytes"), p[text].alias("text"))
    schema = T.StructType([*read.schema[:-1], T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.num_columns - 1
            texts = [t or "" for t in batch.column(last).to_pylist()]
            own, counts = _counting(path, pattern), []
            if own.table_name != name:
                own.use(name, opened_table(table.value))
            for a, b in slices(texts, 8_000_000):
                counts += own.count(texts[a:b])
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], pa.array(counts, pa.int64())], names=schema.names)

    return read.mapInArrow(tidy(run), schema).select(*p.back, "n_bytes", "n_tokens")
