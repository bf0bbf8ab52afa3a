"""Line dedup with two Bloom filters.

A line's key is the line stripped of the contract's white space with A-Z lower-cased; keys are compared by 128-bit
digests. The filters have ``BITS_PER_LINE`` bits for every line counted, a power of two, so few keys
that occur once are suspected at any size. First pass: every task marks its keys in a once-seen filter and, where that
filter already held one, in a twice-seen filter; the filters travel as compressed slices and are merged slice by slice
(a bit that two tasks saw once counts as seen twice), so no repeat is missed. Second pass: only keys that the twice-seen
filter suspects are counted, summed in the task first, and shuffled as digests for the exact number of documents and
the first place. Third pass: the confirmed lines go.

One filter has at most ``RANGE_BITS`` bits, so what a worker holds and what is broadcast has a bound. More lines than
that serves are dealt into ranges of keys: the first two passes run once a range, each with filters of its own range
alone, up to ``MOST_RANGES`` times. Beyond that filters fill up and more keys become suspects: 12-byte sums then shuffle
that a larger filter would have saved, while the exact count decides as before.

Confirmed keys are broadcast, those of most documents first, up to ``broadcast_keys``; the rest, which are no longer in
many documents each, are joined to the suspected lines, and only line numbers return to the documents.

A document is a row. Defined results: a null or empty text is one empty line; lines whose key is shorter than
``min_chars`` code points always stay; a key repeated inside one document counts once; null ids come last in the order
that picks a first place, and rows that share that id and line all keep it; texts and lines are whole at any length;
an empty table gives an empty table; extra columns pass through and columns of the output's names are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import Passed, ship, slices, tidy, written

#: Bits of the filters for every line, of one filter at least and at most, ranges of keys, and slices a filter travels in.
BITS_PER_LINE, LEAST_BITS, RANGE_BITS, MOST_RANGES, SLICES = 16, 1 << 20, 1 << 28, 16, 64
#: Confirmed keys that may be broadcast: 32 bytes each.
BROADCAST_KEYS = 1_000_000
#: Suspected keys a task holds before it passes its sums on.
HELD_KEYS = 50_000
_LAST_ID = 2**63 - 1


def line_keys(text: bytes, min_chars: int) -> tuple[list[bytes], list[bytes | None]]:
    """Lines of a text and the digests of their keys; None for a key that is too short."""
    import xxhash

    lines = text.split(b"\n")
    digest, keys = xxhash.xxh3_128_digest, []
    for line in lines:
        key = line.strip().lower()
        long_enough = len(key) >= min_chars and (min_chars <= 1 or len(key.decode(errors="replace")) >= min_chars)
        keys.append(digest(key) if key and long_enough else None)
    return lines, keys


def _words(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)


def bit_places(words: np.ndarray, bits: int) -> np.ndarray:
    """Two bit positions for each digest."""
    return (words & np.uint64(bits - 1)).astype(np.int64)


class TwoFilters:
    """Once-seen and twice-seen Bloom filters, as packed bits."""

    def __init__(self, bits: int):
        self.bits, self.once, self.twice = bits, np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)

    def add(self, digests: list[bytes]) -> None:
        if not digests:
            return
        distinct, n = np.unique(np.array(digests, "V16"), return_counts=True)
        at = bit_places(distinct.view("<u8").reshape(-1, 2), self.bits)
        byte, bit = at >> 3, (128 >> (at & 7)).astype(np.uint8)
        again = ((self.once[byte] & bit) > 0).all(1) | (n > 1)
        np.bitwise_or.at(self.twice, byte[again].ravel(), bit[again].ravel())
        np.bitwise_or.at(self.once, byte.ravel(), bit.ravel())

    def parts(self) -> Iterator[tuple[int, bytes, bytes]]:
        step = self.bits // 8 // SLICES
        for k in range(SLICES):
            part = slice(k * step, (k + 1) * step)
            if self.once[part].any():
                yield k, *(zlib.compress(x[part].tobytes(), 1) for x in (self.once, self.twice))


def filter_plan(lines: int) -> tuple[int, int]:
    """Bits of one filter and the number of key ranges for so many lines."""
    bits = 1 << max(0, lines * BITS_PER_LINE - 1).bit_length()
    return min(max(bits, LEAST_BITS), RANGE_BITS), min(max(1, bits // RANGE_BITS), MOST_RANGES)


def in_range(digest: bytes, part: int, ranges: int) -> bool:
    """Whether a key belongs to a range. Ranges use other bits of the digest than places in the filters do."""
    return ranges == 1 or int.from_bytes(digest[5:8], "little") % ranges == part


def twice_seen(texts: DataFrame, min_chars: int, bits: int, part: int = 0, ranges: int = 1) -> bytes:
    """The merged twice-seen filter of one range of keys, as packed bits: ``bits / 8`` bytes, whatever the corpus.
    ``texts`` has one binary column."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            own = own or TwoFilters(bits)
            texts = batch.column(0).to_pylist()
            for a, b in slices(texts):
                own.add([k for t in texts[a:b] for k in {*line_keys(t, min_chars)[1]} if k and in_range(k, part, ranges)])
        for k, once, twice in own.parts() if own else ():
            yield pa.RecordBatch.from_arrays(
                [pa.array([k], pa.int32()), pa.array([once], pa.binary()), pa.array([twice], pa.binary())],
                names=["part", "once", "twice"],
            )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        size = bits // SLICES // 8
        for batch in batches:
            for k, once, twice in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                o, t = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (once, twice))
                a, b = held.setdefault(k, (np.zeros(size, np.uint8), np.zeros(size, np.uint8)))
                b |= t | (a & o)
                a |= o
        for k, (_, b) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([k], pa.int32()), pa.array([b.tobytes()], pa.binary())], names=["part", "twice"]
            )

    marks = texts.mapInArrow(tidy(mark), "part int, once binary, twice binary")
    out = bytearray(bits // 8)
    for k, part in marks.repartition(16, "part").mapInArrow(tidy(merge), "part int, twice binary").collect():
        out[k * len(part) : (k + 1) * len(part)] = part
    return bytes(out)


def _suspects(packed: bytes, bits: int, digests: list[bytes]) -> np.ndarray:
    at = bit_places(_words(digests), bits)
    plane = np.frombuffer(packed, np.uint8)
    return ((plane[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(1)


def suspected_sums(places: DataFrame, plane, min_chars: int, bits: int, part: int, ranges: int) -> DataFrame:
    """``key, n, id, line``: for suspected keys of one range, documents and first place, summed in the task. ``places`` has
    an id and a binary text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}

        def out():
            cols = [list(held), *map(list, zip(*held.values(), strict=True))]
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["key", "n", "id", "line"])

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc, t in zip(ids, texts, strict=True):
                first: dict[bytes, int] = {}
                for k, key in enumerate(line_keys(t, min_chars)[1]):
                    if key and in_range(key, part, ranges):
                        first.setdefault(key, k)
                keys = list(first)
                for key, yes in zip(keys, _suspects(plane.value, bits, keys).tolist() if keys else (), strict=True):
                    if yes:
                        have = held.get(key)
                        if have is None:
                            held[key] = [1, doc, first[key]]
                        else:
                            have[0] += 1
                            if (doc, first[key]) < (have[1], have[2]):
                                have[1:] = [doc, first[key]]
                if len(held) >= HELD_KEYS:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return places.mapInArrow(tidy(run), "key binary, n long, id long, line int")


class KnownKeys:
    """Broadcast keys in order, with their first places."""

    def __init__(self, rows):
        words = _words(rows["key"].tolist() or [b""])[: len(rows)]
        by = np.lexsort((words[:, 1], words[:, 0]))
        self.words, self.ids, self.lines = words[by], rows["id"].to_numpy(np.int64)[by], rows["line"].to_numpy(np.int64)[by]

    def dropped(self, doc: int, digests: list[bytes | None], keep_first: bool) -> set[int]:
        """Lines of a document that have one of the keys, but for a first place."""
        at = [k for k, d in enumerate(digests) if d]
        if not at or not len(self.words):
            return set()
        words = _words([digests[k] for k in at])
        low = np.searchsorted(self.words[:, 0], words[:, 0]).tolist()
        high = np.searchsorted(self.words[:, 0], words[:, 0], side="right").tolist()
        gone = set()
        for k, a, b, second in zip(at, low, high, words[:, 1], strict=True):
            for p in range(a, b):  # more than one only where 64 bits of two digests agree
                if self.words[p, 1] == second and not (keep_first and self.ids[p] == doc and self.lines[p] == k):
                    gone.add(k)
        return gone


def line_dedup(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    min_docs: int = 2,
    keep_first: bool = True,
    min_chars: int = 1,
    filters: tuple[int, int] | None = None,
    broadcast_keys: int = BROADCAST_KEYS,
) -> DataFrame:
    """``docs`` with the lines whose key at least ``min_docs`` documents hold taken out of ``text`` (all, or all but the
    first place by id and line), and with ``n_lines`` and ``n_dropped`` (long). ``filters`` are the bits of one filter and
    the number of key ranges; without them lines are counted first."""
    spark = docs.sparkSession
    ship(spark)
    made = ("n_lines", "n_dropped")
    p = Passed(docs, made)
    body = F.coalesce(p[text], F.lit("")).cast("binary").alias("body")
    order = F.coalesce(p[doc_id].cast("long"), F.lit(_LAST_ID)).alias("id")
    if filters is None:
        whole = F.coalesce(p[text], F.lit(""))
        counted = p.frame.agg(F.sum(1 + F.octet_length(whole) - F.octet_length(F.replace(whole, F.lit("\n"), F.lit("")))))
        filters = filter_plan(counted.first()[0] or 0)
    bits, ranges = filters
    sums, planes = None, []
    for part in range(ranges):
        plane = spark.sparkContext.broadcast(twice_seen(p.frame.select(body), min_chars, bits, part, ranges))
        planes.append(plane)
        own = suspected_sums(p.frame.select(order, body), plane, min_chars, bits, part, ranges)
        sums = own if sums is None else sums.union(own)
    confirmed = written(
        sums.groupBy("key")
        .agg(F.sum("n").alias("n"), F.min(F.struct("id", "line")).alias("at"))
        .where(F.col("n") >= min_docs)
        .select("key", "n", "at.id", "at.line")
    )
    known, number = confirmed, confirmed.count()
    if number > broadcast_keys:
        known = written(confirmed.orderBy(F.col("n").desc(), "key").limit(broadcast_keys))
    table = spark.sparkContext.broadcast(KnownKeys(known.select("key", "id", "line").toPandas()))  # 28 bytes a row
    rows = p.frame
    if number > broadcast_keys:
        rows = written(p.frame.withColumn("row", F.monotonically_increasing_id()))
        rest = confirmed.join(known, "key", "left_anti")

        def lines_of(part: int):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for row, doc, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                        keys = line_keys(t, min_chars)[1]
                        taken = table.value.dropped(doc, keys, False)
                        at = [k for k, d in enumerate(keys) if d and k not in taken and in_range(d, part, ranges)]
                        yes = _suspects(planes[part].value, bits, [keys[k] for k in at]).tolist() if at else ()
                        at = [k for k, y in zip(at, yes, strict=True) if y]
                        cols = [[row] * len(at), [doc] * len(at), at, [keys[k] for k in at]]
                        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["row", "doc", "k", "key"])

            return run

        texts = rows.select("row", order, body)
        lines = reduce(DataFrame.union, [texts.mapInArrow(tidy(lines_of(part)), "row long, doc long, k int, key binary") for part in range(ranges)])
        first = (F.col("id") == F.col("doc")) & (F.col("line") == F.col("k")) if keep_first else F.lit(False)
        gone = lines.join(rest, "key").where(~first).groupBy("row").agg(F.collect_list("k").alias("gone"))
        rows = rows.join(gone, "row", "left").drop("row")
    else:
        rows = rows.withColumn("gone", F.lit(None).cast("array<int>"))
    source = rows.select(*Passed(docs, made, (text,)).kept, order, "gone", body)
    schema = T.StructType([*source.schema[:-3], T.StructField("body", T.BinaryType()), *[T.StructField(c, T.LongType()) for c in made]])

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_columns - 3
            ids, found, texts = (batch.column(m + k).to_pylist() for k in range(3))
            for a, b in slices(texts):
                new, n, less = [], [], []
                for doc, own, t in zip(ids[a:b], found[a:b], texts[a:b], strict=True):
                    lines, digests = line_keys(t, min_chars)
                    gone = table.value.dropped(doc, digests, keep_first) | set(own or ())
                    new.append(b"\n".join([x for k, x in enumerate(lines) if k not in gone]) if gone else t)
                    n.append(len(lines))
                    less.append(len(gone))
                cols = [batch.column(k).slice(a, b - a) for k in range(m)]
                cols += [pa.array(new, pa.binary()), pa.array(n, pa.int64()), pa.array(less, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    out = source.mapInArrow(tidy(drop), schema)
    return out.select(*p.back_with(text, F.col("body").cast("string")), *made)
