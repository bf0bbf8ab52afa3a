"""Byte-level BPE over whole texts, by length-bucketed padded numpy matrices.

A rank file gives every token's bytes and id; a smaller id is merged first. A text is split by a pattern, the distinct
pieces of a slice of texts that the worker's cache does not hold are laid out as rows of padded matrices, one matrix
per length bucket, and in every round each row merges its leftmost pair of minimum rank. Pair ranks come from an
open-addressing hash table; rows that are done leave the matrix. Pieces longer than ``MATRIX_BYTES`` would cost
rounds times width, so they merge the same pairs in the same order from a heap.

Defined results: a null text is an empty one, with no ids and empty decoded bytes; texts are never cut; repeated rows
are encoded each for itself; extra columns pass through and columns of the output's names are replaced.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import Passed, piece_splitter, ship, slices, tidy

#: Pieces up to this many bytes go through the matrices.
MATRIX_BYTES = 256
#: Bound of a worker's cache: pieces, and the bytes of one piece that may stay.
CACHE_PIECES, CACHE_BYTES = 300_000, 64
_FREE = np.int32(2**31 - 1)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Pair of ids -> id of their merger, by open addressing with linear probing."""

    def __init__(self, pairs: np.ndarray, merged: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(pairs)) * 3))))
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, _FREE, np.int32)
        left = np.arange(len(pairs))
        slot = self._home(pairs)
        while len(left):
            free = self.keys[slot] < 0
            first = np.zeros(len(left), bool)
            at = np.flatnonzero(free)
            first[at[np.unique(slot[at], return_index=True)[1]]] = True
            self.keys[slot[first]] = pairs[left[first]]
            self.values[slot[first]] = merged[left[first]]
            left, slot = left[~first], (slot[~first] + 1) & self.mask

    def _home(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.astype(np.uint64) * _GOLDEN) >> self.shift).astype(np.int64)

    def look(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merged ids of pairs, or ``_FREE`` where a pair does not merge or an id is negative (padding)."""
        out = np.full(a.shape, _FREE, np.int32)
        at = np.flatnonzero((a >= 0) & (b >= 0))
        pairs = (a.ravel()[at].astype(np.int64) << 32) | b.ravel()[at]
        slot, flat = self._home(pairs), out.ravel()
        while len(at):
            keys = self.keys[slot]
            hit = keys == pairs
            flat[at[hit]] = self.values[slot[hit]]
            on = ~hit & (keys >= 0)
            at, pairs, slot = at[on], pairs[on], (slot[on] + 1) & self.mask
        return flat.reshape(a.shape)


class ByteBpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.split = piece_splitter(pattern)
        self.ranks = ranks
        self.bytes_of = dict(map(reversed, ranks.items()))
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        found = [
            (ranks[t[:k]], ranks[t[k:]], r)
            for t, r in ranks.items()
            for k in range(1, len(t))
            if t[:k] in ranks and t[k:] in ranks
        ]
        a, b, merged = np.array(found, np.int64).reshape(-1, 3).T
        self.pairs = PairTable((a << 32) | b, merged.astype(np.int32))
        self.cache: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str, pattern: str) -> ByteBpe:
        with open(path, "rb") as f:
            return cls({base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}, pattern)

    def _rows(self, pieces: list[bytes], width: int) -> np.ndarray:
        """Ids of pieces of up to ``width`` bytes, a row each, padded with -1."""
        n = len(pieces)
        lens = np.fromiter(map(len, pieces), np.int64, n)
        flat = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        cols = np.arange(width)
        ids = np.full((n, width), -1, np.int32)
        ids[cols < lens[:, None]] = flat
        rank = self.pairs.look(ids[:, :-1], ids[:, 1:])
        done, order, live = np.full((n, width), -1, np.int32), np.arange(n), lens.copy()
        while len(order):
            best = rank.argmin(1)
            row = np.arange(len(order))
            over = rank[row, best] == _FREE
            if over.any():  # compaction: rows without a pair leave
                done[order[over], : ids.shape[1]] = ids[over]
                keep = ~over
                order, ids, rank, best, live = order[keep], ids[keep], rank[keep], best[keep], live[keep]
                row = np.arange(len(order))
                if not len(order):
                    break
                wide = int(live.max())
                if wide < ids.shape[1]:
                    ids, rank = ids[:, :wide], rank[:, : wide - 1]
            merged = rank[row, best]
            at = np.arange(ids.shape[1])
            shifted = np.concatenate([ids[:, 1:], np.full((len(order), 1), -1, np.int32)], 1)
            ids = np.where(at[None, :] > best[:, None], shifted, ids)
            ids[row, best] = merged
            at = at[:-1]
            shifted = np.concatenate([rank[:, 1:], np.full((len(order), 1), _FREE, np.int32)], 1)
            rank = np.where(at[None, :] > best[:, None], shifted, rank)
            live = live - 1
            right = np.minimum(best + 1, ids.shape[1] - 1)
            rank[row, best] = np.where(best + 1 < ids.shape[1], self.pairs.look(ids[row, best], ids[row, right]), _FREE)
            before = np.flatnonzero(best > 0)
            rank[before, best[before] - 1] = self.pairs.look(ids[before, best[before] - 1], ids[before, best[before]])
        return done

    def _matrix(self, pieces: list[bytes], width: int) -> list[bytes]:
        done = self._rows(pieces, width)
        size = (done >= 0).sum(1) * 4
        raw = np.ascontiguousarray(done.astype("<u4")).view(np.uint8).reshape(len(pieces), -1)
        return [r[:k].tobytes() for r, k in zip(raw, size.tolist(), strict=True)]

    def _heap(self, piece: bytes) -> bytes:
        """The same merges for one long piece, of order n log n."""
        ids = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        nxt, prev, ranks, bytes_of = list(range(1, n + 1)), list(range(-1, n - 1)), self.ranks, self.bytes_of
        look = lambda i, j: ranks.get(bytes_of[ids[i]] + bytes_of[ids[j]])
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := look(i, i + 1)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j], nxt[i] = r, -1, nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
                if (q := look(i, nxt[i])) is not None:
                    heapq.heappush(heap, (q, i, r, ids[nxt[i]]))
            if prev[i] >= 0 and (q := look(prev[i], i)) is not None:
                heapq.heappush(heap, (q, prev[i], ids[prev[i]], r))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def encode_pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of distinct pieces."""
        raw = [p.encode() for p in pieces]
        out: dict[str, bytes] = {}
        lens = np.fromiter(map(len, raw), np.int64, len(raw))
        low, width = 0, 4
        while low < MATRIX_BYTES and len(raw):
            at = np.flatnonzero((lens > low) & (lens <= width))
            step = max(1, (1 << 20) // width)
            for k in range(0, len(at), step):
                part = at[k : k + step].tolist()
                out.update(zip((pieces[i] for i in part), self._matrix([raw[i] for i in part], width), strict=True))
            low, width = width, width * 2
        for i in np.flatnonzero(lens > MATRIX_BYTES).tolist():
            out[pieces[i]] = self._heap(raw[i])
        return out

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text, little-endian unsigned 32-bit."""
        split = [self.split(t) for t in texts]
        distinct = set(chain.from_iterable(split))
        missing = [p for p in distinct if p not in self.cache]
        if len(self.cache) + len(missing) > CACHE_PIECES:
            self.cache, missing = {}, list(distinct)
        found = self.encode_pieces(missing)
        self.cache.update(found)
        get = self.cache.__getitem__
        for pieces in split:
            yield b"".join(map(get, pieces))
        for p in missing:
            if len(p) > CACHE_BYTES:
                self.cache.pop(p, None)

    def decode(self, ids: bytes) -> bytes:
        """The bytes behind ids; an id that no token has raises KeyError."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_LOADED: dict[tuple[str, str], ByteBpe] = {}


def coder(path: str, pattern: str) -> ByteBpe:
    """The worker's own coder of a rank file, kept between batches and tasks."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = ByteBpe.load(path, pattern)
    return _LOADED[path, pattern]


def _mapped(df: DataFrame, source: str, keep_source: bool, made: tuple[str, ...], step) -> DataFrame:
    ship(df.sparkSession)
    p = Passed(df, made, () if keep_source else (source,))
    read = p.frame.select(*p.kept, p[source].alias("source"))
    schema = T.StructType([*read.schema[:-1], *[T.StructField(k, T.BinaryType()) for k in made]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.num_columns - 1
            empty = b"" if pa.types.is_binary(batch.column(last).type) else ""
            values = [empty if v is None else v for v in batch.column(last).to_pylist()]
            for a, b in slices(values):
                cols = [batch.column(k).slice(a, b - a) for k in range(last)]
                cols += [pa.array(x, pa.binary()) for x in step(values[a:b])]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return read.mapInArrow(tidy(run), schema).select(*p.back, *made)


def bpe_encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep_text: bool = False) -> DataFrame:
    """``df`` with ``ids``: the text's token ids as little-endian unsigned 32-bit integers; ``text`` goes unless kept."""
    return _mapped(df, text, keep_text, ("ids",), lambda xs: [list(coder(ranks_path, pattern).encode(xs))])


def bpe_decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """``df`` with ``decoded``: the bytes behind its ids."""
    return _mapped(df, ids, True, ("decoded",), lambda xs: [[coder(ranks_path, pattern).decode(x) for x in xs]])


def bpe_round_trip(df: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """``df`` without its text, with ``ids`` and, made from those ids, ``decoded``, in one pass."""

    def both(texts: list[str]):
        own = coder(ranks_path, pattern)
        ids = list(own.encode(texts))
        return [ids, [own.decode(x) for x in ids]]

    return _mapped(df, text, False, ("ids", "decoded"), both)
