"""Language identification by rank-order profiles.

A text becomes letters of lower case with single spaces between runs of letters, and its profile is its ``profile_size``
most frequent n-grams of 1 to ``MAX_N`` characters, ranked by count and, of ties, in code point order. Each language has
the profile of all its training texts together. The out-of-place distance adds, over the document's n-grams, the
difference of ranks, or ``profile_size`` for an n-gram the language does not have; the smallest distance wins, of ties
the first language in code point order. The score is 1 - distance / largest possible distance.

Training counts n-grams in the task first (bounded, then passed on), sums them by a shuffle, and keeps the most
frequent per language through per-slice top lists, so no language's n-grams meet in one task. Profiles are broadcast in
blocks of at most ``BLOCK_LANGUAGES`` languages, ``profile_size`` entries each; a text keeps the best of all blocks, so no
language is left out however many there are.

Defined results: a null text, or one without a letter, is ``und`` with score 0, and so is every text if nothing was
learned; rows with a null language or a null id are not learned from; a null id is not held out; texts are whole;
repeated rows count each for itself; extra columns pass through and columns of the output's names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import Passed, durable, ship, tidy

PROFILE_SIZE, MAX_N = 400, 3
#: Languages of one broadcast: about 6 KB each.
BLOCK_LANGUAGES = 4_096
#: Distinct n-grams a training task holds for all languages before it passes its counts on.
HELD_GRAMS = 500_000
UNKNOWN = "und"
#: Characters of a text that are counted at a time; n-grams across the seams are counted once.
_CHUNK = 1 << 20
_letters = None


def letters() -> np.ndarray:
    """For every code point whether it is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text, as packed code points that sort like the strings, and their counts."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    is_letter = letters()[code]
    if not is_letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = np.where(is_letter, code, 32)
    keep = np.ones(len(code), bool)
    keep[1:] = is_letter[1:] | is_letter[:-1]
    code = np.concatenate([[32], code[keep], [32]])
    if code[1] == 32:
        code = code[1:]
    if code[-2] == 32:
        code = code[:-1]
    parts = []
    for start in range(0, len(code), _CHUNK):
        own = code[start : start + _CHUNK + MAX_N - 1]
        n = min(_CHUNK, len(code) - start)
        one = own[:n] << 42
        two = one[: len(own) - 1] | (own[1 : n + 1] << 21)
        three = two[: len(own) - 2] | own[2 : n + 2]
        every = np.concatenate([one[own[:n] != 32], two, three])
        parts.append(np.unique(every, return_counts=True))
    if len(parts) == 1:
        return parts[0]
    keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(back, np.concatenate([c for _, c in parts])).astype(np.int64)


def profile(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams, best first."""
    if len(keys) > size:  # all that could be among them, ties included
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        at = np.flatnonzero(counts >= least)
        keys, counts = keys[at], counts[at]
    return keys[np.argsort(-counts, kind="stable")][:size]


class Profiles:
    """Language profiles as a sorted list of n-grams, each with the languages that have it and its ranks there."""

    def __init__(self, ranked: dict[str, list[int]], size: int):
        self.size, self.langs = size, sorted(ranked)
        gram = np.array([g for k in self.langs for g in ranked[k]], np.int64)
        lang = np.repeat(np.arange(len(self.langs), dtype=np.int32), [len(ranked[k]) for k in self.langs])
        rank = np.array([r for k in self.langs for r in range(len(ranked[k]))], np.int32)
        by = np.argsort(gram, kind="stable")
        self.lang, self.rank = lang[by], rank[by]
        self.keys, starts = np.unique(gram[by], return_index=True)
        self.ends = np.append(starts, len(gram))

    def distances(self, own: np.ndarray) -> np.ndarray:
        """The out-of-place distance of a document's profile to every language."""
        total = np.full(len(self.langs), self.size * len(own), np.int64)
        if len(self.keys) and len(own):
            at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
            mine = np.flatnonzero(self.keys[at] == own)
            first, n = self.ends[at[mine]], self.ends[at[mine] + 1] - self.ends[at[mine]]
            entry = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
            nearer = self.size - np.abs(self.rank[entry] - np.repeat(mine, n))
            total -= np.bincount(self.lang[entry], nearer, len(self.langs)).astype(np.int64)
        return total

    def predict(self, text: str | None) -> tuple[str, float]:
        own = profile(*grams(text), self.size) if text else np.zeros(0, np.int64)
        if not len(own) or not self.langs:
            return UNKNOWN, 0.0
        total = self.distances(own)
        best = int(total.argmin())
        return self.langs[best], float(1.0 - total[best] / (self.size * len(own)))


def learn(df: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE_SIZE) -> DataFrame:
    """``lang, grams``: the profiles, best first, of all rows whose language is not null."""
    ship(df.sparkSession)
    p = Passed(df)
    read = p.frame.select(p[lang].cast("string").alias("lang"), p[text].alias("t")).where("lang IS NOT NULL AND t IS NOT NULL")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        waiting = 0

        def summed() -> dict[str, tuple[np.ndarray, np.ndarray]]:
            out = {}
            for own, parts in held.items():
                keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                out[own] = keys, np.bincount(back, np.concatenate([c for _, c in parts])).astype(np.int64)
            return out

        def rows(own: str, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            cols = [pa.array([own] * len(keys), pa.string()), pa.array(keys), pa.array(counts)]
            return pa.RecordBatch.from_arrays(cols, names=["lang", "gram", "n"])

        for batch in batches:
            for own, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys, counts = grams(t)
                held.setdefault(own, []).append((keys, counts))
                waiting += len(keys)
                if waiting > 4 * HELD_GRAMS:
                    total = summed()
                    if (waiting := sum(len(k) for k, _ in total.values())) > HELD_GRAMS:
                        yield from (rows(k, *v) for k, v in total.items())
                        total, waiting = {}, 0
                    held = {k: [v] for k, v in total.items()}
        yield from (rows(k, *v) for k, v in summed().items())

    counts = read.mapInArrow(tidy(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = [F.col("n").desc(), F.col("gram")]
    slices = W.partitionBy("lang", F.pmod(F.xxhash64("gram"), F.lit(64))).orderBy(*best)
    few = counts.withColumn("r", F.row_number().over(slices)).where(F.col("r") <= size)
    top = few.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(*best))).where(F.col("r") <= size)
    listed = top.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("r", "gram"))).alias("g"))
    return durable(listed.select("lang", F.col("g.gram").alias("grams")))


def blocks(learned: DataFrame, size: int = PROFILE_SIZE, most: int = BLOCK_LANGUAGES) -> Iterator[Profiles]:
    """The learned profiles in blocks of at most ``most`` languages, in code point order; at least one block."""
    last = None
    while True:
        rest = learned if last is None else learned.where(F.col("lang") > F.lit(last))
        rows = rest.orderBy("lang").limit(most).collect()
        if rows or last is None:
            yield Profiles({row["lang"]: list(row["grams"]) for row in rows}, size)
        if len(rows) < most:
            return
        last = rows[-1]["lang"]


def train(df: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE_SIZE) -> list[Profiles]:
    """Profiles of all rows whose language is not null, in blocks."""
    return list(blocks(learn(df, text, lang, size), size))


def identify(docs: DataFrame, profiles: list[Profiles], text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``lang_pred`` and ``score``. Blocks are scored one after another in the same pass."""
    spark = docs.sparkSession
    ship(spark)
    shared = [spark.sparkContext.broadcast(p) for p in profiles]
    p = Passed(docs, ("lang_pred", "score"), (text,))
    read = p.frame.select(*p.kept, p[text].alias("text"))
    made = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    schema = T.StructType([*read.schema[:-1], *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.num_columns - 1
            owns = [profile(*grams(t), PROFILE_SIZE if not shared else shared[0].value.size) if t else () for t in batch.column(last).to_pylist()]
            best: list = [None] * len(owns)
            for block in shared:
                own = block.value
                for k, mine in enumerate(owns):
                    if len(mine) and own.langs:
                        total = own.distances(mine)
                        at = int(total.argmin())
                        score = float(1.0 - total[at] / (own.size * len(mine)))
                        if best[k] is None or score > best[k][1]:  # of ties the earlier block, so the first language
                            best[k] = own.langs[at], score
            best = [b or (UNKNOWN, 0.0) for b in best]
            cols = [pa.array([f[0] for f in best], pa.string()), pa.array([f[1] for f in best], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], *cols], names=schema.names)

    return read.mapInArrow(tidy(run), schema).select(*p.back, "lang_pred", "score")
