"""SimHash near-dedup: fingerprints linked by BK-trees.

Distinct fingerprints only are searched, in shards. Two 64-bit fingerprints within a small ``radius`` agree on at least
one of ``radius + 1`` bit blocks, so each goes to the shard of each of its block values (`block_shards`). A similarity
of 0.8 leaves far too many differing bits for that; there a text goes to the shards of its min-hash bands, of which two
such texts share one but for 1 pair in ten thousand, while texts that only have a passage in common rarely do
(`band_shards`). A shard is searched by a BK-tree: children are keyed by their integer Hamming distance to the parent,
and a search follows only the edges within the radius of the distance at hand. A shard's trees are sent to all query
chunks of that shard and to no other task: all trees together have no size bound, so they do not pass through the
driver. A task returns a spanning forest of the links it finds, at most one row a fingerprint, and never all pairs.

A shard of more than ``SHARD_NODES`` fingerprints is first held against some ``LANDMARKS`` of its own, chunk by chunk.
What these links put into one component needs no further links within; only the rest meets all pieces of the shard. So
a large group of near copies costs time in proportion to its size, and no link is lost.

Components come from alternating large-star and small-star rounds on those rows, cut by checkpoints in the shared folder.
For a similarity the components of fingerprint links are candidates only: the shingle sets of such texts, and of no
others, are sent once to the task of their candidate component, where a tree again says which to compare, and links
need an exact Jaccard similarity.

Defined results: a null or empty text, or one without words, has fingerprint zero and links like any other; fewer words
than a shingle make one shingle of the whole; equal fingerprints are one node, so copies never make pairs; a null id
takes part but never names a component that has another id; an empty table gives an empty table; extra columns pass
through and columns of the output's names are replaced. Texts are whole at any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import Passed, durable, in_key_filter, key_filter, ship, tidy, written

#: Nodes of one BK-tree, and about so many bytes of their shingle sets.
SHARD_NODES, SHARD_BYTES = 8_192, 16 << 20
#: Fingerprints (about) of a large shard that all others are held against first, and salts of a join by shard.
LANDMARKS, JOIN_SALTS = 64, 8
#: Min-hash bands and rows: two sets of similarity 0.8 share no band with probability (1 - 0.8^3)^13 = 0.0001.
BANDS, ROWS = 13, 3
SEED = 42
#: Odd constants that turn one shingle hash into the hashes of further lanes of 64 bits.
LANE_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def shingle_hashes(text: bytes | None, n: int) -> np.ndarray:
    """XXH64 of the text's shingles of ``n`` words, repeats included; the whole sequence if it is shorter."""
    import xxhash

    words, h = (text or b"").lower().split(), xxhash.xxh64_intdigest
    if len(words) < n:
        return np.array([h(b" ".join(words), SEED)] if words else [], np.uint64)
    shingles = map(b" ".join, zip(*(words[k:] for k in range(n)), strict=False))
    return np.fromiter((h(s, SEED) for s in shingles), np.uint64, len(words) - n + 1)


def fingerprint(hashes: np.ndarray, lanes: int = 1) -> bytes:
    """The SimHash of shingle hashes, 64 bits a lane, the first lane big-endian in front: a bit is 1 if more than half
    of the hashes have it."""
    out = b""
    for lane in range(lanes):
        ones = np.zeros(64, np.int64)
        for k in range(0, len(hashes), 65_536):
            part = hashes[k : k + 65_536]
            if lane:
                part = (part ^ (part >> np.uint64(32))) * np.uint64(LANE_MULTIPLIERS[lane - 1])
                part ^= part >> np.uint64(29)
            ones += np.unpackbits(part.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
        out += np.packbits(2 * ones > len(hashes)).tobytes()
    return out


def band_keys(own: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> list[int]:
    """Min-hash band keys of distinct shingle hashes: for each band a hash of its number and of ``rows`` minima, each under
    an own multiplication of the hashes. Without shingles there are none."""
    import xxhash

    if not len(own):
        return []
    rng = np.random.default_rng(SEED)
    times = rng.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(bands * rows, np.uint64(2**64 - 1))
    for k in range(0, len(own), 16_384):
        mixed = own[k : k + 16_384] ^ (own[k : k + 16_384] >> np.uint64(31))
        least = np.minimum(least, (mixed[None, :] * times[:, None]).min(1))
    found = least.reshape(bands, rows)
    return [xxhash.xxh64_intdigest(found[k].tobytes(), k) - 2**63 for k in range(bands)]


def with_fingerprints(docs: DataFrame, text: str, words: int, lanes: int = 1, bands: int = 0) -> DataFrame:
    """``docs`` without its text, with ``fp`` (binary). With ``bands`` the fingerprint is of distinct shingles, as bounds from
    set similarities need, and there are ``set_id`` (a 128-bit digest of the set), ``bands`` (keys) and ``bytes`` (of the
    set as 32-bit hashes); else repeats count."""
    ship(docs.sparkSession)
    p = Passed(docs, ("fp", "set_id", "bands", "bytes") if bands else ("fp",), (text,))
    read = p.frame.select(*p.kept, p[text].cast("binary").alias("text"))
    made = [T.StructField("fp", T.BinaryType())]
    if bands:
        made += [T.StructField("set_id", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("bytes", T.LongType())]
    schema = T.StructType([*read.schema[:-1], *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            last = batch.num_columns - 1
            fps, ids, keys, held = [], [], [], []
            for t in batch.column(last).to_pylist():
                hashes = shingle_hashes(t, words)
                if bands:
                    hashes = np.unique(hashes)
                    ids.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                    keys.append(band_keys(hashes, bands))
                    held.append(4 * len(hashes))
                fps.append(fingerprint(hashes, lanes))
            cols = [pa.array(fps, pa.binary())]
            if bands:
                cols += [pa.array(ids, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(held, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], *cols], names=schema.names)

    return read.mapInArrow(tidy(run), schema).select(*p.back, *[f.name for f in made])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints, a row of 64-bit lanes each."""
    return np.bitwise_count(a ^ b).sum(1, dtype=np.int64)


class BkTree:
    """A BK-tree over fingerprints, built and searched level by level.

    The tree is the one that inserting the fingerprints in order gives. ``edges`` holds ``parent * 1024 + distance`` in
    ascending order, so a node's children within a range of distances are neighbours there.
    """

    def __init__(self, fps: np.ndarray):
        self.fps = fps
        n = len(fps)
        edges, kids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        left, parent = np.arange(1, n), np.zeros(max(0, n - 1), np.int64)
        while len(left):
            d = distances(fps[left], fps[parent])
            keys, first, back = np.unique(parent * 1024 + d, return_index=True, return_inverse=True)
            edges.append(keys)
            kids.append(left[first])
            parent = left[first][back]
            stay = np.ones(len(left), bool)
            stay[first] = False
            left, parent = left[stay], parent[stay]
        self.edges, self.kids = np.concatenate(edges), np.concatenate(kids)
        by = np.argsort(self.edges)
        self.edges, self.kids = self.edges[by], self.kids[by]

    def near(self, queries: np.ndarray, radius: int, chunk: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, node) within the radius, some queries at a time."""
        for start in range(0, len(queries) if len(self.fps) else 0, chunk):
            q = np.arange(start, min(start + chunk, len(queries)))
            node = np.zeros(len(q), np.int64)
            while len(q):
                d = distances(queries[q], self.fps[node])
                hit = d <= radius
                if hit.any():
                    yield q[hit], node[hit]
                low = np.searchsorted(self.edges, node * 1024 + np.maximum(d - radius, 0))
                high = np.searchsorted(self.edges, node * 1024 + d + radius, side="right")
                n = high - low
                at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
                q, node = np.repeat(q, n), self.kids[at]


def joined(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the smallest index of its set) after the sets of all pairs are joined."""
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return labels
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while (labels[labels] != labels).any():
            labels = labels[labels]


class ShingleSets:
    """Shingle sets of a shard's rows, for exact similarities. Shingles that one row only has count for sizes alone."""

    #: Pairs up to which sets are held against each other one by one; cells of a dense part.
    FEW, CELLS = 64, 1 << 22

    def __init__(self, sets: list[np.ndarray]):
        self.sets, self.sizes = sets, np.array([len(s) for s in sets])
        self.shared = None

    def _index(self) -> None:
        """Rows and columns of the shingles that several rows have, in order of column; one sort, and 32 bits a number."""
        flat = np.concatenate(self.sets)
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        again = flat[1:] == flat[:-1]
        on = np.zeros(len(flat), bool)
        on[1:] |= again
        on[:-1] |= again
        flat = flat[on]
        first = np.ones(len(flat), bool)
        first[1:] = flat[1:] != flat[:-1]
        row = np.repeat(np.arange(len(self.sets), dtype=np.int32), self.sizes)[order[on]]
        self.shared, self.width = (row, np.cumsum(first, dtype=np.int32) - 1), int(first.sum())

    def similar(self, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
        """Which pairs of rows are at least so similar."""
        if len(a) <= self.FEW:
            both = np.array([len(np.intersect1d(self.sets[i], self.sets[j], assume_unique=True)) for i, j in zip(a, b, strict=True)])
        else:
            if self.shared is None:
                self._index()
            (left, la), (right, lb) = (np.unique(x, return_inverse=True) for x in (a, b))
            total = np.zeros((len(left), len(right)), np.float32)
            place = np.full(len(self.sets), -1, np.int32)
            rows, cols = self.shared
            step = max(1, self.CELLS // (len(left) + len(right)))
            for low in range(0, self.width, step):
                span = slice(*np.searchsorted(cols, [low, low + step]))
                parts = []
                for own in (left, right):
                    place[:] = -1
                    place[own] = np.arange(len(own))
                    at = place[rows[span]]
                    m = np.zeros((len(own), min(step, self.width - low)), np.float32)
                    m[at[at >= 0], cols[span][at >= 0] - low] = 1
                    parts.append(m)
                total += parts[0] @ parts[1].T
            both = total[la, lb]
        return both >= least * (self.sizes[a] + self.sizes[b] - both) - 1e-6


def shard_links(tree: np.ndarray, queries: np.ndarray, radius: int, sets: ShingleSets | None = None, similarity: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as index pairs over the tree's rows followed by the queries'; without queries, of the tree
    with itself. ``sets`` (of the rows in that order) verify what the search finds."""
    n = len(tree)
    labels = np.arange(n + len(queries))
    for q, node in BkTree(tree).near(queries if len(queries) else tree, radius):
        q = q + n if len(queries) else q
        if sets is not None:
            open_ = labels[q] != labels[node]
            q, node = q[open_], node[open_]
            yes = sets.similar(q, node, similarity) if len(q) else np.zeros(0, bool)
            q, node = q[yes], node[yes]
        labels = joined(labels, q, node)
    moved = np.flatnonzero(labels != np.arange(len(labels)))
    return moved, labels[moved]


def block_shards(radius: int):
    """Shards of a 64-bit fingerprint: its value in each of ``radius + 1`` blocks of bits."""
    out = []
    for k in range(radius + 1):
        low, high = 64 * k // (radius + 1), 64 * (k + 1) // (radius + 1)
        value = F.shiftrightunsigned(F.col("node"), low).bitwiseAND(F.lit((1 << (high - low)) - 1))
        out.append(F.struct(F.lit(k).alias("k"), value.alias("v")))
    return F.array(*out)


def band_shards():
    """Shards of a text: its min-hash bands."""
    return F.transform("bands", lambda v, k: F.struct(k.alias("k"), v.alias("v")))


def _number(of: int):
    return F.pmod(F.xxhash64("node", F.lit(of)), F.lit(1 << 40))


def near_links(nodes: DataFrame, shards, radius: int, shard_nodes: int | None = None, similarity: float | None = None) -> DataFrame:
    """Links ``(a, b)`` between nodes (columns ``node, fp``, distinct) that put those of one shard within ``radius``
    differing bits of each other, and (if given) of that similarity by their sets ``sh``, into the same component."""
    most = shard_nodes or SHARD_NODES
    sh = F.col("sh") if similarity is not None else F.lit(None).cast("binary")
    salt = F.pmod(F.xxhash64("node", F.lit(3)), F.lit(JOIN_SALTS)).cast("int")
    keyed = nodes.select("node", "fp", sh.alias("sh"), F.explode(shards).alias("s")).select("node", "fp", "sh", "s.k", "s.v", salt.alias("salt"))
    held = F.sum(F.coalesce(F.octet_length("sh"), F.lit(0)))
    sizes = keyed.groupBy("k", "v").agg(F.count("*").alias("n"), held.alias("bytes")).where("n > 1")
    m = F.greatest(F.ceil(F.col("n") / most), F.ceil(F.col("bytes") / SHARD_BYTES)).cast("int").alias("m")
    # A shard's rows meet its size in several tasks.
    sizes = durable(sizes.select("k", "v", "n", m, F.explode(F.sequence(F.lit(0), F.lit(JOIN_SALTS - 1))).alias("salt")))
    placed = keyed.join(sizes, ["k", "v", "salt"]).drop("salt")
    cells = ["k", "v", "t", "q"]

    def cell(rows: DataFrame, t, q, tree: bool) -> DataFrame:
        return rows.select("k", "v", t.cast("int").alias("t"), q.cast("int").alias("q"), F.lit(tree).alias("tree"), "node", "fp", "sh")

    zero = F.lit(0)
    small = tree_links(cell(placed.where("m = 1"), zero, zero, True), cells, radius, similarity)
    if not sizes.where("m > 1").limit(1).count():
        return small
    large = written(placed.where("m > 1"))
    every = F.explode(F.sequence(zero, F.col("m") - 1)).alias("q")
    marks = large.where(F.pmod(F.xxhash64("node", F.lit(4)), F.col("n")) < LANDMARKS).select("*", every)
    first = durable(
        tree_links(cell(marks, zero, F.col("q"), True).union(cell(large, zero, F.pmod(_number(1), F.col("m")), False)), cells, radius, similarity)
    )
    # The largest component of a shard is done with itself; all others meet the whole shard.
    rooted = large.select("k", "v", "node").join(components(first), "node", "left").select("k", "v", "node", F.coalesce("root", "node").alias("root"))
    groups = rooted.groupBy("k", "v", "root").agg(F.count("*").alias("c"))
    done = groups.groupBy("k", "v").agg(F.max_by("root", F.struct("c", "root")).alias("done"))
    rest = durable(rooted.join(F.broadcast(done) if sizes.where("m > 1").count() <= 100_000 else done, ["k", "v"]).where("root <> done").select("k", "v", "node"))
    counts = rest.groupBy("k", "v").agg(F.ceil(F.count("*") / most).cast("int").alias("chunks"))
    few = F.broadcast(counts) if counts.count() <= 100_000 else counts
    left = large.join(rest, ["k", "v", "node"], "left_semi").join(few, ["k", "v"])
    trees = large.join(few, ["k", "v"]).select("*", F.explode(F.sequence(zero, F.col("chunks") - 1)).alias("q"))
    pieces = left.select("*", F.explode(F.sequence(zero, F.col("m") - 1)).alias("t"))
    meet = cell(trees, F.pmod(_number(2), F.col("m")), F.col("q"), True).union(cell(pieces, F.col("t"), F.pmod(_number(1), F.col("chunks")), False))
    return small.union(first).union(tree_links(meet, cells, radius, similarity))


def tree_links(rows: DataFrame, cells: list[str], radius: int, similarity: float | None) -> DataFrame:
    """Links within cells: of the rows marked ``tree`` with the others, or with themselves in a cell that has no others."""
    ship(rows.sparkSession)
    ready = rows.repartition(*cells).sortWithinPartitions(*cells, "tree", "node")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, ...] | None = None
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def groups(cols: tuple[np.ndarray, ...], last: bool) -> tuple[np.ndarray, ...]:
            """Works off whole cells; the last one waits for more rows and is returned."""
            new = np.zeros(len(cols[0]), bool)
            for c in cols[:4]:
                new[1:] |= c[1:] != c[:-1]
            bounds = [0, *np.flatnonzero(new).tolist(), len(new)]
            for a, b in zip(bounds[:-1], bounds[1:] if last else bounds[1:-1], strict=False):
                side = cols[4][a:b]
                if b - a > 1:
                    order = np.r_[np.flatnonzero(side), np.flatnonzero(~side)] + a
                    names, fps, n = cols[5][order], cols[6][order], int(side.sum())
                    if b - a == 2 and distances(fps[:1], fps[1:])[0] > radius:  # most shards
                        continue
                    sets = None if similarity is None else ShingleSets([np.frombuffer(x, np.uint32) for x in cols[7][order]])
                    x, y = shard_links(fps[:n], fps[n:], radius, sets, similarity or 0.0)
                    found.append((names[x], names[y]))
            return tuple(c[bounds[-2] :] for c in cols)

        def out() -> pa.RecordBatch:
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            if batch.num_rows:
                cols = tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in range(6))
                sets = np.empty(batch.num_rows, object)
                sets[:] = batch.column(7).to_pylist()
                cols = (*cols, np.frombuffer(b"".join(batch.column(6).to_pylist()), np.uint64).reshape(batch.num_rows, -1), sets)
                held = groups(cols if held is None else tuple(map(np.concatenate, zip(held, cols, strict=True))), False)
            if len(found) > 10_000:
                yield out()
        if held is not None:
            groups(held, True)
        if found:
            yield out()

    return ready.mapInArrow(tidy(search), "a long, b long").where("a <> b")


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """``(node, root)`` of every linked node, root being the smallest node of its component: alternating star rounds
    until no link changes."""
    now = durable(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = None
    for _ in range(most):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Large star: larger neighbours of u hang on the smallest of u and its neighbours.
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: smaller neighbours of u, and u itself, hang on the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u").select(F.col("v").alias("x"), "m").union(least.select(F.col("u").alias("x"), "m"))
            .where("x <> m").select(F.col("x").alias("u"), F.col("m").alias("v")).distinct()
        )
        now = durable(small)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def simhash_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 3, radius: int = 2) -> DataFrame:
    """``docs`` without its text, with ``fp`` (8 bytes) and ``component_id``: the smallest id that links reach, where
    64-bit fingerprints link at ``radius`` or fewer differing bits."""
    p = Passed(docs, ("fp", "component_id"), (text,))
    thin = with_fingerprints(p.frame.select(*p.kept, p[doc_id].alias("id"), p[text].alias("text")), "text", words)
    thin = written(thin.withColumn("node", F.conv(F.hex("fp"), 16, -10).cast("long")))
    nodes = written(thin.groupBy("node", "fp").agg(F.min("id").alias("least")))
    rooted = nodes.join(components(near_links(nodes, block_shards(radius), radius)), "node", "left")
    rooted = rooted.select("node", "least", F.coalesce("root", "node").alias("root"))
    labels = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("best")), "root").select("node", "best")
    return thin.join(labels, "node").select(*p.back, "fp", F.col("best").alias("component_id"))


def differing_bits(similarity: float, bits: int, deviations: float = 0.0) -> int:
    """Bits in which SimHashes of ``bits`` bits differ at a Jaccard similarity of shingle sets, with so many standard
    deviations to spare: sets of one size at Jaccard similarity s have the cosine 2 s / (1 + s), and a bit differs with
    probability angle / pi."""
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(np.floor(bits * p + deviations * np.sqrt(bits * p * (1 - p))))


def shingle_sets(texts: DataFrame, wanted: DataFrame, row: str, text: str, words: int) -> DataFrame:
    """``(row, sh)``: sorted distinct shingle hashes (32 bits each) of the texts whose row number ``wanted`` has. A filter of
    those numbers is broadcast, so other texts cost a look-up; what passes it by chance is for the caller's join."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(key_filter(wanted, row))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_numpy()
            at = np.flatnonzero(in_key_filter(shared.value, rows))
            own = batch.column(1).take(pa.array(at)).to_pylist()
            made = [np.unique(shingle_hashes(t, words).astype(np.uint32)).tobytes() for t in own]
            yield pa.RecordBatch.from_arrays([pa.array(rows[at]), pa.array(made, pa.binary())], names=["row", "sh"])

    return texts.select(row, F.col(f"`{text}`").cast("binary").alias("t")).mapInArrow(tidy(run), "row long, sh binary")


def simhash_dedup(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 5, similarity: float = 0.8, lanes: int = 4, bands: int = BANDS
) -> DataFrame:
    """One row of each group of near duplicates, the one with the smallest id (nulls last; of equal ids the first read).

    Two texts link where the sets of their shingles of ``words`` words have a Jaccard similarity of at least
    ``similarity``; SimHashes of ``64 * lanes`` bits and four standard deviations of spare bits say which to look at.
    Rows without words are one group."""
    p = Passed(docs)
    radius = differing_bits(similarity, 64 * lanes, 4.0)
    full = written(p.frame.withColumn("row", F.monotonically_increasing_id()))
    key = F.struct(p[doc_id].isNull().alias("none"), p[doc_id].alias("id"), F.col("row"))
    thin = written(with_fingerprints(full.select(key.alias("at"), p[text].alias("text")), "text", words, lanes, bands))
    same = thin.groupBy("set_id").agg(F.min("at").alias("at"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    nodes = written(same.select(F.col("at.row").alias("node"), "at", "fp", "bands"))
    candidates = components(near_links(nodes.select("node", "fp", "bands"), band_shards(), radius))
    members = written(candidates.union(candidates.select(F.col("root").alias("node"), "root").distinct()))
    names = p.frame.columns
    sets = shingle_sets(full.select("row", F.col(names[p._place(text)]).alias("text")), members.select(F.col("node").alias("row")), "row", "text", words)
    some = members.join(nodes.select("node", "fp"), "node").join(sets.withColumnRenamed("row", "node"), "node")
    own = F.array(F.struct(F.lit(0).alias("k"), F.col("root").alias("v")))
    rooted = nodes.select("node", "at").join(components(near_links(some, own, radius, similarity=similarity)), "node", "left")
    kept = rooted.groupBy(F.coalesce("root", "node")).agg(F.min("at").alias("at")).select(F.col("at.row").alias("row"))
    gone = thin.select(F.col("at.row").alias("row")).join(kept, "row", "left_anti")
    return full.join(gone, "row", "left_anti").select(*p.back)
