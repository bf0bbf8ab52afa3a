import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm.search import top_k
from tidemark.llm.simhash import BkTree, components, differing_bits, distances, simhash_components, simhash_dedup


def fp(text, n=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w)] if len(w) < n else [b" ".join(w[k : k + n]) for k in range(len(w) - n + 1)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, radius=2):
    fps = [fp(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    best = {}
    for g, r in zip(group, rows, strict=True):
        if r[0] is not None:
            best[g] = min(best.get(g, r[0]), r[0])
    return sorted(str((r[0], f"{f:016x}", best.get(g))) for r, f, g in zip(rows, fps, group, strict=True))


def test_components_of_documents(docs, rows, nothing):
    got = simhash_components(docs).select("doc_id", F.lower(F.hex("fp")), "component_id")
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(rows)
    assert simhash_components(nothing).count() == 0


@pytest.mark.parametrize("radius", [0, 2, 9])
def test_tree_finds_all_within_the_radius(radius):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, (300, 2), dtype=np.uint64)
    x[100:200] = x[:100] ^ (np.uint64(1) << rng.integers(0, 60, (100, 2)).astype(np.uint64))
    found = {(int(a), int(b)) for q, n in BkTree(x).near(x, radius) for a, b in zip(q, n, strict=True)}
    want = {(i, j) for i in range(300) for j in range(300) if distances(x[i : i + 1], x[j : j + 1])[0] <= radius}
    assert found == want


def test_tree_children_are_keyed_by_distance():
    x = np.random.default_rng(2).integers(0, 2**63, (200, 1), dtype=np.uint64)
    t = BkTree(x)
    assert len(t.edges) == 199 and len(np.unique(t.edges)) == 199
    for e, k in zip(t.edges, t.kids, strict=True):
        assert distances(x[k : k + 1], x[e // 1024 : e // 1024 + 1])[0] == e % 1024


def test_small_pieces_lose_no_link(spark, monkeypatch):
    from tidemark.llm import simhash
    from tidemark.llm.simhash import block_shards, near_links

    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 2**62))
    names = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 40, (60, 2))})
    df = spark.createDataFrame([(n, bytearray(n.to_bytes(8, "big"))) for n in names], "node long, fp binary")
    for size, marks in ((4, 64), (4, 2), (4, 0), (1000, 64)):
        monkeypatch.setattr(simhash, "LANDMARKS", marks)
        links = near_links(df, block_shards(2), 2, size)
        roots = {r["node"]: r["root"] for r in components(links).collect()}
        group = {n: n for n in names}
        for i in names:
            for j in names:
                if bin(i ^ j).count("1") <= 2 and group[i] != group[j]:
                    a, b = sorted((group[i], group[j]))
                    group = {k: a if g == b else g for k, g in group.items()}
        smallest = {}
        for n, g in group.items():
            smallest[g] = min(smallest.get(g, n), n)
        assert all(roots.get(n, n) == smallest[g] for n, g in group.items())


def test_long_chains_settle(spark):
    chain = spark.range(1, 400).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["root"] for r in components(chain).collect()} == {1}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_dedup_keeps_one_of_each_group(docs, rows, nothing):
    kept = simhash_dedup(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(200) == 1 and not {*range(201, 212), *range(300, 306)} & set(ids)
    assert {*range(60)} <= set(ids) and ids.count(3) == 1
    assert sum(i in (100, 101, 102, None) for i in ids) == 2  # texts without words are one group; one text has no id
    assert simhash_dedup(nothing).count() == 0


def test_repeats_of_a_passage_do_not_part_near_duplicates(spark):
    rng = np.random.default_rng(11)
    rows = []
    for k, times in enumerate((10, 15, 20, 25)):
        words = [f"w{k}x{x}" for x in rng.integers(0, 5_000, 700)]
        said = [f"s{k}y{j}" for j in range(10)]
        edited = list(words)
        edited[350] = "edited"
        rows += [(2 * k, " ".join([*words, *said])), (2 * k + 1, " ".join([*edited, *said * times]))]
    for (_, a), (_, b) in zip(rows[::2], rows[1::2], strict=True):
        x, y = ({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
        assert len(x & y) >= 0.95 * len(x | y)
    kept = simhash_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 4, 6]


def test_pieces_bounded_by_bytes_lose_nothing(docs, monkeypatch):
    import tidemark.llm.simhash as S

    whole = sorted(str(r["doc_id"]) for r in simhash_dedup(docs).collect())
    monkeypatch.setattr(S, "SHARD_BYTES", 3_000)
    assert sorted(str(r["doc_id"]) for r in simhash_dedup(docs).collect()) == whole


def test_passages_in_common_rarely_share_a_band():
    from tidemark.llm.simhash import BANDS, band_keys

    rng = np.random.default_rng(12)
    passage = rng.integers(0, 2**63, 46, dtype=np.uint64)
    texts = [np.unique(np.r_[passage, rng.integers(0, 2**63, 300, dtype=np.uint64)]) for _ in range(200)]
    keys = [band_keys(t) for t in texts]
    assert all(len(k) == BANDS for k in keys) and band_keys(texts[0][:0]) == []
    met = sum(bool(set(keys[i]) & set(keys[j])) for i in range(200) for j in range(i))
    assert met < 0.1 * 200 * 199 / 2
    lost = 0
    for _ in range(500):
        every = rng.integers(0, 2**63, 1_000, dtype=np.uint64)
        lost += not set(band_keys(every[:900])) & set(band_keys(every[100:]))  # similarity 0.8
    assert lost <= 2


def test_bits_of_a_similarity():
    assert differing_bits(1.0, 64) == 0 and 36 <= differing_bits(0.8, 256) <= 40


def naive(vectors, k):
    ok = [(i, v) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    q = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in ok]
    out = []
    for i, v in sorted({(i, tuple(v)) for i, v in q if i % 50 == 0}):
        score = lambda w: min(max(sum(a * b for a, b in zip(v, w, strict=True)), -(2**63)), 2**63 - 1)  # noqa: B023, E731
        best = sorted((-score(w), j) for j, w in q if j != i and len(w) == len(v))[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("case", ["random", "lengths", "ties", "edge", "large", "huge"])
def test_search_is_exact(spark, case):
    rng = np.random.default_rng(4)
    n = 260
    v = rng.normal(size=(n, 8)).astype(np.float32)
    if case == "lengths":
        v *= rng.lognormal(0, 1.5, (n, 1)).astype(np.float32)
    if case == "ties":
        v = np.round(v)
        v[50:200] = v[50]
    if case == "large":
        v *= np.float32(2.0**20)
    if case == "huge":  # components from 2**54 on, and products beyond a long
        v[::7] *= np.float32(2.0**53)
        v[3] = np.float32(2.0**54)
        v[11] *= np.float32(2.0**90)
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    if case == "edge":
        rows = rows[:55] + [(60, None), (61, [1.0, None]), (62, [float("nan")] * 8), (63, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (64, [1.0, 2.0]), (100, [3.0, -1.0]), (65, [0.0] * 8), (3, rows[3][1]), (50, rows[50][1]), (66, []), (150, [1e30] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = top_k(df, F.col("vec_id") % 50 == 0, k=5, range_rows=60)
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == naive(rows, 5)


def test_search_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert top_k(df, F.col("vec_id") % 50 == 0).count() == 0


def test_search_in_buckets_prunes_nothing_it_needs(spark, monkeypatch):
    import tidemark.llm.search as S

    monkeypatch.setattr(S, "SEEDS", 20)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(600, 6)).astype(np.float32)
    v[300:] = v[:300] + rng.normal(scale=0.05, size=(300, 6)).astype(np.float32)
    asked = S.Asked(np.arange(600)[::50], np.floor(256 * v.astype(float))[::50], 3)
    q = np.floor(256 * v.astype(float))
    length = np.sqrt((q.astype(float) ** 2).sum(1))
    by = np.argsort(-length)
    for s in range(0, 600, 40):
        at = by[s : s + 40]
        asked.scan(S.Bucket(at, q[at], length[at]))
    row, score, vec = asked.best
    for r in range(len(asked.ids)):
        want = sorted((-int(q[asked.ids[r]] @ q[j]), j) for j in range(600) if j != asked.ids[r])[:3]
        assert [(-int(s), int(j)) for s, j in zip(score[row == r], vec[row == r], strict=True)] == want


def test_exact_similarities_of_many_pairs():
    from tidemark.llm.simhash import ShingleSets

    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint32)) for _ in range(40)]
    a, b = (x.ravel() for x in np.meshgrid(np.arange(40), np.arange(40)))
    want = np.array([len(set(sets[i]) & set(sets[j])) >= 0.4 * len(set(sets[i]) | set(sets[j])) for i, j in zip(a, b, strict=True)])
    own = ShingleSets(sets)
    own.CELLS = 500
    assert (own.similar(a, b, 0.4) == want).all()
    assert (own.similar(a[:50], b[:50], 0.4) == want[:50]).all()


def test_row_filter_misses_nothing(spark):
    from tidemark.llm.common import in_key_filter, key_filter

    packed = key_filter(spark.range(0, 3000, 3), "id", 1 << 16)
    assert in_key_filter(packed, np.arange(0, 3000, 3)).all()
    assert in_key_filter(packed, np.arange(10**6, 10**6 + 1000)).mean() < 0.05
