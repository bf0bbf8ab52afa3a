import random

import numpy as np
import pytest

from tidemark.llm import whitening as W

NAN, INF = float("nan"), float("inf")


def vectors(n=400, dim=40, seed=4):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(dim, dim)) * np.geomspace(1, 1e-2, dim)
    return (rng.normal(size=(n, dim)) @ mix * 0.3 + rng.normal(size=dim)).astype(np.float32)


def plain(rows, components=32):
    """The contract with plain Python integers and a dense eigensolver."""
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in rows]
    n, dim = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(dim)]
    dev = [sum((n * r[j] - s[j]) ** 2 for j in range(dim)) for r in x]
    c = np.array([[(n * r[j] - s[j]) / n for j in range(dim)] for r in x])
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    k = min(components, dim)
    return n, dev, c @ v[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def frame(spark, rows, parts=5):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(parts)


@pytest.mark.parametrize("fan_in", [16, 2])
def test_against_plain_python(spark, monkeypatch, fan_in):
    """Also in rounds of two triangles, and in blocks of a few rows."""
    monkeypatch.setattr(W, "FAN_IN", fan_in)
    monkeypatch.setattr(W, "BLOCK", 17 if fan_in == 2 else 4_096)
    v = vectors()
    odd = [(9_001, None, 1), (9_002, [], 1), (9_003, [NAN] * 40, 1), (9_004, [0.5] * 39 + [None], 1), (9_005, [0.5] * 39 + [INF], None), (9_006, [0.5] * 39, 1), (9_007, [3e38] * 40, 1)]
    rows = [(i, [float(c) for c in r], i % 3) for i, r in enumerate(v)]
    rows += [(None, [float(c) for c in v[7]], None), (7, [float(c) for c in v[7]], 1)]
    n, dev, white, explained = plain([r[1] for r in rows])
    got = W.whiten(frame(spark, rows + odd, 9)).collect()
    assert len(got) == len(rows) * 32 and {r["n"] for r in got} == {n}
    by: dict = {}
    for r in got:
        by.setdefault((r["vec_id"], r["component"]), []).append(r)
    first: dict = {}
    for k, r in enumerate(rows):
        first.setdefault(r[0], k)
    sign = [np.sign(by[0, c + 1][0]["whitened"] * white[0, c]) for c in range(32)]
    for (i, c), same in by.items():
        k = first[i]
        assert len(same) == (2 if i == 7 else 1)
        for r in same:
            assert r["deviation"] == dev[k]
            assert r["whitened"] == pytest.approx(sign[c - 1] * white[k, c - 1], abs=1e-7)
            assert r["explained"] == pytest.approx(explained[c - 1], rel=1e-9)
            assert r["identity_error"] < 1e-9


def test_same_for_any_partitioning(spark):
    v = [(i, [float(c) for c in r], 0) for i, r in enumerate(vectors(300, 9))]
    a, b = ({(r["vec_id"], r["component"]): r for r in W.whiten(frame(spark, v, p)).collect()} for p in (1, 40))
    assert a.keys() == b.keys() and len(a) == 300 * 9
    assert all(a[k]["whitened"] == pytest.approx(b[k]["whitened"], abs=1e-9) and a[k]["deviation"] == b[k]["deviation"] for k in a)


def test_few_and_equal_rows(spark):
    assert W.whiten(frame(spark, [])).collect() == []
    assert W.whiten(frame(spark, [(1, None, 1), (2, [], 1), (3, [NAN], 1)])).collect() == []
    assert W.whiten(frame(spark, [(1, [1.0, 2.0], 1)])).collect() == []
    assert W.whiten(frame(spark, [(k, [1.0, 2.0], 1) for k in range(9)])).collect() == []
    got = W.whiten(frame(spark, [(k, [float(k), 2.0 * k, 5.0], 1) for k in range(9)])).collect()
    assert len(got) == 9 and {r["component"] for r in got} == {1} and got[0]["explained"] == pytest.approx(1.0)
    mean = sum(r["whitened"] for r in got)
    assert mean == pytest.approx(0, abs=1e-9) and sum(r["whitened"] ** 2 for r in got) == pytest.approx(9)
    tie = W.whiten(frame(spark, [(1, [1.0], 1), (2, [2.0], 1), (3, [1.0, 0.0], 1), (4, [0.0, 3.0], 1)])).collect()
    assert {r["vec_id"] for r in tie} == {3, 4}


def test_names_and_id_types(spark):
    rows = [(f"v{k}", [random.Random(7 * k + j).random() for j in range(3)], "e", 2) for k in range(20)]
    df = spark.createDataFrame(rows, "`my.id` string, `a vector` array<double>, x string, n int")
    got = W.whiten(df, "my.id", "a vector", components=2).collect()
    assert len(got) == 40 and {r["vec_id"] for r in got} == {r[0] for r in rows} and got[0]["n"] == 20


def test_deviations_beyond_a_long():
    own = W.Fit(3_000_000_000, [0, 3_000_000_000], np.array([2.0, 1.0]), np.eye(2), 2)
    assert own.deviations(np.array([[2, 1], [40, -7]])).tolist() == [min(36 * 10**18, W.LONG_MAX), W.LONG_MAX]
    assert own.deviations(np.array([[1, 1]])).tolist() == [9 * 10**18]


def test_jacobi_is_accurate_for_small_deviations():
    rng = np.random.default_rng(0)
    for d in (1, 2, 7, 64):
        q = np.linalg.qr(rng.normal(size=(d, d)))[0]
        want = np.geomspace(1, 1e-12, d)
        r = np.linalg.qr(rng.normal(size=(d, d)))[0] * want  # columns of falling length, then turned a little
        sigma, v = W.jacobi(r)
        assert np.allclose(sigma, want, rtol=1e-12) and np.allclose(v.T @ v, np.eye(d), atol=1e-12)
        sigma, v = W.jacobi(q @ np.diag(want) @ q.T)
        assert np.allclose(sigma[: d // 2 + 1], want[: d // 2 + 1], rtol=1e-6)
    assert W.jacobi(np.zeros((2, 3)))[0].tolist() == [0, 0, 0]
