import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm.infill import Infill, infill, restore


def plain(doc_id, text, how=Infill()):
    """The contract in plain Python."""
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"{how.seed}{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(s in text for s in how.sentinels) or h[2] % 100 >= how.rate:
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b, c = ("".join(units[i:j]) for i, j in ((0, low), (low, high), (high, n)))
    p, s, m = how.sentinels
    spm = h[3] % 100 < how.suffix_first
    return n, "spm" if spm else "psm", len(a), len(b), s + c + p + a + m + b if spm else p + a + s + c + m + b


def test_against_plain_python(docs, rows):
    got = restore(infill(docs)).collect()
    want = sorted(((r[0], *plain(r[0], r[1])) for r in rows), key=repr)
    assert sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got), key=repr) == want
    assert all(r["restored"] == (r["text"] or "") for r in got)
    assert {"plain", "psm", "spm"} == {r["form"] for r in got}


ODD = ["<P>", "a<S>b", "x<M>", "<P", "<", "<<<S", "P>", ">", "a\nb\r\n", "\x00zero", "日本語🙂x", " ", "İ", "<P>a<S>b<M>c", "ab" * 50_000, "é" * 50_000]


def test_odd_texts_and_other_sentinels(spark):
    rows = [(i, t) for i, t in enumerate(t for t in ODD for _ in range(30))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for how in (Infill(), Infill(100, 50, "7:", ("<|fim_prefix|>", "<|fim_suffix|>", "<|fim_middle|>")), Infill(rate=0)):
        got = {r["doc_id"]: r for r in restore(infill(df, how=how), how=how).collect()}
        for i, t in rows:
            r = got[i]
            assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain(i, t, how)
            assert r["restored"] == t


def test_bad_sentinels_and_outputs(spark):
    for bad in (("a", "b", ""), ("<P>", "<P>x", "<M>"), ("aXa", "<S>", "<M>"), (">x", "<S>", "<M>")):
        with pytest.raises(ValueError):
            Infill(sentinels=bad)
    with pytest.raises(ValueError):
        Infill(sentinels=("<P>", "<P>", "<M>"))
    rows = [("psm", "<P>a<S>b<M>c", "acb"), ("spm", "<P>a<S>b<M>c", None), ("spm", "<S>b<P>a<M>c", "acb"), ("psm", "a<P><S><M>", None), ("psm", "<P>a<S>b", None), ("psm", "<P>a<S>b<M>c<M>", None), ("plain", "<P>a", "<P>a"), ("psm", None, None), (None, "x", None), ("psm", "<P><S><M>", "")]
    df = spark.createDataFrame(rows, "form string, output string, want string")
    assert all(r["restored"] == r["want"] for r in restore(df).collect())


def test_empty_table_and_plan(nothing, docs):
    assert restore(infill(nothing)).count() == 0
    plan = infill(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("Scan")[0].replace("Exchange RoundRobin", "") and "Python" not in plan and "Arrow" not in plan


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "some text here", "u", "b", "k", "x", "o", 5)], "doc_id long, text string, units string, body string, __kept0 string, cut0 string, OUTPUT string, N int")
    r = restore(infill(df)).collect()[0]
    assert (r["units"], r["body"], r["__kept0"], r["cut0"]) == ("u", "b", "k", "x") and r["n"] == 5 and "OUTPUT" not in r.asDict()
    assert r["restored"] == "some text here"
    assert infill(df).where(F.col("form") == "plain").count() in (0, 1)
