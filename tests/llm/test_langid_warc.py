import datetime as dt
from collections import Counter

from pyspark.sql import functions as F

from tidemark.llm.langid import Profiles, blocks, grams, identify, learn, profile, train
from tidemark.llm.warc import attach_payload, canonical_url, header_lines, resolve_revisits


def plain(text, size):
    s = "".join(c if c.isalpha() else " " for c in text.lower())
    s = " " + " ".join(s.split()) + " "
    n = Counter(s[k : k + w] for w in (1, 2, 3) for k in range(len(s) - w + 1))
    n.pop(" ", None)
    return [g for g, _ in sorted(n.items(), key=lambda x: (-x[1], x[0]))][:size]


def unpack(g):
    return "".join(chr(c) for c in ((g >> 42) & 0x1FFFFF, (g >> 21) & 0x1FFFFF, g & 0x1FFFFF) if c)


def test_grams_and_ranks_against_plain_python():
    for text in ("Hello, the Hat!", "a", "été 漢字 x", "  --a-b--  ", "the " * 50, "x1y2"):
        assert [unpack(int(g)) for g in profile(*grams(text), 40)] == plain(text, 40)
    assert len(grams("123 !?")[0]) == 0


def test_distance_against_plain_python():
    words = {"en": "the cat sat on the mat and the dog", "de": "der hund und die katze auf der matte"}
    p = Profiles({k: profile(*grams(v), 30).tolist() for k, v in words.items()}, 30)
    for text in ("the dog", "die katze", "zzz"):
        own = plain(text, 30)
        away = {}
        for k, v in words.items():
            ranks = {g: r for r, g in enumerate(plain(v, 30))}
            away[k] = sum(abs(ranks[g] - r) if g in ranks else 30 for r, g in enumerate(own))
        want = min(sorted(away), key=away.get)
        lang, score = p.predict(text)
        assert lang == want and abs(score - (1 - away[want] / (30 * len(own)))) < 1e-12


def test_edges(spark, docs, nothing):
    p = train(docs)
    assert [x.langs for x in p] == [["en", "fr"]]
    got = {r["doc_id"]: r for r in identify(docs, p).collect()}
    assert [got[i]["lang_pred"] for i in (100, 101, 102, 108)] == ["und"] * 4 and got[100]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in got.values())
    empty = train(nothing)
    assert [x.langs for x in empty] == [[]] and {r["lang_pred"] for r in identify(docs, empty).collect()} == {"und"}
    assert identify(nothing, p).count() == 0


def test_training_against_plain_python(docs, rows):
    for lang in ("en", "fr"):
        total = Counter()
        for r in rows:
            if r[2] == lang and r[1]:
                s = "".join(c if c.isalpha() else " " for c in r[1].lower())
                s = " " + " ".join(s.split()) + " "
                if s.strip():
                    total.update(s[k : k + w] for w in (1, 2, 3) for k in range(len(s) - w + 1))
        total.pop(" ", None)
        want = [g for g, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))][:400]
        own = {r["lang"]: r["grams"] for r in learn(docs).collect()}[lang]
        assert [unpack(g) for g in own] == want


def test_blocks_of_languages_leave_none_out(spark):
    import random

    rng = random.Random(3)
    rows = [(k, f"l{k:02d}", " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(4)) for _ in range(60))) for k in range(23)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    learned = learn(df)
    one, many = list(blocks(learned)), list(blocks(learned, most=5))
    assert len(one) == 1 and [len(p.langs) for p in many] == [5, 5, 5, 5, 3]
    a, b = ({r["doc_id"]: (r["lang_pred"], r["score"]) for r in identify(df, p).collect()} for p in (one, many))
    assert a == b == {k: (lang, a[k][1]) for k, lang, _ in rows}


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(sf_dir.replace("0.001", "0.01") + "/documents.parquet")
    part = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    p = train(docs.where(part != 1))
    out = identify(docs.where(part == 1).select("lang", "text"), p)
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98


def test_canonical(spark):
    cases = {
        "HTTP://User@WWW.Example.com:80/a/b/?b=2&utm_source=x&a=1#top": "example.com/a/b?a=1&b=2", "https://example.com": "example.com", "https://example.com:8443/": "example.com:8443",
        "": None, "no url": None, None: None, "https://example.com/?gclid=1": "example.com", "http://h/p?": "h/p",
    }
    df = spark.createDataFrame([(k,) for k in cases], "u string")
    assert {r[0]: r[1] for r in df.select("u", canonical_url(F.col("u"))).collect()} == cases


def naive(rows):
    low = lambda h: {k.lower(): v for k, v in sorted((h or {}).items())}
    weak = lambda v: v.removeprefix("W/") if v else v
    ok = {"age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"}
    out = []
    for i, kind, url, at, head in rows:
        if kind != "revisit":
            continue
        mine = low(head)
        lines = lambda h: "\n".join(f"{k}: {v}" for k, v in sorted(h.items()))
        if not url or at is None:
            out.append((i, "no_url_or_date", None, lines(mine)))
            continue
        old = [r for r in rows if r[1] == "response" and r[2] == url and r[3] is not None and r[3] < at]
        if not old:
            out.append((i, "no_earlier_response", None, lines(mine)))
            continue
        r = max(old, key=lambda r: (r[3], r[0] or ""))
        theirs = low(r[4])
        same = weak(mine["etag"]) == weak(theirs.get("etag")) if "etag" in mine else mine["last-modified"] == theirs.get("last-modified") if "last-modified" in mine else True
        out.append((i, "resolved" if same else "validator_mismatch", r[0], lines({**theirs, **{k: v for k, v in mine.items() if k in ok}} if same else mine)))
    return sorted(map(str, out))


def test_revisits_against_brute_force(spark):
    t = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    a, b = "http://a/x", "http://b/"
    rows = [
        ("r1", "response", a, t(0), {"ETag": '"1"', "Content-Length": "5", "Date": "0"}), ("r2", "response", a, t(30), {"etag": '"2"', "Last-Modified": "m"}), ("r3", "response", a, t(30), {"ETag": '"3"'}),
        ("v1", "revisit", a, t(1), {"ETag": 'W/"1"', "Date": "1", "Content-Length": "0"}), ("v2", "revisit", a, t(29), {"ETag": '"9"'}), ("v3", "revisit", a, t(30), {"ETag": '"1"', "DATE": "x"}),
        ("v4", "revisit", a, t(500), {"Last-Modified": "m"}), ("v5", "revisit", a, t(500), None), ("v6", "revisit", b, t(5), {}), ("v7", "revisit", None, t(5), {"ETag": "x"}), ("v8", "revisit", a, None, {}),
        ("v5", "revisit", a, t(500), None), (None, "response", b, t(9), None), ("v9", "revisit", b, t(10), {"Vary": "*"}), (None, "revisit", b, t(11), {}), ("m", "metadata", a, t(3), {}), ("v10", "revisit", "", t(1), {}), ("v0", "revisit", a, t(0), {}),
    ]
    df = spark.createDataFrame(rows, "record_id string, kind string, uri string, at timestamp, headers map<string,string>").withColumn("headers_", F.lit(1))
    for seconds in (86_400, 3_600, 10**9):
        out = resolve_revisits(df, slice_seconds=seconds)
        got = out.select("record_id", "status", "response_id", header_lines("headers"))
        assert sorted(str(tuple(r)) for r in got.collect()) == naive(rows)
    bodies = df.withColumn("payload", F.concat(F.lit("body of "), "record_id"))
    have = {r["record_id"]: r["payload"] for r in attach_payload(resolve_revisits(df), bodies).collect()}
    assert have["v1"] == "body of r1" and have["v2"] is None
    assert resolve_revisits(df.limit(0)).count() == 0


def test_hot_url_and_ties(spark):
    rows = [(f"r{k:04d}", "response" if k % 3 == 0 else "revisit", "http://hot/", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=k // 2), {}) for k in range(300)]
    df = spark.createDataFrame(rows, "record_id string, kind string, uri string, at timestamp, headers map<string,string>")
    got = resolve_revisits(df, slice_seconds=600).select("record_id", "status", "response_id", header_lines("headers"))
    assert sorted(str(tuple(r)) for r in got.collect()) == naive(rows)
