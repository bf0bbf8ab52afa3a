import hashlib
import re

from pyspark.sql import functions as F

from tidemark.llm.lines import TwoFilters, line_dedup
from tidemark.llm.quality import quality_filter, quality_rules

WORD = re.compile("[^\x20\x09-\x0d]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    wins = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    seen = {}
    for w in wins:
        seen[w] = seen.get(w, 0) + 1
    covered = {k + j for k, w in enumerate(wins) if seen[w] > 1 for j in range(8)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_base_counts(docs, rows):
    got = quality_rules(docs)
    assert [c for c in got.columns if c.lower() == "kept"] == ["kept"]
    want = sorted(str((r[0], *base(r[1]))) for r in rows)
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert sorted(str(tuple(r)) for r in got.select(*cols).collect()) == want
    for r in got.collect():
        failed = r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_line_rules(spark):
    good = "This is a sentence that says a good deal about nothing at all, and it ends."
    lines = [good, "Home | About | Contact | Help.", "Read our privacy policy.", "buy$$$ now### and%%% win***.", "WIN!! MORE!! NOW!!", "short scrap"]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, good + "\nAnother line with words of its own that no other line of this text has to offer.\nWin now"), (3, good + "\n" + "\n".join(lines[1:] * 4))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality_rules(df).collect()}
    assert got[1]["clean_text"] == good
    assert got[2]["kept"] and not got[3]["kept"]
    assert [r["doc_id"] for r in quality_filter(df).collect()] == [2]


def test_empty(nothing):
    assert quality_rules(nothing).count() == 0
    assert line_dedup(nothing).count() == 0


def dedup(rows, min_docs, keep_first):
    strip = lambda x: x.strip(" \t\n\x0b\x0c\r")
    low = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x)
    docs = [((10**18 if r[0] is None else r[0]), (r[1] or "").split("\n")) for r in rows]
    held, first = {}, {}
    for d, (i, ls) in enumerate(docs):
        for k, x in enumerate(ls):
            key = low(strip(x))
            if key:
                held.setdefault(key, set()).add(d)
                first[key] = min(first.get(key, (10**19, 0)), (i, k))
    out = []
    for (i, ls), r in zip(docs, rows, strict=True):
        keep = [x for k, x in enumerate(ls) if not (low(strip(x)) in held and len(held[low(strip(x))]) >= min_docs) or (keep_first and first[low(strip(x))] == (i, k))]
        out.append((r[0], len(ls), len(ls) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return sorted(map(str, out))


def test_line_dedup(docs, rows):
    cases = ((2, True, 10**6, None), (3, False, 10**6, (1 << 12, 3)), (2, True, 0, (1 << 16, 1)), (10, False, 0, None), (2, True, 2, (1 << 12, 3)))
    for min_docs, first, most, filters in cases:
        got = line_dedup(docs, min_docs=min_docs, keep_first=first, broadcast_keys=most, filters=filters)
        cols = got.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256))
        assert sorted(str(tuple(r)) for r in cols.collect()) == dedup(rows, min_docs, first)


def test_a_full_filter_still_gives_whole_results(docs, rows):
    got = line_dedup(docs, min_docs=2, keep_first=True, filters=(512, 1))
    cols = got.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256))
    assert sorted(str(tuple(r)) for r in cols.collect()) == dedup(rows, 2, True)


def test_filters_miss_no_repeat():
    f = TwoFilters(1 << 12)
    keys = [hashlib.md5(str(k).encode()).digest() for k in range(200)]
    f.add(keys)
    f.add(keys[:50])
    from tidemark.llm.lines import _suspects
    assert _suspects(f.twice.tobytes(), 1 << 12, keys[:50]).all() and not _suspects(f.twice.tobytes(), 1 << 12, keys[50:]).all()


def test_filters_grow_with_the_lines():
    """Few keys that occur once are suspected, also at ten times the lines and where keys are dealt into ranges."""
    from tidemark.llm.lines import RANGE_BITS, _suspects, filter_plan, in_range

    assert filter_plan(0)[1] == 1 and filter_plan(10**12) == (RANGE_BITS, 16)
    bits, ranges = filter_plan(60_000_000)
    assert bits == RANGE_BITS and bits * ranges >= 16 * 60_000_000
    for n in (70_000, 700_000):
        keys = [hashlib.md5(str(k).encode()).digest() for k in range(n)]
        bits, _ = filter_plan(n)
        whole = TwoFilters(bits)
        for k in range(0, n, 50_000):
            whole.add(keys[k : k + 50_000])
        assert _suspects(whole.twice.tobytes(), bits, keys).mean() < 0.02
    dealt = [sum(in_range(k, part, 3) for k in keys[:3000]) for part in range(3)]
    assert sum(dealt) == 3000 and min(dealt) > 900


def test_line_rules_by_kind(spark):
    good = "This is a sentence that says a good deal about nothing at all, and it ends."
    bad = [
        "Home > Products > Lamps > Desk lamps.", "News · Sport · Weather · Travel.", "Shop » Men » Shoes.", "Home / Blog / About us.",
        "About Our Company And What Our Customers Say About All Our Services", "THIS IS A LINE OF NOTHING BUT SHOUTS THAT GOES ON.",
        "Click here to log in to the site.", "We use cookies to make this site better for all.", "two  words",
    ]
    menu = "Home:\nNews:\nSport:\nWeather."
    df = spark.createDataFrame([(k, f"{good}\n{good} Again.\n{x}") for k, x in enumerate([*bad, menu])], "doc_id long, text string")
    assert {r["clean_text"] for r in quality_rules(df).collect()} == {f"{good}\n{good} Again."}
    fine = ["Es war Abend, und der Hund lief durch die Stadt.", "He said: read more books!", "Yes.\nNo.\nYes.", "From 3 - 4 we slept > 2 hours, and that was well over what we had been told."]
    df = spark.createDataFrame([(k, f"{good}\n{x}") for k, x in enumerate(fine)], "doc_id long, text string")
    assert {r["clean_text"] for r in quality_rules(df).collect()} == {f"{good}\n{x}" for x in fine}


def test_very_many_lines_take_no_longer_each(spark):
    import time

    took = []
    for n in (2_000, 2_000, 40_000):
        df = spark.createDataFrame([(1, "\n".join(f"Line {k} of a long text is here." for k in range(n)))], "doc_id long, text string")
        start = time.perf_counter()
        assert quality_rules(df).collect()[0]["n_words"] == 8 * n
        took.append(time.perf_counter() - start)
    assert took[2] < 60 * took[1] + 10
