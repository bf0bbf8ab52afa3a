import random
import re

import pytest

from tidemark.llm.licenses import NOTICES, PHRASES, Scanner, license_scan, normal_words, pieces


def words_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_base(text):
    """The contract's columns in plain Python."""
    words = words_of(text)
    at = [(k, label) for p, label in PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
    starts = [k for k, _ in at]
    return len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


def fewest_edits(notice, words):
    """The fewest edits between a notice and a run of whole words, by dynamic programming from every word's start."""
    joined = " ".join(words)
    starts = [0] + [i + 1 for i, c in enumerate(joined) if c == " "]
    best = len(notice)
    for s in starts:
        row = list(range(len(notice) + 1))
        for i, c in enumerate(joined[s : s + 2 * len(notice)]):
            new = [i + 1]
            for j, d in enumerate(notice):
                new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (c != d)))
            row = new
            if s + i + 1 == len(joined) or joined[s + i + 1] == " ":
                best = min(best, row[-1])
    return best


def spoiled(rng, text, edits):
    for _ in range(edits):
        k = rng.randrange(len(text))
        text = rng.choice((text[:k] + text[k + 1 :], text[:k] + rng.choice("abcxyz é") + text[k:], text[:k] + rng.choice("abcxyzé") + text[k + 1 :]))
    return text


def test_base_columns(docs, rows):
    texts = {**{r[0]: r[1] for r in rows}}
    for r in license_scan(docs, keep_text=True).collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain_base(r["text"])
        assert r["labels"] == "" and r["score"] == 0.0 and r["spans"] == []
    assert len(texts) > 50


def test_notices_against_brute_force(spark):
    """Notices with edits up to beyond their bounds, among other words: labels are those of the full dynamic programme."""
    rng = random.Random(3)
    filler = ["the", "of", "and", "river", "public", "license", "software", "under", "cc", "by", "general", "naïve", "mit", "gnu", "terms"]
    rows = []
    for i, (text, _, edits) in enumerate(NOTICES * 3):
        noise = lambda n: [rng.choice(filler) for _ in range(n)]
        body = spoiled(rng, text, rng.randint(0, edits + 2))
        rows.append((i, " ".join([*noise(rng.randint(0, 9)), body, *noise(rng.randint(0, 9))]).title() if i % 2 else " ".join([*noise(4), body, *noise(3)])))
    got = {r["doc_id"]: r for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    fuzzy = 0
    for i, text in rows:
        words = words_of(text)
        edits = {n: fewest_edits(n, words) for n, _, _ in NOTICES}
        want = {label for n, label, most in NOTICES if edits[n] <= most} | set(filter(None, plain_base(text)[4].split(",")))
        assert set(filter(None, got[i]["labels"].split(","))) == want, (text, edits)
        share = [1 - edits[n] / len(n) for n, _, most in NOTICES if edits[n] <= most] + [1.0] * bool(plain_base(text)[1])
        assert got[i]["score"] == pytest.approx(max(share, default=0.0))
        fuzzy += any(0 < s["edits"] for s in got[i]["spans"])
    assert fuzzy > 20


def test_spans_lie_in_the_text(spark):
    text = "Ünïcode 🙂 first.\n\n/* Licenced under the\n * Apache   Licence, Version 2.0 */ Then: MIT License; CC-BY-NC 4.0."
    r = license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    cut = {(s["label"], s["edits"]): text[s["start"] : s["end"]] for s in r["spans"]}
    assert cut["apache", 2] == "Licenced under the\n * Apache   Licence"
    assert cut["mit", 0] == "MIT License" and cut["cc-by-nc", 0] == "CC-BY-NC" and cut["cc-by", 0] == "CC-BY"
    assert r["labels"] == "apache,cc-by,cc-by-nc,mit" and r["base_labels"] == "cc-by,mit" and r["n_base"] == 2 and r["score"] == 1.0


def test_notices_keep_apart():
    """No notice is near enough another of a different label to be taken for it, but where it holds the other's phrase."""
    for a, x, _ in NOTICES:
        for b, y, most in NOTICES:
            if x != y and b not in a and not a.startswith("creative") and not a.startswith("cc by"):
                assert fewest_edits(b, a.split()) > most or y in PHRASES.values() and b in a, (a, b)


def test_pieces_and_odd_words():
    for text, _, edits in NOTICES:
        cut = pieces(text, edits)
        assert len(cut) == edits + 1 and "".join(p for _, p in cut) == text and all(text[a:].startswith(p) for a, p in cut)
    s = Scanner({"a b": "x"}, (("abcd efgh", "y", 1),))
    assert s.result("")[:6] == (0, 0, None, None, "", "") and s.result("A-b a B")[:6] == (4, 2, 0, 2, "x", "x")
    assert s.result("z" * 100_000 + " abcdefgh " + "z" * 100_000)[5] == "y" and s.result("xabcd efgh" + "z" * 50)[5] == ""
    many = s.result("abcd efgh " * 5_000)
    assert len(many[7]) == 5_000 and many[6] == 1.0 and many[7][-1]["start"] == 49_990
    for bad in (({"A b": "x"}, ()), ({}, (("abc", "x", 3),)), ({}, (("a  b", "x", 0),))):
        with pytest.raises(ValueError):
            Scanner(*bad)
    assert Scanner({}, ()).result("mit license")[:6] == (2, 0, None, None, "", "")
    assert normal_words("A\x7fb\x00C é É9")[1] == "a b c é É9"


def test_empty_table_and_clashing_columns(spark, nothing):
    assert license_scan(nothing).count() == 0
    df = spark.createDataFrame([(1, "MIT License", "s", "x", 4)], "doc_id long, text string, source string, __kept0 string, SCORE int")
    r = license_scan(df, keep_text=True).collect()[0]
    assert (r["source"], r["__kept0"], r["labels"], r["score"], r["text"]) == ("s", "x", "mit", 1.0, "MIT License") and "SCORE" not in r.asDict()
