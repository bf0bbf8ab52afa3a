import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, IDS string, fp string, Kept string, copies int"


def corpus() -> list[tuple]:
    """Nulls in every column, empty, blank and very long texts, ties, copies, near copies and repeated rows."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n)) + "."
    shared = prose(40)
    out = []
    for i in range(60):
        text = "\n".join(prose(rng.randint(5, 60)) for _ in range(rng.randint(1, 4)))
        out.append([i, text + ("\n" + shared if i % 4 == 0 else ""), ("en", "fr", None)[i % 3], f"s{i % 4}"])
    for i, text in enumerate([None, "", " \t\n\x0b ", "one", "Two words", "x" * 30_000, prose(9_000), "é漢🙂 naïve text, don't\n\n<|endoftext|>", "12 34", "a | b | c | d", "la " * 200]):
        out.append([100 + i, text, "en", None if i % 2 else "é"])
    base = prose(300)
    words = base.split()
    for k in range(12):
        out.append([200 + k, base, "en", "s1"])
    for k in range(6):
        w = list(words)
        w[50 + k] = "changed"
        out.append([300 + k, " ".join(w), "fr", "s0"])
    out += [[None, base, None, None], [None, None, None, None], [None, "lonely text without an id", "en", "s9"]]
    out += [list(out[3]), list(out[3]), list(out[60])]
    return [(*r, len(r[1]) if r[1] else None, "mine", "mine", None, "mine", 7) for r in out]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
