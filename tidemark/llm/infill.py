"""Fill-in-the-middle arrangement of documents and its reversal, in native Spark SQL.

A text is cut into units by ``UNITS`` (``regexp_extract_all``), two of them are drawn from the document's SHA-256 digest
(``conv`` and ``substring`` of ``sha2``), and prefix, middle and suffix (``slice``, ``array_join``) are written between three
sentinels in one of two orders. `restore` splits an output at its sentinels and puts the parts back. All work is on one row
at a time: no shuffle, no Python.

Defined results: a null text is an empty one; an empty text, a text that holds a sentinel and a text that the rate leaves
out stay as they are (form ``plain``, no cuts); a null id is drawn like an id without digits; texts are never cut off;
repeated rows are treated alike, each for itself; an empty table gives an empty table; extra columns pass through and
columns of the output's names (in any case) are replaced. Sentinels must be three, and such that none can begin inside
another or across its edge, for then an output has one reading; others are refused.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Passed

#: A unit is a run of ASCII letters or one other code point.
UNITS = "[A-Za-z]+|[^A-Za-z]"


@dataclass(frozen=True)
class Infill:
    """What is drawn: the per cent of texts arranged, the per cent of these that put the suffix first, the seed before the
    id in the digest, and the sentinels before prefix, suffix and middle."""

    rate: int = 90
    suffix_first: int = 20
    seed: str = "1:"
    sentinels: tuple[str, str, str] = ("<P>", "<S>", "<M>")

    def __post_init__(self):
        if len(self.sentinels) != 3 or not all(self.sentinels):
            raise ValueError("three sentinels that are not empty are needed")
        for i, a in enumerate(self.sentinels):
            for j, b in enumerate(self.sentinels):
                inside = i != j and a in b
                if inside or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)))):
                    raise ValueError(f"sentinels {a!r} and {b!r} overlap")

    def splitter(self) -> str:
        """The sentinels as a pattern."""
        return "|".join(f"\\Q{s}\\E" for s in self.sentinels)


def _draw(digest: Column, k: int) -> Column:
    """The ``k``-th group of eight hexadecimal digits as a number."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def infill(df: DataFrame, text: str = "text", doc_id: str = "doc_id", how: Infill = Infill()) -> DataFrame:
    """``df`` with ``n`` (units), ``form`` (plain, psm or spm), ``prefix_chars`` and ``middle_chars`` (code points; null if
    plain) and ``output``."""
    own = Passed(df, made=("n", "form", "prefix_chars", "middle_chars", "output"))
    p, s, m = (F.lit(x) for x in how.sentinels)
    # The text is read once a row: each step names what the next one uses more than once.
    body = own.frame.select(
        *own.kept,
        F.coalesce(own[text], F.lit("")).alias("body"),
        F.sha2(F.concat(F.lit(how.seed), F.coalesce(own[doc_id].cast("string"), F.lit(""))).cast("binary"), 256).alias("digest"),
    )
    units = body.select("*", F.regexp_extract_all("body", F.lit(UNITS), F.lit(0)).alias("units"))
    held = F.contains("body", p) | F.contains("body", s) | F.contains("body", m)
    n = F.size("units").cast("long")
    form = (
        F.when((n == 0) | held | (_draw(F.col("digest"), 2) % 100 >= how.rate), "plain")
        .when(_draw(F.col("digest"), 3) % 100 < how.suffix_first, "spm")
        .otherwise("psm")
    )
    drawn = units.select("*", n.alias("n"), form.alias("form"), *[(_draw(F.col("digest"), k) % (n + 1)).alias(f"cut{k}") for k in (0, 1)])
    low, high = F.least("cut0", "cut1").cast("int"), F.greatest("cut0", "cut1").cast("int")
    on = F.col("form") != "plain"
    piece = lambda start, length: F.when(on, F.array_join(F.slice("units", start + 1, length), ""))
    cut = drawn.select("*", piece(F.lit(0), low).alias("prefix"), piece(low, high - low).alias("middle"), piece(high, F.col("n").cast("int") - high).alias("suffix"))
    psm = F.concat(p, "prefix", s, "suffix", m, "middle")
    spm = F.concat(s, "suffix", p, "prefix", m, "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("body"))
    chars = [F.length(c).cast("long").alias(f"{c}_chars") for c in ("prefix", "middle")]
    return cut.select(*own.back, "n", "form", *chars, output.alias("output"))


def restore(df: DataFrame, output: str = "output", form: str = "form", how: Infill = Infill(), name: str = "restored") -> DataFrame:
    """``df`` with the text that an output and its form stand for. An output that lacks the sentinels of its form, or that
    has more of them, gives null."""
    own = Passed(df, made=(name,))
    parts = F.split(own[output], how.splitter(), -1)
    split = own.frame.select(*own.kept, own[output].alias("given"), own[form].alias("kind"), F.when(own[form] != "plain", parts).alias("parts"))
    at = lambda k: F.element_at("parts", k)
    p, s, m = how.sentinels
    marks = lambda a, b: F.concat(F.lit(a), at(2), F.lit(b), at(3), F.lit(m), at(4)) == F.col("given")
    whole = (
        F.when(F.col("kind") == "plain", F.col("given"))
        .when((F.size("parts") != 4) | (at(1) != ""), F.lit(None).cast("string"))
        .when((F.col("kind") == "psm") & marks(p, s), F.concat(at(2), at(4), at(3)))
        .when((F.col("kind") == "spm") & marks(s, p), F.concat(at(3), at(4), at(2)))
    )
    return split.select(*own.back, whole.alias(name))
