"""Line-first quality rules, by DataFrame functions only.

Every line is held against the punctuation, navigation and boilerplate rules, failing lines go, and a document that
loses too much of its text, or fails the base rules, is rejected.

Defined results: a null or empty text has no words, so it fails the base rules and its clean text is empty; repeated
rows are judged each for itself; an empty table gives an empty table; extra columns pass through, and columns of the
operator's own names are replaced. Texts are taken whole; all work on a text is of order n log n at most.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WS_RUN, Passed, strip_ws

#: Characters the base rule counts as symbols.
SYMBOLS = "#*$%&|<>"
#: How a sentence may end.
TERMINAL = (".", "!", "?", "…", "。", "！", "？", '"', "”", "»", "'", "’", ")", ":", ";")
#: What parts the entries of a menu, as single characters and as strings.
SEPARATORS, SPACED_SEPARATORS = "|·•›→»", (" > ", " / ", " :: ", " - ")
#: Phrases of boilerplate, lower case. One of the first groups condemns a line.
LEGAL = ("all rights reserved", "privacy policy", "terms of service", "terms of use", "terms and conditions")
CONSENT = ("accept cookies", "cookie policy", "we use cookies", "uses cookies", "cookie settings")
TECHNICAL = ("enable javascript", "javascript is disabled", "skip to content", "skip to main content", "powered by", "404 not found")
FILLER = ("lorem ipsum", "sign up for our newsletter", "subscribe to our newsletter")
BOILERPLATE = (*LEGAL, *CONSENT, *TECHNICAL, *FILLER)
#: What alone may be prose; two different ones condemn a line.
CALLS = ("click here", "read more", "learn more", "log in", "sign in", "sign up", "contact us", "about us", "follow us", "share this", "subscribe", "back to top", "leave a comment")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class QualityRules:
    """Thresholds of the line and document rules."""

    min_words: int = 20
    window: int = 8
    max_repeat_percent: int = 30
    #: Navigation: at least so many separators, and so many a word; or a run of at least ``MENU_RUN`` lines of at most so
    #: many words each; or an open line of which this share of words begins with a capital (A-Z).
    nav_min_separators: int = 2
    nav_share: float = 0.2
    menu_words: int = 3
    title_share: float = 0.8
    #: Punctuation: a line without an ending needs this many words, and a word may not carry more than this many
    #: symbols or shouts on average; a line of this many capitals (A-Z) must have a small letter too.
    min_open_words: int = 10
    symbol_share: float = 0.3
    shout_letters: int = 20
    #: Boilerplate phrases condemn a line of up to this many characters.
    boilerplate_max_chars: int = 300
    #: A document is rejected if the lines it keeps hold less than this share of its characters.
    min_kept_share: float = 0.4


#: Lines of a run that make a menu.
MENU_RUN = 4


def _occurrences(line: Column, what: str) -> Column:
    return (F.octet_length(line) - F.octet_length(F.replace(line, F.lit(what), F.lit("")))) / len(what.encode())


def _among(line: Column, chars: str) -> Column:
    """How many characters of a line are among ``chars``."""
    return sum((_occurrences(line, c) for c in chars), F.lit(0.0))


def _count_words(line: Column) -> Column:
    return F.size(F.split(strip_ws(line), WS_RUN))


def _any(line: Column, phrases: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for phrase in phrases:
        found = found | F.contains(line, F.lit(phrase))
    return found


def line_passes(line: Column, low: Column, words: Column, rules: QualityRules) -> Column:
    """Whether a line, also given in lower case, with so many words passes the punctuation, navigation and boilerplate
    rules. Cheap conditions come first, as the rest is left out where they fail."""
    ended = F.right(strip_ws(line), F.lit(1)).isin(*TERMINAL)
    shouts = ~line.rlike("[a-z]") & (F.length(line) - F.length(F.translate(line, UPPER, "")) >= rules.shout_letters)
    punctuation = (
        (ended | (words >= rules.min_open_words))
        & (_occurrences(line, "!!") <= rules.symbol_share * words)
        & (_among(line, SYMBOLS.replace("|", "")) <= rules.symbol_share * words)
        & ~shouts
    )
    parts = _among(line, SEPARATORS) + sum((_occurrences(line, x) for x in SPACED_SEPARATORS), F.lit(0.0))
    titles = F.regexp_count(line, F.lit(r"(^|[\x20\x09-\x0D])[A-Z]"))
    menu = (parts >= rules.nav_min_separators) & (parts >= rules.nav_share * words)
    navigation = (~ended & (titles >= rules.title_share * words)) | menu
    calls = sum((F.contains(low, F.lit(c)).cast("int") for c in CALLS), F.lit(0))
    boiler = (F.length(line) <= rules.boilerplate_max_chars) & (_any(low, BOILERPLATE) | (calls >= 2))
    return punctuation & ~navigation & ~boiler


def quality_rules(docs: DataFrame, text: str = "text", rules: QualityRules = QualityRules()) -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (long), ``base_failed``, ``kept``
    (boolean) and ``clean_text`` (the passing lines joined by \\n; lines without a word stay between them).

    The 8-word windows of one text are compared by 64-bit hashes.
    """
    own = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_text")
    p = Passed(docs, own)
    w = rules.window
    body = F.coalesce(p[text], F.lit(""))
    bare = strip_ws(body)
    base = p.frame.select(
        *p.kept,
        body.alias("__body"),
        F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WS_RUN)).alias("__words"),
        F.split(body, "\n").alias("__lines"),
        F.split(F.lower(body), "\n").alias("__lows"),
    )
    n = F.size("__words")
    windows = F.when(
        n >= w, F.transform(F.sequence(F.lit(1), n - (w - 1)), lambda i: F.xxhash64(F.slice("__words", i, w)))
    ).otherwise(F.array().cast("array<bigint>"))
    full = F.filter("__lines", lambda x: strip_ws(x) != "")
    # Words of every line (0: a blank one), and whether it is short; a run of short lines is a menu.
    base = base.withColumn("__nw", F.transform("__lines", lambda x: F.when(strip_ws(x) == "", 0).otherwise(_count_words(x))))
    base = base.withColumn("__short", F.transform("__nw", lambda k: (k > 0) & (k <= rules.menu_words)))
    short = lambda i, d: F.coalesce(F.get(F.col("__short"), i + d), F.lit(False)) if d else F.get(F.col("__short"), i)

    def menu(i: Column) -> Column:
        """Whether line ``i`` is in a run: with it, ``MENU_RUN`` short lines that begin so many lines before it."""
        runs = F.lit(False)
        for back in range(MENU_RUN):
            run = F.lit(True)
            for d in range(-back, MENU_RUN - back):
                run = run & short(i, d)
            runs = runs | run
        return short(i, 0) & runs

    def stays(x: Column, i: Column) -> Column:
        words = F.get(F.col("__nw"), i)
        return (words == 0) | (line_passes(x, F.get(F.col("__lows"), i), words, rules) & ~menu(i))

    marked = base.select(
        *p.kept,
        "__body",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("__body", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        windows.alias("__win"),
        full.alias("__full"),
        F.filter("__lines", stays).alias("__passed"),
    )
    # Only a text with a window found twice pays for the sort.
    twice = F.size(F.array_distinct("__win")) < F.size("__win")
    ordered = marked.select(
        "*",
        F.when(twice, F.sort_array(F.transform("__win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("__ord"),
    ).drop("__win")
    same = lambda p, k: F.get(F.col("__ord"), k)["h"].eqNullSafe(p["h"])
    placed = ordered.select(
        "*",
        F.sort_array(
            F.transform(F.filter("__ord", lambda p, k: ((k > 0) & same(p, k - 1)) | same(p, k + 1)), lambda p: p["i"])
        ).alias("__pos"),
    ).drop("__ord")
    m = F.size("__pos")
    steps = F.zip_with(
        F.slice("__pos", F.lit(2), m - 1), F.slice("__pos", F.lit(1), m - 1), lambda b, a: F.least(F.lit(w), b - a)
    )
    # A row number, always true here, keeps the optimizer from pushing a later filter below this projection and with it
    # copies of the sorted windows into the functions that run for each of their elements.
    once = F.monotonically_increasing_id() >= 0
    repeat = F.when(once & F.col("__pos").isNotNull(), w + F.aggregate(steps, F.lit(0), lambda s, x: s + x)).otherwise(0)
    counted = placed.select(
        *p.kept,
        "n_words", "word_chars", "n_symbols",
        (F.size("__full") - F.size(F.array_distinct("__full"))).cast("long").alias("n_dup_lines"),
        repeat.cast("long").alias("n_repeat_words"),
        F.array_join("__passed", "\n").alias("clean_text"),
        F.length("__body").alias("__chars"),
    )
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    return counted.select(
        *p.back,
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (F.length("clean_text") >= rules.min_kept_share * F.col("__chars"))).alias("kept"),
        "clean_text",
    )


def quality_filter(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """Kept documents with their failing lines removed; the columns of ``docs``, ``n_chars`` (if there) brought up to date."""
    own, name = Passed(docs).inner()
    out = quality_rules(own, name("text"), rules).where("kept")
    made = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}
    return out.select([made.get(c, F.col(f"__doc{k}")).alias(c) for k, c in enumerate(docs.columns)])
