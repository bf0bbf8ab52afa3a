"""Mixing sources to target token weights by entropy balancing.

Targets: sources share ``share`` times all words by weight; a target stops at ``cap`` times its source's words and the
excess is shared again by weight (water filling). Rates: for each source the convex dual of the entropy problem "stay
close to taking every document once, take the target's words in all" has one multiplier; a Newton step needs only two
sums a source, so each iteration is one aggregation over the histogram of sizes, and the multiplier's bracket keeps the
steps safe. The base measure takes each of ``cap`` copies with probability 1 / cap, so the tilted rate of a document of
x mean sizes is ``cap / (1 + (cap - 1) exp(-multiplier x))``: between 0 and ``cap``. Copies: within a source, in order
of size, a copy falls wherever the running sum of the rates' fractions passes a whole number, so a source's words miss
its target by about one document; then twice one document a source, of the size nearest to the gap, is taken once more
or less. All sums are of integers, so reruns agree.

Work is spread by size and salt, never by source alone. Defined results: a null or empty text has size 0, and its
copies take no words; a null source is a source of its own, last in order; sources without words get target 0 and
stay once; null or repeated ids: a document is a row, and rows that agree in id, source, size and (if there is such a
column) text are interchangeable; an empty table gives an empty table; extra columns pass through and columns of the output's names are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import WS_RUN, Passed, durable, strip_ws

MADE = ("size", "source_size", "target", "rate", "copies", "taken")
#: Fixed point of rates and of word sums, and Newton's limits.
RATE_UNIT, WORD_UNIT, MOST_STEPS = 1 << 20, 1 << 10, 60
#: Rows that one salt of one size of one source should hold at most, and the fewest salts.
SALT_ROWS, MIN_SALTS = 1 << 20, 16
#: Rounds of mending a source's last gap by one document each, and the sources up to which their rows are broadcast.
REPAIRS, BROADCAST_SOURCES = 2, 10_000


def word_count(text):
    """Runs of characters other than the contract's white space."""
    bare = strip_ws(F.coalesce(text, F.lit("")))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, WS_RUN))).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """``sizes`` (columns ``none, src, source_size``, a row a source) with ``target``. Sources are few: their table is
    ordered in one task."""
    order = W.orderBy("none", "src")
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))).cast("int") + 1)
    given = sizes.select("*", weight.cast("double").alias("w"), (F.col("source_size") * float(cap)).alias("most"))
    by = W.orderBy(F.col("most") / F.col("w"), "none", "src")
    before = by.rowsBetween(W.unboundedPreceding, -1)
    level = (
        share * F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    ) / (F.sum("w").over(W.partitionBy()) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    found = given.select("*", level.alias("level"))
    # The first source, by cap and weight, that its share does not fill sets the level for all that are not filled.
    open_ = F.when(F.col("most") / F.col("w") >= F.col("level"), F.col("level"))
    final = F.first(open_, ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    target = F.least(F.col("most"), F.coalesce(final * F.col("w"), F.col("most")))
    return found.select("none", "src", "source_size", "most", target.alias("target"))


def _rate(multiplier, x, cap: float):
    return F.lit(float(cap)) / (1.0 + (cap - 1.0) * F.exp(F.least(F.lit(700.0), -multiplier * x)))


def multipliers(hist: DataFrame, goals: DataFrame, cap: float) -> DataFrame:
    """``goals`` with ``mult``, the root of the dual's gradient, and ``full``/``never`` where the target is a bound.

    ``hist``: ``none, src, size, n``."""
    key = ["none", "src"]
    mean = hist.where("size > 0").groupBy(*key).agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean"))
    start = goals.join(mean, key, "left").select(
        "*", F.lit(0.0).alias("mult"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"),
        ((F.col("target") > 0) & (F.col("target") < F.col("most") * (1 - 1e-9))).alias("open"),
    )
    now = durable(start)
    for _ in range(MOST_STEPS):
        x = F.col("size") / F.col("mean")
        r = _rate(F.col("mult"), x, cap)
        words = F.round(F.col("n") * F.col("size") * r * WORD_UNIT).cast("long")
        slope = F.round(F.col("n") * F.col("size") * x * r * (1 - r / cap) * WORD_UNIT).cast("long")
        sums = (
            hist.where("size > 0").join(now.where("open"), key).groupBy(*key)
            .agg((F.sum(words) / WORD_UNIT).alias("got"), (F.sum(slope) / WORD_UNIT).alias("slope"))
        )
        gap = F.col("got") - F.col("target")
        low = F.when(gap < 0, F.col("mult")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("mult")).otherwise(F.col("high"))
        reach = 1.0 + F.abs("mult")
        newton = F.col("mult") - F.greatest(-reach, F.least(reach, gap / F.greatest(F.col("slope"), F.lit(1e-3))))
        middle = (F.col("low2") + F.col("high2")) / 2
        stepped = (
            now.join(sums, key, "left")
            .select(*now.columns, "got", gap.alias("gap"), low.alias("low2"), high.alias("high2"), newton.alias("newton"))
            .select(
                *key, "source_size", "most", "target", "mean",
                F.when(~F.col("open") | (F.abs("gap") <= 0.5) | F.col("gap").isNull(), F.col("mult"))
                .when((F.col("newton") <= F.col("low2")) | (F.col("newton") >= F.col("high2")), middle)
                .otherwise(F.col("newton")).alias("mult"),
                F.col("low2").alias("low"), F.col("high2").alias("high"),
                (F.col("open") & F.col("gap").isNotNull() & (F.abs("gap") > 0.5) & ~F.coalesce(F.col("high2") - F.col("low2") < 1e-12, F.lit(False))).alias("moving"),
                "open",
            )
        )
        now = durable(stepped)
        if not now.where("moving").limit(1).count():
            break
        now = now.drop("moving")
    return now.select(*key, "source_size", "most", "target", "mean", F.round("mult", 12).alias("mult"), "open")


def mix_sources(
    docs: DataFrame,
    size: str | None = None,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    cap: int = 2,
) -> DataFrame:
    """``docs`` with ``size, source_size, target, rate, copies, taken``. ``size`` names a column of word counts; without
    it the words of ``text`` are counted. Weights go round the sources in code point order, null last."""
    spark = docs.sparkSession
    p = Passed(docs, MADE)
    words = p[size].cast("long") if size else word_count(p[text])
    src = p[source].cast("string")
    known = [p[doc_id].cast("string"), *([p[text]] if text.lower() in map(str.lower, docs.columns) else [])]
    sized = p.frame.select(
        *p.kept,
        F.coalesce(words, F.lit(0)).alias("__size"),
        src.isNull().alias("__none"),
        F.coalesce(src, F.lit("")).alias("__src"),
        p[doc_id].cast("string").alias("__id"),
        F.xxhash64(*known).alias("__h"),
    )
    total = sized.count()
    salt = F.pmod("__h", F.lit(max(MIN_SALTS, -(-total // SALT_ROWS))))
    salted = durable(
        sized.groupBy(F.col("__none").alias("none"), F.col("__src").alias("src"), F.col("__size").alias("size"), salt.alias("salt"))
        .agg(F.count("*").alias("m"))
    )
    cells = durable(salted.groupBy("none", "src", "size").agg(F.sum("m").alias("n")))
    sources = cells.agg(F.count_distinct("none", "src")).first()[0]
    few = sources <= BROADCAST_SOURCES
    goals = targets(cells.groupBy("none", "src").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, share, cap)
    dual = multipliers(cells, durable(goals), cap)
    # A rate for every size of a source, in fixed point, and the fractions' sum over all smaller sizes.
    rate = (
        F.when(F.col("size") == 0, 1.0)
        .when(F.col("open"), _rate(F.col("mult"), F.col("size") / F.col("mean"), cap))
        .when(F.col("target") > 0, float(cap))
        .otherwise(0.0)
    )
    fixed = F.round(rate * RATE_UNIT).cast("long")
    smaller = W.partitionBy("none", "src").orderBy("size").rowsBetween(W.unboundedPreceding, -1)
    rated = (
        cells.join(dual, ["none", "src"])
        .select("none", "src", "size", "n", "source_size", "target", fixed.alias("fixed"))
        .select("*", (F.col("fixed") % RATE_UNIT).alias("part"))
        .select("*", F.coalesce(F.sum(F.col("n") * F.col("part")).over(smaller), F.lit(0)).alias("below"))
    )
    # Where a salt of a size starts within its size.
    ahead = W.partitionBy("none", "src", "size").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    starts = salted.select("*", F.coalesce(F.sum("m").over(ahead), F.lit(0)).alias("ahead")).join(rated, ["none", "src", "size"])
    rank = F.row_number().over(W.partitionBy("__none", "__src", "__size", "__salt").orderBy("__h", "__id"))
    ranked = sized.withColumn("__salt", salt).withColumn("__rank", rank)
    on = (
        (F.col("__none") == F.col("none")) & (F.col("__src") == F.col("src"))
        & (F.col("__size") == F.col("mixed.size")) & (F.col("__salt") == F.col("salt"))
    )
    upto = F.col("below") + (F.col("ahead") + F.col("__rank")) * F.col("part") + F.lit(RATE_UNIT // 2)
    passed = F.floor(upto / RATE_UNIT) - F.floor((upto - F.col("part")) / RATE_UNIT)
    copies = (F.expr(f"fixed div {RATE_UNIT}") + passed).cast("long")
    placed = ranked.join(starts.alias("mixed"), on)
    place = ["none", "src", "size", "salt", "rank"]
    thin = durable(placed.select("none", "src", "mixed.size", "salt", F.col("__rank").alias("rank"), "target", copies.alias("copies")))
    repairs = None
    for _ in range(REPAIRS):
        if repairs is not None:
            delta = F.coalesce("delta", F.lit(0))
            current = thin.join(repairs, place, "left").select(*place, "target", (F.col("copies") + delta).alias("copies"))
        else:
            current = thin
        gaps = current.groupBy("none", "src").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("gap"))
        # One document a source, of the size nearest to the gap, taken once more or once less where that helps.
        nearest = F.struct(F.abs(F.abs("gap") - F.col("size")).alias("miss"), "size", "salt", "rank")
        able = F.when(F.col("gap") > 0, F.col("copies") < cap).otherwise(F.col("copies") > 0)
        fix = (
            current.join(F.broadcast(gaps) if few else gaps, ["none", "src"])
            .where(able & (F.col("size") > 0) & (F.col("size") < 2 * F.abs("gap")))
            .groupBy("none", "src").agg(F.min(nearest).alias("at"), F.first(F.signum("gap").cast("long")).alias("delta"))
            .select("none", "src", "at.size", "at.salt", "at.rank", "delta")
        )
        both = fix if repairs is None else repairs.union(fix).groupBy(*place).agg(F.sum("delta").alias("delta"))
        repairs = durable(both)
    fixes = repairs.select(*[F.col(c).alias(f"fix_{c}") for c in place], "delta")
    mended = (
        (F.col("__none") == F.col("fix_none")) & (F.col("__src") == F.col("fix_src")) & (F.col("__size") == F.col("fix_size"))
        & (F.col("__salt") == F.col("fix_salt")) & (F.col("__rank") == F.col("fix_rank"))
    )
    return (
        placed.select(*p.kept, "__none", "__src", "__size", "__salt", "__rank", "source_size", "target", (F.col("fixed") / RATE_UNIT).alias("rate"), copies.alias("__copies"))
        .join(F.broadcast(fixes) if few else fixes, mended, "left")
        .select(*p.kept, F.col("__size").alias("size"), "source_size", "target", "rate", (F.col("__copies") + F.coalesce("delta", F.lit(0))).alias("copies"))
        .select(*p.back, "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as its copies say, with the columns of ``docs``."""
    own, name = Passed(docs).inner()
    columns = {"text": "text", "source": "source", "doc_id": "doc_id"} | {k: v for k, v in options.items() if k in ("text", "source", "doc_id", "size")}
    out = mix_sources(own, **{**options, **{k: name(v) for k, v in columns.items()}})
    often = out.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return often.select([F.col(f"__doc{k}").alias(c) for k, c in enumerate(docs.columns)])
