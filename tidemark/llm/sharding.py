"""Sharding by balanced label propagation, by DataFrame functions only.

Documents of equal text are linked. Linked documents are handled in chunks, ``(group, salt)`` with a bounded number of
salts, so a group of any size is a bounded number of rows in every join. Each chunk starts in a shard by its hash. In
every round a group's chunks want the shard that holds most of the group and is not yet full of it. The wishes from one
shard for another are summed over all groups: as many as wish to come the other way may swap, and beyond that a shard
takes as many as it has room for (with some slack, as the last pass makes sizes exact). Within these quotas whole groups
are let through by hash, so a group's pieces move together.

The last pass makes counts exact. Each shard keeps its linked documents, whole groups side by side, up to its quota; what
is above goes in order of group into the free places of other shards, so a group is cut only where a shard or a run of
free places ends; documents without partners, which cut nothing, fill the rest. Groups are stars around a text's hash,
never pairs.

The law is ``rows``: every shard holds the same number of documents, at most one apart. Rankings are two-level (within
a bucket, then offsets from the buckets' counts), so neither a shard nor a group is ever ordered in one task.

Defined results: a null text is one of size 8 and CRC-32 0, linked to other null texts only; an empty text likewise,
to empty ones; ids may be null or repeated, a document is a row, and rows that agree in id and text are
interchangeable; fewer documents than shards leave shards empty; an empty table gives an empty table; extra columns
pass through and columns of the output's names are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import Passed, durable, written

MADE = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
#: Buckets of a two-level ranking: rows each should hold, fewest and most.
BUCKET_ROWS, MIN_BUCKETS, MOST_BUCKETS = 1 << 18, 8, 4096
#: Chunks of a group at most, unless documents are so many that a chunk could hold more than this many of them; and the
#: share of its quota by which a shard may be over in the rounds.
SALTS, CHUNK_ROWS, SLACK = 256, 1 << 20, 0.1


def _unit(*cols):
    """A number from 0 to 1 from a hash of columns."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / float(1 << 30)


def _bucket(buckets: int, *cols):
    return F.pmod(F.xxhash64(*cols), F.lit(buckets)).cast("int")


def running(df: DataFrame, within: list, bucket, order: list, weight, name: str) -> DataFrame:
    """``df`` with the sum of ``weight`` over all rows before it within ``within``, buckets in ascending order; ``bucket``
    has a bounded number of values, so the table of bucket sums is small."""
    marked = df.withColumn("__b", bucket).withColumn("__w", weight)
    keys = [*within, "__b"]
    sums = marked.groupBy(*keys).agg(F.sum("__w").alias("__m"))
    before = W.partitionBy(*within, F.lit(0)).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(*keys, F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__off"))
    own = F.sum("__w").over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)) - F.col("__w")
    local = marked.withColumn("__own", own)
    return local.join(offsets, keys).withColumn(name, (F.col("__off") + F.col("__own")).cast("long")).drop("__b", "__w", "__own", "__off")


def wishes(state: DataFrame, quota: int, turn: int) -> DataFrame:
    """``state`` with ``wish``, a shard that holds more of a chunk's group than its own, and ``u``, which lets a group's
    chunks through together.

    A group that fits a shard wants the one that holds most of it; a larger group the ``wide`` shards it takes, of which
    its other chunks pick one each that the group does not fill yet. Of ties the shard that the group's hash likes comes
    first, so that groups spread. ``wish`` is null for chunks that are best off where they are."""
    of = W.partitionBy("grp")
    cells = (
        state.repartition("grp").withColumn("held", F.sum("n").over(W.partitionBy("grp", "shard")))
        .withColumn("rank", F.dense_rank().over(of.orderBy(F.col("held").desc(), F.xxhash64("grp", "shard"), "shard")))
        .withColumn("wide", F.ceil(F.sum("n").over(of) / quota))
        .withColumn("pick", F.when(F.col("rank") > F.col("wide"), 1 + F.pmod(F.xxhash64("salt", F.lit(turn)), F.col("wide"))))
    )
    top = F.when((F.col("rank") <= F.col("wide")) & ((F.col("held") < quota) | (F.col("wide") == 1)), F.struct("rank", "shard"))
    wanted = F.filter(F.collect_set(top).over(of), lambda x: x["rank"] == F.col("pick"))
    u = F.when(F.col("wide") > 1, _unit("grp", "salt", F.lit(turn))).otherwise(_unit("grp", F.lit(turn)))
    return cells.select("grp", "salt", "n", "shard", F.get(wanted, F.lit(0))["shard"].alias("wish"), u.alias("u"))


def flows(wished: DataFrame, loads: DataFrame, most: float) -> DataFrame:
    """``shard, wish, part``: the share of each flow between two shards that may pass. A table of shards squared at most."""
    asked = wished.where("wish IS NOT NULL").groupBy("shard", "wish").agg(F.sum("n").alias("asked"))
    back = asked.select(F.col("wish").alias("shard"), F.col("shard").alias("wish"), F.col("asked").alias("back"))
    both = asked.join(back, ["shard", "wish"], "left").withColumn("swap", F.least("asked", F.coalesce("back", F.lit(0))))
    rest = both.groupBy("wish").agg(F.sum(F.col("asked") - F.col("swap")).alias("rest"))
    room = F.greatest(F.lit(0.0), F.lit(most) - F.coalesce("load", F.lit(0)))
    free = rest.join(loads.withColumnRenamed("shard", "wish"), "wish", "left").select(
        "wish", F.when(F.col("rest") > 0, F.least(F.lit(1.0), room / F.col("rest"))).otherwise(0.0).alias("share")
    )
    passing = F.col("swap") + (F.col("asked") - F.col("swap")) * F.col("share")
    return both.join(free, "wish").select("shard", "wish", (passing / F.col("asked")).alias("part"))


def propagate(state: DataFrame, quota: int, rounds: int) -> DataFrame:
    """Rounds of moves on chunks ``grp, salt, n, shard``, until hardly any more chunk can move."""
    now, waiting = state, None
    for turn in range(rounds):
        wished = durable(wishes(now, quota, turn))
        want = wished.where("wish IS NOT NULL").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if not want or (waiting is not None and want > 0.95 * waiting):
            return now
        part = flows(wished, wished.groupBy("shard").agg(F.sum("n").alias("load")), quota * (1 + SLACK))
        moved = F.when(F.col("u") < F.col("part"), F.col("wish")).otherwise(F.col("shard"))
        now, waiting = wished.join(part, ["shard", "wish"], "left").select("grp", "salt", "n", moved.alias("shard")), want
    return durable(now)


def pieces(state: DataFrame, shards: int, total: int, buckets: int) -> tuple[DataFrame, DataFrame]:
    """Where linked documents stay in the end, as ``grp, salt, low, high, shard`` (the documents of a chunk from number
    ``low`` to before ``high``), and the places left for the others, as ``shard, first, end`` on one line."""
    spark = state.sparkSession
    base, extra = divmod(total, shards)
    quota = (F.lit(base) + (F.col("shard") < extra).cast("int")).cast("long")
    # The shards that hold most of a group larger than a shard keep it, then whole groups stay as far as there are places.
    # What is on the edge of a shard or still in pieces goes, to be laid side by side elsewhere.
    cells = state.groupBy("grp", "shard").agg(F.sum("n").alias("held"))
    of = W.partitionBy("grp")
    nth = F.row_number().over(of.orderBy(F.col("held").desc(), "shard"))
    known = cells.withColumn("all", F.sum("held").over(of)).withColumn("large", F.col("all") > base)
    known = known.withColumn("stays", F.when(F.col("large"), nth <= F.ceil(F.col("all") / max(1, base))).otherwise(F.count("*").over(of) == 1))
    laid = running(known.where("stays"), ["shard"], F.when(F.col("large"), 0).otherwise(1 + _bucket(buckets, "grp")), ["grp"], F.col("held"), "start")
    room = F.greatest(F.lit(0), quota - F.col("start"))
    fits = F.when(F.col("large") | (F.col("held") <= room), F.least(F.col("held"), room)).otherwise(0)
    within = state.join(laid.select("grp", "shard", fits.alias("fits")), ["grp", "shard"], "left")
    inner = F.sum("n").over(W.partitionBy("grp", "shard").orderBy("salt").rowsBetween(W.unboundedPreceding, -1))
    kept = F.greatest(F.lit(0), F.least(F.col("n"), F.coalesce("fits", F.lit(0)) - F.coalesce(inner, F.lit(0))))
    cut = durable(within.withColumn("kept", kept).drop("fits"))
    stay = cut.where("kept > 0").select("grp", "salt", F.lit(0).cast("long").alias("low"), F.col("kept").alias("high"), "shard")
    over = cut.where("kept < n").select("grp", "salt", "kept", (F.col("n") - F.col("kept")).alias("more"))
    spilled = running(over, [], _bucket(buckets, "grp"), ["grp", "salt"], F.col("more"), "begin")
    every = spark.range(shards).select(F.col("id").cast("int").alias("shard"))

    def spans(taken: DataFrame) -> DataFrame:
        """Free places of the shards, one after another; a row a shard."""
        held = taken.groupBy("shard").agg(F.sum(F.col("high") - F.col("low")).alias("load"))
        free = every.join(held, "shard", "left").select("shard", (quota - F.coalesce("load", F.lit(0))).alias("free"))
        upto = F.sum("free").over(W.orderBy("shard"))
        return free.select("shard", (upto - F.col("free")).alias("first"), upto.alias("end")).where("end > first")

    meets = (F.col("begin") < F.col("end")) & (F.col("begin") + F.col("more") > F.col("first"))
    low = F.col("kept") + F.greatest(F.lit(0), F.col("first") - F.col("begin"))
    high = F.col("kept") + F.least(F.col("more"), F.col("end") - F.col("begin"))
    gone = spilled.join(F.broadcast(spans(stay)), meets).select("grp", "salt", low.alias("low"), high.alias("high"), "shard")
    found = durable(stay.union(gone))
    return found, durable(spans(found))


def shard_documents(
    docs: DataFrame, shards: int = 24, text: str = "text", doc_id: str = "doc_id", rounds: int = 8
) -> DataFrame:
    """``docs`` without its text, with ``size`` (UTF-8 bytes plus 8), ``text_crc32``, ``law``, ``shard``, ``slot`` and
    ``grown_shard`` (null under this law)."""
    p = Passed(docs, MADE, (text,))
    body = p[text].cast("binary")
    thin = written(
        p.frame.select(
            *p.kept,
            F.coalesce(F.octet_length(body) + 8, F.lit(8)).cast("long").alias("size"),
            F.coalesce(F.crc32(body), F.lit(0)).cast("long").alias("text_crc32"),
            F.coalesce(F.xxhash64(F.sha2(body, 256)), F.lit(0)).alias("grp"),
            F.xxhash64(p[doc_id].cast("string")).alias("key"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    total = thin.count()
    salt = _bucket(max(SALTS, total // CHUNK_ROWS), "key", "row").alias("salt")
    rows = thin.select("row", "grp", "key", salt)
    chunks = rows.groupBy("grp", "salt").agg(F.count("*").alias("n"), F.min("key").alias("key"))
    linked = chunks.withColumn("all", F.sum("n").over(W.partitionBy("grp"))).where("all > 1")
    state = durable(linked.select("grp", "salt", "n", _bucket(shards, "grp", "key").alias("shard")))
    buckets = max(MIN_BUCKETS, min(MOST_BUCKETS, -(-total // (shards * BUCKET_ROWS))))
    placed, spans = pieces(propagate(state, max(1, total // shards), rounds), shards, total, buckets)
    # Documents of chunks, numbered within their chunk; the others fill what is free.
    nth = F.row_number().over(W.partitionBy("grp", "salt").orderBy("row")) - 1
    numbered = rows.select("row", "grp", "salt", nth.alias("nth")).join(placed, ["grp", "salt"], "left")
    numbered = durable(numbered.where("shard IS NULL OR (nth >= low AND nth < high)").select("row", "shard"))
    alone = running(numbered.where("shard IS NULL").select("row"), [], _bucket(4 * buckets, "row"), ["row"], F.lit(1), "nth")
    fill = alone.join(F.broadcast(spans), (F.col("nth") >= F.col("first")) & (F.col("nth") < F.col("end"))).select("row", "shard")
    done = numbered.where("shard IS NOT NULL").union(fill)
    # Another hash than the one that filled free places in order, or a shard's documents would all be of one bucket.
    slots = running(done, ["shard"], _bucket(4 * buckets, "row", F.lit(1)), ["row"], F.lit(1), "slot")
    return thin.join(slots, "row").select(
        *p.back, "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
