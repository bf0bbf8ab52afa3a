"""WARC: resolution of not-modified revisits.

A revisit record (HTTP 304, profile server-not-modified) has no payload; its page is that of the latest earlier full
response for the same canonical URL. The as-of join is two-level: within a URL's time slice by a window, and across
slices by each slice's last response, so a URL that holds a large part of all records is not ordered in one task.
Payloads are not shuffled: the join carries record ids, validators and headers, and `attach_payload` fetches payloads
by id where they are wanted.

Validators: if the revisit has an ETag, it must equal the response's by weak comparison (a leading ``W/`` aside); else
if it has a Last-Modified, that must be equal; with neither, the earlier response is taken. Merging: the response's
headers, updated by those of the revisit that a 304 may carry (``PERMITTED``).

Defined results: status ``resolved``, ``validator_mismatch``, ``no_earlier_response`` or ``no_url_or_date`` (a null or
empty URL or a null date). Earlier is strictly earlier; of responses of one time the one with the largest id counts,
a null id least. Null headers are none; repeated revisits are resolved each for itself; an empty table gives an empty
table; columns other than the five named are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Headers of a 304 response that update the stored response.
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that do not choose a page.
TRACKING = "^(utm_[^=]*|gclid|fbclid)(=|$)"
SLICE_SECONDS = 86_400


def canonical_url(uri):
    """Host in lower case without ``www.``, user or default port, path without a trailing slash, parameters in order
    without tracking; scheme and fragment go. Null for a null or empty URL or one without a host."""
    u = F.regexp_replace(F.trim(uri), "#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(u, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?([^/?:]*)", 1)), "^www\\.", "")
    port = F.regexp_extract(u, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*:([0-9]+)(?:[/?]|$)", 1)
    path = F.regexp_replace(F.regexp_extract(u, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*(/[^?]*)", 1), "/+$", "")
    query = F.regexp_extract(u, "\\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    full = F.concat(
        host,
        F.when(port.isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), port)),
        path,
        F.when(F.size(kept) == 0, "").otherwise(F.concat(F.lit("?"), F.array_join(kept, "&"))),
    )
    return F.when(host != "", full)


def lower_keys(headers):
    """Headers by lower-case name; of names that differ only in case the last value in name order stays."""
    entries = F.array_sort(F.map_entries(headers))
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    value = lambda n: F.element_at(F.filter(entries, lambda e: F.lower(e["key"]) == n), -1)["value"]
    return F.coalesce(F.map_from_arrays(names, F.transform(names, value)), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))


def resolve_revisits(
    records: DataFrame,
    record_id: str = "record_id",
    kind: str = "kind",
    uri: str = "uri",
    at: str = "at",
    headers: str = "headers",
    slice_seconds: int = SLICE_SECONDS,
) -> DataFrame:
    """``record_id, canonical, at, status, response_id, headers`` for every record of kind ``revisit``; records of kind
    ``response`` are full responses. ``headers`` is a map of strings, ``at`` a timestamp."""
    events = records.where(F.col(f"`{kind}`").isin("response", "revisit")).select(
        F.col(f"`{record_id}`").alias("record_id"),
        (F.col(f"`{kind}`") == "response").alias("full"),
        canonical_url(F.col(f"`{uri}`")).alias("canonical"),
        F.col(f"`{at}`").alias("at"),
        lower_keys(F.col(f"`{headers}`")).alias("headers"),
    )
    apart = F.col("canonical").isNull() | F.col("at").isNull()
    slot = F.floor(F.unix_timestamp("at") / slice_seconds)
    placed = events.where(~apart).withColumn("slot", slot)
    stored = F.struct("record_id", "headers")
    # A response is seen only by later times: of one time, revisits come before responses.
    own = W.partitionBy("canonical", "slot").orderBy("at", "full", "record_id").rowsBetween(W.unboundedPreceding, 0)
    seen = placed.withColumn("here", F.last(F.when(F.col("full"), stored), ignorenulls=True).over(own)).where(~F.col("full"))
    latest = F.max_by(F.when(F.col("full"), stored), F.when(F.col("full"), F.struct("at", "record_id")))
    before = W.partitionBy("canonical").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    carried = placed.groupBy("canonical", "slot").agg(latest.alias("last")).select(
        "canonical", "slot", F.last("last", ignorenulls=True).over(before).alias("carried")
    )
    found = seen.join(carried.where(F.col("carried").isNotNull()), ["canonical", "slot"], "left").select(
        "record_id", "canonical", "at", "headers", F.coalesce("here", "carried").alias("old")
    )
    weak = lambda m: F.regexp_replace(F.element_at(m, "etag"), "^W/", "")
    mine, theirs = F.col("headers"), F.col("old.headers")
    same = (
        F.when(F.element_at(mine, "etag").isNotNull(), F.coalesce(weak(mine) == weak(theirs), F.lit(False)))
        .when(F.element_at(mine, "last-modified").isNotNull(), F.coalesce(F.element_at(mine, "last-modified") == F.element_at(theirs, "last-modified"), F.lit(False)))
        .otherwise(True)
    )
    status = F.when(F.col("old").isNull(), "no_earlier_response").when(same, "resolved").otherwise("validator_mismatch")
    judged = found.withColumn("status", status)
    new = F.map_filter("headers", lambda k, _: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(theirs, lambda k, _: ~F.map_contains_key(new, k)), new)
    good = F.col("status") == "resolved"
    out = judged.select(
        "record_id", "canonical", "at", "status",
        F.when(F.col("status") != "no_earlier_response", F.col("old.record_id")).alias("response_id"),
        F.when(good, merged).otherwise(F.col("headers")).alias("headers"),
    )
    rest = events.where(apart & ~F.col("full")).select(
        "record_id", "canonical", "at", F.lit("no_url_or_date").alias("status"),
        F.lit(None).cast(events.schema["record_id"].dataType).alias("response_id"), "headers",
    )
    return out.union(rest)


def attach_payload(resolved: DataFrame, records: DataFrame, record_id: str = "record_id", payload: str = "payload") -> DataFrame:
    """``resolved`` with the payload of its response; null where it was not resolved. Response ids are taken as unique."""
    bodies = records.select(F.col(f"`{record_id}`").alias("__id"), F.col(f"`{payload}`").alias("payload"))
    return resolved.join(bodies, (F.col("response_id") == F.col("__id")) & (F.col("status") == "resolved"), "left").drop("__id")


def header_lines(headers):
    """Headers as ``name: value`` lines in name order."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def records_of_pages(pages: DataFrame) -> DataFrame:
    """A crawl made of the page table: each page is a full response at minute ``page_id``, and is asked for again as its
    crc32 decides: up to a day later or up to two hours earlier, by another spelling of its URL, and with the page's
    ETag or, for one in seven, one that has changed."""
    start = F.lit(1_704_067_200)
    h = F.crc32(F.col("page_id").cast("string").cast("binary"))
    first = start + F.col("page_id") * 60
    etag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce(F.col("html"), F.lit("")).cast("binary")), 1, 16), F.lit('"'))
    text = lambda n: n.cast("string")
    full = pages.select(
        F.concat(F.lit("response-"), text(F.col("page_id"))).alias("record_id"),
        F.lit("response").alias("kind"),
        F.col("url").alias("uri"),
        F.timestamp_seconds(first).alias("at"),
        F.create_map(
            F.lit("Content-Type"), F.lit("text/html; charset=utf-8"),
            F.lit("Content-Length"), text(F.coalesce(F.octet_length("html"), F.lit(0))),
            F.lit("ETag"), etag, F.lit("Date"), text(first), F.lit("Last-Modified"), text(first - 3600),
            F.lit("Cache-Control"), F.lit("max-age=60"),
        ).alias("headers"),
    )
    again = first + F.pmod(h, F.lit(93_600)) - 7_200
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)
    spelled = F.concat(F.lit("https://"), F.upper(host), F.regexp_replace("url", "^[a-z]+://[^/?#]*", ""))
    revisit = pages.where(h % 5 != 0).select(
        F.concat(F.lit("revisit-"), text(F.col("page_id"))).alias("record_id"),
        F.lit("revisit").alias("kind"),
        spelled.alias("uri"),
        F.timestamp_seconds(again).alias("at"),
        F.create_map(
            F.lit("ETag"), F.when(h % 7 == 0, F.lit('"changed"')).otherwise(F.concat(F.lit("W/"), etag)),
            F.lit("Date"), text(again), F.lit("Cache-Control"), F.lit("max-age=600"),
            F.lit("Content-Length"), F.lit("0"), F.lit("Connection"), F.lit("close"),
        ).alias("headers"),
    )
    return full.union(revisit)
