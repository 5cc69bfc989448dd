"""Not-modified revisits resolved to the full responses they stand for.

A revisit record ("304 Not Modified") has no body. It refers to the latest
earlier full response of the same canonical URL, if their validators agree, and
updates the stored headers with those that such an answer may carry.

Earlier means a smaller (time, record_id). The as-of join runs in windows of
(URL, time slice); what a slice starts with comes from a table with one row per
URL and slice, so a URL with a large share of all captures is spread over its
slices. Bodies stay where they are: results name the response to read.

Defined cases: a null URL or time is never resolved ("no_response"). A revisit
with an entity tag is checked by it alone (weak tags compare without W/), one
without by its modification date, one with neither is taken as it is
("unvalidated"). Where validators differ ("mismatch") the revisit keeps its own
headers. Null headers are none. Equal times are settled by record_id; rows equal
in both are not earlier than each other. Repeated revisits are each resolved.
An empty table gives an empty table; columns beyond the named ones are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Headers of a 304 answer that replace stored ones (RFC 9110, section 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Seconds of a time slice.
SLICE = 3600


def canonical_url(url: str) -> Column:
    """Host in lower case without www., m. or default port; path without trailing slash; sorted query without tracking; no fragment."""
    bare = F.regexp_replace(url, "#.*$", "")
    head = "^[A-Za-z][A-Za-z0-9+.-]*://"
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, head + "([^/?]*)", 1)), r"^(www|m)\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, head + "[^/?]*([^?]*)", 1), "/+$", "")
    params = F.split(F.regexp_extract(bare, r"[?](.*)$", 1), "&")
    query = F.array_join(F.array_sort(F.filter(params, lambda p: (p != "") & ~F.rlike(p, F.lit("^(utm_[^=]*|ref)(=|$)")))), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def _tag(c: Column) -> Column:
    return F.regexp_replace(c, "^W/", "")


def resolve(captures: DataFrame, slice_seconds: int = SLICE) -> DataFrame:
    """(record_id, canonical, status, refers_to, digest, headers) of each revisit.

    ``captures`` has record_id, kind ("response" or "revisit"), url, ts (seconds),
    etag, last_modified, headers (map of lower-case names) and digest of the body.
    """
    rows = captures.select("record_id", "kind", canonical_url("url").alias("canonical"), "ts", "etag", "last_modified", "headers", "digest")
    rows = rows.withColumn("slice", F.floor(F.col("ts") / slice_seconds).cast("bigint"))
    full = F.when(F.col("kind") == "response", F.struct("ts", "record_id", "etag", "last_modified", "headers", "digest"))
    rows = rows.withColumn("full", full)
    order = Window.partitionBy("canonical").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = rows.filter("canonical is not null and slice is not null").groupBy("canonical", "slice").agg(
        F.max_by("full", F.when(F.col("full").isNotNull(), F.struct("ts", "record_id"))).alias("latest"))
    carried = slices.select("canonical", "slice", F.last("latest", ignorenulls=True).over(order).alias("carried"))
    # Within a slice: the last response before this row; a response sorts behind revisits of the same place.
    place = Window.partitionBy("canonical", "slice").orderBy("ts", "record_id", F.col("full").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.withColumn("near", F.last("full", ignorenulls=True).over(place)).filter("kind = 'revisit'")
    joined = seen.join(carried, ["canonical", "slice"], "left").withColumn(
        "found", F.when(F.col("canonical").isNotNull() & F.col("ts").isNotNull(), F.coalesce("near", "carried")))
    same = F.when(F.col("etag").isNotNull(), F.coalesce(_tag(F.col("etag")) == _tag(F.col("found.etag")), F.lit(False))).otherwise(
        F.coalesce(F.col("last_modified") == F.col("found.last_modified"), F.lit(False)))
    status = F.when(F.col("found").isNull(), "no_response").when(F.col("etag").isNull() & F.col("last_modified").isNull(), "unvalidated").when(same, "resolved").otherwise("mismatch")
    empty = F.expr("cast(map() as map<string,string>)")
    own, stored = F.coalesce("headers", empty), F.coalesce(F.col("found.headers"), empty)
    fresh = F.map_filter(own, lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(stored, lambda k, v: ~F.array_contains(F.map_keys(fresh), k)), fresh)
    taken = F.col("status").isin("resolved", "unvalidated")
    return joined.withColumn("status", status).select(
        "record_id", "canonical", "status", F.when(taken, F.col("found.record_id")).alias("refers_to"), F.when(taken, F.col("found.digest")).alias("digest"),
        F.when(taken, merged).otherwise(own).alias("headers"))


def captures(pages: DataFrame) -> DataFrame:
    """A capture log derived from pages: a response of each and four revisits.

    The first revisit has the page's tag, the second another one for every third
    page, the third only a date, the fourth neither and a time before the page's
    own. Their URLs vary in ways that don't change the canonical one.
    """
    time = F.lit(1_600_000_000) + F.col("page_id") * 60
    tag = F.md5(F.coalesce("html", F.lit("")))
    date = time.cast("string")
    record = lambda k, kind, url, ts, etag, modified, headers, digest=F.lit(None).cast("string"): F.struct(
        (F.col("page_id") * 8 + k).alias("record_id"), F.lit(kind).alias("kind"), url.alias("url"), ts.alias("ts"), etag.alias("etag"), modified.alias("last_modified"),
        headers.alias("headers"), digest.alias("digest"))
    none = F.lit(None).cast("string")
    pairs = lambda **h: F.create_map(*[x for k, v in h.items() for x in (F.lit(k.replace("_", "-")), v)])
    again = lambda ts, **h: pairs(date=ts.cast("string"), cache_control=F.lit("max-age=120"), content_length=F.lit("0"), **h)
    other = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("x"), tag)).otherwise(F.concat(F.lit("W/"), tag))
    later = [time + 600, time + 7200, time + 90_000, time - 5]
    return pages.select(F.inline(F.array(
        record(0, "response", F.col("url"), time, tag, date, pairs(
            content_type=F.lit("text/html"), content_length=F.octet_length(F.coalesce("html", F.lit(""))).cast("string"), etag=tag, last_modified=date,
            cache_control=F.lit("max-age=60"), server=F.concat(F.lit("s"), (F.col("page_id") % 5).cast("string"))), F.sha2(F.coalesce("html", F.lit("")), 256)),
        record(1, "revisit", F.concat("url", F.lit("#again")), later[0], tag, none, again(later[0], etag=tag)),
        record(2, "revisit", F.regexp_replace("url", "^https?://", "HTTPS://"), later[1], other, date, again(later[1], etag=other)),
        record(3, "revisit", F.col("url"), later[2], none, date, again(later[2], expires=later[2].cast("string"))),
        record(4, "revisit", F.col("url"), later[3], none, none, again(later[3])),
    )))
