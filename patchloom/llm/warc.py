"""WARC records, and the resolution of revisits that say "not modified".

A revisit record holds the answer 304 of a server without a body. It stands for the latest earlier full response of the same
canonical URL, provided that the validators agree: entity tags by weak comparison, or else the dates of last
modification. The resolved record has the body of that response and its headers, with those headers of the 304 in their place
that RFC 9110 lets a 304 carry.

The as-of join runs over narrow rows. They are dealt out by ranges of (URL, time), so that a URL with very many captures
spreads over many tasks; each range finds the latest response within itself, one row per URL and range carries it on to
later ranges. Only then are headers and bodies fetched, by the id of the response.

Edge cases: "earlier" means a strictly smaller date; of responses at one date the greatest record id counts; of rows with one record
id any one serves as response (they are one record); repeated revisits are all kept; revisits with a null URL or date are
not resolved (no_response); null headers count as none; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from patchloom.llm.tables import materialize

#: Header fields of a 304 that replace those of the stored response (RFC 9110, 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Fixed value: profile of a revisit by the server's word.
NOT_MODIFIED = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"

_HEADERS = "array<struct<name:string,value:string>>"


def _fields(block: Column) -> Column:
    """Header lines as (name, value)."""
    lines = F.filter(F.split(block, "\r\n"), lambda line: F.locate(":", line) > 1)
    return F.transform(lines, lambda line: F.struct(
        F.trim(F.substring_index(line, ":", 1)).alias("name"),
        F.trim(F.substr(line, F.locate(":", line) + 1)).alias("value"),
    ))


def field(headers: Column, name: str) -> Column:
    """The first value of a header; null if there is none."""
    return F.get(F.filter(headers, lambda h: F.lower(h["name"]) == name), F.lit(0))["value"]


def canonical_url(url: Column) -> Column:
    """Without scheme, user, leading "www.", default port, fragment, tracking parameters and last slash; host in lower case, parameters sorted."""
    bare = F.regexp_replace(F.trim(url), "(?s)#.*$", "")
    bare = F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    place = F.regexp_extract(bare, "^[^/?]*", 0)
    host = F.regexp_replace(F.lower(place), "^.*@", "")
    host = F.regexp_replace(F.regexp_replace(host, ":(80|443)$", ""), r"^www\.", "")
    rest = F.substr(bare, F.length(place) + 1)
    path = F.regexp_replace(F.regexp_extract(rest, "^[^?]*", 0), "/+$", "")
    asked = F.substr(rest, F.length(F.regexp_extract(rest, "^[^?]*", 0)) + 2)
    parameters = F.array_sort(F.filter(F.split(asked, "&"), lambda p: (p != "") & ~F.lower(p).rlike("^utm_")))
    return F.concat(host, path, F.when(F.size(parameters) > 0, F.concat(F.lit("?"), F.array_join(parameters, "&"))).otherwise(""))


def parse_records(raw: DataFrame, column: str = "record") -> DataFrame:
    """record_id, warc_type, uri, date, profile, status, headers and payload from whole WARC records with HTTP content.

    Text that does not begin like a WARC record has null in all columns but stays a row.
    """
    crlf2 = "\r\n\r\n"
    whole = F.when(F.col(f"`{column}`").startswith("WARC/"), F.col(f"`{column}`"))

    def before(text: Column) -> Column:
        at = F.locate(crlf2, text)
        return F.when(at > 0, F.substr(text, F.lit(1), at - 1)).otherwise(text)

    def after(text: Column) -> Column:
        at = F.locate(crlf2, text)
        return F.when(at > 0, F.substr(text, at + 4)).otherwise("")

    head = raw.select(_fields(before(whole)).alias("warc"), after(whole).alias("content"))
    both = head.select("warc", before(F.col("content")).alias("http"), after(F.col("content")).alias("body"))
    return both.select(
        field(F.col("warc"), "warc-record-id").alias("record_id"),
        field(F.col("warc"), "warc-type").alias("warc_type"),
        field(F.col("warc"), "warc-target-uri").alias("uri"),
        F.try_to_timestamp(field(F.col("warc"), "warc-date")).alias("date"),
        field(F.col("warc"), "warc-profile").alias("profile"),
        F.expr("try_cast(regexp_extract(http, '^HTTP/[0-9.]+ ([0-9]{3})', 1) as int)").alias("status"),
        _fields(F.col("http")).alias("headers"),
        F.when(F.endswith("body", F.lit(crlf2)), F.expr("substring(body, 1, length(body) - 4)")).otherwise(F.col("body")).alias("payload"),
    )


def _latest_earlier(narrow: DataFrame) -> DataFrame:
    """(row, found) of each revisit: the latest earlier full response (date, record_id, tag, modified) of its URL, or null."""
    parts = int(narrow.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(
        narrow.filter("url is not null and at is not null").repartitionByRange(parts, "url", "at")
        .withColumn("part", F.spark_partition_id())
    )
    full = F.when(F.col("full"), F.struct("at", "record_id", "tag", "modified"))
    within = Window.partitionBy("url", "part").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    seen = ranged.withColumn("near", F.max(full).over(within))
    earlier = Window.partitionBy("url").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranged.groupBy("url", "part").agg(F.max(full).alias("last")).select(
        "url", "part", F.max("last").over(earlier).alias("far")
    )
    return seen.filter("revisit").join(carried, ["url", "part"]).select(
        "record_id", "url", "tag", "modified", "row", F.coalesce("near", "far").alias("found")
    )


def resolve(records: DataFrame) -> DataFrame:
    """Revisits with profile "not modified" or status 304, and what each stands for.

    Returns record_id, url (canonical), outcome, refers_to, headers (merged) and payload. Outcomes: resolved; unvalidated (the
    304 or the response has no validator to compare; taken as resolved); mismatch and no_response (no headers, no payload).
    """
    tag = F.regexp_replace(F.trim(field(F.col("headers"), "etag")), "^[Ww]/", "")
    # stored, so that records are parsed once and filters work on plain columns
    known = materialize(records.select(
        "record_id", canonical_url(F.col("uri")).alias("url"), F.unix_micros("date").alias("at"), "headers", "payload",
        tag.alias("tag"), F.trim(field(F.col("headers"), "last-modified")).alias("modified"),
        F.coalesce((F.lower("warc_type") == "response") & (F.col("status") == 200), F.lit(False)).alias("full"),
        F.coalesce(
            (F.lower("warc_type") == "revisit") & ((F.col("profile") == NOT_MODIFIED) | (F.col("status") == 304)), F.lit(False)
        ).alias("revisit"),
    ))
    # what the headers of a 304 may replace travels with the row; headers and bodies of responses do not
    allowed = F.filter(F.coalesce("headers", F.array().cast(_HEADERS)), lambda h: F.lower(h["name"]).isin(*PERMITTED))
    narrow = known.filter("full or revisit").withColumn("row", F.when(F.col("revisit"), F.struct(allowed.alias("fresh")))).select(
        "record_id", "url", "at", "tag", "modified", "full", "revisit", "row"
    )
    late = narrow.filter("revisit and (url is null or at is null)").select(
        "record_id", "url", "tag", "modified", "row", F.lit(None).cast("struct<at:bigint,record_id:string,tag:string,modified:string>").alias("found")
    )
    asked = _latest_earlier(narrow.withColumn("record_id", F.col("record_id").cast("string"))).unionByName(late)
    tagged = F.col("tag").isNotNull() & F.col("found.tag").isNotNull()
    dated = F.col("modified").isNotNull() & F.col("found.modified").isNotNull()
    outcome = (
        F.when(F.col("found").isNull(), "no_response")
        .when(tagged, F.when(F.col("tag") == F.col("found.tag"), "resolved").otherwise("mismatch"))
        .when(dated, F.when(F.col("modified") == F.col("found.modified"), "resolved").otherwise("mismatch"))
        .otherwise("unvalidated")
    )
    judged = asked.select(
        "record_id", "url", outcome.alias("outcome"), F.col("row.fresh").alias("fresh"), F.col("found.record_id").alias("latest")
    ).withColumn("refers_to", F.when(F.col("outcome").isin("resolved", "unvalidated"), F.col("latest")))
    bodies = known.filter("full").select(
        F.col("record_id").cast("string").alias("refers_to"), F.col("headers").alias("stored"), "payload"
    ).dropDuplicates(["refers_to"])
    merged = F.concat(
        F.filter("stored", lambda h: ~F.exists("fresh", lambda f: F.lower(f["name"]) == F.lower(h["name"]))), F.col("fresh")
    )
    return judged.join(bodies, "refers_to", "left").select(
        "record_id", "url", "outcome", "refers_to", F.when(F.col("refers_to").isNotNull(), merged).alias("headers"), "payload"
    )
