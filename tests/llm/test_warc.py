import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchloom.llm import warc

SCHEMA = T.StructType([
    T.StructField("record_id", T.StringType()), T.StructField("warc_type", T.StringType()), T.StructField("uri", T.StringType()),
    T.StructField("date", T.TimestampType()), T.StructField("profile", T.StringType()), T.StructField("status", T.IntegerType()),
    T.StructField("headers", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())]))),
    T.StructField("payload", T.StringType()),
])


def at(minute):
    return None if minute is None else datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)


def full(key, uri, minute, body, **headers):
    return (key, "response", uri, at(minute), None, 200, [(k.replace("_", "-"), v) for k, v in headers.items()], body)


def revisit(key, uri, minute, **headers):
    return (key, "revisit", uri, at(minute), warc.NOT_MODIFIED, 304, [(k.replace("_", "-"), v) for k, v in headers.items()], None)


def resolved(spark, rows, parts=3):
    got = warc.resolve(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect()
    return {r.record_id: (r.outcome, r.refers_to, r.headers and [tuple(h) for h in r.headers], r.payload) for r in got}


@pytest.mark.parametrize("url,want", [
    ("HTTP://www.Example.COM:80/A/b/?utm_source=x&b=2&a=1#top", "example.com/A/b?a=1&b=2"), ("https://user@h.net:443", "h.net"),
    ("h.net/?", "h.net"), ("http://h.net:8080/p?UTM_x=1", "h.net:8080/p"), ("", ""), ("https://h.net/a?x=/&x", "h.net/a?x&x=/"), (None, None),
    ("http://www.www.net/é ", "www.net/é"),
])
def test_canonical_urls(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(warc.canonical_url(F.col("u"))).first()[0] == want


def test_validators_and_headers(spark):
    rows = [
        full("a1", "http://x.org/p", 0, "one", ETag='W/"1"', Content_Type="t", Expires="old", Last_Modified="mon"),
        full("a2", "http://x.org/p/", 10, "two", ETag='"2"', Content_Length="3"),
        revisit("r1", "https://www.x.org/p", 5, etag='"1"', Expires="new", Content_Length="0", Vary="v"),
        revisit("r2", "http://x.org/p", 11, ETag='"1"'), revisit("r3", "http://x.org/p", 11, Date="d"),
        revisit("r4", "http://x.org/p", 10, Last_Modified="mon"), revisit("r5", "http://x.org/p", 9, Last_Modified="tue"),
        revisit("r6", "http://x.org/p", 0), revisit("r7", "http://x.org/other", 50), revisit("r8", None, 50), revisit("r9", "http://x.org/p", None),
        ("n1", "response", "http://x.org/p", at(3), None, 404, None, "no"), ("n2", "revisit", "http://x.org/p", at(30), "identical-payload-digest", 200, None, None),
        ("r10", "revisit", "http://x.org/p", at(12), None, 304, None, None), (None, None, None, None, None, None, None, None),
    ]
    got = resolved(spark, rows)
    assert got["r1"] == ("resolved", "a1", [("Content-Type", "t"), ("Last-Modified", "mon"), ("etag", '"1"'), ("Expires", "new"), ("Vary", "v")], "one")
    assert got["r2"] == ("mismatch", None, None, None)
    assert got["r3"][:2] == ("unvalidated", "a2") and ("Date", "d") in got["r3"][2] and got["r10"] == ("unvalidated", "a2", [("ETag", '"2"'), ("Content-Length", "3")], "two")
    assert got["r4"][:2] == ("resolved", "a1") and got["r5"][0] == "mismatch"
    assert all(got[k] == ("no_response", None, None, None) for k in ("r6", "r7", "r8", "r9"))
    assert len(got) == 10


def test_ties_repeats_and_a_hot_url(spark):
    rows = [full(f"f{k:04d}", "http://hot/", k // 3, f"body {k}", ETag=f'"{k}"') for k in range(600)]
    rows += [revisit(f"r{k:04d}", "http://hot/", k) for k in range(250)]
    rows += [rows[-1], rows[0]]  # repeated records
    got = warc.resolve(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert len(got) == 251
    for r in got:
        k = int(r.record_id[1:])
        last = min(3 * k - 1, 599)
        assert r.payload == (f"body {last}" if k else None) and r.refers_to == (f"f{last:04d}" if k else None)


def test_parsing(spark):
    text = (
        "WARC/1.1\r\nWARC-Type: response\r\nwarc-record-id: <a>\r\nWARC-Target-URI: http://h/x:y\r\nWARC-Date: 2024-02-03T04:05:06Z\r\nBroken line\r\n\r\n"
        "HTTP/1.1 200 OK\r\nETag: \"q:1\"\r\nX-Empty:\r\n\r\nbody\r\n\r\nmore é\r\n\r\n"
    )
    rows = [(text, 1), ("WARC/1.0\r\nWARC-Type: warcinfo", 2), ("junk", 3), ("", 4), (None, 5), ("WARC/1.1\r\nWARC-Date: never\r\n\r\nHTTP/x", 6)]
    got = warc.parse_records(spark.createDataFrame(rows, "record string, status int").coalesce(1)).collect()
    first = got[0]
    assert (first.record_id, first.warc_type, first.uri, first.status, first.payload) == ("<a>", "response", "http://h/x:y", 200, "body\r\n\r\nmore é")
    assert first.date == datetime.datetime(2024, 2, 3, 4, 5, 6) and [tuple(h) for h in first.headers] == [("ETag", '"q:1"'), ("X-Empty", "")]
    assert got[1].warc_type == "warcinfo" and got[1].status is None and len(got) == 6
    assert all(r.record_id is None and r.warc_type is None for r in got[2:])
    assert warc.resolve(warc.parse_records(spark.createDataFrame([], "record string"))).count() == 0
