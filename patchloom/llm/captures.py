"""WARC records derived from `pages`, one row per record: captures of each page, its revisits, and the SQL of what these resolve to.

Each page is captured at minute page_id; a thirteenth of them again a day and a half later with other content. Revisits
name the page by another spelling of its URL: with its entity tag after a day, with its date of modification
after two (wrong for a seventh of them), without a validator after three, and one before the first capture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.llm.tables import table
from patchloom.llm.warc import NOT_MODIFIED

#: (kind of record, condition, seconds after the page's own minute); SQL that Spark and DuckDB read alike.
_CAPTURES = (
    (0, "true", 0), (1, "page_id % 3 <> 0", 86_400), (2, "page_id % 2 = 0", 172_800), (3, "page_id % 5 = 0", 259_200),
    (4, "page_id % 11 = 0", -30), (5, "page_id % 13 = 0", 129_600),
)
_URI = "CASE kind WHEN 0 THEN url WHEN 1 THEN replace(url, 'http://', 'https://www.') WHEN 2 THEN concat(url, '#again') ELSE url END"
_TAG = "CASE WHEN kind = 5 THEN concat('\"v2-', digest, '\"') WHEN page_id % 4 = 0 AND kind = 0 THEN concat('W/\"', digest, '\"') ELSE concat('\"', digest, '\"') END"
_MODIFIED = "concat('day ', CAST(CASE WHEN kind = 2 AND page_id % 7 = 0 THEN -1 ELSE page_id % 97 END AS VARCHAR(20)))"
#: (name, value, condition)
_HEADERS = (
    ("Content-Type", "'text/html'", "kind IN (0, 5)"),
    ("Date", "concat('second ', CAST(ts AS VARCHAR(20)))", "true"),
    ("ETag", _TAG, "kind IN (0, 1, 4, 5) AND (page_id % 5 <> 4 OR kind = 5)"),
    ("Last-Modified", _MODIFIED, "kind IN (0, 2, 5)"),
    ("Cache-Control", "concat('max-age=', CAST(kind * 100 AS VARCHAR(20)))", "kind IN (0, 1, 3)"),
    ("X-Served-By", "concat('cache', CAST(kind AS VARCHAR(20)))", "true"),
    ("Content-Length", "'0'", "kind NOT IN (0, 5)"),
)
_FULL = "kind IN (0, 5)"
_ID = "concat('urn:page:', CAST(page_id AS VARCHAR(20)), ':', CAST(kind AS VARCHAR(20)))"


def _kinds() -> str:
    return " UNION ALL ".join(f"SELECT {k} AS kind, {after} AS after_s" for k, _, after in _CAPTURES)


def _condition() -> str:
    return " OR ".join(f"(kind = {k} AND {when})" for k, when, _ in _CAPTURES)


def warc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`record`: every record as WARC text."""
    pages = table(spark, sf_dir, "pages")
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(s).alias("after_s")) for k, _, s in _CAPTURES)))
    rows = (
        pages.select("page_id", "url", "html", F.md5(F.encode("html", "utf-8")).alias("digest"), kinds.alias("c"))
        .select("page_id", "url", "html", "digest", "c.kind", (F.col("page_id") * 60 + F.col("c.after_s")).alias("ts"))
        .filter(_condition())
    )
    lines = [F.expr(f"CASE WHEN {when} THEN concat('{name}: ', {value}) END") for name, value, when in _HEADERS]
    stamp = F.date_format(F.timestamp_seconds(F.col("ts") + 1_700_000_000), "yyyy-MM-dd'T'HH:mm:ssXXX")
    return rows.select(F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"), F.expr(f"CASE WHEN {_FULL} THEN 'WARC-Type: response' ELSE 'WARC-Type: revisit' END"),
        F.concat(F.lit("WARC-Record-ID: "), F.expr(_ID)), F.concat(F.lit("WARC-Target-URI: "), F.expr(_URI)),
        F.concat(F.lit("WARC-Date: "), stamp),
        F.expr(f"CASE WHEN NOT ({_FULL}) THEN 'WARC-Profile: {NOT_MODIFIED}' END"), F.lit(""),
        F.expr(f"CASE WHEN {_FULL} THEN 'HTTP/1.1 200 OK' ELSE 'HTTP/1.1 304 Not Modified' END"), *lines, F.lit(""),
        F.expr(f"CASE WHEN {_FULL} THEN concat(html, CASE WHEN kind = 5 THEN ' v2' ELSE '' END) ELSE '' END"), F.lit(""), F.lit(""),
    ).alias("record"))


_CANONICAL = """
    concat(
        regexp_replace(regexp_replace(regexp_replace(lower(place), '^.*@', ''), ':(80|443)$', ''), '^www\\.', ''),
        regexp_replace(regexp_extract(rest, '^[^?]*'), '/+$', ''),
        CASE WHEN len(asked) > 0 THEN concat('?', array_to_string(asked, '&')) ELSE '' END)
"""

ORACLE = f"""
    WITH kinds AS ({_kinds()}),
    captures AS (
        SELECT *, {_ID} AS record_id, {_URI} AS uri FROM (
            SELECT page_id, url, md5(html) AS digest, html, kind, page_id * 60 + after_s AS ts FROM pages, kinds WHERE {_condition()})),
    bare AS (SELECT *, regexp_replace(regexp_replace(trim(uri), '(?s)#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM captures),
    placed AS (SELECT *, regexp_extract(bare, '^[^/?]*') AS place FROM bare),
    resting AS (SELECT *, substr(bare, length(place) + 1) AS rest FROM placed),
    asking AS (
        SELECT *, list_sort(list_filter(string_split(substr(rest, length(regexp_extract(rest, '^[^?]*')) + 2), '&'),
            lambda p: p <> '' AND NOT regexp_matches(lower(p), '^utm_'))) AS asked FROM resting),
    records AS (
        SELECT record_id, {_CANONICAL} AS curl, ts, kind, {_FULL} AS is_full,
               CASE WHEN {_HEADERS[2][2]} THEN replace({_TAG}, 'W/', '') END AS tag,
               CASE WHEN {_HEADERS[3][2]} THEN {_MODIFIED} END AS modified,
               list_filter([{', '.join(f"CASE WHEN {when} THEN {{'name': '{name}', 'value': {value}}} END" for name, value, when in _HEADERS)}],
                           lambda h: h IS NOT NULL) AS headers,
               md5(concat(html, CASE WHEN kind = 5 THEN ' v2' ELSE '' END)) AS digest FROM asking),
    responses AS (
        SELECT curl, ts, max(record_id) AS record_id FROM records WHERE is_full GROUP BY curl, ts),
    full_ones AS (SELECT r.* FROM records r JOIN responses USING (record_id)),
    found AS (
        SELECT v.record_id, v.curl, v.tag, v.modified, v.headers AS own, s.record_id AS latest, s.tag AS s_tag, s.modified AS s_modified,
               s.headers AS stored, s.digest
        FROM (SELECT * FROM records WHERE NOT is_full) v ASOF LEFT JOIN full_ones s ON v.curl = s.curl AND v.ts > s.ts),
    judged AS (
        SELECT *, list_filter(own, lambda h: lower(h.name) IN ('cache-control', 'content-location', 'date', 'etag', 'expires', 'vary')) AS fresh,
               CASE WHEN latest IS NULL THEN 'no_response'
                    WHEN tag IS NOT NULL AND s_tag IS NOT NULL THEN CASE WHEN tag = s_tag THEN 'resolved' ELSE 'mismatch' END
                    WHEN modified IS NOT NULL AND s_modified IS NOT NULL THEN CASE WHEN modified = s_modified THEN 'resolved' ELSE 'mismatch' END
                    ELSE 'unvalidated' END AS outcome FROM found)
    SELECT record_id, curl AS url, outcome, CASE WHEN outcome IN ('resolved', 'unvalidated') THEN latest END AS refers_to,
           CASE WHEN outcome IN ('resolved', 'unvalidated') THEN array_to_string(list_transform(
               list_concat(list_filter(stored, lambda h: NOT list_contains(list_transform(fresh, lambda f: f.name), h.name)), fresh),
               lambda h: concat(h.name, ': ', h.value)), chr(10)) END AS headers,
           CASE WHEN outcome IN ('resolved', 'unvalidated') THEN digest END AS payload_md5
    FROM judged
"""
