"""Resolution of not-modified revisits in web archives.

A revisit record of a 304 answer has no body. It is resolved by an as-of join: the latest earlier full
response of the same canonical URL, provided its validators agree; the answer's permitted headers
replace those of the response.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwork.llm.common import materialize
from tillwork.operators.ordered import Running, scan

# Headers that a 304 answer may update (never those that describe the stored body).
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
TRACKING = "^(utm_[a-z]*|ref|fbclid|gclid|sessionid|phpsessid)="


def canonical_url(url: Column) -> Column:
    """Host in lower case without scheme, user, `www.` and default port; path without a final slash;
    query parameters sorted, without tracking ones; no fragment. Null stays null."""
    parts = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(:[0-9]*)?([^?#]*)(?:\?([^#]*))?"
    host = F.regexp_replace(F.lower(F.regexp_extract(url, parts, 1)), r"^www[0-9]*\.", "")
    port = F.regexp_replace(F.regexp_extract(url, parts, 2), "^:(80|443)?$", "")
    path = F.regexp_replace(F.regexp_extract(url, parts, 3), "/+$", "")
    given = F.filter(F.split(F.regexp_extract(url, parts, 4), "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING))
    query = F.array_join(F.array_sort(given), "&")
    found = F.concat(host, port, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(url.rlike(parts), found).otherwise(url)


def _header(headers: Column, name: str) -> Column:
    return F.element_at(headers, name)


def validators_agree(answer: Column, stored: Column) -> Column:
    """Entity tags decide, weakly compared, if both have one; else equal dates of modification; an
    answer without validators agrees with anything."""
    tag = F.regexp_replace(_header(answer, "etag"), "^W/", "")
    other = F.regexp_replace(_header(stored, "etag"), "^W/", "")
    dates = _header(answer, "last-modified") == _header(stored, "last-modified")
    silent = _header(answer, "etag").isNull() & _header(answer, "last-modified").isNull()
    return F.when(tag.isNotNull() & other.isNotNull(), tag == other).when(silent, F.lit(True)).otherwise(F.coalesce(dates, F.lit(False)))


def merged_headers(answer: Column, stored: Column) -> Column:
    """Stored headers, with permitted ones of the answer in place of theirs."""
    fresh = F.map_filter(answer, lambda k, v: k.isin(PERMITTED) & v.isNotNull())
    rest = F.map_filter(stored, lambda k, v: ~F.array_contains(F.map_keys(fresh), k))
    return F.map_concat(rest, fresh)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per revisit: record_id, canonical_url, at, outcome, response_id, headers.

    `records`: record_id, url, at (time), status, headers (map with lower-case names). Status 200 is a
    full response, 304 a revisit, others are left out. A response counts as earlier if its time is
    smaller, or equal with a smaller record_id. outcome: `resolved`; `changed` if the validators of the
    latest earlier response disagree (response_id then null, headers those of the revisit); `orphan`
    if there is none, and for a null url or time. Null headers count as none. Repeated rows are resolved each. Bodies are
    not moved: response_id names the record that has it. A URL with very many records is cut into
    segments by the ordered scan.
    """
    none = F.create_map().cast("map<string,string>")
    events = records.select("record_id", canonical_url(F.col("url")).alias("canonical_url"), "at", "status", F.coalesce("headers", none).alias("headers")).where(
        "status in (200, 304)")
    events = materialize(events, "captures")
    usable = events.where("canonical_url is not null and at is not null")
    stored = F.when(F.col("status") == 200, F.struct(F.col("record_id").alias("id"), "headers"))
    seen = scan(usable, ["canonical_url"], ["at", "record_id", "status"], [Running("latest", "last", stored, current=False)])
    answers = seen.where("status = 304").unionByName(
        events.where("status = 304 and (canonical_url is null or at is null)"), allowMissingColumns=True)
    found, agree = F.col("latest").isNotNull(), validators_agree(F.col("headers"), F.col("latest.headers"))
    return answers.select(
        "record_id", "canonical_url", "at",
        F.when(~found, "orphan").when(agree, "resolved").otherwise("changed").alias("outcome"),
        F.when(found & agree, F.col("latest.id")).alias("response_id"),
        F.when(found & agree, merged_headers(F.col("headers"), F.col("latest.headers"))).otherwise(F.col("headers")).alias("headers"))
