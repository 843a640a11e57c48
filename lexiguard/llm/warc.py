"""Not-modified revisits: find, for each one, the latest earlier full response of the same address.

An as-of join by canonical address. It is done by time slices: within a slice
a running aggregate gives the latest response, and each slice receives the
last response of the slices before it. No address needs one task for all its
captures, and no pairs are formed. Only record ids and headers move; bodies
stay where they are and are named by the resolved record.

A revisit is resolved if the latest earlier response's validators agree:
equal entity tags where both have one, compared weakly (without the mark W/),
else equal payload digests where both have one, else equal last-modified
values. Permitted headers of the revisit replace those of the response; others
stay as they were stored. Names are the same in any case of letters, and the
result has each once: of several spellings the first in order of characters, and
of both records' values the revisit's.

Records with a null or empty address match none. Ties in time are broken by
record id, the smaller first, then by validators; each row of a repeated revisit
is answered. Null header maps count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Headers that a not-modified answer may update.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Records of one address that a time slice holds on average, at most.
SLICE_RECORDS = 4096


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host without www., default port, fragment, tracking parameters or trailing slash; other parameters sorted."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    rest = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    params = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(utm_[a-z]+|gclid|fbclid|ref)(=|$)")))
    tail = F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise(F.lit(""))
    web = F.when(scheme.isin("http", "https"), F.lit("http")).otherwise(scheme)
    return F.when(host == "", F.lit(None)).otherwise(F.concat(web, F.lit("://"), host, path, tail))


def merged_headers(stored: Column, fresh: Column) -> Column:
    empty = F.array().cast("array<struct<key:string,value:string>>")
    old, new = F.coalesce(F.map_entries(stored), empty), F.filter(F.coalesce(F.map_entries(fresh), empty), lambda e: F.lower(e.key).isin(*PERMITTED))
    both = F.concat(F.array_sort(new), F.array_sort(old))
    names = F.transform(both, lambda e: F.lower(e.key))
    return F.map_from_entries(F.filter(both, lambda e, i: F.array_position(names, F.lower(e.key)) == i + 1))


def opaque_tag(tag: Column) -> Column:
    """An entity tag without the mark of a weak one."""
    return F.regexp_replace(F.trim(tag), "^W/", "")


def resolve_revisits(records: DataFrame, slice_width: int = 1) -> DataFrame:
    """One row for each record of type 'revisit': its id, address, the resolved response and how, merged headers.

    records: record_id, url, at (long), kind ('response' with a body, or
    'revisit'), etag, last_modified, digest (strings), headers (map). at is cut
    into slices of slice_width. status is 'resolved', 'changed' where the
    latest earlier response's validators differ, or 'missing'; an empty table
    gives no rows.
    """
    r = records.select(
        "record_id", canonical_url(F.col("url")).alias("address"), "at", (F.col("kind") == "revisit").alias("is_revisit"), "etag", "last_modified", "digest", "headers",
        F.floor(F.col("at") / F.lit(slice_width)).alias("slice"),
    ).where(F.col("address").isNotNull() & F.col("at").isNotNull())
    response = F.when(~F.col("is_revisit"), F.struct("record_id", "at", "etag", "last_modified", "digest", "headers"))
    r = r.withColumn("response", response)
    ties = ("etag", "last_modified", "digest")
    order = [F.col("at"), F.col("record_id"), *ties]
    within = Window.partitionBy("address", "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    lasts = r.where(~F.col("is_revisit")).groupBy("address", "slice").agg(F.max_by("response", F.struct("at", "record_id", *ties)).alias("last_response"))
    slices = r.groupBy("address", "slice").agg(F.max("is_revisit").alias("has_revisit")).join(lasts, ["address", "slice"], "left")
    before = Window.partitionBy("address").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.select("address", "slice", "has_revisit", F.last("last_response", ignorenulls=True).over(before).alias("carried")).where("has_revisit").drop("has_revisit")
    found = r.withColumn("near", F.last("response", ignorenulls=True).over(within)).where("is_revisit").drop("response")
    found = found.join(carried, ["address", "slice"], "left").withColumn("got", F.coalesce("near", "carried"))

    def both(name: str) -> Column:
        return F.col(name).isNotNull() & F.col(f"got.{name}").isNotNull()

    agrees = F.when(both("etag"), opaque_tag(F.col("etag")) == opaque_tag(F.col("got.etag"))).when(both("digest"), F.col("digest") == F.col("got.digest")).when(both("last_modified"), F.col("last_modified") == F.col("got.last_modified")).otherwise(F.lit(False))
    status = F.when(F.col("got").isNull(), "missing").when(agrees, "resolved").otherwise("changed")
    kept = found.withColumn("status", status)
    lost = records.where((F.col("kind") == "revisit") & (canonical_url(F.col("url")).isNull() | F.col("at").isNull()))
    empty = F.create_map().cast("map<string,string>")
    return kept.select(
        "record_id", "address", "status",
        F.when(F.col("status") == "resolved", F.col("got.record_id")).alias("response_id"),
        F.when(F.col("status") == "resolved", merged_headers(F.col("got.headers"), F.col("headers"))).otherwise(F.coalesce("headers", empty)).alias("headers"),
    ).unionByName(lost.select("record_id", canonical_url(F.col("url")).alias("address"), F.lit("missing").alias("status"), F.lit(None).cast(records.schema["record_id"].dataType).alias("response_id"), F.coalesce("headers", empty).alias("headers")))


#: Pages that pass before a page is asked for again, in records_of_pages.
REVISIT_LAG = 200


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Capture records made from a pages table, which has no protocol data.

    Every page is a full response at time 2 * page_id with the MD5 of its html
    as entity tag. Its address drops the page number, which makes the pages of
    a site and language one captured address, a popular one hot. REVISIT_LAG
    pages later it is asked for again as a not-modified revisit (id -1 -
    page_id) with its own tag, which holds only if no other page of that
    address was captured in between.
    """
    body = F.coalesce("html", F.lit(""))
    site = F.regexp_replace("url", r"/[0-9]+(\.html)?", "")
    base = pages.select("page_id", site.alias("url"), F.md5(body).alias("tag"), F.length(body).cast("string").alias("size"))
    none, later = F.lit(None).cast("string"), (F.col("page_id") + REVISIT_LAG) * 2 + 1

    def headers(size: Column, at: Column) -> Column:
        return F.create_map(F.lit("etag"), F.col("tag"), F.lit("content-length"), size, F.lit("date"), at.cast("string"))

    full = base.select(F.col("page_id").alias("record_id"), "url", (F.col("page_id") * 2).alias("at"), F.lit("response").alias("kind"), F.col("tag").alias("etag"), none.alias("last_modified"), F.col("tag").alias("digest"), headers(F.col("size"), F.col("page_id") * 2).alias("headers"))
    revisit = base.select((-1 - F.col("page_id")).alias("record_id"), "url", later.alias("at"), F.lit("revisit").alias("kind"), F.col("tag").alias("etag"), none.alias("last_modified"), none.alias("digest"), headers(F.lit("0"), later).alias("headers"))
    return full.unionByName(revisit)


RESOLVE_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, regexp_replace(regexp_replace(trim(url), '/[0-9]+(\.html)?', '', 'g'), '#.*$', '') AS u FROM pages),
q AS (
  SELECT *, regexp_replace(u, '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme FROM p),
a AS (
  SELECT page_id, body,
         CASE WHEN scheme IN ('http', 'https') THEN 'http' ELSE scheme END AS scheme,
         regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^www\.', ''), ':(80|443)$', '') AS host,
         regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
         list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|gclid|fbclid|ref)(=|$)'))) AS params
  FROM q),
r AS (
  SELECT page_id, body, scheme || '://' || host || path || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS address FROM a WHERE host <> '')
SELECT -1 - v.page_id AS record_id, v.address,
       CASE WHEN f.page_id IS NULL THEN 'missing' WHEN md5(f.body) = md5(v.body) THEN 'resolved' ELSE 'changed' END AS status,
       CASE WHEN md5(f.body) = md5(v.body) THEN f.page_id ELSE -1 END AS response_id,
       md5(v.body) AS etag,
       CASE WHEN md5(f.body) = md5(v.body) THEN CAST(length(f.body) AS VARCHAR) ELSE '0' END AS content_length,
       CAST(2 * (v.page_id + 200) + 1 AS VARCHAR) AS capture_date
FROM (SELECT v.*, (SELECT max(f.page_id) FROM r f WHERE f.address = v.address AND f.page_id <= v.page_id + 200) AS fid FROM r v) v
LEFT JOIN r f ON f.page_id = v.fid
"""
