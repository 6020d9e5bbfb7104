"""WARC not-modified revisits: an as-of join to the latest earlier full response of the canonical URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.shared import own_columns, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Records of a part of the time line, and the parts at least and most. A URL's records are dealt out by part, so a hot URL is no single task.
PART_RECORDS, PARTS_LEAST, PARTS_MOST = 50_000, 64, 4096
#: Header fields that a not-modified answer may update in the stored response.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "set-cookie", "vary", "warning"]
#: Ticks of the crawl clock of the registered query, and the steps by which page ids give the ticks of responses and revisits.
TICKS, STEP_FULL, STEP_AGAIN = 1009, 7, 13


def canonical_url(url: Column) -> Column:
    """Host without case, leading www. and default port; path without trailing slashes; query sorted and without utm_ fields; no scheme or fragment. Null without a host."""
    tail = F.regexp_replace(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), r"(?s)#.*$", "")
    host = F.translate(F.regexp_extract(tail, r"^[^/?]*", 0), UPPER, LOWER)
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(tail, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.split(F.regexp_extract(tail, r"(?s)\?(.*)$", 1), "&")
    query = F.array_join(F.array_sort(F.filter(query, lambda x: (x != "") & ~x.startswith("utm_"))), "&")
    return F.when(host != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def weak(etag: Column) -> Column:
    """An entity tag without its weakness mark: revisits compare weakly."""
    return F.regexp_replace(etag, r"^W/", "")


def part_of(ts: Column, edges: list[int]) -> Column:
    """How many of the sorted *edges* are at most *ts*: first among every 64th of them, then among those between."""
    if not edges:
        return F.lit(0)
    coarse = F.array(*[F.lit(e) for e in edges[63::64]]) if len(edges) > 63 else F.array().cast("array<bigint>")
    fine = F.array(*[F.array(*[F.lit(e) for e in edges[i : i + 63]]) for i in range(0, len(edges), 64)])
    block = F.size(F.filter(coarse, lambda e: e <= ts))
    within = F.coalesce(F.get(fine, block), F.array().cast("array<bigint>"))
    return F.when(ts.isNull(), 0).otherwise(block * 64 + F.size(F.filter(within, lambda e: e <= ts)))


def resolve_revisits(records: DataFrame, parts: int | None = None) -> DataFrame:
    """Every revisit of *records* with canonical, response_id, outcome and merged.

    *records*: record_id, url, ts (bigint), revisit (boolean), etag, last_modified, digest, headers
    (map of lower-case names). A revisit belongs to the latest full response of its canonical URL with a
    smaller ts; of several at one ts the one of the largest record_id. outcome is `resolved` if a
    validator that both have agrees (entity tag, else date, else payload digest), `mismatch` if it
    differs, `unverified` if they share none, `missing` without an earlier response or canonical URL.
    merged holds, for a resolved or unverified revisit, the stored headers updated by those that a
    not-modified answer may change, sorted, as `name: value` lines; else null.

    The records of a URL and tick are one row first: their last response, combined before the shuffle. The time line is cut at
    quantiles into *parts* (by the number of records, where none is given); within a part a window finds the latest response,
    and across parts only one response a URL and part is carried on. So a URL, or a tick, with a third of all records is
    spread over the parts or is a few rows. A null ts is before all others for a response and has nothing before it for a
    revisit. Repeated rows stay; extra columns are ignored; an empty table gives an empty result.
    """
    r = own_columns(records, "record_id", "url", "ts", "revisit", "etag", "last_modified", "digest", "headers")
    r = r.withColumn("canonical", canonical_url(F.col("url"))).withColumn("revisit", F.coalesce("revisit", F.lit(False)))
    if parts is None:
        parts = min(PARTS_MOST, max(PARTS_LEAST, r.count() // PART_RECORDS))
    edges = r.agg(F.percentile_approx("ts", [i / parts for i in range(1, parts)], 10_000).alias("e")).first().e or []
    stored = F.struct("ts", "record_id", "etag", "last_modified", "digest", F.array_sort(F.map_entries("headers")).alias("headers"))
    ticks = (
        r.filter("canonical is not null")
        .groupBy("canonical", "ts")
        .agg(F.max(F.when(~F.col("revisit"), stored)).alias("full"), F.bool_or("revisit").alias("asked"))
        .withColumn("part", part_of(F.col("ts"), sorted(set(edges))))
    )
    near = Window.partitionBy("canonical", "part").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)  # a tick is one row
    own = ticks.withColumn("found", F.max("full").over(near)).filter("asked and ts is not null").select("canonical", "part", "ts", "found")
    marks = ticks.groupBy("canonical", "part").agg(F.max("full").alias("last"))  # at most a row for each part of a URL
    before = Window.partitionBy("canonical").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = marks.withColumn("carry", F.max("last").over(before)).select("canonical", "part", "carry").filter("carry is not null")
    answers = own.join(carry, ["canonical", "part"], "left").select("canonical", "ts", F.coalesce("found", "carry").alias("found"))
    out = r.filter("revisit").join(answers, ["canonical", "ts"], "left")
    agrees = (
        F.when(F.col("etag").isNotNull() & F.col("found.etag").isNotNull(), weak(F.col("etag")) == weak(F.col("found.etag")))
        .when(F.col("last_modified").isNotNull() & F.col("found.last_modified").isNotNull(), F.col("last_modified") == F.col("found.last_modified"))
        .when(F.col("digest").isNotNull() & F.col("found.digest").isNotNull(), F.col("digest") == F.col("found.digest"))
    )
    out = out.withColumn("outcome", F.when(F.col("found").isNull(), "missing").when(agrees, "resolved").when(~agrees, "mismatch").otherwise("unverified"))
    permitted = F.array(*[F.lit(x) for x in PERMITTED])
    fresh = F.filter(F.map_entries(F.coalesce("headers", F.create_map().cast("map<string,string>"))), lambda x: F.array_contains(permitted, x.key))
    kept = F.filter(F.coalesce(F.col("found.headers"), F.array().cast("array<struct<key:string,value:string>>")), lambda x: ~F.exists(fresh, lambda y: y.key == x.key))
    lines = F.array_join(F.array_sort(F.transform(F.concat(kept, fresh), lambda x: F.concat(x.key, F.lit(": "), F.coalesce(x.value, F.lit(""))))), "\n")
    return out.select("record_id", "canonical", F.col("found.record_id").alias("response_id"), "outcome", F.when(F.col("outcome").isin("resolved", "unverified"), lines).alias("merged"))


def crawl_of(pages: DataFrame) -> DataFrame:
    """Two records of each page: a full response and a conditional fetch, at ticks that the page id deals out, so that either may come first.

    By page id mod 4 the fetch has an entity tag, a date, a digest or no validator; that of every fifth page is
    of another version. Every sixth response has no entity tag.
    """
    html, page = F.coalesce("html", F.lit("")), F.col("page_id")
    tag, date = F.concat(F.lit('"'), F.substring(F.md5(html), 1, 16), F.lit('"')), F.concat(F.lit("day "), F.length(html) % 97)
    kind, stale = page % 4, F.when(page % 5 == 0, "-old").otherwise("")
    full_ts, again_ts = page * STEP_FULL % TICKS, page * STEP_AGAIN % TICKS
    own_tag = F.when(page % 6 != 0, tag)
    full = pages.select(
        page.alias("record_id"), "url", full_ts.alias("ts"), F.lit(False).alias("revisit"), own_tag.alias("etag"), date.alias("last_modified"), F.md5(html).alias("digest"),
        F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), F.length(html).cast("string"), F.lit("last-modified"), date, F.lit("date"), F.coalesce(full_ts.cast("string"), F.lit(""))).alias("headers"),
    )
    again = pages.select(
        page.alias("record_id"), "url", again_ts.alias("ts"), F.lit(True).alias("revisit"), F.when(kind == 0, F.concat(F.lit("W/"), tag, stale)).alias("etag"), F.when(kind <= 1, F.concat(date, stale)).alias("last_modified"),
        F.when(kind <= 2, F.concat(F.md5(html), stale)).alias("digest"),
        F.create_map(F.lit("cache-control"), F.lit("max-age=60"), F.lit("content-length"), F.lit("0"), F.lit("date"), F.coalesce(again_ts.cast("string"), F.lit(""))).alias("headers"),
    )
    return full.unionByName(again)


def op2_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = own_columns(table(spark, sf_dir, "pages"), "page_id", "url", "html")
    return resolve_revisits(crawl_of(pages)).withColumnRenamed("record_id", "page_id")


ORACLE = rf"""
WITH a AS (
  SELECT page_id, page_id * {STEP_FULL} % {TICKS} AS full_ts, page_id * {STEP_AGAIN} % {TICKS} AS again_ts, page_id % 4 AS kind, CASE WHEN page_id % 5 = 0 THEN '-old' ELSE '' END AS stale,
    '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' AS tag, 'day ' || (length(coalesce(html, '')) % 97) AS date, md5(coalesce(html, '')) AS digest, length(coalesce(html, '')) AS size,
    regexp_replace(regexp_extract(url, '^.*?://(.*)$', 1, 's'), '#.*$', '', 's') AS tail FROM pages
), b AS (
  SELECT *, regexp_replace(regexp_replace(translate(regexp_extract(tail, '^[^/?]*'), '{UPPER}', '{LOWER}'), ':(80|443)$', ''), '^www\.', '') AS host,
    regexp_replace(regexp_extract(tail, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(tail, '\?(.*)$', 1, 's'), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_'))), '&') AS query FROM a
), p AS (SELECT *, CASE WHEN host <> '' THEN host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS canonical FROM b),
f AS (
  SELECT canonical, full_ts, max(page_id) AS id, arg_max(CASE WHEN page_id % 6 <> 0 THEN tag ELSE '' END, page_id) AS f_tag, arg_max(date, page_id) AS f_date, arg_max(digest, page_id) AS f_digest, arg_max(size, page_id) AS f_size
  FROM p WHERE canonical IS NOT NULL GROUP BY canonical, full_ts
), j AS (
  SELECT p.*, id AS response_id, full_at, f_tag, f_date, f_digest, f_size,
    CASE WHEN id IS NULL THEN 'missing' WHEN kind = 0 AND f_tag <> '' THEN CASE WHEN tag || stale = f_tag THEN 'resolved' ELSE 'mismatch' END
      WHEN kind <= 1 THEN CASE WHEN date || stale = f_date THEN 'resolved' ELSE 'mismatch' END
      WHEN kind = 2 THEN CASE WHEN digest || stale = f_digest THEN 'resolved' ELSE 'mismatch' END ELSE 'unverified' END AS outcome
  FROM p ASOF LEFT JOIN (SELECT *, full_ts AS full_at FROM f) f ON p.canonical = f.canonical AND p.again_ts > f.full_ts
)
SELECT page_id, canonical, response_id, outcome,
  CASE WHEN outcome IN ('resolved', 'unverified') THEN 'cache-control: max-age=60' || chr(10) || 'content-length: ' || f_size || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || again_ts || chr(10) || 'last-modified: ' || f_date END AS merged
FROM j
"""
