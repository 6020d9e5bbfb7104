"""URL filtering by hashed host-suffix and path-prefix expressions (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.shared import free_names, literal_table, own_columns, table

#: The rules of the registered query, as (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Hex digits of the digest that the equi-join compares; the rest is confirmed afterwards.
PREFIX_HEX = 8
#: Verdict for a URL that no rule fits.
DEFAULT_VERDICT = "allow"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """Columns r_host, r_path, r_verdict."""
    return literal_table(spark, [dict(zip(("r_host", "r_path", "r_verdict"), x, strict=True)) for x in rules])


def digest(*parts: str | Column) -> Column:
    return F.sha2(F.concat_ws("\n", *parts), 256)


def met(expressions: DataFrame, rules: DataFrame) -> DataFrame:
    """The join of digest and r_digest on their first digits; the rest confirms it."""
    e, r = (d.withColumn("prefix", F.substring(c, 1, PREFIX_HEX)) for d, c in ((expressions, "digest"), (rules, "r_digest")))
    return e.join(r, "prefix").filter("digest = r_digest").drop("prefix", "digest", "r_digest")


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """*pages* with host, path, rule and verdict.

    A rule (host, path) fits its host and every subdomain of it if the URL's path starts with the
    rule's path; the longest rule wins, then the smallest rule, then block. Every URL is expanded first into
    its host suffixes (cut at dots), which meet the rules' hosts by the first digits of a SHA-256 digest, the whole one confirmed.
    What has a rule is then expanded into the path prefixes of those lengths that rules of that host have, which meet the
    rules in the same way. So a hostile URL's expansion is bounded by its labels and by its path's length, whatever the number of rules,
    and no rule is missed. Distinct (host, path) pairs are judged once: a host or URL that holds a third
    of the rows is one row here, and the join back to the pages is one that Spark splits when skewed.

    A null URL, or one without `://`, has an empty host and path and fits no rule. Repeated rows stay,
    extra columns stay, and an empty table gives an empty result.
    """
    pages = pages.drop(*[c for c in pages.columns if c.lower() in ("host", "path", "rule", "verdict")])
    h, p = free_names(pages, "_h", "_p")
    parts = pages.withColumn("host", host_of(F.col(f"`{url}`"))).withColumn("path", path_of(F.col(f"`{url}`")))
    r = rules.filter("r_host is not null and r_path is not null").select("r_host", "r_path", "r_verdict", digest("r_host", "r_path").alias("r_digest"), F.length("r_path").alias("chars"))
    hosts = r.groupBy("r_host").agg(F.array_sort(F.collect_set("chars")).alias("lengths")).withColumn("r_digest", digest("r_host"))  # at most one length for each character of a path
    pairs = parts.filter("host <> ''").select("host", "path").distinct()
    suffixes = (
        pairs.select("host", F.explode(F.sequence(F.lit(1), F.size(F.split("host", r"\.")))).alias("n"))
        .distinct()
        .select("host", F.expr("substring_index(host, '.', -n)").alias("e_host"))
        .withColumn("digest", digest("e_host"))
    )
    ruled = met(suffixes, hosts).select("host", "e_host", "lengths")
    prefixes = (
        pairs.join(ruled, "host")
        .select("host", "path", "e_host", F.explode("lengths").alias("chars"))
        .filter("chars <= length(path)")
        .withColumn("digest", digest("e_host", F.expr("substring(path, 1, chars)")))
    )
    found = (
        met(prefixes.drop("chars"), r)
        .select("host", "path", F.concat("r_host", "r_path").alias("rule"), "r_verdict")
        .groupBy("host", "path")
        .agg(F.min(F.struct((-F.length("rule")).alias("len"), F.col("rule"), F.when(F.col("r_verdict") == "block", 0).otherwise(1).alias("second"), F.col("r_verdict"))).alias("best"))
        .select(F.col("host").alias(h), F.col("path").alias(p), F.col("best.rule").alias("rule"), F.col("best.r_verdict").alias("verdict"))
    )
    out = parts.join(found, (parts.host == found[h]) & (parts.path == found[p]), "left").drop(h, p)
    return out.withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = own_columns(table(spark, sf_dir, "pages"), "page_id", "url")
    return judge_urls(pages, rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS tail FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(tail, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r(h, q, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow'))
SELECT page_id, host, path,
  (SELECT arg_max(h || q, length(h || q)) FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q)) AS rule,
  coalesce((SELECT arg_max(v, length(h || q)) FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q)), 'allow') AS verdict
FROM p
"""
