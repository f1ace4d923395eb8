"""WARC: resolution of not-modified revisits.

A revisit record (a 304 answer) has no body. It stands for the latest earlier
full response of the same canonical URL, if their validators agree: the payload
digests if both records have one, else the entity tags (weakly compared), else
the dates of last modification. The resolved record has the response's headers,
replaced by those that a 304 answer may update.

The as-of join takes no group whole: a URL's records are dealt to ``BUCKETS``
ranges of time, bounded by quantiles of all records' times; within a range a
window finds the response, and a table with the last response of each range (at
most ``BUCKETS`` rows a URL) carries it to later ranges. Records without URL or
time are dealt by hash and resolve to nothing. Bodies never move; the result names the response's record.

Defined cases: a record without URL or time resolves to nothing; a response at
the very time of the revisit is not earlier; of responses at one time the one
with the larger id counts; if no validator is on both sides, the revisit is
unresolved but names the response; a revisit without an earlier response has
null for it; header names are lower-cased, and of a repeated name the last
stays; repeated revisit rows are resolved each; an empty table gives an empty
result; other columns are unused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import UPPER, LOWER, table

BUCKETS = 256
#: Header fields that a 304 answer may update (fixed values).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Scheme, authority, path and query of a URI (the pattern of RFC 3986, appendix B).
URI = r"^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?"


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no default port, no fragment, ``/`` for no path, sorted query."""
    part = lambda k: F.regexp_extract(url, URI, k)
    scheme = F.translate(part(2), UPPER, LOWER)
    host = F.translate(part(4), UPPER, LOWER)
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    path = F.when(part(5) == "", F.lit("/")).otherwise(part(5))
    query = F.array_join(F.array_sort(F.split(part(7), "&", -1)), "&")
    return F.concat(scheme, F.lit("://"), host, path, F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))


def _lowered(headers: Column) -> Column:
    """A map with lower-case names; of equal names the last."""
    entries = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    names = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(entries, lambda e: e["key"] == n), -1)["value"]))


def _range_of(ts: Column, bounds: list[int], step: int = 16) -> Column:
    """A number that grows with the bounds at or below ``ts``, found among every ``step``-th bound first."""
    groups = [bounds[k : k + step] for k in range(0, len(bounds), step)] or [[]]
    below = lambda some: F.size(F.filter(some, lambda b: b <= ts))
    group = below(F.lit([g[0] for g in groups[1:]]).cast("array<long>"))
    whole = F.array(*(F.lit(g).cast("array<long>") for g in groups))
    return group * (step + 1) + below(F.get(whole, group))


def as_of(records: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Each revisit with ``found``: the latest earlier response of its canonical URL, or null.

    records: record_id, url, ts (long), kind ('response' or 'revisit'), digest, headers (map).
    """
    kept = ("record_id", "ts", "kind", "digest", "url")
    rows = records.select(*kept, _lowered(F.col("headers")).alias("headers")).withColumn("canonical", canonical_url(F.col("url")))
    placed = F.col("canonical").isNotNull() & F.col("ts").isNotNull()
    at = records.agg(F.percentile_approx("ts", [k / buckets for k in range(1, buckets)], 20 * buckets)).head()[0] if buckets > 1 else None
    aside = -1 - F.pmod(F.xxhash64("record_id", "url"), F.lit(buckets)).cast("int")
    rows = rows.withColumn("_bucket", F.when(placed, _range_of(F.col("ts"), sorted(set(at or [])))).otherwise(aside))
    whole = F.struct("record_id", "ts", "digest", "headers")
    usable = F.col("kind").eqNullSafe("response") & placed
    last = rows.filter(usable).groupBy("canonical", "_bucket").agg(F.max_by(whole, F.struct("ts", "record_id")).alias("_last"))
    # The ranges in which a URL has any record, with what earlier ranges leave.
    ranges = rows.filter(placed).select("canonical", "_bucket").distinct().join(last, ["canonical", "_bucket"], "left")
    before = Window.partitionBy("canonical").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranges.select("canonical", "_bucket", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    # A revisit goes before a response of its own time, so that it does not see it.
    inside = Window.partitionBy("canonical", "_bucket").orderBy("ts", F.when(usable, 1).otherwise(0), "record_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.withColumn("_seen", F.last(F.when(usable, whole), ignorenulls=True).over(inside)).filter(F.col("kind").eqNullSafe("revisit"))
    found = seen.join(carried, ["canonical", "_bucket"], "left").withColumn("found", F.when(placed, F.coalesce("_seen", "_carried")))
    return found.drop("_seen", "_carried", "_bucket")


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolve(records: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Each revisit: record_id, canonical_url, ts, response_id, validator, resolved, headers (a map)."""
    rows = as_of(records, buckets)
    mine, theirs = F.col("headers"), F.col("found.headers")
    pair = lambda name: (_weak(F.try_element_at(mine, F.lit(name))), _weak(F.try_element_at(theirs, F.lit(name))))
    checks = (("digest", (F.col("digest"), F.col("found.digest"))), ("etag", pair("etag")), ("last-modified", pair("last-modified")))
    validator, agrees = F.lit("none"), F.lit(False)
    for name, (a, b) in reversed(checks):
        there = a.isNotNull() & b.isNotNull()
        validator = F.when(there, F.lit(name)).otherwise(validator)
        agrees = F.when(there, a == b).otherwise(agrees)
    update = F.map_filter(mine, lambda k, _: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(theirs, lambda k, _: ~F.array_contains(F.map_keys(update), k)), update)
    none = F.col("found").isNull()
    return rows.select(
        "record_id",
        F.col("canonical").alias("canonical_url"),
        "ts",
        F.col("found.record_id").alias("response_id"),
        F.when(none, F.lit("none")).otherwise(validator).alias("validator"),
        (~none & agrees).alias("resolved"),
        F.when(~none & agrees, F.when(F.size(update) > 0, merged).otherwise(theirs)).alias("headers"),
    )


def header_block(headers: Column) -> Column:
    """The fields in order of their names, a line each."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def captures(pages: DataFrame) -> DataFrame:
    """Records of ``pages``: each page is a full response, and is asked for again later.

    Page p is captured at time 10 p and revalidated 5 to 50,025 later; the
    revisit carries the page's own validators, so it resolves unless another
    page of the same canonical URL came in between with another body.
    """
    tag = F.concat(F.lit('"'), F.md5(F.col("html").cast("binary")), F.lit('"'))
    p = F.col("page_id")
    first = F.create_map(
        F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), tag, F.lit("Content-Length"), F.octet_length("html").cast("string"),
        F.lit("Cache-Control"), F.lit("max-age=60"), F.lit("Date"), (p * 10).cast("string"),
    )
    later = p * 10 + 5 + F.pmod(p * 7919, F.lit(5003)) * 10
    again = F.create_map(
        F.lit("ETag"), tag, F.lit("Content-Length"), F.lit("0"), F.lit("Cache-Control"),
        F.concat(F.lit("max-age="), (F.pmod(p, F.lit(10)) * 60).cast("string")), F.lit("Date"), later.cast("string"), F.lit("Server"), F.lit("edge"),
    )
    digest = F.sha1(F.col("html").cast("binary"))
    response = F.struct((p * 2).alias("record_id"), "url", (p * 10).alias("ts"), F.lit("response").alias("kind"), digest.alias("digest"), first.alias("headers"))
    revisit = F.struct((p * 2 + 1).alias("record_id"), "url", later.alias("ts"), F.lit("revisit").alias("kind"), F.lit(None).cast("string").alias("digest"), again.alias("headers"))
    return pages.select(F.explode(F.array(response, revisit)).alias("r")).select("r.*")


def op9_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve(captures(table(spark, sf_dir, "pages")))
    return out.withColumn("headers", header_block(F.col("headers")))


SQL = r"""
WITH parts AS (
  SELECT page_id AS p, md5(html) AS tag, octet_length(encode(html)) AS n,
    lower(regexp_extract(url, '^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?', 2)) AS scheme,
    lower(regexp_extract(url, '^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?', 4)) AS host,
    regexp_extract(url, '^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?', 5) AS path,
    list_sort(string_split(regexp_extract(url, '^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?', 7), '&')) AS query
  FROM pages),
captured AS (
  SELECT p, tag, n, scheme || '://' || CASE scheme WHEN 'http' THEN regexp_replace(host, ':80$', '') WHEN 'https' THEN regexp_replace(host, ':443$', '') ELSE host END
    || CASE path WHEN '' THEN '/' ELSE path END || CASE array_to_string(query, '&') WHEN '' THEN '' ELSE '?' || array_to_string(query, '&') END AS canonical,
    10 * p AS first, 10 * p + 5 + (p * 7919) % 5003 * 10 AS later
  FROM parts),
matched AS (
  SELECT r.p, r.canonical, r.later, r.tag, arg_max(f.p, f.first) AS f, arg_max(f.tag, f.first) AS ftag, arg_max(f.n, f.first) AS fn
  FROM captured r LEFT JOIN captured f ON r.canonical = f.canonical AND f.first < r.later GROUP BY ALL)
SELECT 2 * p + 1 AS record_id, canonical AS canonical_url, later AS ts, 2 * f AS response_id,
  CASE WHEN f IS NULL THEN 'none' ELSE 'etag' END AS validator, coalesce(tag = ftag, false) AS resolved,
  CASE WHEN tag = ftag THEN 'cache-control: max-age=' || p % 10 * 60 || chr(10) || 'content-length: ' || fn || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || later || chr(10) || 'etag: "' || tag || '"' END AS headers
FROM matched
"""
