"""Operator 5: not-modified revisit resolution by an as-of join on canonical URLs.

A revisit record (a 304 answer) has no body: it stands for the latest full response of the same
canonical URL that was captured strictly earlier, provided that its validators agree (entity tags
by weak comparison if both sides have one, else the Last-Modified date). A resolved revisit takes the
response's payload and headers, with those headers replaced that a 304 is permitted to update.

The as-of join runs in blocks of capture time, so that a URL with a very long history is many small
windows: each (URL, block) sums up its last response, a window over those few rows carries it to the
next blocks as a synthetic first row, and one window per (URL, block) does the rest.

Defined results: a revisit without an earlier response is `no_earlier_response`; one whose validators
disagree, or where neither kind is on both sides, is `validator_mismatch`; an address without a scheme
begins with its host; a null URL or one without a host has no key, and it, a null time or
a null kind never resolves and resolves nothing; of full responses at one time that with the largest
record id counts as latest; repeated rows get repeated results; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Capture-time units in a block.
BLOCK = 1 << 15

#: Headers that a 304 may update; the message's own framing and content headers stay as stored.
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")

_DROPPED = r"^(utm_[^=]*|ref|gclid|fbclid|sessionid|phpsessid|jsessionid)(=|$)"


def canonical_url(url: Column) -> Column:
    """Null without a host; else host and path without scheme, www prefix, default port, fragment, trailing slash and tracking parameters; parameters sorted."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//", "")
    authority = F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(authority, r"^www[0-9]*\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(_DROPPED)))
    whole = F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))
    return F.when(host != "", whole)


def _tag(c: Column) -> Column:
    """An entity tag for weak comparison."""
    return F.regexp_replace(c, r"^W/", "")


def resolve_revisits(records: DataFrame, block: int = BLOCK) -> DataFrame:
    """record_id, url_key, status, source_id, payload_digest, headers (map) of every revisit.

    records: record_id long, url string, ts long, kind string (response or revisit), payload_digest string,
    headers map<string,string> with lower-case names.
    """
    named = records.select(
        F.col("record_id").cast("long").alias("record_id"), canonical_url(F.col("url")).alias("url_key"), F.col("ts").cast("long").alias("ts"), "kind",
        F.struct("record_id", "payload_digest", F.coalesce("headers", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).alias("headers")).alias("body"),
    ).withColumn("block", F.floor(F.col("ts") / block))
    usable = F.col("url_key").isNotNull() & F.col("ts").isNotNull()
    full = named.where(usable & (F.col("kind") == "response"))
    revisits = named.where(F.col("kind") == "revisit")
    last = full.groupBy("url_key", "block").agg(F.max_by("body", F.struct("ts", "record_id")).alias("body"))
    needed = revisits.where(usable).select("url_key", "block").distinct()
    history = last.join(needed, ["url_key", "block"], "full")
    before = Window.partitionBy("url_key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = history.select("url_key", "block", F.last("body", ignorenulls=True).over(before).alias("body")).where("body is not null")
    events = (
        full.select("url_key", "block", "ts", "record_id", F.lit(1).alias("rank"), "body", F.lit(None).cast(named.schema["body"].dataType).alias("asked"))
        .unionByName(carried.select("url_key", "block", F.lit(None).cast("long").alias("ts"), F.lit(None).cast("long").alias("record_id"), F.lit(1).alias("rank"), "body", F.lit(None).cast(named.schema["body"].dataType).alias("asked")))
        .unionByName(revisits.where(usable).select("url_key", "block", "ts", "record_id", F.lit(0).alias("rank"), F.lit(None).cast(named.schema["body"].dataType).alias("body"), F.col("body").alias("asked")))
    )
    so_far = Window.partitionBy("url_key", "block").orderBy(F.col("ts").asc_nulls_first(), "rank", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    matched = events.withColumn("source", F.last("body", ignorenulls=True).over(so_far)).where("rank = 0").select("url_key", "asked", "source")
    lost = revisits.where(~usable).select("url_key", F.col("body").alias("asked"), F.lit(None).cast(named.schema["body"].dataType).alias("source"))
    rows = matched.unionByName(lost)

    asked, stored = F.col("asked.headers"), F.col("source.headers")
    tags = _tag(asked["etag"]) == _tag(stored["etag"])
    dates = asked["last-modified"] == stored["last-modified"]
    agree = F.coalesce(tags, dates, F.lit(False))
    status = F.when(F.col("source").isNull(), "no_earlier_response").when(agree, "resolved").otherwise("validator_mismatch")
    update = F.map_filter(asked, lambda k, _: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(stored, lambda k, _: ~F.array_contains(F.map_keys(update), k)), update)
    out = rows.withColumn("status", status)
    done = F.col("status") == "resolved"
    return out.select(
        F.col("asked.record_id").alias("record_id"), "url_key", "status",
        F.when(done, F.col("source.record_id")).alias("source_id"), F.when(done, F.col("source.payload_digest")).alias("payload_digest"), F.when(done, merged).alias("headers"),
    )


def crawl_records(pages: DataFrame) -> DataFrame:
    """A crawl log of the pages: one full response and one revisit of every page.

    A page's response is captured at 10 x page_id. Its revisit follows 5 later, or comes 5 before where the
    page's length is a multiple of 5. The length's rest modulo 7 says which validators there are: 0 a stale tag
    on the revisit; 1 no tag, the same date of modification; 2 no tag, another date; 3 none on the revisit;
    4 none on the response; else both have the tag (weak on the revisit where the length is odd), and 6 another date
    beside it. Revisits where the length is a multiple of 3 carry a cache rule (permitted), all a content type (not).
    """
    size, tag = F.char_length("html"), F.substring(F.sha2("html", 256), 1, 16)
    rest = size % 7
    quoted = F.concat(F.lit('"'), tag, F.lit('"'))
    stale = F.concat(F.lit('"'), F.substring(F.sha2("url", 256), 1, 16), F.lit('"'))
    stamp = lambda c: F.concat(F.lit("t"), c.cast("string"))
    t = F.col("page_id") * 10
    later = F.when(size % 5 == 0, t - 5).otherwise(t + 5)

    def headers(**values) -> Column:
        """A map without the null ones."""
        entries = F.array(*(F.struct(F.lit(k.replace("_", "-")).alias("key"), v.alias("value")) for k, v in values.items()))
        return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))

    response = pages.select(
        (F.col("page_id") * 2).alias("record_id"), "url", t.alias("ts"), F.lit("response").alias("kind"), F.sha2("html", 256).alias("payload_digest"),
        headers(content_length=size.cast("string"), content_type=F.lit("text/html"), date=stamp(t), etag=F.when(~rest.isin(1, 2, 4), quoted), last_modified=F.when(rest.isin(1, 2, 5, 6), stamp(t))).alias("headers"),
    )
    asked_tag = F.when(rest == 0, stale).when(rest.isin(4, 5, 6), F.when(size % 2 == 1, F.concat(F.lit("W/"), quoted)).otherwise(quoted))
    asked_date = F.when(rest.isin(1, 5), stamp(t)).when(rest.isin(2, 6), stamp(t + 1))
    revisit = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), "url", later.alias("ts"), F.lit("revisit").alias("kind"), F.lit(None).cast("string").alias("payload_digest"),
        headers(cache_control=F.when(size % 3 == 0, stamp(size)), content_length=F.lit("0"), content_type=F.lit("text/plain"), date=stamp(later), etag=asked_tag, last_modified=asked_date).alias("headers"),
    )
    return response.unionByName(revisit)


def revisit_digests(pages: DataFrame) -> DataFrame:
    """record_id, url_key, status, source_id, payload_digest, headers (sorted text) of every revisit of crawl_records(pages)."""
    got = resolve_revisits(crawl_records(pages))
    return got.withColumn("headers", F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";"))


ORACLE = r"""
WITH parts AS (
  SELECT page_id, html, url, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//', '') AS bare FROM pages
), keyed AS (
  SELECT page_id, html, url, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^www[0-9]*\.', ''), ':(80|443)$', '') AS host,
    regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_[^=]*|ref|gclid|fbclid|sessionid|phpsessid|jsessionid)(=|$)'))) AS kept
  FROM parts
), named AS (
  SELECT page_id, html, url, CASE WHEN host <> '' THEN host || path || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS url_key,
    '"' || substr(sha256(html), 1, 16) || '"' AS tag, length(html) AS size, length(html) % 7 AS rest, page_id * 10 AS t FROM keyed
), full_answers AS (
  SELECT page_id * 2 AS record_id, url_key, t AS ts, sha256(html) AS payload_digest, size, CASE WHEN rest NOT IN (1, 2, 4) THEN tag END AS tag, CASE WHEN rest IN (1, 2, 5, 6) THEN 't' || t END AS modified FROM named
), revisits AS (
  SELECT page_id * 2 + 1 AS record_id, url_key, CASE WHEN size % 5 = 0 THEN t - 5 ELSE t + 5 END AS ts, CASE WHEN size % 3 = 0 THEN 't' || size END AS cache,
    CASE WHEN rest = 0 THEN '"' || substr(sha256(url), 1, 16) || '"' WHEN rest IN (4, 5, 6) THEN CASE WHEN size % 2 = 1 THEN 'W/' || tag ELSE tag END END AS tag,
    CASE WHEN rest IN (1, 5) THEN 't' || t WHEN rest IN (2, 6) THEN 't' || (t + 1) END AS modified FROM named
), matched AS (
  SELECT r.record_id, r.url_key, r.ts, r.cache, r.tag, r.modified, f.record_id AS source_id, f.payload_digest, f.size, f.tag AS stored, f.modified AS stored_modified,
    row_number() OVER (PARTITION BY r.record_id ORDER BY f.ts DESC) AS k
  FROM revisits r LEFT JOIN full_answers f ON f.url_key = r.url_key AND f.ts < r.ts
), judged AS (
  SELECT *, CASE WHEN source_id IS NULL THEN 'no_earlier_response' WHEN coalesce(regexp_replace(tag, '^W/', '') = stored, modified = stored_modified, false) THEN 'resolved' ELSE 'validator_mismatch' END AS status FROM matched WHERE k = 1
)
SELECT record_id, url_key, status, CASE WHEN status = 'resolved' THEN source_id END AS source_id, CASE WHEN status = 'resolved' THEN payload_digest END AS payload_digest,
  CASE WHEN status = 'resolved' THEN concat_ws(';', 'cache-control=' || cache, 'content-length=' || size, 'content-type=text/html', 'date=t' || ts, 'etag=' || coalesce(tag, stored), 'last-modified=' || coalesce(modified, stored_modified)) END AS headers
FROM judged
"""
