"""Resolution of not-modified revisits in web archives.

A revisit stands for a response that had not changed; its body is that of the
latest earlier full response for the same canonical URL.  The two are joined as
of the capture time, their validators are compared, and the stored headers are
updated with those that a not-modified answer may change.

Time is cut into slices.  Per URL and slice only the last full response is
carried on, so a URL with a third of all captures is spread over its slices.

Defined results: a revisit is ``resolved`` if an entity tag, or failing that a
modification time, agrees; ``mismatch`` if the one that both have differs;
``unchecked`` if they have none in common; ``missing`` if there is no earlier
full response.  Earlier means a smaller time; of full responses at one time the
largest record id counts.  A null URL is its own canonical URL and resolves to
nothing; a record without a time is never resolved and resolves nothing;
repeated rows are repeated records; null headers are empty; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from fleetpulse.llm.common import ascii_lower, table

SLICE = 3600

#: Header fields that describe a stored body or one connection; a not-modified answer leaves them as stored.
KEPT_FIELDS = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate",
    "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade",
)


def canonical_url(url: Column) -> Column:
    """Host lower-cased without a leading www., no scheme, fragment, tracking fields, default port or final slash."""
    bare = F.regexp_replace(url, r"#.*$", "")
    bare = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    host = ascii_lower(F.regexp_extract(bare, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^www\.", "")
    rest = F.regexp_extract(bare, r"^[^/?]*(.*)$", 1)
    rest = F.regexp_replace(rest, r"([?&])(utm_[a-z]+|ref)=[^&]*", "$1")
    rest = F.regexp_replace(F.regexp_replace(rest, r"[?&]+$", ""), r"([?&])&+", "$1")
    return F.concat(host, F.regexp_replace(rest, r"/+$", ""))


def weak_tag(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def lower_fields(headers: Column) -> Column:
    """Field names in lower case; of several that fall together the last one counts."""
    entries = F.coalesce(F.map_entries(headers), F.array().cast("array<struct<key:string,value:string>>"))
    names = F.transform(entries, lambda e: ascii_lower(e["key"]))
    last = F.filter(entries, lambda e, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), ascii_lower(e["key"])))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(ascii_lower(e["key"]).alias("key"), e["value"].alias("value"))))


def merged_headers(stored: Column, fresh: Column) -> Column:
    """Stored fields, with the permitted ones of the answer in place of or beside them."""
    allowed = F.map_filter(fresh, lambda k, _: ~k.isin(*KEPT_FIELDS))
    rest = F.map_filter(stored, lambda k, _: ~F.array_contains(F.map_keys(allowed), k))
    return F.map_concat(rest, allowed)


def resolve_revisits(records: DataFrame, slice_seconds: int = SLICE) -> DataFrame:
    """One row per revisit of (record_id, url, at long seconds, kind, headers map, digest).

    Result: record_id, canonical, response_id, status, headers, digest.
    """
    base = records.select(
        "record_id", canonical_url(F.col("url")).alias("canonical"), "at", (F.col("kind") == "response").alias("is_full"),
        lower_fields(F.col("headers")).alias("headers"), "digest",
    ).withColumn("slice", F.floor(F.col("at") / slice_seconds))
    full = F.when(F.col("is_full") & F.col("at").isNotNull(), F.struct("at", "record_id", F.map_entries("headers").alias("fields"), "digest"))
    timed = base.filter(F.col("canonical").isNotNull() & F.col("at").isNotNull()).withColumn("full", full)
    last = timed.groupBy("canonical", "slice").agg(F.max("full").alias("full"))
    before = W.partitionBy("canonical").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    carried = last.select("canonical", "slice", F.last("full", ignorenulls=True).over(before).alias("carried"))
    earlier = W.partitionBy("canonical", "slice").orderBy("at").rangeBetween(W.unboundedPreceding, -1)
    seen = timed.withColumn("here", F.max("full").over(earlier)).filter(~F.col("is_full"))
    matched = seen.join(carried, ["canonical", "slice"]).withColumn("found", F.coalesce("here", "carried"))
    untimed = base.filter((F.col("canonical").isNull() | F.col("at").isNull()) & ~F.col("is_full"))
    columns = ["record_id", "canonical", "headers", "digest", "found"]
    both = matched.select(*columns).unionByName(untimed.withColumn("found", F.lit(None)).select(*columns))
    stored = F.map_from_entries("found.fields")
    tag, stored_tag = weak_tag(F.col("headers")["etag"]), weak_tag(stored["etag"])
    when, stored_when = F.col("headers")["last-modified"], stored["last-modified"]
    by_tag, by_time = tag.isNotNull() & stored_tag.isNotNull(), when.isNotNull() & stored_when.isNotNull()
    status = (
        F.when(F.col("found").isNull(), "missing")
        .when(by_tag, F.when(tag == stored_tag, "resolved").otherwise("mismatch"))
        .when(by_time, F.when(when == stored_when, "resolved").otherwise("mismatch"))
        .otherwise("unchecked")
    )
    out = both.withColumn("status", status).withColumn("stored", stored)
    good = F.col("status") == "resolved"
    return out.select(
        "record_id", "canonical", F.col("found.record_id").alias("response_id"), "status",
        F.when(good, merged_headers(F.col("stored"), F.col("headers"))).otherwise(F.col("headers")).alias("headers"),
        F.when(good, F.col("found.digest")).alias("digest"),
    )


def records_of(pages: DataFrame) -> DataFrame:
    """The captures that a crawl of ``pages`` would have left.

    Every page is a full response at 97 seconds from the next one, tagged with
    the digest of its body.  The crawler asked again a while later, by the URL
    without fragment, and got a not-modified answer; one in seven answers
    carries another tag, one in five only a modification time, one in eleven no
    validator.
    """
    digest = F.md5(F.coalesce("html", F.lit("")))
    at = F.col("page_id") * 97
    date = lambda days: F.concat(F.lit("day "), days.cast("string"))
    fields = F.map_concat(
        F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), F.concat(F.lit('"'), digest, F.lit('"'))),
        F.create_map(F.lit("Content-Length"), F.length(F.coalesce("html", F.lit(""))).cast("string"), F.lit("Last-Modified"), date(F.floor(F.col("page_id") / 100))),
    )
    full = pages.select((F.col("page_id") * 2).alias("record_id"), "url", at.alias("at"), F.lit("response").alias("kind"), fields.alias("headers"), digest.alias("digest"))
    tag = F.concat(F.lit('W/"'), F.when(F.col("page_id") % 7 == 3, F.reverse(digest)).otherwise(digest), F.lit('"'))
    answer = F.create_map(F.lit("Date"), date(F.floor(F.col("page_id") / 100) + 1), F.lit("Content-Length"), F.lit("0"))
    tagged = F.create_map(F.lit("etag"), tag)
    dated = F.create_map(F.lit("Last-Modified"), date(F.floor(F.col("page_id") / 100)))
    headers = F.when(F.col("page_id") % 11 == 5, answer).when(F.col("page_id") % 5 == 2, F.map_concat(answer, dated)).otherwise(F.map_concat(answer, tagged))
    again = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), F.regexp_replace("url", "#.*$", "").alias("url"),
        (at + 50 * (F.col("page_id") % 400)).alias("at"), F.lit("revisit").alias("kind"), headers.alias("headers"), F.lit(None).cast("string").alias("digest"),
    )
    return full.unionByName(again)


def op1_warc_revisits(spark, sf_dir: str) -> DataFrame:
    resolved = resolve_revisits(records_of(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    text = F.array_join(F.transform(F.array_sort(F.map_keys("headers")), lambda k: F.concat(k, F.lit("="), F.col("headers")[k])), "; ")
    return resolved.select("record_id", "canonical", "response_id", "status", text.alias("headers"), "digest")


ORACLE = r"""
WITH p AS (
  SELECT page_id, url, md5(coalesce(html, '')) AS digest, length(coalesce(html, '')) AS size, page_id * 97 AS ts, page_id // 100 AS day,
    regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.\-]*://', '') AS bare
  FROM pages
),
c AS (
  SELECT *,
    regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), ':(80|443)$', ''), '^www\.', '') ||
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(bare, '^[^/?]*(.*)$', 1),
      '([?&])(utm_[a-z]+|ref)=[^&]*', '\1', 'g'), '[?&]+$', ''), '([?&])&+', '\1', 'g'), '/+$', '') AS canonical
  FROM p
),
v AS (
  SELECT page_id * 2 + 1 AS record_id, canonical, ts + 50 * (page_id % 400) AS ts, day,
    CASE WHEN page_id % 11 = 5 OR page_id % 5 = 2 THEN NULL WHEN page_id % 7 = 3 THEN reverse(digest) ELSE digest END AS tag,
    CASE WHEN page_id % 11 <> 5 AND page_id % 5 = 2 THEN 'day ' || day END AS modified
  FROM c
),
j AS (
  SELECT v.record_id, v.canonical, v.day, v.tag, v.modified, f.page_id * 2 AS response_id, f.digest AS stored, f.size, f.day AS stored_day,
    row_number() OVER (PARTITION BY v.record_id ORDER BY f.ts DESC, f.page_id DESC) AS k
  FROM v LEFT JOIN c f ON f.canonical = v.canonical AND f.ts < v.ts
),
s AS (
  SELECT *, CASE WHEN response_id IS NULL THEN 'missing'
    WHEN tag IS NOT NULL THEN CASE WHEN tag = stored THEN 'resolved' ELSE 'mismatch' END
    WHEN modified IS NOT NULL THEN CASE WHEN modified = 'day ' || stored_day THEN 'resolved' ELSE 'mismatch' END
    ELSE 'unchecked' END AS status
  FROM j WHERE k = 1
)
SELECT record_id, canonical, response_id, status,
  CASE WHEN status = 'resolved' THEN
    'content-length=' || size || '; content-type=text/html; date=day ' || (day + 1) || '; etag=' ||
    CASE WHEN tag IS NOT NULL THEN 'W/"' || tag || '"' ELSE '"' || stored || '"' END || '; last-modified=day ' || stored_day
  ELSE 'content-length=0; date=day ' || (day + 1) || CASE WHEN tag IS NOT NULL THEN '; etag=W/"' || tag || '"' ELSE '' END
    || CASE WHEN modified IS NOT NULL THEN '; last-modified=' || modified ELSE '' END END AS headers,
  CASE WHEN status = 'resolved' THEN stored END AS digest
FROM s
"""
