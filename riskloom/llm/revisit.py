"""Resolve not-modified revisits of a web archive to the response they stand for.

A revisit is joined, as of its time, to the latest earlier full response (type response, status 200) of the same
canonical URL. If the validators agree the revisit gets that response's status, payload digest and headers, with those a
304 may update taken from the revisit.

Records are range-partitioned by (URL, time, id), so a URL with any share of all captures is cut over many tasks. Each
task reads forward within its own rows; for the few URLs that go on from one task to the next (at most one per border)
the last full response before the border is carried over in a list bounded by the number of tasks.

Defined results: records without URL, or with times that are NULL, resolve to nothing ("no earlier response"). Ties in
time go by record id; repeated rows give repeated results. A revisit with no validator the response has as well is
"unvalidated". NULL header maps are empty. Only the columns named are read; others of `records` are not kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, stored

#: Header fields that a 304 answer may update (fixed values of the HTTP specification).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
COLUMNS = ("record_id", "url", "seen_at", "type", "status", "etag", "last_modified", "digest", "headers")


def canonical_url(url: Column) -> Column:
    """Scheme, user, www or m prefix, default port, fragment, tracking parameters and trailing slashes dropped; host in
    lower case; parameters in order."""
    u = F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    u = F.regexp_replace(u, r"#.*$", "")
    host = F.lower(F.regexp_extract(u, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":(80|443)$", ""), r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_extract(u, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(u, r"\?(.*)$", 1)
    kept = F.sort_array(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def _bare(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def resolve(records: DataFrame) -> DataFrame:
    """One row per revisit: record_id, canonical_url, outcome (resolved, changed, unvalidated, no earlier response),
    response_id, status, digest and headers."""
    n = partitions(records.sparkSession)
    rows = records.select(
        F.col("record_id").cast("long").alias("record_id"), canonical_url(F.col("url")).alias("u"), F.col("seen_at").cast("long").alias("seen_at"),
        (F.col("type") == "revisit").alias("revisit"), "etag", "last_modified", "digest", "headers",
        F.coalesce((F.col("type") == "response") & (F.col("status") == 200) & F.col("seen_at").isNotNull(), F.lit(False)).alias("full"))
    rows = rows.filter(F.col("full") | F.col("revisit"))
    rows = stored(rows.repartitionByRange(n, F.xxhash64("u"), "u", "seen_at", "record_id").withColumn("part", F.spark_partition_id()), "captures")
    response = F.when(F.col("full"), F.struct("seen_at", "record_id", "etag", "last_modified", "digest", "headers"))
    # ties in time go by id; a revisit does not see what comes after it
    order = Window.partitionBy("part", "u").orderBy(F.col("seen_at").asc_nulls_first(), "record_id").rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("seen", F.last(response, ignorenulls=True).over(order)).filter("revisit")
    # URLs on both sides of a border between tasks: at most one per border
    spread = rows.groupBy("u").agg(F.min("part").alias("a"), F.max("part").alias("z")).filter("a < z").select("u")
    last = (rows.filter("full").join(F.broadcast(spread), "u").groupBy("u", "part")
            .agg(F.max(F.struct("seen_at", "record_id", "etag", "last_modified", "digest", F.map_entries("headers").alias("h"))).alias("last")))
    ends = rows.join(F.broadcast(spread), "u").select("u", "part").distinct().join(last, ["u", "part"], "left")
    before = Window.partitionBy("u").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("u", "part", F.last("last", ignorenulls=True).over(before).alias("carry"))
    found = local.join(F.broadcast(carried), ["u", "part"], "left")
    carry = F.when(F.col("carry").isNotNull() & F.col("seen_at").isNotNull(), F.struct(
        *[F.col(f"carry.{c}").alias(c) for c in ("seen_at", "record_id", "etag", "last_modified", "digest")], F.map_from_entries("carry.h").alias("headers")))
    found = found.withColumn("r", F.coalesce("seen", carry))
    same = F.when(F.col("etag").isNotNull() & F.col("r.etag").isNotNull(), _bare(F.col("etag")) == _bare(F.col("r.etag"))) \
        .when(F.col("last_modified").isNotNull() & F.col("r.last_modified").isNotNull(), F.col("last_modified") == F.col("r.last_modified")) \
        .when(F.col("digest").isNotNull() & F.col("r.digest").isNotNull(), F.col("digest") == F.col("r.digest"))
    outcome = (F.when(F.col("r").isNull(), "no earlier response").when(same.isNull(), "unvalidated")
               .when(same, "resolved").otherwise("changed"))
    empty = F.create_map().cast("map<string,string>")
    held, new = F.coalesce("r.headers", empty), F.coalesce("headers", empty)
    new = F.map_filter(new, lambda k, _: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(held, lambda k, _: ~F.map_contains_key(new, k)), new)
    ok = F.col("outcome") == "resolved"
    return found.withColumn("outcome", outcome).select(
        "record_id", F.col("u").alias("canonical_url"), "outcome", F.col("r.record_id").alias("response_id"),
        F.when(ok, 200).alias("status"), F.when(ok, F.col("r.digest")).alias("digest"), F.when(ok, merged).alias("headers"))


def with_payload(resolved: DataFrame, payloads: DataFrame) -> DataFrame:
    """Adds the payload of the response each resolved revisit stands for; `payloads` has record_id and payload."""
    p = payloads.select(F.col("record_id").alias("response_id"), "payload")
    ok = resolved.filter("outcome = 'resolved'").join(p, "response_id", "left")
    rest = resolved.filter("outcome <> 'resolved'").withColumn("payload", F.lit(None).cast(dict(p.dtypes)["payload"]))
    return ok.select(*rest.columns).unionByName(rest)


#: Captures made from the pages table: each page's response, a revisit five ticks later under another spelling of its
#: URL, and for every second page one that came before. Both engines run this text.
CAPTURES = """
SELECT 4 * page_id AS record_id, url, page_id AS seen_at, 'response' AS type, CASE WHEN page_id % 11 = 0 THEN 404 ELSE 200 END AS status,
  CASE WHEN page_id % 3 <> 0 THEN concat('"', substr(md5(html), 1, 12), '"') END AS etag,
  concat('day ', CAST(page_id % 28 AS VARCHAR(8))) AS last_modified, md5(html) AS digest,
  concat('max-age=', CAST(page_id % 60 AS VARCHAR(8))) AS cache, CAST(length(html) AS VARCHAR(12)) AS size
FROM {pages}
UNION ALL
SELECT 4 * page_id + 1, concat(replace(url, 'http://', 'https://'), '#again'), page_id + 5, 'revisit', 304,
  CASE WHEN page_id % 5 = 0 THEN '"other"' ELSE concat('W/"', substr(md5(html), 1, 12), '"') END,
  concat('day ', CAST(page_id % 28 AS VARCHAR(8))), CAST(NULL AS VARCHAR(32)), 'max-age=600', 'text'
FROM {pages}
UNION ALL
SELECT 4 * page_id + 2, concat(url, CASE WHEN url LIKE '%?%' OR url LIKE '%#%' THEN '' ELSE '?utm_medium=x' END), page_id - 3, 'revisit', 304,
  CAST(NULL AS VARCHAR(16)), CASE WHEN page_id % 4 = 0 THEN concat('day ', CAST(page_id % 28 AS VARCHAR(8))) END, md5(html), 'no-cache', 'text'
FROM {pages} WHERE page_id % 2 = 0"""


def captures(pages: DataFrame) -> DataFrame:
    rows = pages.sparkSession.sql(CAPTURES.format(pages="{pages}"), pages=pages.select("page_id", "url", "html"))
    headers = F.map_filter(F.create_map(
        F.lit("cache-control"), F.col("cache"), F.lit("content-length"), F.col("size"), F.lit("etag"), F.col("etag"),
        F.lit("date"), F.col("seen_at").cast("string")), lambda _, v: v.isNotNull())
    return rows.withColumn("headers", headers)
