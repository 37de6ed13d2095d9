"""Not-modified revisits of a web crawl: an as-of join by canonical URL to the latest earlier full response.

The join is carried out as running state, in two levels so that one URL or host with a third of all records does not
meet in one task: records are dealt by (URL, bucket); each bucket's last full response is carried to later buckets of
its URL in a table of one row per bucket, and inside a bucket a window carries it from record to record.
Payloads never travel: the result names the response that holds them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Headers that a 304 may renew; all others stay those of the full response.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
_TRACKING = r"(?i)(^|&)(utm_[a-z]+|ref|fbclid|gclid)=[^&]*"
#: Records of one URL that stay in one bucket, and the most buckets of a URL with more.
BUCKET_ROWS, CUTS = 1 << 16, 512


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.`` and default port, no scheme, fragment or tracking parameters, no last slash.

    Remaining parameters are sorted. Null stays null.
    """
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"(?i)^https?://", "")
    place, query = F.regexp_extract(bare, r"^([^?]*)", 1), F.regexp_extract(bare, r"\?(.*)$", 1)
    host = F.regexp_replace(F.lower(F.regexp_extract(place, r"^([^/]*)", 1)), r"^www\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_replace(place, r"^[^/]*", ""), r"/+$", "")
    kept = F.regexp_replace(F.regexp_replace(query, _TRACKING, ""), r"^&+", "")
    ordered = F.array_join(F.array_sort(F.split(kept, "&")), "&")
    return F.concat(host, path, F.when(ordered == "", "").otherwise(F.concat(F.lit("?"), ordered)))


def folded(headers: Column) -> Column:
    """A header map with lower-case names; of names equal but for case the smallest in byte order wins. Null is empty."""
    entries = F.array_sort(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))))
    lowered = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    names = F.transform(lowered, lambda e: e["key"])
    first = F.filter(lowered, lambda e, i: F.array_position(names, e["key"]) == i + 1)
    return F.map_from_entries(first)


def resolve_revisits(records: DataFrame, rows_per_bucket: int = BUCKET_ROWS) -> DataFrame:
    """``records`` with ``url_key, refers_to, resolution`` and merged ``headers``.

    Columns: record_id long, url string, ts long, kind ('response' or 'revisit'), etag, last_modified and digest
    strings, headers map<string,string>; any more are kept, but for columns named like the three results, which these
    replace. A revisit takes the latest full response of its canonical URL that is earlier by (ts, record_id); of
    records equal in both, responses come first, the one with the largest etag and digest last. ``resolution``: 'full'
    for responses, 'resolved' if a validator of the revisit (etag, weak or strong; else last_modified; else digest)
    equals the response's, 'mismatch' if it differs or there is none, 'orphan' if no earlier response exists (then
    ``refers_to`` is null). Revisits with a null URL, time or record_id are orphans; such responses are full and answer
    nobody. Headers of a resolved revisit are the response's, renewed by the revisit's permitted ones, with lower-case
    names (see ``folded``); all others stay as they are. Repeated rows each get a row; an empty table gives none.

    The records of a URL with more than ``rows_per_bucket`` are cut into up to ``CUTS`` buckets of about as many each,
    at quantiles of time, so a burst on one URL is dealt like any other; records of one URL and instant stay together.
    """
    full = F.col("kind") == "response"
    keyed = records.drop("url_key", "refers_to", "resolution").withColumn("url_key", canonical_url(F.col("url")))
    able = F.col("url_key").isNotNull() & F.col("ts").isNotNull() & F.col("record_id").isNotNull()
    state = F.struct(F.col("ts").alias("s_ts"), F.col("record_id").alias("s_id"), F.col("etag").alias("s_etag"),
                     F.col("last_modified").alias("s_modified"), F.col("digest").alias("s_digest"), F.col("headers").alias("s_headers"))
    usable = keyed.where(able)
    many = usable.groupBy("url_key").agg(F.count("*").alias("__n")).where(F.col("__n") > rows_per_bucket)
    cuts = (
        usable.join(many, "url_key", "left_semi").groupBy(F.col("url_key").alias("__url"))
        .agg(F.array_distinct(F.percentile_approx("ts", [i / CUTS for i in range(1, CUTS)], 10 * CUTS)).alias("__cuts"))
    )
    bucket = F.coalesce(F.size(F.filter("__cuts", lambda c: c < F.col("ts"))), F.lit(0))
    placed = usable.join(cuts, F.col("url_key") == F.col("__url"), "left").withColumn("__bucket", bucket).drop("__url", "__cuts")
    order = F.struct("ts", "record_id", "etag", "digest")
    # One row per bucket that has any record: what earlier buckets hand over.
    buckets = placed.groupBy("url_key", "__bucket").agg(F.max_by(F.when(full, state), F.when(full, order)).alias("__end"))
    earlier = Window.partitionBy("url_key").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = buckets.select(F.col("url_key").alias("__u"), F.col("__bucket").alias("__b"), F.last("__end", ignorenulls=True).over(earlier).alias("__before"))
    carried = carried.where("__before is not null")
    inside = Window.partitionBy("url_key", "__bucket").orderBy("ts", "record_id", full.desc(), "etag", "digest").rowsBetween(Window.unboundedPreceding, -1)
    seen = (
        placed.withColumn("__in", F.last(F.when(full, state), ignorenulls=True).over(inside))
        .join(carried, (F.col("url_key") == F.col("__u")) & (F.col("__bucket") == F.col("__b")), "left")
        .withColumn("__of", F.coalesce("__in", "__before")).drop("__bucket", "__in", "__u", "__b", "__before")
    )
    alone = keyed.where(~able)
    seen = seen.unionByName(alone.withColumn("__of", F.lit(None).cast(seen.schema["__of"].dataType)))
    weak = lambda c: F.regexp_replace(c, r"^W/", "")
    same = F.when(F.col("etag").isNotNull(), weak(F.col("etag")) == weak(F.col("__of.s_etag")))
    same = same.when(F.col("last_modified").isNotNull(), F.col("last_modified") == F.col("__of.s_modified"))
    same = F.coalesce(same.otherwise(F.col("digest") == F.col("__of.s_digest")), F.lit(False))
    verdict = F.when(full, "full").when(F.col("__of").isNull(), "orphan").when(same, "resolved").otherwise("mismatch")
    renewed = F.map_filter(folded(F.col("headers")), lambda k, v: k.isin(*PERMITTED))
    stay = F.map_filter(folded(F.col("__of.s_headers")), lambda k, v: ~F.map_contains_key(renewed, k))
    return (
        seen.withColumn("resolution", verdict)
        .withColumn("refers_to", F.when(full, F.col("record_id")).otherwise(F.col("__of.s_id")))
        .withColumn("headers", F.when(F.col("resolution") == "resolved", F.map_concat(stay, renewed)).otherwise(F.col("headers")))
        .drop("__of")
    )


def recrawl(pages: DataFrame) -> DataFrame:
    """WARC records of an interleaved crawl of ``pages`` (page_id, url, html): each page once in full, and once asked again.

    Both happen at times from hashes of page_id, so a page may be asked for before any full response of its URL
    (orphan), or after a later full response of it (often a mismatch, as the asker holds its own page's validators). By
    page_id the asker sends the etag (weak), the last-modified time, or the digest.
    """
    tag = F.md5(F.coalesce(F.col("html").cast("string"), F.lit("")))
    head = lambda *kv: F.create_map(*[x for k, v in kv for x in (F.lit(k), v.cast("string"))])
    page = F.col("page_id").cast("long")
    none = F.lit(None).cast("string")
    at = lambda salt: F.conv(F.substring(F.md5(F.concat(F.lit(salt), page.cast("string"))), 1, 8), 16, 10).cast("long")
    modified = F.concat(F.lit("day "), F.substring(tag, 1, 2))
    common = [F.col("url").cast("string").alias("url")]
    first = pages.select(
        (page * 2).alias("record_id"), *common, at("full").alias("ts"), F.lit("response").alias("kind"), tag.alias("etag"), modified.alias("last_modified"), tag.alias("digest"),
        head(("Content-Type", F.lit("text/html")), ("Date", at("full")), ("ETag", tag)).alias("headers"))
    way = F.pmod(page, F.lit(3))
    second = pages.select(
        (page * 2 + 1).alias("record_id"), *common, at("again").alias("ts"), F.lit("revisit").alias("kind"), F.when(way == 0, F.concat(F.lit("W/"), tag)).alias("etag"),
        F.when(way == 1, modified).alias("last_modified"), F.when(way == 2, tag).alias("digest"), head(("Date", at("again")), ("Set-Cookie", F.lit("x"))).alias("headers"))
    return first.unionByName(second)
