"""Resolution of WARC not-modified revisits.

A revisit record (a 304 answer) has no payload of its own. It is joined as of its time, by canonical URL,
to the latest earlier full response. The validators must agree: entity tags by weak comparison if the
revisit has one, else Last-Modified. Of the revisit's headers those that a 304 may update replace the
stored ones; headers that describe the stored payload stay.

A hot URL is cut by time into ``buckets`` of about equal numbers of records. The as-of window runs within
(URL, bucket); the last response of earlier buckets is carried over from one row for each bucket.

Outcomes: ``resolved``; ``mismatch`` (the validators differ: response_id says with what); ``unvalidated``
(the revisit has none); ``missing`` (no earlier response).

Cases. Earlier means strictly: a response of the same instant doesn't count. Of responses of one instant
the largest record_id is latest. Null URLs and null times never match. Null headers count as none. Header
names are compared, and returned, in lower case; of names that differ in case only the last in byte order counts. Each row
that is a revisit gives one row, also where records repeat or have no record_id; of equal responses one is
taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import written

# Header fields that a 304 answer may update (RFC 9110, section 15.4.5, and RFC 9111, section 3.2).
PERMITTED = ["age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]

# Canonical URL, in order: scheme, port and host prefix, fragment, tracking parameters, loose ends.
URL_STEPS = [
    (r"#.*$", ""),
    (r"^[a-z]+://", ""),
    (r"^(www[0-9]*|m)\.", ""),
    (r"^([^/?]*):(80|443)([/?]|$)", "$1$3"),
    (r"([?&])(utm_[a-z]+|ref|fbclid|gclid)=[^&]*", "$1"),
    (r"&&+", "&"),
    (r"\?&+", "?"),
    (r"[?&]+$", ""),
    (r"/(index\.html?)?(\?|$)", "$2"),
]


def canonical_url(url: Column) -> Column:
    """Host lower-cased, without scheme, default port, www or m, fragment, tracking parameters, trailing slash."""
    host = F.regexp_extract(url, r"^([A-Za-z]+://)?([^/?#]*)", 0)
    out = F.concat(F.lower(host), F.substr(url, F.char_length(host) + 1))
    for pattern, to in URL_STEPS:
        out = F.regexp_replace(out, pattern, to)
    return out


def as_of(left: DataFrame, right: DataFrame, buckets: int = 64) -> DataFrame:
    """(row, response): for each left row (key, ts, record_id, row) the latest right row of the same ``key`` with a
    smaller ``ts``, as a struct (ts, record_id, row)."""
    none = F.lit(None).cast("struct<ts:long,record_id:long,row:long>")
    both = left.select("key", "ts", "record_id", "row", none.alias("response")).withColumn("kind", F.lit(0)).unionByName(
        right.select("key", "ts", "record_id", "row", F.struct("ts", "record_id", "row").alias("response")).withColumn("kind", F.lit(1)))
    cuts = [i / buckets for i in range(1, buckets)]
    bounds = both.agg(F.percentile_approx("ts", cuts, 10_000).alias("c")).first()["c"] or []
    bucket = F.size(F.filter(F.array(*map(F.lit, sorted(set(bounds)))), lambda b: b <= F.col("ts"))) if bounds else F.lit(0)
    both = both.where("key is not null and ts is not null").withColumn("bucket", bucket)
    within = Window.partitionBy("key", "bucket").orderBy("ts", "kind", "record_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("found", F.last("response", ignorenulls=True).over(within)).where("kind = 0")
    ends = both.groupBy("key", "bucket").agg(F.max("response").alias("end"))
    carried = ends.select("key", "bucket", F.last("end", ignorenulls=True).over(Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    return near.join(carried, ["key", "bucket"]).select("row", F.coalesce("found", "carried").alias("response"))


def by_lower_name(headers: Column) -> Column:
    """The map with lower-case names; of names that differ in case only the last in byte order counts, so ``etag`` before ``ETag``."""
    entries = F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    later = lambda i: F.slice(F.transform(entries, lambda e: e["key"]), i + 2, F.size(entries))
    return F.map_from_entries(F.filter(entries, lambda e, i: ~F.array_contains(later(i), e["key"])))


def resolve(records: DataFrame, buckets: int = 64) -> DataFrame:
    """One row per revisit: record_id, canonical_url, response_id, outcome, headers (merged, map), payload.

    ``records``: record_id long, kind ('response' or 'revisit'), url, ts long, headers map, payload (of
    responses: anything that finds it, such as its digest or place).
    """
    headers = by_lower_name(F.coalesce(F.col("headers"), F.create_map().cast("map<string,string>")))
    # Rows are told apart by a number of their own: record ids may be null or come again.
    records = records.select("record_id", "kind", "ts", "payload", canonical_url(F.col("url")).alias("key"), headers.alias("headers"), F.monotonically_increasing_id().alias("row"))
    records = written(records, "records")
    revisits, responses = records.where("kind = 'revisit'"), records.where("kind = 'response'")
    found = as_of(revisits, responses, buckets).select("row", F.col("response.record_id").alias("response_id"), F.col("response.row").alias("stored"))
    stored = responses.select(F.col("row").alias("stored"), F.col("headers").alias("old"), "payload")
    rows = revisits.drop("payload").join(found, "row", "left").join(stored, "stored", "left")
    tag = lambda x: F.regexp_replace(F.try_element_at(F.col(x), F.lit("etag")), "^W/", "")
    changed = lambda x: F.try_element_at(F.col(x), F.lit("last-modified"))
    same = F.when(tag("headers").isNotNull(), tag("headers").eqNullSafe(tag("old"))).when(changed("headers").isNotNull(), changed("headers").eqNullSafe(changed("old")))
    outcome = F.when(F.col("stored").isNull(), "missing").when(same.isNull(), "unvalidated").when(same, "resolved").otherwise("mismatch")
    newer = F.map_filter("headers", lambda k, _: k.isin(PERMITTED))
    older = F.map_filter("old", lambda k, _: ~F.array_contains(F.map_keys(newer), k))
    usable = F.col("outcome").isin("resolved", "unvalidated")
    rows = rows.withColumn("outcome", outcome)
    return rows.select(
        "record_id", F.col("key").alias("canonical_url"), "response_id", "outcome",
        F.when(usable, F.map_concat(older, newer)).alias("headers"), F.when(usable, F.col("payload")).alias("payload"),
    )
