"""Not-modified WARC revisits: each takes the latest earlier full response of its canonical URL, if the validators agree.

The as-of join runs on distinct (URL, time) points in two levels: inside time buckets of a URL, then from bucket to bucket, so that a URL
with a third of all captures is spread over many tasks; the second level has one row for each bucket of a URL. Points carry the fields of
their response, so revisits never meet by response: neither those of one popular response nor those without any share a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_SECONDS = 3600
# Headers that a 304 answer may replace in the stored response, and query parameters that don't name a page.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "set-cookie", "vary"]
TRACKING = "utm_[A-Za-z]+|ref|gclid|fbclid"
HEADERS = "array<struct<name:string,value:string>>"
RESPONSE = f"struct<record_id:bigint,etag:string,last_modified:string,headers:{HEADERS}>"


def canonical_url(url: Column) -> Column:
    """URL without scheme, fragment, www., default port, tracking parameters and trailing slash; host lower-cased, parameters sorted."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), "^[A-Za-z][A-Za-z0-9+.-]*://", ""), "#.*$", "")
    host = F.regexp_extract(rest, "^[^/?]*", 0)
    site = F.regexp_replace(F.regexp_replace(F.lower(host), r"^www\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), "/+$", "")
    named = F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(f"^({TRACKING})(=|$)"))
    query = F.array_join(F.array_sort(named), "&")
    return F.concat(site, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def _tag(etag: Column) -> Column:
    return F.regexp_replace(F.trim(etag), "^W/", "")


def latest_earlier(points: DataFrame) -> DataFrame:
    """(url, fetched, found) for distinct points (url, fetched, response): the response of the latest strictly earlier point that has one."""
    placed = points.withColumn("bucket", F.floor(F.col("fetched") / BUCKET_SECONDS))
    inside = Window.partitionBy("url", "bucket").orderBy("fetched").rowsBetween(Window.unboundedPreceding, -1)
    near = placed.withColumn("near", F.last("response", ignorenulls=True).over(inside))
    ends = placed.groupBy("url", "bucket").agg(F.max_by("response", F.when(F.col("response").isNotNull(), F.col("fetched"))).alias("end"))
    across = Window.partitionBy("url").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    far = ends.withColumn("far", F.last("end", ignorenulls=True).over(across)).drop("end")
    return near.join(far, ["url", "bucket"]).select("url", "fetched", F.coalesce("near", "far").alias("found"))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Every revisit of `records` with the response it stands for.

    `records`: record_id bigint, url string, fetched bigint (seconds), kind string ('response' or 'revisit'), etag string, last_modified
    string, headers (HEADERS). Returns record_id, canonical_url, fetched, state, response_id, headers:

    - `resolved`: the latest earlier response of the canonical URL has the revisit's etag (weak marks aside) or, if the revisit has no
      etag, its last_modified. Headers are the response's, where those that PERMITTED names and the revisit gives replace the old ones.
    - `mismatch`: that response has another validator, or none; `no_validator`: the revisit has none; `no_response`: there is no
      earlier one; `no_key`: url or fetched is null. response_id is null unless resolved; headers are then the revisit's own.

    Of responses at one URL and time, the greatest record_id counts; earlier means strictly earlier. Rows that repeat the record_id of a
    response are one response (the greatest by time, URL and validators). One row for each input revisit, repeated rows included; rows of
    other or null kinds are ignored, as are other columns; empty tables give none. Null headers are empty.
    """
    fields = ["record_id", "url", "fetched", "etag", "last_modified", "headers"]
    rows = records.select("kind", *fields).withColumn("url", canonical_url(F.col("url"))).withColumn("headers", F.coalesce("headers", F.array().cast(HEADERS)))
    responses = rows.where("kind = 'response' AND url IS NOT NULL AND fetched IS NOT NULL AND record_id IS NOT NULL").groupBy("record_id")
    responses = responses.agg(F.max(F.struct("fetched", "url", "etag", "last_modified", "headers")).alias("r")).select("record_id", "r.*")
    revisits = rows.where("kind = 'revisit'").drop("kind")
    keyed = revisits.where("url IS NOT NULL AND fetched IS NOT NULL")
    response = F.struct("record_id", "etag", "last_modified", "headers")
    points = responses.select("url", "fetched", response.alias("response")).unionByName(keyed.select("url", "fetched", F.lit(None).cast(RESPONSE).alias("response")))
    found = latest_earlier(points.groupBy("url", "fetched").agg(F.max("response").alias("response"))).where("found IS NOT NULL")

    # Revisits without a key stay out of the join, where all nulls would be dealt to one task.
    unkeyed = revisits.where("url IS NULL OR fetched IS NULL").withColumn("found", F.lit(None).cast(RESPONSE))
    joined = keyed.join(found, ["url", "fetched"], "left").unionByName(unkeyed).select(
        *fields, F.col("found.record_id").alias("found"), F.col("found.etag").alias("old_etag"),
        F.col("found.last_modified").alias("old_modified"), F.col("found.headers").alias("old_headers"),
    )
    agrees = F.when(F.col("etag").isNotNull(), _tag(F.col("etag")) == _tag(F.col("old_etag"))).otherwise(F.col("last_modified") == F.col("old_modified"))
    state = (
        F.when(F.col("url").isNull() | F.col("fetched").isNull(), "no_key").when(F.col("found").isNull(), "no_response")
        .when(F.coalesce("etag", "last_modified").isNull(), "no_validator").when(F.coalesce(agrees, F.lit(False)), "resolved").otherwise("mismatch")
    )
    given = F.filter("headers", lambda h: F.lower(h["name"]).isin(PERMITTED))
    kept = F.filter("old_headers", lambda o: ~F.exists(given, lambda h: F.lower(h["name"]) == F.lower(o["name"])))
    out = joined.withColumn("state", state)
    resolved = F.col("state") == "resolved"
    return out.select(
        "record_id", F.col("url").alias("canonical_url"), "fetched", "state", F.when(resolved, F.col("found")).alias("response_id"),
        F.when(resolved, F.concat(kept, given)).otherwise(F.col("headers")).alias("headers"),
    )
