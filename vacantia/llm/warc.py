"""WARC not-modified revisits: as-of join to the latest earlier full response of the same URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.llm.urls import host_of, path_of
from vacantia.session import materialize

#: Headers that describe the stored body; a not-modified answer may not replace them.
BODY_HEADERS = ("content-encoding", "content-length", "content-range", "content-type", "transfer-encoding")
#: Query parameters that do not select content.
TRACKING = "^(utm_[a-z]+|ref)="


def canonical_url(url: Column) -> Column:
    """Host (A-Z lower-cased, no "www.", no port 80 or 443), path without trailing slashes, and
    the sorted query without tracking parameters; null without a host. The fragment goes."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^www\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(path_of(url), "/+$", "")
    asked = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(asked, "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    query = F.array_join(F.array_sort(kept), "&")
    return F.when(host != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def _strong(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolve_revisits(records: DataFrame, *, partitions: int | None = None) -> DataFrame:
    """Revisits with record_id, canonical_url, response_id, status and merged headers.

    ``records``: record_id, kind ("response" or "revisit"), url, ts, etag, last_modified, headers
    (map of lower-case names). A revisit refers to the full response of its canonical URL with the
    largest (ts, record_id) strictly before its own ts. ETags decide if both have one (weak tags
    equal strong ones), else Last-Modified if both have it. status is "resolved", "mismatch" or
    "unverified" (no validator on both sides), or "no_response"; only resolved revisits have a
    response_id and headers: the response's, replaced by those of the revisit that may.

    Rows are range-partitioned by (URL, time), so a URL with any share of the rows is cut by time.
    Within a partition the last response is carried forward by a window; over its edge comes one
    carried response per partition from the partitions before it. A null url, one without host,
    or a null ts finds nothing; other kinds and other columns are ignored; repeated rows are
    answered each; null headers are empty; an empty table gives no rows.
    """
    no_headers = F.create_map().cast("map<string,string>")
    given = records.where(F.col("kind").isin("response", "revisit")).select(
        canonical_url(F.col("url")).alias("canon"), "ts", (F.col("kind") == "response").alias("full"), "record_id",
        "etag", "last_modified", F.coalesce("headers", no_headers).alias("headers"),
    )
    given = given.where(~F.col("full") | (F.col("canon").isNotNull() & F.col("ts").isNotNull()))
    order = ["ts", "full", "record_id"]
    n = partitions or int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(given.repartitionByRange(n, "canon", *order).withColumn("part", F.spark_partition_id()), "captures")
    answer = F.when(F.col("full"), F.struct("canon", "ts", "record_id", "etag", "last_modified", "headers"))
    before = Window.partitionBy("part", "canon").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    filled = dealt.withColumn("own", F.last(answer, ignorenulls=True).over(before)).where(~F.col("full"))
    edges = dealt.groupBy("part").agg(F.min("canon").alias("first_canon"), F.max("canon").alias("last_canon"))
    last = F.broadcast(edges.select(F.col("part").alias("of"), "last_canon"))
    tails = (
        dealt.where("full").join(last, (F.col("part") == F.col("of")) & (F.col("canon") == F.col("last_canon")))
        .groupBy("part").agg(F.max_by(answer, F.struct("ts", "record_id")).alias("tail"))
    )
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        edges.join(F.broadcast(tails), "part", "left")
        .withColumn("carried", F.last("tail", ignorenulls=True).over(earlier))
        .where(F.col("carried.canon") == F.col("first_canon"))
        .select("part", F.col("first_canon").alias("canon"), "carried")
    )
    found = filled.join(F.broadcast(carried), ["part", "canon"], "left").withColumn("found", F.coalesce("own", "carried"))
    found = found.withColumn("found", F.when(F.col("ts").isNotNull() & F.col("canon").isNotNull(), F.col("found")))
    same_tag = _strong(F.col("etag")) == _strong(F.col("found.etag"))
    same_time = F.col("last_modified") == F.col("found.last_modified")
    valid = F.coalesce(same_tag, same_time)
    status = (
        F.when(F.col("found").isNull(), "no_response").when(valid, "resolved").when(~valid, "mismatch").otherwise("unverified")
    )
    permitted = F.map_filter("headers", lambda k, _: ~k.isin(*BODY_HEADERS))
    stored = F.map_filter("found.headers", lambda k, _: ~F.map_contains_key(F.col("permitted"), k))
    judged = found.withColumn("status", status).withColumn("permitted", permitted)
    resolved = F.col("status") == "resolved"
    return judged.select(
        "record_id", F.col("canon").alias("canonical_url"), F.when(resolved, F.col("found.record_id")).alias("response_id"), "status",
        F.when(resolved, F.map_concat(stored, F.col("permitted"))).alias("headers"),
    )
