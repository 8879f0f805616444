"""Web-archive revisits: a not-modified record gets the full response it stands for.

A revisit says that a page has not changed.  It belongs to the latest full response of the same
canonical URL captured before it, if their validators agree; the headers a 304 response may
renew are then taken from it, all others from the full response.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loopwright.llm.common import stored

# The header fields a 304 response renews (RFC 9110, 15.4.5).
RENEWED = ["cache-control", "content-location", "date", "etag", "expires", "vary"]
# Query parameters that do not name a page.
TRACKING = "^(utm_[^=]*|ref|fbclid|gclid)(=|$)"
# Records of a time slice on average.
SLICE_ROWS = 50_000


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.`` and default port, path without end slashes, sorted query.

    Scheme, fragment and tracking parameters are dropped; NULL stays NULL.
    """
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, "^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, ":(80|443)$", ""), "^www[.]", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/+$", "")
    parts = F.filter(
        F.split(F.regexp_extract(rest, "[?](.*)$", 1), "&"),
        lambda x: (x != "") & ~x.rlike(TRACKING),
    )
    query = F.array_join(F.array_sort(parts), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def _header(headers: Column, name: str) -> Column:
    return F.nullif(F.trim(headers[name]), F.lit(""))


def merged_headers(full: Column, revisit: Column) -> Column:
    """The full response's headers, renewed by those of the revisit that may renew them."""
    empty = F.create_map().cast("map<string,string>")
    full, revisit = F.coalesce(full, empty), F.coalesce(revisit, empty)
    renewed = F.map_filter(revisit, lambda k, v: k.isin(RENEWED) & v.isNotNull())
    kept = F.map_filter(full, lambda k, v: ~F.array_contains(F.map_keys(renewed), k))
    return F.map_concat(kept, renewed)


def _agreement(full: Column, revisit: Column) -> Column:
    """Whether validators agree: entity tags (weak comparison) first, else the dates of change."""
    tags = [F.regexp_replace(_header(h, "etag"), "^W/", "") for h in (full, revisit)]
    dates = [_header(h, "last-modified") for h in (full, revisit)]
    verdict = lambda a, b: F.when(a == b, F.lit("resolved")).otherwise(F.lit("mismatch"))
    return (
        F.when(tags[0].isNotNull() & tags[1].isNotNull(), verdict(*tags))
        .when(dates[0].isNotNull() & dates[1].isNotNull(), verdict(*dates))
        .otherwise(F.lit("unverified"))
    )


def resolve_revisits(records: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """One row a revisit: the full response it stands for, the outcome and the merged headers.

    ``records``: ``record_id`` long, ``url``, ``ts`` long, ``kind`` (``response`` or ``revisit``;
    others are ignored), ``headers`` map of lower-case names.  The response is the latest one
    strictly before the revisit with the same canonical URL (of several at one time, the largest
    id).  ``outcome``: ``resolved``, ``mismatch`` (validators differ; no headers), ``unverified``
    (nothing to compare) or ``no_response``.  A revisit without URL or time has no response; such
    responses stand for none.  Repeated revisits get equal answers; an empty table gives no
    rows; other columns are ignored.

    A URL's records are cut into slices of time, and each slice starts from the last response of
    the slices before; so a URL that holds much of the archive is spread over many tasks.
    """
    rows = stored(
        records.filter(F.col("kind").isin("response", "revisit")).select(
            F.col("record_id").cast("long"),
            canonical_url(F.col("url")).alias("page"),
            F.col("ts").cast("long"),
            (F.col("kind") == "response").alias("full"),
            "headers",
        ),
        "captures",
    )
    span = rows.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.count("*").alias("n")).first()
    usable = F.col("page").isNotNull() & F.col("ts").isNotNull()
    slices = max(1, -(-span["n"] // slice_rows))
    width = ((span["hi"] or 0) - (span["lo"] or 0)) // slices + 1
    cut = rows.filter(usable).withColumn(
        "slice", F.floor((F.col("ts") - F.lit(span["lo"] or 0)) / width)
    )
    response = F.struct("record_id", "ts", "headers")
    last_of = (
        cut.filter("full")
        .groupBy("page", "slice")
        .agg(F.max_by(response, F.struct("ts", "record_id")).alias("last"))
    )
    # Every slice of a page that holds records, and the last response before it.
    before = Window.partitionBy("page").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        cut.select("page", "slice")
        .distinct()
        .join(last_of, ["page", "slice"], "left")
        .select("page", "slice", F.last("last", ignorenulls=True).over(before).alias("carried"))
    )
    # At equal times a revisit comes first: its response must be earlier.
    order = Window.partitionBy("page", "slice").orderBy("ts", "full", "record_id").rowsBetween(
        Window.unboundedPreceding, 0
    )
    found = (
        cut.withColumn("near", F.last(F.when(F.col("full"), response), ignorenulls=True).over(order))
        .filter(~F.col("full"))
        .join(carried, ["page", "slice"], "left")
        .select(
            "record_id", "page", "ts", "headers", F.coalesce("near", "carried").alias("response")
        )
    )
    lost = rows.filter(~F.col("full") & ~usable).select(
        "record_id", "page", "ts", "headers", F.lit(None).cast(found.schema["response"].dataType).alias("response")
    )
    answered = found.union(lost).withColumn(
        "outcome",
        F.when(F.col("response").isNull(), F.lit("no_response")).otherwise(
            _agreement(F.col("response.headers"), F.col("headers"))
        ),
    )
    served = F.col("outcome").isin("resolved", "unverified")
    return answered.select(
        "record_id",
        F.col("page").alias("canonical_url"),
        "ts",
        F.col("response.record_id").alias("response_id"),
        F.col("response.ts").alias("response_ts"),
        "outcome",
        F.when(served, merged_headers(F.col("response.headers"), F.col("headers"))).alias("headers"),
    )
