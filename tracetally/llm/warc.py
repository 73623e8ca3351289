"""Not-modified revisits of a web archive: find the response that a 304 stands for.

An as-of join by canonical URL gives every revisit the latest full response captured earlier.
Captures of one URL are scanned in blocks of time, each starting from the last response of the
blocks before, so a URL with very many captures is not one task. The validators must agree: entity
tags by weak comparison if both have one, else the modification dates. The restored record has the
response's headers, updated by those a 304 may change.

Records have record_id, url, captured (seconds), status, headers (map with lower-case names).
Defined results: captures at the same second are not earlier; of responses in one second the one with
the largest id counts; records that are neither 200 nor 304 are ignored; a null URL or time matches
nothing (``no_response``); null headers count as none; repeated rows are resolved each. An empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scan import carry_blocks

DAY = 86_400
# Header fields that a 304 response sends to update a stored one.
UPDATES = ["cache-control", "content-location", "date", "etag", "expires", "vary"]
TRACKING = r"^(?:ref|fbclid|gclid|utm_[a-z]+)(?:=|$)"
HOST_PREFIX = r"^(?:www|m)\."


def canonical_url(url: Column) -> Column:
    """Host in lower case without default port and www. or m., no scheme, fragment, trailing slash or tracking; query sorted."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    place, query = F.regexp_replace(bare, r"\?.*$", ""), F.regexp_extract(bare, r"\?(.*)$", 1)
    host = F.lower(F.regexp_replace(place, r"/.*$", ""))
    host = F.regexp_replace(F.regexp_replace(host, r":(?:80|443)$", ""), HOST_PREFIX, "")
    path = F.regexp_replace(F.regexp_extract(place, r"^[^/]*(/.*)$", 1), r"/+$", "")
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolve(records: DataFrame, block_seconds: int = DAY) -> DataFrame:
    """record_id, canonical_url, captured, response_id, outcome and headers of every revisit.

    Outcomes: ``resolved``, ``no_response`` and ``validator_mismatch``; headers are null unless resolved.
    """
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    rows = records.filter("status IN (200, 304)").select(
        "record_id", canonical_url(F.col("url")).alias("canonical_url"), "captured", (F.col("status") == 304).alias("revisit"),
        F.coalesce("headers", none).alias("headers"),
    )
    usable = F.col("canonical_url").isNotNull() & F.col("captured").isNotNull()
    lost = rows.filter("revisit").filter(~usable).withColumn("response", F.lit(None).cast(f"struct<id:{rows.schema['record_id'].dataType.simpleString()},headers:map<string,string>>"))
    rows = rows.filter(usable).withColumn("block", F.floor(F.col("captured") / block_seconds))
    response = F.when(~F.col("revisit"), F.struct(F.col("record_id").alias("id"), "headers"))
    rows = rows.withColumn("own", response).withColumn("place", F.struct("captured", (~F.col("revisit")).alias("late"), "record_id"))
    # max_by leaves out rows without order, so revisits do not count
    last = {"last": F.max_by("own", F.when(~F.col("revisit"), F.col("place"))), "edge": F.max(F.when(~F.col("revisit"), F.col("place")))}
    rows = carry_blocks(rows, ["canonical_url"], "block", last, {"carried": F.max_by("last", F.col("edge"))})
    upto = Window.partitionBy("canonical_url", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("response", F.coalesce(F.last("own", ignorenulls=True).over(upto), F.col("carried")))
    seen = rows.filter("revisit").select(*lost.columns).unionByName(lost)
    ours, theirs = F.col("headers"), F.col("response.headers")
    tags = ours["etag"].isNotNull() & theirs["etag"].isNotNull()
    same = F.when(tags, weak(ours["etag"]) == weak(theirs["etag"])).otherwise(F.coalesce(ours["last-modified"] == theirs["last-modified"], F.lit(False)))
    outcome = F.when(F.col("response").isNull(), "no_response").when(same, "resolved").otherwise("validator_mismatch")
    news = F.map_filter(ours, lambda k, v: k.isin(UPDATES))
    merged = F.map_concat(F.map_filter(theirs, lambda k, v: ~F.map_contains_key(news, k)), news)
    return seen.select(
        "record_id", "canonical_url", "captured", F.when(outcome != "no_response", F.col("response.id")).alias("response_id"),
        outcome.alias("outcome"), F.when(outcome == "resolved", merged).alias("headers"),
    )


def header_lines(headers: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat_ws(": ", e["key"], e["value"])), "\n")
