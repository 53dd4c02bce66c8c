"""Not-modified revisits of web captures, resolved against the latest earlier full response.

Captures of one canonical URL are put in time order and each revisit looks back to the last response
strictly before it. A URL may hold any share of all captures: the order is cut into blocks of bounded
size whatever the URLs in it, the look-back runs inside blocks, and a block whose first URL began
earlier gets the last response from the blocks before it (one row per block). Only ids and validators
take part; headers and bodies are joined to the few columns that were found.

The validators then decide. With entity tags on both sides they must be equal under weak comparison
(without ``W/``); else the times of last modification must be equal; else nothing is proven and the
revisit stays open. A resolved revisit has the body and status of the response, and the headers of the
response with those that a 304 may change replaced.

Defined cases: revisits with no earlier response, no common validator, or validators that differ, are
returned with the outcome that says so and without a base; of responses at one time the largest id
counts; a null time or URL never finds a base and is no base; header names count without case; repeated
rows are resolved each for itself, and of responses that repeat an id one is read; a revisit without an id
is resolved like others, a response without one is no base.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.llm.blocks import in_blocks
from ledgerlark.llm.link_graph import lower_ascii
from ledgerlark.session import pin

#: Header fields that a 304 response carries for the stored one (RFC 9110, section 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
RESPONSE, REVISIT = "response", "revisit"


def canonical_url(url: Column) -> Column:
    """Without scheme, fragment, default port, tracking parameters and an empty query; host in lower case."""
    bare = F.regexp_replace(F.regexp_replace(url, "^[A-Za-z][A-Za-z0-9+.-]*://", ""), "#.*$", "")
    host = F.regexp_replace(lower_ascii(F.regexp_extract(bare, "^([^/?]*)", 1)), ":(80|443)$", "")
    path = F.regexp_extract(bare, "^[^/?]*([^?]*)", 1)
    query = F.regexp_replace(F.regexp_extract(bare, "\\?(.*)$", 1), "(^|&)(utm_[a-z]+|gclid|fbclid)=[^&]*", "")
    query = F.regexp_replace(query, "^&", "")
    return F.concat(host, F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def latest_response(captures: DataFrame) -> DataFrame:
    """url_key and captured_at of revisits, once each, with ``base`` (record_id, etag, last_modified of the
    response), null if none: what a revisit looks back on depends on nothing else.

    ``captures`` has record_id, url_key, captured_at, kind, etag and last_modified.
    """
    narrow = captures.where(F.col("url_key").isNotNull() & F.col("captured_at").isNotNull()).select(
        "record_id", "url_key", "captured_at", (F.col("kind") == RESPONSE).alias("_full"), "etag", "last_modified"
    )
    narrow = narrow.where(F.col("record_id").isNotNull() | ~F.col("_full"))
    # at one time revisits come first, so that a response is strictly earlier than what it answers
    tie = F.xxhash64(F.monotonically_increasing_id())
    order = [F.col(c) for c in ("url_key", "captured_at", "_full", "record_id", "_tie")]
    rows = in_blocks(narrow.withColumn("_tie", tie), order)
    rows = rows.withColumn("_own", F.when(F.col("_full"), F.struct("record_id", "etag", "last_modified")))
    inside = Window.partitionBy("_block", "url_key").orderBy("_seq").rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.withColumn("_inside", F.last("_own", ignorenulls=True).over(inside))
    # one row per block: its first and last URL, and the last response of the last URL
    edge = rows.groupBy("_block").agg(F.min_by("url_key", "_seq").alias("_first"), F.max_by("url_key", "_seq").alias("_last"))
    edge = pin(edge)
    last = rows.join(F.broadcast(edge.select("_block", F.col("_last").alias("url_key"))), ["_block", "url_key"])
    last = last.groupBy("_block", "url_key").agg(F.max_by("_own", F.when(F.col("_full"), F.col("_seq"))).alias("_carry"))
    asks = edge.select("_block", F.col("_first").alias("url_key"), F.lit(0).alias("_when"), F.lit(None).cast(last.schema["_carry"].dataType).alias("_carry"))
    line = asks.unionByName(last.withColumn("_when", F.lit(1)))
    before = Window.partitionBy("url_key").orderBy("_block", "_when").rowsBetween(Window.unboundedPreceding, -1)
    carried = line.withColumn("_before", F.last("_carry", ignorenulls=True).over(before)).where("_when = 0").select("_block", "url_key", "_before")
    found = seen.where(~F.col("_full")).join(F.broadcast(pin(carried)), ["_block", "url_key"], "left")
    return found.groupBy("url_key", "captured_at").agg(F.max(F.coalesce("_inside", "_before")).alias("base"))


def outcome(base: Column, etag: Column, last_modified: Column) -> Column:
    weak = lambda tag: F.regexp_replace(F.trim(tag), "^W/", "")
    base_tag, base_time = base["etag"], base["last_modified"]
    return (
        F.when(base.isNull(), "no_base")
        .when(base_tag.isNotNull() & etag.isNotNull(), F.when(weak(base_tag) == weak(etag), "resolved").otherwise("validator_mismatch"))
        .when(base_time.isNotNull() & last_modified.isNotNull(), F.when(base_time == last_modified, "resolved").otherwise("validator_mismatch"))
        .otherwise("no_validator")
    )


def merged_headers(stored: Column, fresh: Column) -> Column:
    """``stored`` with the permitted fields of ``fresh`` put in their place; names in lower case."""
    lower = lambda m: F.transform_keys(m, lambda k, v: F.lower(k))
    allowed = F.map_filter(lower(fresh), lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    kept = F.map_filter(lower(stored), lambda k, v: ~F.map_contains_key(allowed, k))
    return F.map_concat(kept, allowed)


def resolved_revisits(captures: DataFrame) -> DataFrame:
    """For each revisit: record_id, outcome, base_id, and status, headers and payload of the resolved response.

    ``captures`` has record_id (of one capture, whose row may repeat), url, captured_at, kind, status, headers (map) and payload; other
    columns are left alone.
    """
    header = lambda name: F.element_at(F.map_filter("headers", lambda k, v: F.lower(k) == name), F.lit(name))
    headers = F.transform_keys("headers", lambda k, v: F.lower(k))
    known = captures.select("record_id", "kind", "captured_at", "status", headers.alias("headers"), "payload", canonical_url(F.col("url")).alias("url_key"))
    known = known.withColumns({"etag": header("etag"), "last_modified": header("last-modified")})
    found = latest_response(known)
    asked = known.where(F.col("kind") == REVISIT).select("record_id", "url_key", "captured_at", "headers", "etag", "last_modified")
    asked = asked.join(found, ["url_key", "captured_at"], "left")
    asked = asked.withColumn("outcome", outcome(F.col("base"), F.col("etag"), F.col("last_modified")))
    asked = asked.withColumn("base_id", F.when(F.col("outcome") == "resolved", F.col("base.record_id")))
    full = known.where(F.col("kind") == RESPONSE).select(
        F.col("record_id").alias("_base"), F.col("status"), F.col("headers").alias("_headers"), F.col("payload")
    ).dropDuplicates(["_base"])
    joined = asked.join(full, asked["base_id"] == full["_base"], "left")
    return joined.select(
        "record_id", "url_key", "captured_at", "outcome", "base_id", "status",
        F.when(F.col("base_id").isNotNull(), merged_headers(F.col("_headers"), F.col("headers"))).alias("headers"), "payload",
    )
