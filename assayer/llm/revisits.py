"""Not-modified revisits of web captures: each takes its content from the latest earlier full response of its canonical URL.

The as-of lookup runs in windows over (URL, slice of time), so that one URL with a large share of all captures is many windows; the
latest response of every slice is carried into the later ones through a table with one line per URL and slice.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Header fields of a not-modified answer that never replace those of the stored response.
KEPT_FIELDS = ("connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type", "etag",
               "keep-alive", "proxy-authenticate", "proxy-authorization", "proxy-connection", "te", "trailer",
               "transfer-encoding", "upgrade")
#: Query parameters that only track visits.
TRACKING = "^(utm_[a-z]+|gclid|fbclid|ref)="
SLICES = 64


def canonical_url(url: Column) -> Column:
    """Lower-case host without ``www.`` and default port, path without a closing slash, sorted query without tracking; no scheme, no fragment."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    rest = F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, "^([^/?]*)", 1)), "^www[.]", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(rest, "[?](.*)$", 1), "&"),
                                  lambda p: (p != "") & ~F.lower(p).rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(F.lit("")))


def parse_headers(block: Column) -> Column:
    """``name: value`` lines as a map with lower-case names; of a repeated name the last line counts, lines without a colon do not."""
    lines = F.filter(F.split(F.coalesce(block, F.lit("")), "\r?\n"), lambda x: F.instr(x, ":") > 0)
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"),
                                                  F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("v")))
    later = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(later)


def merge_headers(stored: Column, fresh: Column) -> Column:
    """Stored fields, replaced or joined by those of the not-modified answer that may change them."""
    allowed = F.map_filter(fresh, lambda k, _: ~k.isin(*KEPT_FIELDS))
    return F.map_concat(F.map_filter(stored, lambda k, _: ~F.map_contains_key(allowed, k)), allowed)


def header_text(headers: Column) -> Column:
    """``name: value`` in name order, joined by ``; ``."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "; ")


def _strong(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), "^W/", "")


def resolve(records: DataFrame, record_col: str = "record_id", url_col: str = "url", time_col: str = "captured",
            status_col: str = "status", headers_col: str = "headers", digest_col: str = "payload_digest",
            slices: int = SLICES) -> DataFrame:
    """One row per not-modified record (status 304): what it stands for.

    Returns ``record_id, url_key, captured, state, response_id, response_captured, headers, payload_digest``. The response is the
    latest record with status 200 and a strictly earlier time under the same canonical URL; at equal times the greatest record id.
    ``state`` is ``resolved`` when the validators agree: entity tags compare weakly; without a tag on either side Last-Modified must be
    equal; without any validator to compare nothing contradicts the server and the revisit stands. It is ``changed`` when they
    differ and ``orphan`` without an earlier response; then digest and merged headers are null. Records without URL or time are
    orphans. Repeated rows stay repeated; other statuses, other columns and empty tables are fine.
    """
    def col(name: str) -> Column:
        return F.col(f"`{name}`")

    status = col(status_col).cast("int")
    rows = records.filter(status.isin(200, 304)).select(
        col(record_col).alias("record_id"), canonical_url(col(url_col)).alias("url_key"), col(time_col).alias("captured"),
        F.unix_micros(col(time_col)).alias("_at"), (status == 200).alias("_full"), col(digest_col).alias("payload_digest"),
        F.coalesce(col(headers_col), F.create_map().cast("map<string,string>")).alias("_headers"))
    bounds = sorted(set(rows.agg(F.percentile_approx("_at", [i / slices for i in range(1, slices)], 1000)).first()[0] or []))
    rows = rows.withColumn("_slice", F.size(F.filter(F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast("array<bigint>"),
                                                     lambda b: b < F.col("_at"))))
    # headers travel as an entry list, which compares; maps do not
    answer = F.when(F.col("_full") & F.col("_at").isNotNull() & F.col("url_key").isNotNull(), F.struct(
        F.col("_at").alias("at"), F.col("record_id").alias("id"), F.col("captured").alias("captured"),
        F.col("payload_digest").alias("digest"), F.array_sort(F.map_entries("_headers")).alias("headers")))
    rows = rows.withColumn("_answer", answer)
    earlier = Window.partitionBy("url_key", "_slice").orderBy("_at").rangeBetween(Window.unboundedPreceding, -1)
    near = rows.withColumn("_near", F.max("_answer").over(earlier)).filter(~F.col("_full"))
    last = rows.filter(F.col("_answer").isNotNull()).groupBy("url_key", "_slice").agg(F.max("_answer").alias("_last"))
    # every slice of a URL that holds a revisit learns the latest response of the slices before it
    asked = rows.filter(~F.col("_full") & F.col("url_key").isNotNull()).select("url_key", "_slice").distinct()
    steps = asked.join(last, ["url_key", "_slice"], "full")
    before = Window.partitionBy("url_key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = steps.withColumn("_carried", F.max("_last").over(before)).select("url_key", "_slice", "_carried")
    found = near.join(carried.filter(F.col("_carried").isNotNull()), ["url_key", "_slice"], "left") \
        .withColumn("_from", F.when(F.col("_at").isNotNull(), F.coalesce("_near", "_carried")))
    stored, fresh = F.map_from_entries("_from.headers"), F.col("_headers")
    tag_a, tag_b = _strong(F.element_at(stored, "etag")), _strong(F.element_at(fresh, "etag"))
    day_a, day_b = F.element_at(stored, "last-modified"), F.element_at(fresh, "last-modified")
    agrees = F.when(tag_a.isNotNull() & tag_b.isNotNull(), tag_a == tag_b).when(
        day_a.isNotNull() & day_b.isNotNull(), day_a == day_b).otherwise(F.lit(True))
    good = F.col("_from").isNotNull() & agrees
    return found.select(
        "record_id", "url_key", "captured",
        F.when(F.col("_from").isNull(), "orphan").when(agrees, "resolved").otherwise("changed").alias("state"),
        F.col("_from.id").alias("response_id"), F.col("_from.captured").alias("response_captured"),
        F.when(good, merge_headers(stored, fresh)).alias("headers"), F.when(good, F.col("_from.digest")).alias("payload_digest"))


def attach_payload(resolved: DataFrame, records: DataFrame, record_col: str, payload_col: str) -> DataFrame:
    """Resolved revisits with the payload of their response, joined by record id; the payload is null where none was resolved."""
    payload = records.select(F.col(f"`{record_col}`").alias("response_id"), F.col(f"`{payload_col}`").alias("payload"))
    wanted = resolved.withColumn("_id", F.when(F.col("state") == "resolved", F.col("response_id")))
    return wanted.join(payload.withColumnRenamed("response_id", "_id"), "_id", "left").drop("_id")
