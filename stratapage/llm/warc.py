"""WARC captures: reading records, and resolving not-modified revisits.

A revisit says that a server answered a conditional request with "not
modified". It is resolved by an as-of join to the latest earlier full response
of the same canonical URL; the two validators must agree, and the headers that
such an answer may renew are merged over the stored ones.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Headers of a not-modified answer that replace the stored response's.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that don't change a page.
TRACKING = r"utm_[a-z]+|gclid|fbclid|ref"
#: Seconds of captures of one URL that one task orders.
BUCKET_SECONDS = 4096
#: Bytes of payloads that the reader passes on at once.
HELD_BYTES = 8 << 20

RECORD = "record_id string, warc_type string, target_uri string, captured timestamp, status int, headers map<string,string>, payload_digest string, payload binary"


def canonical_url(url: Column) -> Column:
    """A URL without scheme, ``www.``, default port, fragment, tracking parameters and closing slash; host in lower case, parameters in order. Null and empty stay."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"(?s)#.*$", ""), r"(?i)^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, r"(?s)^[^/?]*", 0)), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"(?s)^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(bare, r"(?s)\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(rf"^({TRACKING})(=|$)")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def _members(raw: bytes) -> Iterator[bytes]:
    """A WARC file's bytes, decompressed one gzip member at a time where it has them; a member that is cut off or broken ends the file."""
    if raw[:2] != b"\x1f\x8b":
        yield raw
        return
    rest = memoryview(raw)
    while len(rest):
        one = zlib.decompressobj(31)
        try:
            out = one.decompress(rest)
        except zlib.error:
            return
        yield out
        if not one.eof:
            return
        rest = rest[len(rest) - len(one.unused_data) :]


def parse(raw: bytes) -> Iterator[tuple]:
    """Records of a WARC file's bytes, each gzip member or the whole read in turn, in RECORD's order with the date as text.

    What is cut off is left out. A record without a usable Content-Length is
    skipped: reading goes on at the next line that opens a record. The payload
    digest is the record's own; where it has none, a full response's is computed.
    """
    for member in _members(raw):
        yield from _records(member)


def _records(raw: bytes) -> Iterator[tuple]:
    at = 0 if raw.startswith(b"WARC/") else _next(raw, 0)
    while at >= 0:
        end = raw.find(b"\r\n\r\n", at)
        if end < 0:
            return
        fields = _headers(raw[at:end])
        size = fields.get("content-length", "")
        if not (size.isascii() and size.isdigit()):
            at = _next(raw, at + 1)
            continue
        block = raw[end + 4 : end + 4 + int(size)]
        if len(block) < int(size):
            return
        at = _next(raw, end + 4 + int(size) - 1)
        status, headers, payload = None, {}, block
        if block.startswith(b"HTTP/"):
            head, _, payload = block.partition(b"\r\n\r\n")
            line = head.split(b"\r\n", 1)[0].split()
            status = int(line[1]) if len(line) > 1 and line[1].isdigit() and len(line[1]) < 9 else None
            headers = _headers(head)
        kind = fields.get("warc-type")
        digest = fields.get("warc-payload-digest")
        if digest is None and kind == "response" and status != 304:
            digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
        yield fields.get("warc-record-id"), kind, fields.get("warc-target-uri"), fields.get("warc-date"), status, headers, digest, payload


def _next(raw: bytes, at: int) -> int:
    """Where the next line that opens a record starts, or -1."""
    found = raw.find(b"\nWARC/", at)
    return found + 1 if found >= 0 else -1


def _headers(head: bytes) -> dict[str, str]:
    """Header lines after the first, names in lower case; a repeated header's values are joined by commas."""
    out: dict[str, str] = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if colon:
            name = name.strip().lower()
            out[name] = f"{out[name]}, {value.strip()}" if name in out else value.strip()
    return out


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files under a path that Spark can read, a file to a row of its reader; resolve_revisits takes them.

    A file is held as it is, its records are decompressed one by one. Broken
    records are left out (see parse), files that are empty or no WARC at all
    give none; dates that can't be read are null.
    """
    import pyarrow as pa

    names = [c.split()[0] for c in RECORD.split(", ")]
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.string(), pa.binary()]

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([list(x.items()) for x in c] if i == 5 else list(c), k) for i, (c, k) in enumerate(zip(zip(*rows, strict=True), kinds, strict=True))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch["content"]:
                held, size = [], 0
                for record in parse(content.as_py() or b""):
                    held.append(record)
                    size += len(record[-1])
                    if size > HELD_BYTES:
                        yield pack(held)
                        held, size = [], 0
                if held:
                    yield pack(held)

    read = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD.replace("captured timestamp", "captured string"))
    return read.withColumn("captured", F.try_to_timestamp("captured"))


def resolve_revisits(records: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """One row for each revisit of records: (record_id, canonical_url, captured, source_id, source_digest, outcome, headers).

    records has record_id, warc_type, target_uri, captured, status, headers and
    payload_digest. A revisit is of type ``revisit`` or a response of status
    304; a full response is of type ``response`` and status 200. Earlier means
    captured strictly before; of several at one time the largest record_id is
    latest. outcome is ``resolved`` where the validators agree (the payload
    digest that an identical-payload revisit has, else ETags compared weakly,
    else Last-Modified; agreed too where the revisit has none),
    ``mismatch`` where they don't, ``unmatched`` without an earlier response;
    only the resolved have a source's headers, renewed by PERMITTED ones.

    A URL may hold any share of all captures: captures are ordered within
    (URL, time bucket), and only the last response of each bucket is ordered by
    URL. Nulls: a null URL or date matches nothing, and such rows are ordered
    with no others; null headers are empty. Repeated rows are resolved alike.
    Other columns are ignored; an empty table gives an empty one.
    """
    none = F.create_map().cast("map<string,string>")
    rows = records.select(
        "record_id", canonical_url(F.col("target_uri")).alias("url"), "captured", F.coalesce("headers", none).alias("headers"), "payload_digest",
        ((F.col("warc_type") == "revisit") | ((F.col("warc_type") == "response") & (F.col("status") == 304))).alias("revisit"),
        ((F.col("warc_type") == "response") & (F.col("status") == 200)).alias("full"),
    ).where("revisit OR full")
    source = F.struct("captured", "record_id", "headers", "payload_digest")
    placed = F.col("captured").isNotNull() & F.col("url").isNotNull()
    loose = rows.where(~placed & F.col("revisit")).withColumn("source", F.when(F.lit(False), source))
    rows = rows.where(placed).withColumn("bucket", F.floor(F.col("captured").cast("long") / bucket_seconds))
    timed = F.when(F.col("full"), source)
    # of equal times revisits stand first, so that a response of the same time isn't earlier
    within = Window.partitionBy("url", "bucket").orderBy("captured", F.col("full").cast("int"), "record_id").rowsBetween(Window.unboundedPreceding, -1)
    near = rows.withColumn("near", F.last(timed, ignorenulls=True).over(within)).where("revisit")

    order = F.struct("captured", "record_id")
    last = rows.where("full").groupBy("url", "bucket").agg(F.max_by(source, order).alias("own"))
    # the last response before each bucket of a URL, from one row for each bucket
    buckets = near.select("url", "bucket").distinct().join(last, ["url", "bucket"], "full")
    before = buckets.withColumn("far", F.last("own", ignorenulls=True).over(Window.partitionBy("url").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).select("url", "bucket", "far")
    found = near.join(before, ["url", "bucket"], "left").withColumn("source", F.coalesce("near", "far"))
    found = found.select(loose.columns).unionAll(loose)

    def header(c: str, name: str) -> Column:
        return F.try_element_at(F.col(c), F.lit(name))

    def weak(c: Column) -> Column:
        return F.regexp_replace(F.trim(c), r"^W/", "")

    tag, date = header("headers", "etag"), header("headers", "last-modified")
    digest = F.col("payload_digest")
    agree = (
        F.when(digest.isNotNull(), F.coalesce(digest == F.col("source.payload_digest"), F.lit(False)))
        .when(tag.isNotNull(), F.coalesce(weak(tag) == weak(header("source.headers", "etag")), F.lit(False)))
        .when(date.isNotNull(), F.coalesce(date == header("source.headers", "last-modified"), F.lit(False)))
        .otherwise(True)
    )
    outcome = F.when(F.col("source").isNull(), "unmatched").when(agree, "resolved").otherwise("mismatch")
    renewed = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED))
    kept = F.map_filter("source.headers", lambda k, v: ~F.array_contains(F.map_keys(renewed), k))
    out = found.withColumn("outcome", outcome)
    return out.select(
        "record_id", F.col("url").alias("canonical_url"), "captured",
        F.when(F.col("source").isNotNull(), F.col("source.record_id")).alias("source_id"),
        F.when(F.col("outcome") == "resolved", F.col("source.payload_digest")).alias("source_digest"),
        "outcome", F.when(F.col("outcome") == "resolved", F.map_concat(kept, renewed)).alias("headers"),
    )


def captures_of_pages(pages: DataFrame, later: int = 500) -> DataFrame:
    """Records of a crawl of pages: a full response of each page at second page_id, and ``later`` seconds after a revisit with its validator.

    A null or empty page is answered with 404, which can't be a source. ETags
    are the content's digest.
    """
    digest = F.md5(F.coalesce(F.col("html"), F.lit("")))
    base = pages.select("page_id", "url", F.coalesce(F.length("html"), F.lit(0)).alias("size"), digest.alias("digest"))
    tag = F.concat(F.lit('"'), F.col("digest"), F.lit('"'))
    response = base.select(
        F.col("page_id").alias("record_id"), F.lit("response").alias("warc_type"), F.col("url").alias("target_uri"), F.timestamp_seconds("page_id").alias("captured"), F.when(F.col("size") > 0, 200).otherwise(404).alias("status"),
        F.create_map(F.lit("etag"), tag, F.lit("content-length"), F.col("size").cast("string"), F.lit("date"), F.col("page_id").cast("string"), F.lit("server"), F.lit("origin")).alias("headers"), F.col("digest").alias("payload_digest"),
    )
    revisit = base.select(
        F.col("page_id").alias("record_id"), F.lit("revisit").alias("warc_type"), F.col("url").alias("target_uri"), F.timestamp_seconds(F.col("page_id") + later).alias("captured"), F.lit(304).alias("status"),
        F.create_map(F.lit("etag"), F.concat(F.lit("W/"), tag), F.lit("date"), (F.col("page_id") + later).cast("string"), F.lit("server"), F.lit("edge")).alias("headers"), F.lit(None).cast("string").alias("payload_digest"),
    )
    return response.unionByName(revisit)
