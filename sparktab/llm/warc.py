"""WARC captures: records in and out of files, and resolution of not-modified revisits.

``resolve`` gives every revisit the latest earlier full response with the same canonical URL
(an as-of join), checks the validators that the two have in common, and lays the headers that a
not-modified answer may update over those of the response.

The as-of join sorts slim records (no payload) into ranges of (URL, time, record), so a URL of any number of
captures is spread over ranges.  Within a range a window finds the latest response; what
earlier ranges leave behind is one row for each range and URL.  Payloads and headers are joined at the
end by the response's id.

States of a revisit: ``resolved``; ``no-url``; ``no-response`` (no earlier full response);
``no-validator`` (none in common); ``mismatch`` (a validator differs).  Only ``resolved`` rows
get a payload and headers; headers that differ in case alone are one.  A response with the revisit's own time is not earlier; of
responses with one time the largest record_id is the latest.  Records without time cannot be ordered: such
responses are ignored and such revisits are ``no-response``.  Repeated rows are records of their own; extra columns are ignored; an empty table
gives none.  Very long payloads travel once, with their revisit.
"""

from __future__ import annotations

import gzip
import io
import re
import zlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import SLICE_BYTES, durable, in_batches

#: Header fields that a not-modified answer must not change, fixed values (lower case).
KEPT_HEADERS = ("connection", "content-encoding", "content-length", "content-md5", "content-range", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade")

#: Bytes of a compressed member that are read at once.
CHUNK = 1 << 16

_filled = re.compile(b"[^\\0]").search

#: Query parameters that do not name a page, as a pattern.
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid|sessionid|phpsessid|jsessionid)(=|$)"

SCHEMA = "record_id long, kind string, url string, ts timestamp, status int, etag string, last_modified string, digest string, headers map<string,string>, payload binary"


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.`` and default port; no scheme, user, fragment, tracking
    parameters or final slash; parameters in order.  Null or blank: null."""
    text = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    head = F.split_part(text, F.lit("?"), F.lit(1))
    host = F.regexp_replace(F.regexp_replace(F.lower(F.split_part(head, F.lit("/"), F.lit(1))), "^[^@]*@", ""), ":(80|443)$", "")
    host = F.regexp_replace(host, "^www[0-9]*\\.", "")
    path = F.regexp_replace(F.regexp_replace(head, "^[^/]*", ""), "/+$", "")
    query = F.when(F.instr(text, "?") > 0, F.regexp_replace(text, "^[^?]*\\?", "")).otherwise("")
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING)))
    full = F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))
    return F.when(F.trim(url) != "", full)


def latest_before(records: DataFrame) -> DataFrame:
    """(row, source): for each revisit row, the row of the latest earlier response of its URL.

    records: row (unique), key, ts, record_id, response boolean.
    """
    order = ["key", "ts", "response", "record_id", "row"]
    ranged = durable(records.filter("key is not null and ts is not null").repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    inside = W.partitionBy("range", "key").orderBy(*order[1:]).rowsBetween(W.unboundedPreceding, -1)
    seen = F.last(F.when(F.col("response"), F.col("row")), ignorenulls=True).over(inside)
    here = ranged.withColumn("here", seen).filter("not response").select("row", "key", "range", "here")
    ends = ranged.filter("response").groupBy("range", "key").agg(F.max_by("row", F.struct("ts", "record_id", "row")).alias("last"))
    spans = ranged.groupBy("range", "key").agg(F.lit(1).alias("one")).join(ends, ["range", "key"], "left")
    before = spans.select("range", "key", F.last("last", ignorenulls=True).over(W.partitionBy("key").orderBy("range").rowsBetween(W.unboundedPreceding, -1)).alias("before"))
    return here.join(before, ["range", "key"], "left").select("row", F.coalesce("here", "before").alias("source"))


def _weak(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def folded_headers(headers: Column) -> Column:
    """Headers by lower-case name, in order of names; the values of names that differ in case alone are joined
    by comma and space, in order, as those of a repeated field."""
    entries = F.array_sort(F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["key"].alias("own"), e["value"].alias("value"))))
    names = F.array_distinct(F.transform(entries, lambda e: e["key"]))

    def joined(name: Column) -> Column:
        values = F.filter(F.transform(F.filter(entries, lambda e: e["key"] == name), lambda e: e["value"]), lambda v: v.isNotNull())
        return F.when(F.size(values) > 0, F.array_join(values, ", "))

    return F.map_from_arrays(names, F.transform(names, joined))


def merged_headers(stored: Column, update: Column) -> Column:
    """Stored headers (names in lower case) under the permitted ones of a not-modified answer."""
    permitted = F.map_filter(folded_headers(update), lambda k, v: ~k.isin(*KEPT_HEADERS))
    return F.map_concat(F.map_filter(folded_headers(stored), lambda k, v: ~F.array_contains(F.map_keys(permitted), k)), permitted)


def resolve(records: DataFrame) -> DataFrame:
    """One row for each revisit: (record_id, url, ts, state, source_id, headers, payload).

    records: the columns of ``SCHEMA``; kind is ``response`` or ``revisit``, other kinds are ignored.
    """
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    rows = durable(records.filter(F.col("kind").isin("response", "revisit")).select(*columns).withColumn("row", F.monotonically_increasing_id()))
    slim = rows.select("row", canonical_url(F.col("url")).alias("key"), "ts", "record_id", (F.col("kind") == "response").alias("response"))
    found = latest_before(slim)
    revisits = rows.filter("kind = 'revisit'").drop("payload").join(found, "row", "left")
    sources = rows.filter("kind = 'response'").select(F.col("row").alias("source"), *(F.col(c).alias(f"of_{c}") for c in ("record_id", "etag", "last_modified", "digest", "headers", "payload")))
    both = revisits.join(sources, "source", "left")
    checks = [(_weak(F.col("etag")), _weak(F.col("of_etag"))), (F.col("last_modified"), F.col("of_last_modified")), (F.col("digest"), F.col("of_digest"))]
    common = reduce(Column.__or__, (a.isNotNull() & b.isNotNull() for a, b in checks))
    differ = reduce(Column.__or__, (F.coalesce(a != b, F.lit(False)) for a, b in checks))
    state = (
        F.when(canonical_url(F.col("url")).isNull(), "no-url").when(F.col("source").isNull(), "no-response").when(~common, "no-validator").when(differ, "mismatch").otherwise("resolved")
    )
    none = F.expr("cast(map() as map<string,string>)")
    out = both.withColumn("state", state)
    fine = F.col("state") == "resolved"
    return out.select(
        "record_id", "url", "ts", "state",
        F.when(fine, F.col("of_record_id")).alias("source_id"),
        F.when(fine, merged_headers(F.coalesce("of_headers", none), F.coalesce("headers", none))).alias("headers"),
        F.when(fine, F.col("of_payload")).alias("payload"),
    )


def _fields(block: bytes) -> tuple[bytes, dict[str, str]]:
    first, _, rest = block.partition(b"\r\n")
    fields = {}
    for line in rest.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if colon:
            fields[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    return first, fields


def _members(raw: bytes) -> Iterator[tuple[bytes, str | None]]:
    """The file's bytes, or what each gzip member of it holds, with what is wrong about it.

    A member is read in chunks from its own place, so the work grows with the file's length; behind a broken one the
    next that can be one is tried.
    """
    if raw[:2] != b"\x1f\x8b":
        yield raw, None
        return
    view, at = memoryview(raw), 0
    while (found := _filled(raw, at)) is not None:
        at = pos = found.start()
        one, parts = zlib.decompressobj(31), []
        try:
            while not one.eof and pos < len(raw):
                parts.append(one.decompress(view[pos : pos + CHUNK]))
                pos += CHUNK
        except zlib.error:
            yield b"".join(parts), "broken compression"
            at = raw.find(b"\x1f\x8b\x08", at + 1)
            if at < 0:
                return
            continue
        if not one.eof:
            yield b"".join(parts), "cut short"
            return
        at = min(pos, len(raw)) - len(one.unused_data)
        yield b"".join(parts), None


def _broken(reason: str) -> dict:
    return {"kind": "broken", "url": None, "ts": None, "status": None, "etag": None, "last_modified": None, "digest": None, "headers": {"error": reason}, "payload": b""}


def parse(raw: bytes) -> Iterator[dict]:
    """The response and revisit records of a WARC file (plain, or one gzip member for each record).

    Other kinds of records are passed over.  What cannot be read gives a record of kind ``broken`` with the
    reason under the header ``error``: a length that is no number (reading goes on at the next record's mark), a record
    or member that is cut short, broken compression.
    """
    for part, wrong in _members(raw):
        at = 0
        whole = True
        while (at := part.find(b"WARC/", at)) >= 0:
            end = part.find(b"\r\n\r\n", at)
            if end < 0:
                whole = False
                break
            _, warc = _fields(part[at:end])
            length = warc.get("content-length", "")
            if not (length.isascii() and length.isdigit() and len(length) < 19):
                yield _broken("bad length")
                at = end + 4
                continue
            body = part[end + 4 : end + 4 + int(length)]
            at = end + 4 + int(length)
            if len(body) < int(length):
                whole = False
                break
            if warc.get("warc-type") not in ("response", "revisit"):
                continue
            head, _, payload = body.partition(b"\r\n\r\n")
            status, headers = _fields(head)
            code = status.split(b" ")[1:2]
            yield {
                "kind": warc["warc-type"], "url": warc.get("warc-target-uri"), "ts": warc.get("warc-date"), "status": int(code[0]) if code and re.fullmatch(rb"[0-9]{1,9}", code[0]) else None,
                "etag": headers.get("etag"), "last_modified": headers.get("last-modified"), "digest": warc.get("warc-payload-digest"), "headers": headers, "payload": payload,
            }
        if wrong or not whole:
            yield _broken(wrong or "cut short")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files as a table (``SCHEMA``); record_id numbers them by file and place.

    A file is one task's work and goes through it as a whole (Spark's limit is 2 GB), its records leave it in slices.
    """
    fields = [("kind", pa.string()), ("url", pa.string()), ("ts", pa.string()), ("status", pa.int32()), ("etag", pa.string()), ("last_modified", pa.string()), ("digest", pa.string())]
    kind = pa.struct([*fields, ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                held: list[dict] = []
                size = 0
                for one in parse(raw.as_py()):
                    held.append(one | {"headers": list(one["headers"].items())})
                    size += len(one["payload"]) + 1024
                    if size > SLICE_BYTES:
                        yield pa.RecordBatch.from_struct_array(pa.array(held, kind))
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_struct_array(pa.array(held, kind))

    files = in_batches(spark.read.format("binaryFile").load(path).select("content"))
    found = files.mapInArrow(run, "kind string, url string, ts string, status int, etag string, last_modified string, digest string, headers map<string,string>, payload binary")
    return found.select(F.monotonically_increasing_id().alias("record_id"), "kind", "url", F.try_to_timestamp("ts").alias("ts"), "status", "etag", "last_modified", "digest", "headers", "payload")


def to_warc(records: list[dict], compress: bool = True) -> bytes:
    """Records as the bytes of a WARC file."""
    out = io.BytesIO()
    for r in records:
        head = f"HTTP/1.1 {r.get('status') or 200} X\r\n" + "".join(f"{k}: {v}\r\n" for k, v in (r.get("headers") or {}).items())
        body = head.encode() + b"\r\n" + (r.get("payload") or b"")
        fields = {"WARC-Type": r["kind"], "WARC-Target-URI": r.get("url"), "WARC-Date": r.get("ts"), "WARC-Payload-Digest": r.get("digest"), "Content-Length": len(body)}
        block = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None).encode() + b"\r\n" + body + b"\r\n\r\n"
        out.write(gzip.compress(block, mtime=0) if compress else block)
    return out.getvalue()


def captures(pages: DataFrame) -> DataFrame:
    """A capture log of a table of pages (page_id, url, html), as records.

    Every page is fetched in full at 2 page_id seconds, and asked for again, with the entity tag
    of that body, seven seconds later; the second answer is a not-modified revisit.
    """
    tag = F.concat(F.lit('"'), F.substring(F.sha2(F.col("html").cast("binary"), 256), 1, 16), F.lit('"'))
    seconds = F.col("page_id") * 2
    size = F.octet_length("html").cast("string")
    none = F.lit(None)
    length = F.coalesce(size, F.lit("0"))
    full = F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), length, F.lit("Cache-Control"), F.lit("max-age=60"), F.lit("Age"), F.lit("0"))
    again = F.create_map(F.lit("Cache-Control"), F.lit("max-age=600"), F.lit("Content-Length"), F.lit("0"), F.lit("Age"), F.col("page_id").cast("string"))

    def record(kind: str, at: Column, status: int, headers: Column, payload: Column) -> DataFrame:
        return pages.select(
            F.col("page_id").cast("long").alias("record_id"), F.lit(kind).alias("kind"), F.col("url").cast("string").alias("url"), F.timestamp_seconds(at).alias("ts"), F.lit(status).alias("status"), tag.alias("etag"),
            none.cast("string").alias("last_modified"), none.cast("string").alias("digest"), headers.alias("headers"), payload.alias("payload"),
        )

    return record("response", seconds, 200, full, F.col("html").cast("binary")).unionByName(record("revisit", seconds + 7, 304, again, none.cast("binary")))


def digests(resolved: DataFrame) -> DataFrame:
    lines = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])))
    return resolved.select(
        F.col("record_id").alias("page_id"),
        "state",
        "source_id",
        F.array_join(lines, "; ").alias("headers"),
        F.sha2("payload", 256).alias("payload_sha256"),
    )
