"""WARC archives: segmented, chunked records out and back in.

Writing: one record for each page. Of equal payloads the one with the smallest page_id is
a response, the others revisit it. A response's block is an HTTP message in chunked
transfer framing; a block over ``segment_bytes`` continues in continuation records that
name its origin. Spark's text sink writes the files (record ends are its line separator),
so they go to any store that Spark reaches, whole tasks at a time.

Reading: records are parsed file by file; segments are grouped by origin id, ordered by
segment number, checked for gaps and against the total length, and the HTTP message's
chunks are decoded. A broken record raises.

Rows: one for each page. Null html is an empty payload. Rows that share page_id and
payload: one is the response, the others revisit it. A null page_id counts as the
smallest. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packetloom.llm import _engine as E

SEGMENT_BYTES, CHUNK_BYTES, RECORDS_A_FILE = 32 << 10, 8 << 10, 4000
END = "\r\n\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _cut(raw: bytes, size: int) -> list[bytes]:
    """Pieces of about ``size`` bytes that end at whole characters."""
    out, at = [], 0
    while at < len(raw):
        end = min(at + size, len(raw))
        while end < len(raw) and raw[end] & 0xC0 == 0x80:
            end += 1
        out.append(raw[at:end])
        at = end
    return out


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    return b"".join(b"%x\r\n%b\r\n" % (len(c), c) for c in _cut(payload, size)) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n" or at + size > len(body):
            raise ValueError("chunk without its end")
        out.append(body[at : at + size])
        at += size + 2


def _header(kind: str, fields: list[tuple[str, str]], block: bytes) -> str:
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Date: 1970-01-01T00:00:00Z\r\n{lines}Content-Length: {len(block)}\r\n\r\n"


def records(page_id, copy: int, url: str | None, html: str | None, first, first_copy: int, revisit: bool, segment_bytes: int) -> Iterator[str]:
    """The records of a page, each without its final END."""
    payload = (html or "").encode()
    uid = f"<urn:page:{'' if page_id is None else page_id}:{copy}>"
    uri = "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")
    fields = [("WARC-Record-ID", uid), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest(payload)}")]
    if revisit:
        block = f"{_HTTP}\r\n".encode()
        fields += [("WARC-Refers-To", f"<urn:page:{'' if first is None else first}:{first_copy}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("Content-Type", "application/http;msgtype=response")]
        yield _header("revisit", fields, block) + block.decode()
        return
    block = f"{_HTTP}Transfer-Encoding: chunked\r\n\r\n".encode() + chunked(payload)
    fields.append(("Content-Type", "application/http;msgtype=response"))
    parts = _cut(block, segment_bytes)
    for n, part in enumerate(parts, 1):
        if n == 1:
            yield _header("response", fields + ([("WARC-Segment-Number", "1")] if len(parts) > 1 else []), part) + part.decode()
        else:
            more = [("WARC-Record-ID", f"{uid[:-1]}:{n}>"), ("WARC-Target-URI", uri), ("WARC-Segment-Origin-ID", uid), ("WARC-Segment-Number", str(n))]
            yield _header("continuation", more + ([("WARC-Segment-Total-Length", str(len(block)))] if n == len(parts) else []), part) + part.decode()


def write_archives(pages: DataFrame, path: str, least: int = 0, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Archives of ``pages`` (page_id, url, html) as gzip files under path. Payloads of fewer
    than ``least`` bytes never become revisits."""
    html = F.coalesce("html", F.lit("")).alias("html")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html).withColumn("_sum", F.sha1("html")).withColumn("_id", F.coalesce("page_id", F.lit(-(2**63))))
    first = pages.groupBy("_sum").agg(F.min("_id").alias("_first"))
    # by page and payload, so that copies of a payload spread over all tasks
    roles = pages.groupBy("_id", "_sum").agg(F.lit(1)).select("_id", "_sum").join(first, "_sum")
    one = Window.partitionBy("_id", "_sum").orderBy("url")
    dealt = pages.join(roles, ["_id", "_sum"]).withColumn("_copy", F.row_number().over(one))

    def build(batches):
        for batch in batches:
            out = []
            for page, copy, url, text, own, head in zip(*(batch.column(c).to_pylist() for c in ("page_id", "_copy", "url", "html", "_id", "_first"))):
                revisit = (own != head or copy > 1) and len(text.encode()) >= least
                out += records(page, copy, url, text, None if head == -(2**63) else head, 1, revisit, segment_bytes)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    dealt.select("page_id", "_copy", "url", "html", "_id", "_first").mapInArrow(build, "value string").write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_A_FILE).text(path)


def parse(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a file, gzip or plain."""
    if raw[:2] == b"\x1f\x8b":
        parts = []
        while raw:
            d = zlib.decompressobj(31)
            parts += [d.decompress(raw), d.flush()]
            raw = d.unused_data.lstrip(b"\0")
        raw = b"".join(parts)
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        lines = raw[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(fields["content-length"])
        block = raw[end + 4 : end + 4 + size]
        at = end + 4 + size
        if len(block) < size or raw[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"record of {fields.get('warc-record-id')} does not end where its length says")
        at += 4
        yield fields, block


def payload_of(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


_PARSED = "origin string, segment int, total long, kind string, refers_to string, digest string, uri string, block binary, payload_bytes long"


def read_archives(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """record_id, uri, record_type, refers_to (record id), payload_digest (the record's own
    header), payload_bytes (of a response) and, with ``payload``, the payload."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def parsed(batches):
        for batch in batches:
            for raw in batch.column("content"):
                rows = []
                for f, block in parse(raw.as_py()):
                    kind, number = f["warc-type"], int(f.get("warc-segment-number", 0))
                    origin = f.get("warc-segment-origin-id") or f["warc-record-id"]
                    total = int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None
                    size, keep = None, block
                    if not number:
                        body = payload_of(block)
                        size, keep = (len(body) if kind == "response" else None), (body if payload else None)
                        if kind == "response":
                            _checked(f.get("warc-payload-digest"), body)
                    rows.append((origin, number, total, kind, f.get("warc-refers-to"), f.get("warc-payload-digest"), f.get("warc-target-uri"), keep, size))
                    if len(rows) == 512:
                        yield _batch(rows)
                        rows = []
                yield _batch(rows)

    def whole(batches):
        held: list[tuple] = []
        for batch in batches:
            rows = []
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if not r[1]:
                    rows.append(r)
                    continue
                if held and held[0][0] != r[0]:
                    rows.append(reassembled(held, payload))
                    held = []
                held.append(r)
            yield _batch(rows)
        if held:
            yield _batch([reassembled(held, payload)])

    found = files.mapInArrow(parsed, _PARSED)
    n = E.partitions(spark)
    found = found.repartition(n, "origin").sortWithinPartitions("origin", "segment").mapInArrow(whole, _PARSED)
    columns = [F.col("origin").alias("record_id"), "uri", F.col("kind").alias("record_type"), "refers_to", F.regexp_replace("digest", "^sha1:", "").alias("payload_digest"), "payload_bytes"]
    return found.select(*columns, *[F.col("block").alias("payload")] * payload)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in _PARSED.split(", ")]
    types = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def _checked(said: str | None, body: bytes) -> None:
    if said and said.removeprefix("sha1:") != digest(body):
        raise ValueError("payload does not match its digest")


def reassembled(segments: list[tuple], payload: bool = False) -> tuple:
    """One record from all of its segments, in order of number."""
    if [s[1] for s in segments] != list(range(1, len(segments) + 1)) or segments[-1][2] is None:
        raise ValueError(f"segments of {segments[0][0]} are missing")
    block = b"".join(s[7] for s in segments)
    if len(block) != segments[-1][2]:
        raise ValueError(f"segments of {segments[0][0]} have {len(block)} bytes, not {segments[-1][2]}")
    first, body = segments[0], payload_of(block)
    _checked(first[5], body)
    return (first[0], 0, None, first[3], first[4], first[5], first[6], body if payload else None, len(body))


def _page(record_id):
    return F.regexp_extract(record_id, "<urn:page:(-?[0-9]*):", 1).try_cast("long")


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, as read back."""
    spark = pages.sparkSession
    path = path or E.new_path(spark, "warc")
    write_archives(pages, path)
    found = E.stored(read_archives(spark, path), "records")
    of = found.filter("record_type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest"))
    back = found.filter("record_type = 'revisit'").join(of, "refers_to", "left")
    same = F.when(F.col("_digest") == F.col("payload_digest"), F.col("_bytes"))
    back = back.select("record_id", same.alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    both = found.filter("record_type = 'response'").select("record_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("string").alias("refers_to")).unionByName(back)
    return both.select(_page(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", _page(F.col("refers_to")).alias("refers_to"))


__all__ = ["chunked", "dechunked", "digest", "parse", "payload_of", "read_archives", "reassembled", "records", "round_trip", "write_archives"]
