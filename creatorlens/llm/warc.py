"""WARC archives: writing with segments, reading back by segment reassembly.

A page becomes a response record whose block is an HTTP message with a chunked body. A block
longer than a segment is split: the record itself is segment 1, the rest are continuation
records that name it as origin. Of pages with equal payloads only the first is stored; the
others become revisit records that refer to it.

The reader takes records off a stream, groups continuation records by their origin, orders
them by segment number, verifies that they are complete and that their total length is the
one declared, and decodes the chunked framing. Archives are compressed whole, so one task
reads a file from its start.

Edge cases: null html is an empty payload. Of equal payloads the smallest page_id is the
response, a missing page_id coming last; among rows that share page_id and payload it is any
one of them. Payloads under ``min_bytes`` are all responses. Records that cannot be put
together (missing segments, wrong length, broken chunks) come back with ``complete`` false
and a null payload. Very long pages are cut into segments and chunks like any other, and put
together in one task. Repeated rows each have a record. An empty table gives empty archives and
no rows. Columns of the pages other than page_id, url and html are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_texts, drop_paths, new_path, stored, stored_at, with_arrow_columns

VERSION = b"WARC/1.1\r\n"
END = "\r\n\r\n"
SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
DATE = "2024-01-01T00:00:00Z"  # the tables have no capture time
ID_PREFIX = "urn:page:"


def payload_digest(payload: bytes) -> str:
    """Base32 of SHA-1, upper case."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, chunk_bytes: int) -> bytes:
    parts = [payload[i : i + chunk_bytes] for i in range(0, len(payload), chunk_bytes)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        stop = body.index(b"\r\n", at)
        size = int(body[at:stop].split(b";")[0], 16)
        at = stop + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk of wrong length")
        out.append(body[at : at + size])
        at += size + 2


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without the two line ends that close it."""
    lines = [*headers, ("WARC-Date", DATE), ("Content-Length", str(len(block)))]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block


def _records(record_id: str, url: str, payload: bytes, digest: str, refers_to: str | None, segment: int, chunk: int) -> Iterator[bytes]:
    common = [("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers_to is not None:
        yield _record(
            [
                ("WARC-Type", "revisit"), ("WARC-Record-ID", f"<{record_id}>"), *common,
                ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                ("WARC-Refers-To", f"<{refers_to}>"), ("Content-Type", "application/http; msgtype=response"),
            ],
            b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n",
        )
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    head = [("WARC-Type", "response"), ("WARC-Record-ID", f"<{record_id}>"), *common, ("Content-Type", "application/http; msgtype=response")]
    yield _record(head + ([("WARC-Segment-Number", "1")] if len(parts) > 1 else []), parts[0])
    for n, part in enumerate(parts[1:], 2):
        extra = [("WARC-Segment-Total-Length", str(len(block)))] if n == len(parts) else []
        yield _record(
            [
                ("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{record_id}:{n}>"), ("WARC-Target-URI", url),
                ("WARC-Segment-Origin-ID", f"<{record_id}>"), ("WARC-Segment-Number", str(n)), *extra,
            ],
            part,
        )


def write(pages: DataFrame, path: str, min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES) -> None:
    """Archive ``pages`` (page_id, url, html) below ``path``."""
    def digests():
        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = byte_texts(batch.column("html"))
            return [pa.array([payload_digest(t) for t in texts], pa.string()), pa.array([len(t) for t in texts], pa.int64())]

        return compute

    numbered = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    numbered = with_arrow_columns(
        numbered, [T.StructField("digest", T.StringType()), T.StructField("bytes", T.LongType())], digests
    ).withColumn("row", F.monotonically_increasing_id())
    held = new_path(pages.sparkSession, "warc-pages")
    numbered = stored_at(numbered, held)  # row numbers must not change between the two uses
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")
    firsts = (
        numbered.where(F.col("bytes") >= min_bytes)
        .groupBy("digest", "bytes")
        .agg(F.min(order).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", "bytes", F.col("first.page_id").alias("first_id"), F.col("first.row").alias("first_row"))
    )
    rows = numbered.join(firsts, ["digest", "bytes"], "left")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {n: batch.column(n).to_pylist() for n in ("page_id", "url", "digest", "row", "first_id", "first_row")}
            out = []
            for i, payload in enumerate(byte_texts(batch.column("html"))):
                again = c["first_row"][i] is not None and c["first_row"][i] != c["row"][i]
                name = lambda page, row: f"{ID_PREFIX}{'' if page is None else page}:{row}"
                url = (c["url"][i] or "").replace("\r", "%0D").replace("\n", "%0A")
                refers = name(c["first_id"][i], c["first_row"][i]) if again else None
                out += _records(name(c["page_id"][i], c["row"][i]), url, payload, c["digest"][i], refers, segment_bytes, chunk_bytes)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    rows.mapInArrow(build, "record binary").select(F.col("record").cast("string")).write.option("lineSep", END).option(
        "compression", "gzip"
    ).text(path)
    drop_paths(pages.sparkSession, [held])


_HEADERS = "record_id string, type string, url string, refers_to string, origin string, segment int, total long, digest string"


def records(spark: SparkSession, path: str) -> DataFrame:
    """Records as they stand in the archives: header fields, block, and whether it is whole.

    Lines end where a version line begins. A block that contains such a line comes in
    several; Content-Length tells how many belong together."""
    lines = (
        spark.read.option("lineSep", VERSION.decode())
        .text(path)
        .select(F.col("value").cast("binary").alias("value"), F.input_file_name().alias("file"))
    )
    schema = _HEADERS + ", block binary, whole boolean"
    names = [f.name for f in T._parse_datatype_string(schema).fields]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, file, need = b"", None, None
        for batch in batches:
            out: list[tuple] = []
            for value, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and name != file:  # the file before ended inside a record
                    out.append(_parsed(held))
                    held = b""
                file = name
                if not held and not value:  # before the first record of a file
                    continue
                held = held + VERSION + value if held else value
                need = _needed(held)
                if need is not None and len(held) >= need:
                    out.append(_parsed(held))
                    held = b""
            yield _arrow(out, names)
        if held:
            yield _arrow([_parsed(held)], names)

    return lines.mapInArrow(parse, schema)


def _needed(data: bytes) -> int | None:
    """Length of headers and block, once the headers are there."""
    stop = data.find(b"\r\n\r\n")
    if stop < 0:
        return None
    for line in data[:stop].split(b"\r\n"):
        k, _, v = line.partition(b":")
        if k.lower() == b"content-length":
            return stop + 4 + int(v)
    return stop + 4


def _parsed(data: bytes) -> tuple:
    stop = data.find(b"\r\n\r\n")
    head = data if stop < 0 else data[:stop]
    h = {}
    for line in head.decode("utf-8", "replace").split("\r\n"):
        k, _, v = line.partition(":")
        h[k.lower()] = v.strip()
    need = _needed(data)
    block = data[stop + 4 : need] if need is not None else b""
    number = lambda k: int(h[k]) if k in h else None
    bare = lambda k: h[k].strip("<>") if k in h else None
    return (
        bare("warc-record-id"), h.get("warc-type"), h.get("warc-target-uri"), bare("warc-refers-to"), bare("warc-segment-origin-id"),
        number("warc-segment-number"), number("warc-segment-total-length"), (h.get("warc-payload-digest") or "").removeprefix("sha1:"),
        block, need is not None and len(data) >= need,
    )


_ARROW = {"segment": pa.int32(), "total": pa.int64(), "block": pa.binary(), "whole": pa.bool_()}


def _arrow(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW.get(n, pa.string())) for n, c in zip(names, columns)], names=names)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Logical records: record_id, type, url, refers_to, digest, payload, complete."""
    found = records(spark, path)
    columns = ("record_id", "type", "url", "refers_to", "digest", "block", "complete")
    single = found.where("segment is null and type <> 'continuation'").withColumn("complete", F.col("whole")).select(*columns)
    parts = found.where("segment is not null or type = 'continuation'").withColumn("key", F.coalesce("origin", "record_id"))
    schema = "record_id string, type string, url string, refers_to string, digest string, block binary, complete boolean"

    def join(key, rows):
        rows = sorted(rows.to_pylist(), key=lambda r: r["segment"] or 0)
        first, block = rows[0], b"".join(r["block"] for r in rows)
        complete = (
            all(r["whole"] for r in rows)
            and [r["segment"] for r in rows] == list(range(1, len(rows) + 1))
            and first["type"] != "continuation"
            and rows[-1]["total"] == len(block)
        )
        one = {k: [first[k]] for k in ("type", "url", "refers_to", "digest")} | {"record_id": [key[0].as_py()], "block": [block], "complete": [complete]}
        return pa.table({n: pa.array(one[n], {"block": pa.binary(), "complete": pa.bool_()}.get(n, pa.string())) for n in columns})

    joined = parts.groupBy("key").applyInArrow(join, schema)

    def decode():
        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            payloads = []
            for block, complete in zip(batch.column("block").to_pylist(), batch.column("complete").to_pylist()):
                head, _, body = block.partition(b"\r\n\r\n")
                try:
                    if not complete:
                        raise ValueError("incomplete")
                    payloads.append(dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body)
                except ValueError:
                    payloads.append(None)
            return [pa.array(payloads, pa.binary()), pa.array([p is not None for p in payloads], pa.bool_())]

        return compute

    fields = [T.StructField("payload", T.BinaryType()), T.StructField("complete", T.BooleanType())]
    return with_arrow_columns(single.union(joined), fields, decode, drop=["block"])


def archived(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to archives below spark.checkpoint.dir and read them back: page_id,
    payload_bytes and payload_digest of the full payload, record_type, refers_to."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write(pages, path, min_bytes)

    def measured():
        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            payloads = batch.column("payload").to_pylist()
            return [
                pa.array([None if p is None else len(p) for p in payloads], pa.int64()),
                pa.array([None if p is None else payload_digest(p) for p in payloads], pa.string()),
            ]

        return compute

    fields = [T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType())]
    found = with_arrow_columns(read(spark, path), fields, measured, drop=["payload"])
    found = stored(found.select("record_id", "type", "refers_to", "payload_bytes", "payload_digest"), "warc-read")
    page = lambda c: F.split(F.expr(f"substring({c}, {len(ID_PREFIX) + 1})"), ":")
    page_id = lambda c: F.when(page(c)[0] != "", page(c)[0].cast("long"))
    whole = found.where("type = 'response'")
    full = whole.select(F.col("record_id").alias("refers_to"), "payload_bytes", "payload_digest")
    again = found.where("type = 'revisit'").select("record_id", "type", "refers_to").join(full, "refers_to", "left")
    columns = ("record_id", "type", "refers_to", "payload_bytes", "payload_digest")
    return whole.select(*columns).union(again.select(*columns)).select(
        page_id("record_id").alias("page_id"), "payload_bytes", "payload_digest",
        F.col("type").alias("record_type"), page_id("refers_to").alias("refers_to"),
    )
