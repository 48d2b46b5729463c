"""WARC archives: records written in segments, and their reassembly.

Writing: of rows with equal payloads the one with the largest id becomes a `response` record and the others `revisit`
records that refer to it. A response's block is an HTTP response with chunked transfer framing; a block beyond
segment_bytes is cut into a first record and `continuation` records, which name the first by WARC-Segment-Origin-ID.
Files are written by Spark's text sink, which puts bytes through unchanged, gzipped, into a folder that all executors share.

Reading: each file is split into records by Content-Length. Records of one segment are decoded where they are read;
segments are grouped by origin identifier, put in order of their number and joined, the total length, the numbers and
the block digests are verified, and then the chunked framing is decoded and the payload's digest verified. A revisit
gets length and digest from the response that it refers to.

Defined cases: a null payload is the empty payload, of which all but one row are revisits too; a null id is smaller
than any other and comes back as null; rows that repeat, id and payload, are copies of one record, all of
its type and with its record id; a null or odd URL is left out or percent-encoded; an empty table gives archives
without records and an empty result; other columns are ignored. A record whose segments are missing, repeated or
damaged is returned with valid = false and a null payload.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from typing import IO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_scratch, materialize, maybe_in, small_batches

SEGMENT_BYTES = 16_384
CHUNK_BYTES = 4_096
#: A record holds one segment at most, so a file has some 35 MB before compression, however long the pages are.
RECORDS_PER_FILE = 2_000
DATE = "2026-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An extension field: the row's id, which no standard field holds.
_ID = "WARC-Row-ID"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(kind: str, record_id: str, fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", DATE), *fields, ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in lines if v is not None) + b"\r\n" + block + b"\r\n\r\n"


def record_id(row_id: str | None, sha: str) -> str:
    """By id and payload, so that a revisit can name its response without looking it up."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{row_id} {sha}')}>"


def frame_chunks(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing."""
    parts = []
    for i in range(0, len(payload), size):
        part = payload[i : i + size]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unframe_chunks(body: bytes) -> bytes | None:
    """The payload within chunked framing, extensions and trailers left out; None if the framing is broken."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].split(b";")[0].strip(), 16) if end >= 0 else -1
        except ValueError:
            size = -1
        if size < 0:
            return None
        if size == 0:
            return b"".join(parts) if body.endswith(b"\r\n\r\n") or body[end:] == b"\r\n" else None
        parts.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size + 2
        if len(parts[-1]) < size or body[at - 2 : at] != b"\r\n":
            return None


def response_records(row_id: str | None, sha: str, uri: str | None, payload: bytes, segment_bytes: int) -> list[bytes]:
    own, block = record_id(row_id, sha), _HTTP + frame_chunks(payload)
    http = ("Content-Type", "application/http; msgtype=response")
    fields = [("WARC-Target-URI", uri), (_ID, row_id), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), http]
    cuts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    if len(cuts) == 1:
        return [_record("response", own, fields, block)]
    out = [_record("response", own, [*fields, ("WARC-Segment-Number", "1")], cuts[0])]
    for n, cut in enumerate(cuts[1:], 2):
        more = [("WARC-Target-URI", uri), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", str(n))]
        out.append(_record("continuation", f"{own[:-1]}-{n}>", more + ([("WARC-Segment-Total-Length", str(len(block)))] if n == len(cuts) else []), cut))
    return out


def revisit_record(row_id: str | None, sha: str, uri: str | None, payload: bytes, of_id: str | None) -> bytes:
    fields = [("WARC-Target-URI", uri), (_ID, row_id), ("WARC-Refers-To", record_id(of_id, sha)), ("WARC-Profile", _PROFILE), ("WARC-Payload-Digest", f"sha1:{digest(payload)}")]
    return _record("revisit", record_id(row_id, sha), fields, b"")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", segment_bytes: int = SEGMENT_BYTES, compression: str = "gzip") -> None:
    """Write the rows of pages as WARC records below path; compression: gzip or none."""
    small_batches(pages.sparkSession)
    rows = pages.select(
        F.col(id_col).alias("id"),
        F.regexp_replace(F.col(url_col), r"[\x00-\x20\x7F]", "%20").alias("uri"),
        F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("sha", F.sha1("payload"))
    # Which payloads repeat is decided on ids and checksums alone. Only rows that may have such a payload are dealt by it, and the table
    # that they meet is written, so Spark splits a payload that many rows share; all others stay where they are read.
    repeated = materialize(rows.select("id", "sha").groupBy("sha").agg(F.max("id").alias("of"), F.count("*").alias("times")).where("times > 1").select("sha", "of"), "warc-repeated")
    some, others = maybe_in(rows, repeated, "sha", rest=True)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes] = []
            for row_id, uri, payload, sha, of_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row_id == of_id:
                    out += response_records(row_id, sha, uri, payload, segment_bytes)
                else:
                    out.append(revisit_record(row_id, sha, uri, payload, of_id))
            yield pa.RecordBatch.from_arrays([pa.array([r[:-1] for r in out], pa.binary())], ["record"])

    fields = lambda of: [F.col("id").cast("string"), "uri", "payload", "sha", of.cast("string").alias("of_id")]
    known = some.join(repeated.withColumn("known", F.lit(True)), "sha", "left").select(*fields(F.when(F.col("known"), F.col("of")).otherwise(F.col("id"))))
    records = known.unionByName(others.select(*fields(F.col("id")))).mapInArrow(build, "record binary")
    # The sink ends each row with the line feed that was taken off the record's end.
    records.select(F.col("record").cast("string")).write.option("lineSep", "\n").option("maxRecordsPerFile", RECORDS_PER_FILE).option("compression", compression).text(path)
    drop_scratch(repeated)


_FIELD = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")


def opened(data: bytes) -> IO[bytes]:
    """An archive as a stream, decompressed as it is read if it is gzipped, as a whole or record by record."""
    return gzip.open(io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)


def split_records(archive: IO[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields (names in lower case) and block of each record of an archive, one at a time; one that is cut off within its fields is left out."""
    while line := archive.readline():
        if not line.startswith(b"WARC/1."):
            continue
        head = []
        while (line := archive.readline()) not in (b"\r\n", b""):
            head.append(line)
        if not line:
            return
        fields = {k.decode().lower(): v.decode() for k, v in _FIELD.findall(b"".join(head))}
        yield fields, archive.read(int(fields.get("content-length", 0)))


def payload_of(block: bytes) -> bytes | None:
    """The entity of an HTTP response, its chunked framing decoded."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        return None
    return unframe_chunks(body) if re.search(rb"(?i)\r\ntransfer-encoding:[^\r\n]*chunked", head) else body


def _entity(block: bytes | None, ok: bool, want: str | None, with_payload: bool) -> tuple[bytes | None, int | None, str | None, bool]:
    """Payload (if wanted), its size and digest, and whether all is sound."""
    payload = payload_of(block) if ok and block is not None else None
    found = None if payload is None else digest(payload)
    if payload is None or want not in (None, found):
        return None, None, want, False
    return payload if with_payload else None, len(payload), found, True


_PART = "type string, id string, uri string, refers_to string, segment int, total_length long, block binary, block_ok boolean, want string, payload binary, payload_bytes long, payload_digest string, valid boolean"
_RESULT = "record_id string, type string, id string, uri string, refers_to string, payload binary, payload_bytes long, payload_digest string, valid boolean"


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[field.split()[1]]) for k, field in enumerate(schema.split(", "))], _names(schema))


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives below path; responses of one segment are decoded, others keep their block."""
    small_batches(spark)
    schema = f"record_id string, {_PART}"

    def row(f: dict[str, str], block: bytes) -> tuple:
        ok = f.get("warc-block-digest") in (None, f"sha1:{digest(block)}") and len(block) == int(f.get("content-length", 0))
        number, total = f.get("warc-segment-number"), f.get("warc-segment-total-length")
        kind, want = f.get("warc-type"), f.get("warc-payload-digest", "").removeprefix("sha1:") or None
        alone = kind == "response" and number is None
        found = _entity(block, ok, want, with_payload) if alone else (None, None, want, ok)
        own = f.get("warc-segment-origin-id") or f.get("warc-record-id")
        known = (kind, f.get(_ID.lower()), f.get("warc-target-uri"), f.get("warc-refers-to"))
        return (own, *known, int(number) if number else None, int(total) if total else None, None if alone else block, ok, want, *found)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows: list[tuple] = []
                for f, block in split_records(opened(data.as_py())):
                    rows.append(row(f, block))
                    if len(rows) >= 500:
                        yield _batch(rows, schema)
                        rows = []
                if rows:
                    yield _batch(rows, schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(split, schema)


def assemble(parts: list[dict], with_payload: bool) -> list[tuple]:
    """The records of one identifier: each head is one row; the segments must be 1 to n, once each, sound and whole."""
    out = [tuple(p[k] for k in ("type", "id", "uri", "refers_to", "payload", "payload_bytes", "payload_digest", "valid")) for p in parts if p["segment"] is None]
    segments = sorted((p for p in parts if p["segment"] is not None), key=lambda p: (p["segment"], p["block"]))
    if segments:
        heads = [p for p in segments if p["segment"] == 1]
        one = segments[:: max(1, len(heads))]  # a record that was written several times is there as often
        copies = all((p["segment"], p["block"]) == (q["segment"], q["block"]) for p, q in zip(segments, [x for x in one for _ in range(max(1, len(heads)))], strict=False))
        block = b"".join(p["block"] for p in one)
        whole = [p["segment"] for p in one] == list(range(1, len(one) + 1)) and len(one) * len(heads) == len(segments) and one[-1]["total_length"] == len(block)
        entity = _entity(block, whole and copies and all(p["block_ok"] for p in segments), segments[0]["want"], with_payload)
        out += [(p["type"], p["id"], p["uri"], p["refers_to"], *entity) for p in heads or [{**segments[0], "type": None}]]
    return out


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per response or revisit: record_id, type, id, uri, refers_to, payload (if wanted), payload_bytes,
    payload_digest and valid. A revisit has its response's payload and size, and refers_to is the response's id."""
    records = read_records(spark, path, with_payload)
    # A group is the segments of one record, whose length the record itself states.
    grouped = records.groupBy("record_id").agg(F.collect_list(F.struct(*_names(_PART))).alias("parts"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(own, *found) for own, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for found in assemble(parts, with_payload)]
            yield _batch(rows, _RESULT)

    decoded = materialize(grouped.mapInArrow(join, _RESULT), "warc-records")
    responses = decoded.where("type = 'response' or type is null")
    targets = responses.select(F.col("record_id").alias("refers_to"), F.col("id").alias("of_id"), F.col("payload").alias("of_payload"), F.col("payload_bytes").alias("of_bytes"), F.col("valid").alias("of_valid")).dropDuplicates(["refers_to"])
    # Written, so that Spark splits a response to which many records refer.
    targets = materialize(targets, "warc-targets")
    revisits = (
        decoded.where("type = 'revisit'")
        .join(targets, "refers_to", "left")
        .select("record_id", "type", "id", "uri", F.col("of_id").alias("refers_to"), F.col("of_payload").alias("payload"), F.col("of_bytes").alias("payload_bytes"), "payload_digest", (F.col("valid") & F.coalesce("of_valid", F.lit(False))).alias("valid"))
    )
    return responses.withColumn("refers_to", F.lit(None).cast("string")).unionByName(revisits)
