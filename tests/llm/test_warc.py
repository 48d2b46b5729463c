import base64
import hashlib
import random

import pytest

from quirespark.llm import warc
from quirespark.llm.common import scratch_path

PAGES = [
    (1, "http://a.example/x y", "short"), (2, "http://b.example/", "short"), (9, None, "short"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 40_000),
    (6, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n0\r\n\r\n"), (None, "u", "unnamed"), (7, "u", "x" * 16_384), (8, "u", "tie"), (8, "u", "tie"), (10, "u", "é" * 40_000), *[(11, f"u{i}", "k" * 3_000) for i in range(3)],
]


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_round_trip(spark, compression):
    pages = spark.createDataFrame([(*p, "z") for p in PAGES], "page_id long, url string, html string, sha string").repartition(3)
    path = scratch_path(spark, "test-warc")
    warc.write_archives(pages, path, segment_bytes=1_000, compression=compression)
    found = warc.read_archives(spark, path).collect()
    assert len(found) == len(PAGES) and all(r["valid"] for r in found)
    kinds = {}
    for r in found:
        payload = bytes(r["payload"])
        assert r["payload_bytes"] == len(payload)
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        kinds.setdefault(payload.decode(), []).append((r["type"], r["id"], r["refers_to"]))
    assert sorted(kinds) == sorted({p[2] or "" for p in PAGES})
    assert sorted(kinds["short"]) == [("response", "9", None), ("revisit", "1", "9"), ("revisit", "2", "9")]
    assert sorted(kinds[""]) == [("response", "4", None), ("revisit", "3", "4")]
    assert sorted(kinds["tie"]) == [("response", "8", None)] * 2 and kinds["k" * 3_000] == [("response", "11", None)] * 3
    assert sorted(kinds["é" * 40_000]) == [("response", "10", None), ("revisit", "5", "10")]
    assert kinds["unnamed"] == [("response", None, None)]
    assert warc.read_records(spark, path).where("segment > 1").count() > 80


def test_empty(spark):
    path = scratch_path(spark, "test-warc")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archives(spark, path).collect() == []


def test_damage_is_found():
    records = warc.response_records("1", 0, "u", b"payload " * 500, 1_000)
    parts = []
    for fields, block in warc.split_records(warc.opened(b"".join(records))):
        total = fields.get("warc-segment-total-length")
        parts.append({"type": fields["warc-type"], "id": "1", "uri": "u", "refers_to": None, "segment": int(fields["warc-segment-number"]), "total_length": int(total) if total else None, "block": block, "block_ok": True, "want": fields.get("warc-payload-digest", "")[5:] or None})
    assert [r[-1] for r in warc.assemble(parts[::-1], True)] == [True]
    assert warc.assemble(parts[::-1], True)[0][4] == b"payload " * 500
    for broken in (parts[:-1], parts[1:], parts[:1] + parts[2:], [*parts, parts[1]], [*parts[:-1], {**parts[-1], "total_length": 7}], [{**parts[0], "block_ok": False}, *parts[1:]]):
        assert [r[-1] for r in warc.assemble(broken, True)] == [False]


def test_chunked_framing():
    for n in (0, 1, 4_095, 4_096, 4_097, 20_000):
        assert warc.unframe_chunks(warc.frame_chunks(b"\r\n0" * n)) == b"\r\n0" * n
    assert warc.unframe_chunks(b"5;name=x\r\nhello\r\n0\r\nTrailer: y\r\n\r\n") == b"hello"
    for broken in (b"", b"5\r\nhell", b"zz\r\nhello\r\n0\r\n\r\n", b"5\r\nhello0\r\n\r\n", b"5\r\nhello\r\n"):
        assert warc.unframe_chunks(broken) is None


def test_large_pages_in_bounded_files(spark, tmp_path):
    """Pages of a megabyte and more are cut to records, so the archives stay small."""
    html = [random.Random(i).randbytes(600_000).hex() for i in range(40)]
    pages = spark.createDataFrame([(i, f"http://x/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, f"{tmp_path}/warc", compression="none")
    sizes = [r["length"] for r in spark.read.format("binaryFile").load(f"{tmp_path}/warc").select("length").collect()]
    assert len(sizes) > 1 and max(sizes) <= warc.RECORDS_PER_FILE * (warc.SEGMENT_BYTES + 1_000)
    found = warc.read_archives(spark, f"{tmp_path}/warc").collect()
    assert {(int(r["id"]), bytes(r["payload"]).decode(), r["valid"]) for r in found} == {(i, h, True) for i, h in enumerate(html)}
