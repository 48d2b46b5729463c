import random
import zlib

import pytest

from quirespark.llm import sharding


@pytest.mark.parametrize("shards", [1, 5, 24])
def test_contiguous_balanced_and_gapless(spark, shards):
    random.seed(shards)
    rows = [(i, "ü" * random.randint(0, 300) if i % 11 else None, i, "a") for i in range(600)] + [(None, "same", 1, "b")] * 200 + [(7, "tie", 2, "c")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, size int, shard string").repartition(3)
    found = sharding.shard_by_bytes(docs, shards).collect()
    assert len(found) == len(rows)
    want = sorted((r[0] is not None, r[0] or 0, len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in found) == want
    by: dict[int, list] = {}
    for r in found:
        by.setdefault(r["shard"], []).append(r)
    assert set(by) == set(range(shards))
    sizes = [sum(r["size"] for r in by[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in found)
    last = -1
    for s in range(shards):
        assert sorted(r["slot"] for r in by[s]) == list(range(len(by[s])))
        keys = [-1 if r["doc_id"] is None else r["doc_id"] for r in sorted(by[s], key=lambda r: r["slot"])]
        assert keys == sorted(keys) and keys[0] >= last
        last = keys[-1]


def test_one_huge_row_and_empty(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b" * 100_000), (3, "c")], "doc_id long, text string")
    found = {r["doc_id"]: r["shard"] for r in sharding.shard_by_bytes(docs, 4).collect()}
    assert found[1] <= found[2] <= found[3]
    assert sharding.shard_by_bytes(docs.where("false"), 4).collect() == []
    with pytest.raises(ValueError):
        sharding.shard_by_bytes(docs, 0)
