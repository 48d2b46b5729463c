import numpy as np
import pytest

from quirespark.llm import egojoin


def brute(rows, cosine):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    links = np.zeros((len(rows), len(rows)), bool)
    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows):
            if i != j and ok[i] and ok[j] and len(a) == len(b):
                a64, b64 = np.array(a, np.float64), np.array(b, np.float64)
                links[i, j] = a64 @ b64 / np.sqrt((a64 @ a64) * (b64 @ b64)) >= cosine
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, j in zip(*np.nonzero(links), strict=True):
            if label[j] < label[i]:
                label[i], changed = label[j], True
    least = {}
    for (k, _), at in zip(rows, label, strict=True):
        if k is not None:
            least[at] = min(k, least.get(at, k))
    return sorted(((k, int(n), least.get(at)) for (k, _), n, at in zip(rows, links.sum(axis=1), label, strict=True)), key=repr)


@pytest.mark.parametrize("block,leaf", [(2_048, 512), (32, 8)])
def test_against_brute_force(spark, block, leaf):
    random = np.random.default_rng(block)
    centres = random.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] * random.uniform(0.1, 5) + random.normal(size=16) * random.choice([0.02, 0.15, 0.35])).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[3][1]) for i in range(40)] + [(2000, [-x for x in rows[5][1]])]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 16), (3003, [None, *rows[0][1][1:]]), (3004, [float("nan")] * 16), (3005, [float("inf")] * 16), (3006, [1.0, 2.0]), (3007, [2.0, 4.0]), (None, rows[7][1]), (None, None), (3, rows[3][1])]
    vectors = spark.createDataFrame([(k, v, 1) for k, v in rows], "vec_id long, embedding array<float>, key int")
    found = egojoin.similar_vectors(vectors, block=block, leaf=leaf).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in found), key=repr) == brute(rows, 0.95)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found)


def test_forest_connects_what_links_connect():
    random = np.random.default_rng(1)
    for _ in range(200):
        links = random.random((random.integers(1, 9), random.integers(1, 9))) < 0.25
        rows, cols = egojoin.forest(links)
        for i, j in np.argwhere(links):
            assert rows[i] == cols[j] >= 0
        assert (rows[~links.any(axis=1)] == -1).all() and (cols[~links.any(axis=0)] == -1).all()


def test_empty(spark):
    assert egojoin.similar_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_in_waves(spark, monkeypatch):
    """Blocks dealt in many waves, none with many more bytes than the blocks have, give the links of all pairs."""
    monkeypatch.setattr(egojoin, "WAVE_BYTES", 1)
    monkeypatch.setattr(egojoin, "GROUP", 2)
    joined = []
    monkeypatch.setattr(egojoin, "_join_blocks", lambda dealt, *rest, plain=egojoin._join_blocks: joined.append(dealt.count()) or plain(dealt, *rest))
    random = np.random.default_rng(3)
    centres = random.normal(size=(9, 16))
    rows = [(i, (centres[i % 9] + random.normal(size=16) * random.choice([0.1, 0.3])).astype(np.float32).tolist()) for i in range(400)]
    found = egojoin.similar_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), block=16, leaf=8).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in found), key=repr) == brute(rows, 0.95)
    assert len(joined) >= 4 and max(joined) <= 2.5 * sum(joined) / len(joined)


def test_blocks_of_two_groups_are_dealt_once(spark):
    names = "abcdefgh"
    pairs = [(x, y) for k, x in enumerate(names) for y in names[k:] if (x, y) != ("a", "h")]
    blocks = spark.createDataFrame([(x, 7 - k) for k, x in enumerate(names)], "block string, at int")
    found = egojoin.dealt_blocks(spark.createDataFrame(pairs, "a string, b string"), blocks, 4).collect()
    assert sorted((r["block"], y) for r in found for y in r["others"]) == sorted(pairs)
    assert len(found) == 16 and {(r["ga"], r["gb"]) for r in found} == {(0, 0), (0, 1), (1, 1)}
