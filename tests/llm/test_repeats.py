import collections
import hashlib
import random

import pytest

from quirespark.llm import repeats


def brute(texts, length):
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        hit = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                hit[i : i + length] = [True] * length
        spans = sum(1 for i, x in enumerate(hit) if x and (i == 0 or not hit[i - 1]))
        out.append((len(t), sum(hit), spans, bytes(b for b, x in zip(t, hit, strict=True) if not x)))
    return out


@pytest.mark.parametrize("rows_at_once,length", [(1_024, 40), (7, 40), (2, 25)])
def test_against_brute_force(spark, monkeypatch, rows_at_once, length):
    """Orders in several partitions and blocks, so that intervals reach over both."""
    monkeypatch.setattr(repeats, "ORDER_ROWS", rows_at_once)
    random.seed(rows_at_once + length)
    passages = ["".join(random.choices("abcdefgh é", k=random.randint(10, 150))) for _ in range(8)] + ["z" * 90, "ab" * 60]
    rows = []
    for i in range(60):
        parts = [random.choice(passages) if random.random() < 0.5 else "".join(random.choices("abcdefgh é", k=random.randint(1, 60))) for _ in range(random.randint(0, 6))]
        rows.append((i % 50, "".join(parts)))
    rows += [(None, rows[3][1]), (3, rows[3][1]), (200, None), (201, ""), (202, "q" * 39), (203, "only once, " + "".join(random.choices("ijklmnop", k=3_000)))]
    docs = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, row int")
    found = repeats.remove_repeats(docs, length=length, gram=8).collect()
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in found), key=repr)
    assert got == sorted(((k, *b) for (k, _), b in zip(rows, brute([(t or "").encode() for _, t in rows], length), strict=True)), key=repr)


def test_long_text_is_parsed_in_stretches(monkeypatch):
    monkeypatch.setattr(repeats, "STRETCH", 100)
    random.seed(1)
    text = bytes(random.choices(b"ab", k=1_000))
    runs = list(repeats.parse(text, 40, 8))
    assert [a for a, *_ in runs] == [0, *(a + n for a, n, *_ in runs[:-1])] and runs[-1][0] + runs[-1][1] == 1_000 - 40 + 1
    assert all(0 <= n - 1 <= at <= 40 - 8 + n - 1 for _, n, at, _ in runs)


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_shared_intervals(parts):
    """Intervals of a sorted list of keys, cut to parts, against all pairs."""
    random.seed(parts)
    keys = sorted("".join(random.choices("ab", k=12)).encode() for _ in range(120))
    most, each = 10, -(-120 // parts)
    cut = [keys[i : i + each] for i in range(0, 120, each)]
    name = lambda k: (k // each << 40) + k % each
    common = [0, *(repeats._common(a, b) for a, b in zip(keys, keys[1:], strict=False))]

    def interval(k, n):
        a = k
        while a and common[a] >= n:
            a -= 1
        b = k
        while b + 1 < len(keys) and common[b + 1] >= n:
            b += 1
        return name(a), name(b)

    for p, own in enumerate(cut):
        at = p * each
        begin, end = ([interval(k, n)[s] for n in range(most + 1)] for s, k in ((0, at), (1, at + len(own) - 1)))
        low, high = repeats.np.full(len(own), 2), repeats.np.full(len(own), most)
        lcp = repeats.np.array([-1, *common[at + 1 : at + len(own)]], repeats.np.int32)
        got = {}
        for rows in repeats.shared_intervals(p, lcp, low, high, repeats.np.array(begin), repeats.np.array(end)):
            for row, a, b, lo, hi in zip(*(x.tolist() for x in rows), strict=True):
                got |= {(row, n): (lo, hi) for n in range(a, b + 1)}
        want = {(k, n): interval(at + k, n) for k in range(len(own)) for n in range(2, most + 1)}
        assert got == {k: v for k, v in want.items() if v[0] != v[1]}


def test_empty(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_passage_of_sf_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [(r["text"] or "").encode() for r in docs.orderBy("doc_id").select("text").collect()]
    found = repeats.remove_repeats(docs).orderBy("doc_id").collect()
    want = brute(texts, 400)
    assert [(r["n_bytes"], r["n_removed"], len(r["spans"]), hashlib.sha256(r["kept"]).digest()) for r in found] == [(*w[:3], hashlib.sha256(w[3]).digest()) for w in want]


def test_rows_that_move_are_written_first(spark):
    text = "".join(random.Random(7).choices("abcdefgh", k=120))
    rows = [(i, text[: i % 7 * 10] + str(i) * 30) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    found = repeats.remove_repeats(docs, length=20, gram=4).collect()
    want = {k: b[3] for (k, _), b in zip(rows, brute([t.encode() for _, t in rows], 20), strict=True)}
    assert {r["doc_id"]: bytes(r["kept"]) for r in found} == want
