import random

import numpy as np
import pytest

from quirespark.llm import periodic


def brute(words):
    """All maximal stretches by period, smallest period only."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i:
                length = j - i + q
                if length >= max(6, 4 * q):
                    found.setdefault((i, length), q)
            i = max(j, i) + 1
    return sorted((s, m, q) for (s, m), q in found.items())


def kept(words, runs):
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def some_words(rng):
    n, letters = rng.randint(0, 60), rng.choice([1, 2, 3, 9])
    words = [rng.choice("abcdefghi"[:letters]) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        root = [rng.choice("abcdxyz") for _ in range(rng.randint(1, 6))]
        at = rng.randint(0, len(words))
        words[at:at] = (root * 9)[: rng.randint(1, 9 * len(root))]
    return words


def test_runs_of_random_texts():
    rng = random.Random(5)
    for _ in range(300):
        texts = [some_words(rng) for _ in range(rng.randint(1, 6))]
        found = periodic.runs_of_texts([[w.encode() for w in t] for t in texts])
        assert [[tuple(r) for r in f.tolist()] for f in found] == [brute(t) for t in texts]


def test_fibonacci_word_and_nested_runs():
    a, b = "a", "ab"
    while len(b) < 2000:
        a, b = b, b + a
    nested = ("xx" * 5 + "y") * 6 + "z" + ("xx" * 5 + "y") * 4
    for text in (b, nested, "a" * 500, "ab" * 250 + "c" + "ab" * 250):
        words = list(text)
        assert [tuple(r) for r in periodic.runs_of_texts([[w.encode() for w in words]])[0].tolist()] == brute(words)


def test_range_minima():
    rng = np.random.default_rng(1)
    for n in (1, 15, 16, 17, 300):
        values = rng.integers(0, 50, n)
        first = rng.integers(0, n, 200)
        last = np.minimum(n - 1, first + rng.integers(0, n, 200))
        assert periodic.RangeMinima(values)(first, last).tolist() == [values[a : b + 1].min() for a, b in zip(first, last, strict=True)]


def test_documents(spark):
    rng = random.Random(6)
    texts = [None, "", " \t\n", "same " * 40, "ein Wort kein Trenner " * 12, "\x1c\x1d " * 30, "a b c d e f", *[" ".join(some_words(rng)) for _ in range(80)]]
    texts += [texts[3], "long " + " ".join(str(rng.randint(0, 5)) for _ in range(30_000)) + " la li" * 4000]
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_words int, runs string").repartition(3)
    found = {r["doc_id"]: r for r in periodic.collapse_runs(docs).collect()}
    assert sorted(found) == list(range(len(texts))) and set(found[0].asDict()) == {"doc_id", "n_words", "runs", "text"}
    for i, t in enumerate(texts[:-1]):
        words = [w.decode() for w in (t or "").encode().split()]
        want = brute(words)
        assert (found[i]["n_words"], [tuple(r) for r in found[i]["runs"]], found[i]["text"]) == (len(words), want, kept(words, want))
    assert found[len(texts) - 1]["runs"][-1] == (30_001, 8000, 2)
    assert periodic.collapse_runs(docs.where("false")).collect() == []


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_against_brute_force(spark, sf):
    import hashlib
    import zlib
    from fractions import Fraction

    from quirespark.llm import queries

    path = f"/root/testdata/{sf}"
    found = {r["doc_id"]: r for r in queries.op12_periodic_runs(spark, path).collect()}
    rows = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()
    assert len(found) == len(rows)
    planted = 0
    for doc_id, text in rows:
        words = [w.decode() for w in (text or "").encode().split()]
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        if n > 2500:
            continue  # brute force is slow there
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words, planted = words[:a] + [words[a + (i - a) % p] for i in range(a, n)], planted + 1
        runs = brute(words)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
        r = found[doc_id]
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == digest("".join(f"{a},{b},{c}\n" for a, b, c in runs))
        assert r["collapsed_sha256"] == digest(kept(words, runs))
    assert planted > 5
