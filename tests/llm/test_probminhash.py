import collections
import random

import numpy as np
import pytest

from quirespark.llm import probminhash as p

WORDS = [f"w{i}" for i in range(4000)]


def exact(x, y):
    both = set(x) & set(y)
    every = set(x) | set(y)
    return sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in every) for d in both)


def sets_of(counter):
    keys = sorted(counter)
    return np.array(keys, np.uint64), np.array([counter[k] for k in keys], np.int32)


def test_similarity_is_exact():
    random.seed(3)
    for n in range(200):
        x, y = (collections.Counter(random.choices(range(1, 12), k=random.randint(1, 25))) for _ in range(2))
        if n % 2:
            x, y = dict.fromkeys(x, 1), dict.fromkeys(y, 1)
        assert p.similarity(sets_of(x), sets_of(y)) == pytest.approx(exact(x, y))


def test_registers_estimate_the_similarity():
    random.seed(4)
    x = collections.Counter({i: random.randint(1, 4) for i in range(1, 60)})
    y = collections.Counter({i: x[i] if i < 45 else random.randint(1, 4) for i in range(8, 66)})
    registers = 4_000
    a, b, one = p.signatures([sets_of(x), sets_of(y), sets_of({7: 3})], registers)
    assert abs((a == b).mean() - exact(x, y)) < 4 * (0.25 / registers) ** 0.5
    assert (one == 7).all()


def shingles(text):
    words = (text or "").lower().split()
    n = min(5, len(words))
    return collections.Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else {}


def classes(rows):
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    sets = [shingles(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(set(sets[i]) & set(sets[j])) * 3 > len(sets[i]) and exact(sets[i], sets[j]) >= 0.8:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    least = {}
    for i, (k, _) in enumerate(rows):
        at = find(i)
        least[at] = min((k is not None, k or 0), least.get(at, (k is not None, k or 0)))
    return [least[find(i)] for i in range(len(rows))]


@pytest.mark.parametrize("block", [64, 4])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(p, "BLOCK", block)
    random.seed(5)
    rows = []
    for group in range(6):
        base = random.choices(WORDS, k=random.choice([6, 30, 80, 200]))
        for _ in range(12):  # some within reach of each other, some only of others
            words = list(base)
            for _ in range(random.randint(0, max(1, len(base) // 25))):
                words[random.randrange(len(words))] = random.choice(WORDS)
            rows.append((len(rows), " ".join(words)))
    line = "a line that a text repeats again and again "
    rows += [(500, line * 9), (501, line * 10), (502, line * 40), (600, "one two"), (601, "One  two!"), (602, "one"), (603, None), (604, ""), (605, "..."), (None, rows[0][1]), (0, rows[0][1]), (700, "x y z " * 20_000), (701, "x y z " * 20_001)]
    docs = spark.createDataFrame([(k, t, "s") for k, t in rows], "doc_id long, text string, row string")
    found = p.near_duplicates(docs).collect()
    brute = [(k, t.replace("!", "") if t else t) for k, t in rows]
    brute = [(k, None if t == "..." else t) for k, t in brute]
    want = sorted(zip((k for k, _ in rows), (None if not c[0] else c[1] for c in classes(brute)), strict=True), key=repr)
    assert sorted(((r["doc_id"], r["class_id"]) for r in found), key=repr) == want
    kept = collections.Counter(r["class_id"] for r in found if r["kept"])
    assert sum(kept.values()) == len({c for c in classes(brute)})


def test_keep_one(spark, tmp_path):
    text = " ".join(WORDS[:50])
    docs = spark.createDataFrame([(2, text, "b", 1), (1, text, "a", 1), (1, text, "a", 1), (3, "other words entirely in this one", "c", 1), (4, None, "d", 1), (5, None, "e", 1)], "doc_id long, text string, lang string, kept_row int")
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    kept = p.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4, 5]
    assert p.near_duplicates(docs.where("false")).collect() == []
