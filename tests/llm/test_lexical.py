import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from quirespark.llm import lexical


def terms(text):
    return [bytes(c + 32 if 65 <= c <= 90 else c for c in m) for m in re.findall(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").encode())]


def brute(docs, items, k):
    """(item, rank, doc, score) by scoring every document."""
    counted = [(i, Counter(terms(t))) for i, t in docs]
    n = [(i, c, sum(c.values())) for i, c in counted if c]
    total, all_terms = len(n), sum(x for *_, x in n)
    held = Counter(t for _, c, _ in n for t in c)
    out = []
    for item, text in items:
        wanted = terms(text)
        scores = []
        for i, c, length in n:
            m = 100 - 25 + (25 * length * total) // all_terms
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * held[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in wanted if t in c)
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, rank + 1, s[3], -s[0]) for rank, s in enumerate(sorted(scores, key=lambda s: s[:3])[:k])]
    return sorted(out, key=repr)


def some_text(rng, most):
    return " ".join(rng.choice(["Wort", "word", "être", "a1", "x"]) if rng.random() < 0.4 else f"t{int(rng.paretovariate(0.7))}" for _ in range(rng.randint(0, most)))


@pytest.mark.parametrize(("block", "segment"), [(lexical.BLOCK_TERMS, lexical.SEGMENT_POSTINGS), (30, 200)])
def test_against_brute_force(spark, block, segment):
    rng = random.Random(block)
    docs = [(i, some_text(rng, 60)) for i in range(400)] + [(None, "word être"), (1000, None), (1001, ""), (1002, "!?"), (7, "WORD,être;a1"), (7, "WORD,être;a1")]
    docs += [(2000 + i, docs[i % 3][1]) for i in range(60)]  # ties
    items = [(i, some_text(rng, 30)) for i in range(12)] + [(100, None), (101, "nowhere at all"), (102, "Word word WORD"), (103, docs[0][1]), (103, docs[0][1])]
    left = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, item_id int, score int").repartition(3)
    right = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    found = lexical.top_documents(left, right, 20, block_terms=block, segment_postings=segment).collect()
    assert sorted((tuple(r) for r in found), key=repr) == brute(docs, items, 20)


def test_whole_table(spark):
    path = "/root/testdata/sf0.001"
    docs, items = (spark.read.parquet(f"{path}/{t}.parquet").select(i, "text") for t, i in (("documents", "doc_id"), ("benchmark", "item_id")))
    found = lexical.top_documents(docs, items).collect()
    assert sorted((tuple(r) for r in found), key=repr) == brute([tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()], 20)


def test_search_skips_ranges():
    """A term that few ranges hold opens few of them."""
    n = 40_000
    rare = np.arange(0, n, 5000)
    doc = np.concatenate([np.arange(n), rare])
    term = np.concatenate([np.zeros(n, np.int64), np.ones(len(rare), np.int64)])
    value = np.concatenate([np.full(n, 3), np.full(len(rare), 900)])
    tree, opened = lexical.MaxTree(doc, term, value), []
    children = tree.children
    tree.children = lambda level, *rest: opened.append(level) or children(level, *rest)
    best = tree.best(np.array([0, 1]), np.array([1, 10]), 5, list(range(n)))
    assert best == [(d, 9003) for d in rare[:5].tolist()]
    assert opened.count(0) <= len(rare)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id int, text string")
    items = spark.createDataFrame([(1, "a")], "item_id int, text string")
    assert [tuple(r) for r in lexical.top_documents(docs, items).collect()] == [tuple(r) for r in brute([(1, "a b")], [(1, "a")], 20)]
    assert lexical.top_documents(docs.where("false"), items).collect() == []
    assert lexical.top_documents(docs, items.where("false")).collect() == []
