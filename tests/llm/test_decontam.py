import re

import pytest

from quirespark.llm import decontam

ITEM = "What is the Capital of France? It is, of course, the city of Paris on the Seine."
SHORT = "Ümlaut Answer"


def brute(text, items, size=10):
    words = [m for m in re.finditer(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").encode())]
    low = [bytes(c + 32 if 65 <= c <= 90 else c for c in m[0]) for m in words]
    hit, found = set(), set()
    for item, t in items:
        other = [bytes(c + 32 if 65 <= c <= 90 else c for c in m) for m in re.findall(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").encode())]
        for k in range(max(1, len(other) - size + 1)) if other else []:
            window = other[k : k + size]
            for i in range(len(low) - len(window) + 1):
                if low[i : i + len(window)] == window:
                    hit.update(range(i, i + len(window)))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("most", [200_000, 3])
def test_against_brute_force(spark, most):
    items = [(1, ITEM), (2, SHORT), (10, ITEM + " More words follow here"), (3, None), (4, "..!"), (5, "one two three four five six seven eight nine ten")]
    texts = [
        f"Before. {ITEM} After", ITEM.upper().replace("?", " --- "), "ümlaut answer", "ÜMLAUT Answer", SHORT * 2, f"{SHORT}. {SHORT}", None, "", "!!!",
        "zero one two three four five six seven eight nine ten eleven one two", ITEM.replace("city", "town"), "x " * 5000 + ITEM,
    ]
    docs = spark.createDataFrame([(i % 9, t, 7) for i, t in enumerate([*texts, texts[0]])], "doc_id int, text string, item_id int")
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id int, text string, doc_id string")
    found = decontam.decontaminate(docs, benchmark, max_windows=most).collect()
    assert len(found) == len(texts) + 1
    for r in found:
        assert (r["n_words"], r["n_hit"], r["items"]) == brute(r["text"], items)
    first = next(r for r in found if r["text"] == texts[0])
    assert texts[0][first["spans"][0]["start"] : first["spans"][0]["stop"]] == ITEM[:-1]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id int, text string")
    none = spark.createDataFrame([], "item_id int, text string")
    assert decontam.decontaminate(docs, none).select("n_words", "n_hit").collect() == [(2, 0)]
    assert decontam.decontaminate(docs.where("false"), none).collect() == []
