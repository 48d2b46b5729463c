"""The operators in one pass give what those by joins and windows give."""

import random
import time

import numpy as np
import pytest

from quirespark.operators import glyphs, onepass

GLYPHS = "doc string, s string, x0 double, x1 double, y double, size double"


def some_glyphs(rng, doc, columns):
    out = []
    for line in range(rng.randint(1, 25)):
        y, size = 100.0 + 12 * line + rng.choice([0, 0, 2.5, 4.0]), rng.choice([10.0, 10.0, 7.0, 12.5])
        for c in range(columns):
            x = 50.0 + 200 * c + rng.choice([0, 0, 3.7])
            for _ in range(rng.randint(0, 20)):
                s = rng.choice("abcdé  ") if rng.random() < 0.95 else "  x"
                wide = size * rng.choice([0.5, 0.25, 0.9])
                out.append((doc, s, x, x + wide, y + (rng.choice([0, -1.5, 3.5]) if rng.random() < 0.05 else 0), size if rng.random() < 0.9 else size * 0.6))
                x += wide + rng.choice([0, 0, 0.1, 0.5, 2.0, 7.0, 20.0])
    return out


@pytest.mark.parametrize("rows", [200_000, 50])
def test_the_same_as_by_windows(spark, rows):
    rng = random.Random(rows)
    every = [g for k in range(30) for g in some_glyphs(rng, f"d{k}", rng.randint(1, 3))] + [("blank", " ", 0.0, 5.0, 10.0, 10.0)]
    table = spark.createDataFrame(every, GLYPHS).repartition(5)
    as_rows = glyphs.baseline_rows(table).cache()
    gutters = glyphs.gutter_bins(as_rows)
    assert sorted(map(tuple, onepass.column_gutters(table, at_once=rows).collect())) == sorted(map(tuple, gutters.collect()))
    columns = ["doc", "row", "frag", "x0", "x1", "base", "text"]
    for cut in (False, True):
        want = glyphs.fragments(as_rows, gutters if cut else None).select(columns).collect()
        assert sorted(map(tuple, onepass.page_fragments(table, gutters=cut, at_once=rows).select(columns).collect())) == sorted(map(tuple, want)) and len(want) > 100


def test_pages_as_keys_and_empty(spark):
    rng = random.Random(9)
    every = [((d, p), *g[1:]) for d in "ab" for p in range(3) for g in some_glyphs(rng, d, 2)]
    table = spark.createDataFrame(every, GLYPHS.replace("doc string", "doc struct<doc: string, page: int>"))
    found = onepass.page_fragments(table).select("doc.doc", "doc.page", "text").collect()
    want = glyphs.fragments(glyphs.baseline_rows(table)).select("doc.doc", "doc.page", "text").collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, want))
    assert onepass.page_fragments(table.where("false")).collect() == [] and onepass.column_gutters(table.where("false")).collect() == []


def test_texts_are_set_where_they_are(spark):
    texts = [(k, t) for k, t in enumerate([None, "", "\n", "a b\n\n c  d", "  x", "ü𝄞 é\n" * 3, "one two\n" * 40])]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    pages = docs.selectExpr("doc_id doc", "text")
    for at_once in (onepass.ROWS, 3):
        assert sorted(map(tuple, onepass.fragments_of(pages, onepass.set_text, at_once=at_once).collect())) == sorted(map(tuple, onepass.page_fragments(glyphs.from_lines(docs)).collect()))
        assert sorted(map(tuple, onepass.gutters_of(pages, onepass.set_text, gap=0.4, at_once=at_once).collect())) == sorted(map(tuple, onepass.column_gutters(glyphs.from_lines(docs), gap=0.4).collect()))


def test_pages_of_files(spark):
    from quirespark.sources import pdf, writers

    line = {"s": b"two words", "x0": 10.0, "y0": 20.0, "x1": 64.0, "y1": 27.86}
    data = writers.pdf([{"w": 200.0, "h": 300.0, "visible": True, "lines": [line, line | {"s": b"more", "x1": 34.0, "y0": 60.0, "y1": 67.86}]}, {"w": 9.0, "h": 9.0}])
    pages = pdf.pdf_pages(spark.createDataFrame([("d", bytearray(data))], "doc string, content binary"))
    found = onepass.fragments_of(pages.selectExpr("named_struct('doc', doc, 'page', page) doc", "glyphs"), onepass.page_glyphs).orderBy("row").collect()
    assert [(r["doc"]["page"], r["text"]) for r in found] == [(0, "two words"), (0, "more")]


def test_order_and_work_of_pages():
    """What is in order is not sorted; what is not, is, also with ties and not-a-numbers. Gutters look at each page's glyphs, not at all for each page."""
    rng = np.random.default_rng(5)
    for keys in ([np.array([1, 2, 3]), np.array([0, 0, 1])], [rng.integers(0, 3, 200), rng.integers(0, 3, 200)], [np.array([3.0, np.nan, 1.0]), np.array([1.0, 1.0, 1.0])], [np.array([1.0, 2.0]), np.array([np.nan, 1.0])], [np.empty(0), np.empty(0)]):
        assert onepass.in_order(*keys).tolist() == np.lexsort(keys).tolist()

    pages, glyphs = 20_000, 20
    place = np.tile(np.arange(glyphs), pages)
    rows = onepass.Rows(np.arange(pages) * glyphs, ["a"], np.zeros(len(place), int), 5.0 * (place % 40), 5.0 * (place % 40) + 5, 12.0 * (place // 40), np.full(len(place), 10.0))
    began = time.process_time()
    onepass._gutters(rows, 5, 0.3, 0.4)
    assert time.process_time() - began < 10  # a look at all glyphs for each page takes 28 s here, this 2.5 s
