"""Reading order against a plain recursive loop, and whole pages from glyphs to Markdown against what they were set from."""

import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from quirespark.functions import text as T
from quirespark.operators import assembly, glyphs as G, reading
from test_layout import sections_by_loop

FRAGS = "doc string, page int, id long, x0 double, x1 double, base double, size double, bold boolean, text string"


def blocks_by_loop(frags, body):
    """[("lines", [(base, text, col_start)]) | ("table", rows)] of one page by recursion. frags: (x0, x1, base, size, text)."""
    strips, bottom = [], None
    for f in sorted(frags, key=lambda f: (f[2] - 0.7 * f[3], f[0])):
        if bottom is not None and f[2] - 0.7 * f[3] < bottom - 0.05 * f[3]:
            strips[-1].append(f)
            bottom = max(bottom, f[2] + 0.2 * f[3])
        else:
            strips.append([f])
            bottom = f[2] + 0.2 * f[3]
    gutters = {}
    numbers = sections_by_loop([[(f[0], f[1]) for f in s] for s in strips], 0.6 * body, gutters)
    blocks = []

    def rows(own):
        out = []
        for f in sorted(own, key=lambda f: (f[2], f[0])):
            if out and abs(f[2] - out[-1][0][2]) < 0.3 * min(f[3], out[-1][0][3]):
                out[-1].append(f)
            else:
                out.append([f])
        return [sorted(r) for r in out]

    def add(lines):
        if blocks and blocks[-1][0] == "lines":
            blocks[-1][1].extend(lines)
        else:
            blocks.append(("lines", list(lines)))

    for n, own in groupby(zip(numbers, strips, strict=True), key=lambda p: p[0]):
        members = [s for _, s in own]
        flat = [f for s in members for f in s]
        edges = [float("-inf"), *[g[1] for g in gutters[n]], float("inf")]
        columns = [c for a, b in zip(edges, edges[1:], strict=False) if (c := [f for f in flat if a < (f[0] + f[1]) / 2 <= b])]
        if len(columns) < 2 or any(len(rows(c)) < 2 for c in columns):
            add([(r[0][2], " ".join(f[4] for f in r), False) for r in rows(flat)])
        elif len(columns) >= 3 and sorted(len(f[4].split()) for f in flat)[len(flat) // 2] <= 4:
            blocks.append(("table", [[" ".join(f[4] for f in r if f in c) for c in columns] for r in rows(flat)]))
        else:
            for c in columns:
                inner = blocks_by_loop(c, body)
                if inner and inner[0][0] == "lines":
                    base, text, _ = inner[0][1][0]
                    inner[0][1][0] = (base, text, True)
                for kind, content in inner:
                    if kind == "lines":
                        add(content)
                    else:
                        blocks.append((kind, content))
    return blocks


def some_column(rng, x0, x1, y, depth):
    """Fragments of a column from y down, and where it ends: lines, tables, columns within."""
    out = []
    for _ in range(rng.randint(1, 3)):
        kind = rng.choice(["lines", "lines", "table", "columns"] if depth and x1 - x0 > 200 else ["lines", "table"] if x1 - x0 > 200 else ["lines"])
        if kind == "lines":
            for _ in range(rng.randint(2, 5)):
                out.append((x0, x1 - rng.choice([0, 0, 3]), y, 10.0, f"many words stand in line {y:.0f} here"))
                y += 12
        elif kind == "table":
            cells = rng.choice([3, 4])
            for row in range(rng.randint(2, 4)):
                wide = (x1 - x0) / cells
                out += [(x0 + k * wide, x0 + (k + 1) * wide - 10, y, 10.0, f"c{k} {y:.0f}") for k in range(cells) if row == 0 or k == 0 or rng.random() < 0.9]
                y += 12
        else:
            middle = (x0 + x1) / 2
            left, a = some_column(rng, x0, middle - 5, y, depth - 1)
            right, b = some_column(rng, middle + 5, x1, y, depth - 1)
            out += left + right
            y = max(a, b)
        y += 12
    return out, y


def found_blocks(spark, rows):
    frags = spark.createDataFrame(rows, FRAGS).repartition(3)
    body = spark.createDataFrame([(d, 10.0) for d in {r[0] for r in rows}], "doc string, body double")
    units = reading.page_blocks(reading.page_units(reading.reading_order(frags, body))).orderBy("doc", "page", "seq").collect()
    out = {}
    for (doc, page), own in groupby(units, key=lambda r: (r["doc"], r["page"])):
        for _, block in groupby(own, key=lambda r: r["block"]):
            block = list(block)
            out.setdefault((doc, page), []).append(("table", block[0]["text"]) if block[0]["kind"] == "table" else ("lines", [(r["base"], r["text"], r["col_start"]) for r in block]))
    return out


def as_markdown(rows):
    return "\n".join(["| " + " | ".join(r) + " |" for r in rows[:1]] + ["|" + " --- |" * len(rows[0])] + ["| " + " | ".join(r) + " |" for r in rows[1:]])


def test_reading_order_with_columns_within_columns(spark):
    rng = random.Random(11)
    pages = {(f"d{k % 3}", k): some_column(rng, 0.0, 600.0, 50.0, 2)[0] for k in range(40)}
    pages["d0", 99] = [(0.0, 280.0, 50.0, 10.0, "left one of many words here"), (300.0, 600.0, 50.0, 10.0, "right one of many words here"), (0.0, 90.0, 62.0, 10.0, "a"), (100.0, 190.0, 62.0, 10.0, "b"), (200.0, 280.0, 62.0, 10.0, "c"), (0.0, 90.0, 74.0, 10.0, "d"), (100.0, 190.0, 74.0, 10.0, "e"), (200.0, 280.0, 74.0, 10.0, "f"), (300.0, 600.0, 62.0, 10.0, "right two of many words"), (300.0, 600.0, 74.0, 10.0, "right three of many words")]
    rows = [(doc, page, n, *f[:4], False, f[4]) for (doc, page), frags in pages.items() for n, f in enumerate(frags)]
    found = found_blocks(spark, rows)
    want = {key: [(kind, as_markdown(content) if kind == "table" else content) for kind, content in blocks_by_loop(frags, 10.0)] for key, frags in pages.items()}
    assert found == want
    assert want["d0", 99] == [("lines", [(50.0, "left one of many words here", True)]), ("table", "| a | b | c |\n| --- | --- | --- |\n| d | e | f |"), ("lines", [(50.0, "right one of many words here", True), (62.0, "right two of many words", False), (74.0, "right three of many words", False)])]
    nested = sum(len(b) > 1 for b in want.values())
    assert nested > 5


def test_figures_split_blocks(spark):
    lines = [("d", 0, k, 0.0, 100.0, 50.0 + 12 * k, 10.0, False, f"line {k}") for k in range(6)]
    frags = spark.createDataFrame(lines, FRAGS)
    body = spark.createDataFrame([("d", 10.0)], "doc string, body double")
    figures = spark.createDataFrame([("d", 0, 1, 0.0, 50.0, 70.0), ("d", 0, 2, 10.0, 60.0, 70.0), ("d", 0, 3, 200.0, 300.0, 0.0), ("d", 0, 4, 0.0, 9.0, 0.0)], "doc string, page int, fig int, x0 double, x1 double, top double")
    found = reading.page_blocks(reading.page_units(reading.reading_order(frags, body)), figures).orderBy("seq").collect()
    assert [(r["fig"] or r["text"], r["block"], r["col_start"]) for r in found] == [
        (4, 1, False), ("line 0", 2, False), ("line 1", 2, False), (1, 3, False), (2, 4, False), ("line 2", 5, True), ("line 3", 5, False), ("line 4", 5, False), ("line 5", 5, False), (3, 6, False),
    ]


def set_line(page, x, y, text, size=10.0, bold=False, doc="d"):
    """Glyphs of a line, half a size wide; a word space is a gap."""
    return [(doc, page, s, x + size * k / 2, x + size * (k + 1) / 2, float(y), size, bold) for k, s in enumerate(text) if s != " "]


def whole_document():
    glyphs, want = [], []
    for page in range(6):
        out = set_line(page, 50, 30, "A Running Title of the Volume") + set_line(page, 540, 780, str(page + 7))
        head = f"Chapter {'ABCDEF'[page]}"
        out += set_line(page, 50, 80, head, 16.0)
        left = [f"left column begins page {'abcdef'[page]} and", "runs on over several lines that", "are of nearly the same length, so", "they make one paragraph which hy-", "phenates and ends before the"]
        for k, t in enumerate(left):
            out += set_line(page, 50, 110 + 12 * k, t)
        for k in range(3):
            for c in range(3):
                out += set_line(page, 50 + 70 * c, 182 + 12 * k, f"r{k} c{c}")
        right = ["table; the right column takes the", "sentence up and carries it to its", "end."]
        for k, t in enumerate(right):
            out += set_line(page, 320, 110 + 12 * k, t)
        out += set_line(page, 320, 160, "Bold Words Alone", bold=True)
        for k, t in enumerate(["Another paragraph stands below a", "figure and says a little more of", "the same kind."]):
            out += set_line(page, 320, 300 + 12 * k, t)
        out += set_line(page, 50, 600, "1 A note at the foot of the column", 8.0) + set_line(page, 50, 610, "that goes on.", 8.0) + set_line(page, 50, 620, "2 Another note.", 8.0)
        out += set_line(page, 320, 336, "Last.")  # after a short line that ends a sentence
        glyphs += out
        want.append((head, page))
    return glyphs


GLYPHS = "doc string, page int, seq long, s string, x0 double, x1 double, y double, size double, bold boolean"


def test_whole_pages(spark):
    glyphs = spark.createDataFrame([(d, p, n, *rest) for n, (d, p, *rest) in enumerate(whole_document())], GLYPHS).repartition(4)
    pages = spark.createDataFrame([("d", p, 800.0) for p in range(7)] + [("empty", 0, 800.0)], "doc string, page int, h double")
    figures = spark.createDataFrame([("d", p, 1, 320.0, 550.0, 170.0, f"v_p{p + 1}_1.jpg") for p in range(6)], "doc string, page int, fig int, x0 double, x1 double, top double, name string")
    found = {(r["doc"], r["page"]): r for r in assembly.markdown_of_glyphs(glyphs, pages, figures).collect()}
    assert len(found) == 8
    for p in range(6):
        want = [
            f"# Chapter {'ABCDEF'[p]}", f"left column begins page {'abcdef'[p]} and runs on over several lines that are of nearly the same length, so they make one paragraph which hyphenates and ends before the",
            "| r0 c0 | r0 c1 | r0 c2 |\n| --- | --- | --- |\n| r1 c0 | r1 c1 | r1 c2 |\n| r2 c0 | r2 c1 | r2 c2 |", "table; the right column takes the sentence up and carries it to its end.", "## Bold Words Alone",
            f"![[v_p{p + 1}_1.jpg]]", "Another paragraph stands below a figure and says a little more of the same kind.", "Last.",
        ]
        notes = "\n\n---\n1 A note at the foot of the column that goes on.\n\n2 Another note."
        assert found["d", p]["markdown"] == "\n\n".join(want) + notes + f"\n\n*— side {p + 7} —*\n\n---\n\n"
        assert (found["d", p]["label"], found["d", p]["n_tables"], found["d", p]["n_notes"]) == (str(p + 7), 1, 2)
    assert found["d", 6]["markdown"] == "*— side 13 —*\n" and found["empty", 0]["markdown"] == "*— side 1 —*\n"


@pytest.mark.parametrize("name", ["markdown_of_columns", "markdown_from_glyphs"])
def test_queries(spark, name):
    from quirespark.plans import queries

    import __spark_entry__  # noqa: F401  it registers them

    found = queries.QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    assert found and all(r["n_chars"] > 0 for r in found)


def test_only_edge_fragments_are_tested(spark):
    """Header tests and numbers are those of all fragments, but told of the edge alone."""
    random.seed(31)
    rows = [("d", p, k, x := random.choice([40.0, 300.0]), x + 100, float(random.randint(1, 80) * 10), 10.0, f"Page {k}", 800.0) for p in range(6) for k in range(40)]
    sized = spark.createDataFrame(rows, "doc string, page int, id long, x0 double, x1 double, base double, size double, text string, h double")
    found = assembly.tested_fragments(sized).collect()
    upper = sized.withColumn("upper_half", F.col("base") - 7 < 400)
    want = {(r["page"], r["id"]): (r["outer"], r["clear"], r["alone"]) for r in G.header_tests(upper, ["doc", "page"], "id").collect()}
    edge = {(r[1], r[2]) for r in rows if r[5] + 2 < 96 or r[5] - 7 > 704}
    assert {(r["page"], r["id"]): (r["outer"], r["clear"], r["alone"]) for r in found} == {k: want[k] for k in edge} and 0 < len(edge) < len(rows)
    assert all(r["number"] == r["id"] and r["numbers"] == [r["id"]] for r in found)


def test_lines_are_joined_by_their_ends(spark):
    """A hyphen tells at the end of what is held, also before a line's end; what stands before does not matter."""
    rows = [(["a-", "b"], "ab"), (["a-", "B"], "a- B"), (["a-\n", "b"], "a-b"), (["a-\r\n", "b"], "a-\rb"), (["-", "b"], "- b"), (["", "x\u00ad", "y"], "xy"), (["a" * 5000 + "-", "b-", "c"], "a" * 5000 + "bc"), ([], "")]
    found = spark.createDataFrame(rows, "l array<string>, want string").select("want", T.join_lines(F.col("l")).alias("t")).collect()
    assert all(r["t"] == r["want"] for r in found)
