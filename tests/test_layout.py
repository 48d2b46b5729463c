"""Layout operators whose steps depend on each other, against plain loops."""

import random

from pyspark.sql import functions as F

from quirespark.functions import text as T
from quirespark.operators import boxes, glyphs, layout, policies, profiles


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def test_rows_are_anchored_at_their_first_glyph(spark):
    """Each glyph is 2 below the one before: compared with the one before all would be one row."""
    rows = [("d", i, "x", 10.0 * i, 10.0 * i + 5, 100.0 + 2 * i, 10.0) for i in range(6)]
    found = glyphs.baseline_rows(frame(spark, rows, "doc string, seq int, s string, x0 double, x1 double, y double, size double"))
    assert [r["row"] for r in found.orderBy("seq").collect()] == [1, 1, 2, 2, 3, 3]
    mixed = [("d", 0, "a", 0.0, 5.0, 100.0, 10.0), ("d", 1, "b", 5.0, 9.0, 102.0, 10.0), ("d", 2, "c", 9.0, 12.0, 102.0, 5.0), ("d", 3, "d", 12.0, 15.0, 102.0, 10.0)]
    found = glyphs.baseline_rows(frame(spark, mixed, "doc string, seq int, s string, x0 double, x1 double, y double, size double"))
    assert [r["row"] for r in found.orderBy("seq").collect()] == [1, 1, 2, 2]


def test_fragments_break_at_gutters_and_collapse_blanks(spark):
    row = [("d", 1, s, x, x + 5, 100.0, 10.0) for s, x in ((" ", 0.0), ("a", 5.0), ("b", 10.0), (" ", 15.0), (" ", 20.0), ("c", 22.0), ("d", 35.0), ("e", 60.0))]
    table = frame(spark, row, "doc string, row long, s string, x0 double, x1 double, y double, size double")
    found = glyphs.fragments(table).orderBy("x0").collect()
    assert [(r["text"], r["x0"], r["x1"]) for r in found] == [("ab c d", 5.0, 40.0), ("e", 60.0, 65.0)]
    gutters = frame(spark, [("d", 30)], "doc string, bin int")
    assert [r["text"] for r in glyphs.fragments(table, gutters).orderBy("x0").collect()] == ["ab c", "d", "e"]


def test_doubles_are_compared_with_the_last_kept(spark):
    rows = [("d", i, "x", 0.6 * i, 10.0, 10.0) for i in range(5)] + [("d", 5, "y", 0.0, 10.0, 10.0)]
    kept = glyphs.without_adjacent_doubles(frame(spark, rows, "doc string, seq int, s string, x0 double, y double, size double"))
    assert sorted(r["seq"] for r in kept.collect()) == [0, 2, 4, 5]


def test_superscripts_join_the_first_larger_row(spark):
    letter = lambda x, y, size: {"x0": x, "x1": x + size / 2, "y": y, "size": size}
    rows = [("d", 1, [letter(0.0, 100.0, 10.0), letter(6.0, 100.0, 10.0)]), ("d", 2, [letter(12.0, 96.0, 6.0)]), ("d", 3, [letter(17.0, 95.0, 4.0)]), ("d", 4, [letter(300.0, 96.0, 6.0)])]
    found = layout.superscript_hosts(frame(spark, rows, "doc string, row long, letters array<struct<x0:double,x1:double,y:double,size:double>>"))
    assert {(r["row"], r["host"]) for r in found.collect()} == {(2, 1), (3, 1)}


def sections_by_loop(strips, least, last_gutters=None):
    """The number of each strip's section; last_gutters, a dict, gets each section's gutters at its end."""
    last_gutters = {} if last_gutters is None else last_gutters

    def union(spans):
        out = []
        for a, b in sorted(spans):
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return out

    def inner(spans):
        u = union(spans)
        return [(p[1], q[0]) for p, q in zip(u, u[1:], strict=False) if q[0] - p[1] >= least]

    def narrowed(gutters, spans):
        out = []
        for g in gutters:
            free = [x for x in range(int(g[0]), int(g[1])) if not any(a < x + 1 and x < b for a, b in spans)]
            runs, best = [], 0
            for x in free:
                if runs and runs[-1][1] == x:
                    runs[-1][1] = x + 1
                else:
                    runs.append([x, x + 1])
            best = max((r[1] - r[0] for r in runs), default=0)
            if best < least:
                return None
            out.append([tuple(r) for r in runs if r[1] - r[0] == best][-1])
        return out

    def ahead(k):
        below = next((inner(s) for s in strips[k + 1 : k + 4] if inner(s)), None)
        return (narrowed(below, strips[k]) or []) if below else []

    number, gutters, out = 0, None, []
    for k, spans in enumerate(strips):
        if gutters:
            left = narrowed(gutters, spans)
            if left is not None:
                gutters = last_gutters[number] = left
                out.append(number)
                continue
        elif gutters is not None and not inner(spans) and not ahead(k):
            out.append(number)
            continue
        number, gutters = number + 1, inner(spans) or ahead(k)
        last_gutters[number] = gutters
        out.append(number)
    return out


def test_sections(spark):
    random.seed(3)
    pages = []
    for _ in range(60):
        strips = []
        for _ in range(random.randint(1, 9)):
            cuts = random.choice(([], [40], [40], [30, 60]))
            edges = [0, *[c + random.randint(-3, 3) for c in cuts], 100]
            strips.append([(float(a + random.randint(2, 6)), float(b - random.randint(2, 6))) for a, b in zip(edges, edges[1:], strict=False)])
        pages.append(strips)
    rows = [(p, k, [{"x0": a, "x1": b} for a, b in spans]) for p, strips in enumerate(pages) for k, spans in enumerate(strips)]
    strips = frame(spark, rows, "doc int, strip long, spans array<struct<x0:double,x1:double>>")
    found = {(r["doc"], r["strip"]): r["section"] for r in layout.sections(strips, frame(spark, [(p, 10.0) for p in range(60)], "doc int, body double")).collect()}
    assert found == {(p, k): n for p, strips in enumerate(pages) for k, n in enumerate(sections_by_loop(strips, 6.0))}
    assert len(set(found.values())) > 2


PIECES = "slot int, id int, x0 int, y0 int, x1 int, y1 int, area int, edge boolean"
BLOCK = "slot int, ax0 int, ay0 int, ax1 int, ay1 int, letter double, w int, h int"


def test_kept_pieces(spark):
    block = frame(spark, [(1, 200, 200, 600, 600, 10.0, 800, 1000), (2, 0, 0, 10, 10, 10.0, 800, 1000)], BLOCK)
    pieces = [
        (1, 1, 300, 300, 310, 310, 60, False),  # text
        (1, 2, 310, 300, 320, 310, 60, False),
        (1, 3, 312, 800, 320, 810, 60, False),  # a page number below the text's columns
        (1, 4, 420, 900, 428, 910, 60, False),  # a letter below the block, beside it by less than 12 letters
        (1, 5, 760, 400, 768, 410, 60, False),  # beside the text: too far
        (1, 6, 790, 0, 795, 900, 2000, True),  # a rule at a cut side
        (1, 7, 315, 980, 316, 981, 1, False),  # a speck in the columns, near nothing
        (2, 1, 500, 500, 510, 510, 60, False),  # nothing in this block: all stay
    ]
    lively = boxes.live(frame(spark, pieces, PIECES), block)
    kept = boxes.kept_pieces(lively)
    assert {(r["slot"], r["id"]) for r in kept.collect()} == {(1, 1), (1, 2), (1, 3), (1, 4), (2, 1)}
    found = {r["slot"]: tuple(r[c] for c in ("x0", "y0", "x1", "y1")) for r in boxes.kept_boxes(frame(spark, pieces, PIECES), kept, block).collect()}
    assert found == {1: (300 - 9, 300 - 12, 428 + 9, 910 + 12), 2: (0, 0, 10, 10)}
    reasons = {r["id"]: r["reason"] for r in boxes.whitened(lively, kept).collect()}
    assert reasons == {5: "not joined", 6: "edge+big", 7: "not joined"}


def test_head_line_reaches_farther_but_once(spark):
    block = frame(spark, [(1, 200, 200, 600, 600, 10.0, 1000, 1000)], BLOCK)
    text = [(1, i, 300 + 12 * i, 200, 310 + 12 * i, 210, 60, False) for i in range(5)]
    beside = [(1, 10, 560, 202, 568, 212, 60, False), (1, 11, 760, 202, 768, 212, 60, False)]
    dotted = [(1, 20 + i, 100, 200 + 80 * i, 106, 212 + 80 * i, 60, False) for i in range(5)]
    kept = boxes.kept_pieces(boxes.live(frame(spark, text + beside + dotted, PIECES), block))
    assert {r["id"] for r in kept.collect()} == {0, 1, 2, 3, 4, 10, 11}


def test_local_minima(spark):
    random.seed(4)
    curves = [[round(random.random(), 3) for _ in range(random.randint(2, 60))] for _ in range(40)]

    def loop(p):
        sm = [round(sum(p[max(i - 1, 0) : i + 2]) / 3, 9) for i in range(len(p))]
        out, a = [0], 0
        while a + 1 < len(sm):
            b = a + 1
            while b + 1 < len(sm) and not (sm[b] <= sm[b - 1] and sm[b] < sm[b + 1] and b - a >= 3):
                b += 1
            out.append(b)
            a = b
        return out

    rows = [(k, i, d) for k, p in enumerate(curves) for i, d in enumerate(p)]
    found = profiles.local_minima(frame(spark, rows, "key int, i int, d double")).groupBy("key").agg(F.sort_array(F.collect_list("i")).alias("cuts")).collect()
    assert {r["key"]: r["cuts"] for r in found} == {k: loop(p) for k, p in enumerate(curves)}


def test_rows_of_a_box(spark):
    rows = [("one line", 0.0, 0.0, 100.0, 10.0), ("a paragraph that was read as one line of a box that is rather tall", 10.0, 20.0, 110.0, 80.0), ("", 0.0, 0.0, 5.0, 5.0), ("unbroken" * 9, 0.0, 0.0, 60.0, 60.0)]
    found = frame(spark, rows, "t string, x0 double, y0 double, x1 double, y1 double").select("t", T.rows_of_box(*map(F.col, ("t", "x0", "y0", "x1", "y1"))).alias("r")).collect()
    by_text = {r["t"]: r["r"] for r in found}
    assert [r["s"] for r in by_text["one line"]] == ["one line"] and by_text[""] == []
    tall = by_text[rows[1][0]]
    assert len(tall) == 4 and " ".join(r["s"] for r in tall) == rows[1][0] and tall[0]["x1"] == 110.0 and tall[-1]["x1"] < 110.0 and tall[-1]["y1"] == 80.0
    assert "".join(r["s"] for r in by_text["unbroken" * 9]) == "unbroken" * 9


def test_winansi(spark):
    found = frame(spark, [("a–b…€ ß漢",)], "t string").select(T.winansi(F.col("t")).alias("w")).first()["w"]
    assert bytes(found["bytes"]) == b"a\x96b\x85\x80 \xdf" and found["skipped"] == 1


def test_hue_clusters(spark):
    """Runs on the hue circle, that over its end included, against a loop."""
    random.seed(6)
    hists = [[random.choice((0, 0, 0, 1, 5, 40)) for _ in range(36)] for _ in range(60)] + [[1] * 36, [0] * 35 + [9], [50, *[0] * 34, 50]]

    def loop(h):
        total = sum(h)
        on = [(h[i - 1] + 2 * h[i] + h[(i + 1) % 36]) / 4 >= 0.02 * total for i in range(36)]
        if all(on):
            return 1
        start, runs, held = on.index(False), [], []
        for i in range(37):
            j = (start + i) % 36
            if on[j] and i < 36:
                held.append(h[j])
            elif held:
                runs.append(sum(held))
                held = []
        return sum(r >= 0.05 * total for r in runs)

    rows = [(k, i, n, 0.0) for k, h in enumerate(hists) for i, n in enumerate(h) if n]
    found = {r["key"]: r["k"] for r in policies.hue_clusters(frame(spark, rows, "key int, bin int, n long, share double")).collect()}
    assert found == {k: loop(h) for k, h in enumerate(hists) if sum(h)}
