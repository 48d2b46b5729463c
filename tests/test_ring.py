"""What lies beyond cut sides, on slots that are drawn."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirespark.operators import boxes, ring
from test_layout import BLOCK, PIECES


def drawn(page, marks):
    for x0, y0, x1, y1 in marks:
        page[y0:y1, x0:x1] = 0.0
    return page


def letters(x, y, n, high=20, wide=12, step=18):
    return [(x + step * k, y, x + step * k + wide, y + high) for k in range(n)]


BOX, REACH = (100, 100, 700, 900), 18  # the slot in a page of 800 x 1000
TEXT = [m for k in range(20) for m in letters(180, 220 + 30 * k, 25)]


def pieces_of(page, split=False, slot=0):
    cut = [True] * 4
    grow = ring.grown_sides(cut, split, slot)
    mask = ring.ring_source(page, BOX, REACH, grow) < 0.5
    x0, y0, x1, y1 = BOX
    kept = np.zeros((y1 - y0, x1 - x0), bool)
    for a, b, c, d in TEXT:
        kept[b - y0 : d - y0, a - x0 : c - x0] = True
    inside = page[y0:y1, x0:x1] < 0.5
    kept |= inside  # what reaches into the slot is kept there
    return ring.ring_pieces(mask, kept, (x1 - x0, y1 - y0), REACH, 0.0, grow, cut)


def found(spark, slots):
    rows = [(s, *p) for s, ps in slots.items() for p in ps]
    pieces = spark.createDataFrame(rows, "slot int, id int, x0 int, y0 int, x1 int, y1 int, area int, out boolean, edge boolean, seed boolean").repartition(3)
    block = spark.createDataFrame([(s, 120, 710, 80, 530, 120, 710, 20.0, 800) for s in slots], "slot int, ay0 int, ay1 int, kx0 int, kx1 int, top int, bottom int, letter double, h int")
    out = {}
    for r in ring.reached(pieces, block).collect():
        out.setdefault(r["slot"], []).append((r["why"], r["x0"], r["y0"], r["x1"], r["y1"]))
    return {s: sorted(v) for s, v in out.items()}, pieces, block


def test_page_numbers_and_lines(spark):
    white = lambda: drawn(np.ones((1000, 800)), TEXT)
    number = [(380, 884, 394, 914), (396, 884, 410, 914)]  # two digits half outside the slot, 1.5 letters tall
    row = letters(200, 892, 8, 18)  # a foot line that the slot clips
    slots = {
        1: pieces_of(drawn(white(), number)),
        2: pieces_of(drawn(white(), [*number, (440, 901, 452, 914)])),  # another letter less than three letters away, itself not anchored
        3: pieces_of(drawn(white(), [(380, 884, 394, 930)])),  # reaches the ring's end
        4: pieces_of(drawn(white(), [(380, 901, 394, 915), (396, 901, 410, 915)])),  # nothing of it in the slot
        5: pieces_of(drawn(white(), row)),
        6: pieces_of(drawn(white(), [*row, (202, 905, 206, 909)])),
        7: pieces_of(drawn(white(), row[:2])),  # too few letters, and too short for a number
        8: pieces_of(drawn(white(), [*row, (240, 911, 246, 913)])),  # a small sign under a letter
        9: pieces_of(white()),
    }
    got, _, _ = found(spark, slots)
    shift = lambda marks, why: sorted((why, a - 100, b - 100, c - 100, d - 100) for a, b, c, d in marks)
    assert got == {1: shift(number, "number"), 5: shift(row, "line"), 6: shift(row, "line"), 8: sorted(shift(row, "line") + shift([(240, 911, 246, 913)], "sign"))}


@pytest.mark.parametrize(("split", "slot", "seen"), [(True, 0, False), (True, 1, True), (False, 0, True)])
def test_the_gutter_side_is_not_searched(spark, split, slot, seen):
    """A number that the right side cuts: the gutter is there for the left slot of two."""
    page = drawn(np.ones((1000, 800)), [*TEXT, (692, 220, 706, 250)])
    got, _, _ = found(spark, {1: pieces_of(page, split, slot)})
    assert got == ({1: [("number", 592, 120, 606, 150)]} if seen else {})


def test_line_classes_and_boxes(spark):
    row = letters(200, 892, 8, 18)
    got, pieces, block = found(spark, {1: pieces_of(drawn(drawn(np.ones((1000, 800)), TEXT), row))})
    lines = ring.reached(pieces, block)
    assert tuple(ring.reached_boxes(lines).first())[1:] == (100, 792, 238, 810)
    rows = sorted({y - 100 for _, b, _, d in TEXT for y in range(b, d)} | set(range(792, 800)))
    ink = spark.createDataFrame([(1, rows, 120, 710, 20.0, 800)], "slot int, rows array<int>, ky0 int, ky1 int, letter double, h int")
    r = ring.line_classes(lines, ink).first()
    assert (r["class"], r["white"]) == ("headfoot", (791 - 710 + 1) / 20)


def test_dotted_rules_are_no_letters(spark):
    dots = [(694, 200 + 100 * k, 704, 214 + 100 * k) for k in range(7)]
    got, _, _ = found(spark, {1: pieces_of(drawn(np.ones((1000, 800)), [*TEXT, *dots]))})
    assert got == {}


def kept_by_loop(pieces, block):
    """kept_pieces() of one slot, piece by piece, until nothing is added."""
    ax0, ay0, ax1, ay1, letter, _, h = block
    inside = [p for p in pieces if p[6] and p[1] < ax1 and p[3] > ax0 and p[2] < ay1 and p[4] > ay0]
    if not inside:
        return {p[0] for p in pieces}
    kept = {p[0]: p for p in inside}
    gap = lambda a, b, c, d: max(c - b, a - d, 0)

    def box():
        return min(p[1] for p in kept.values()), min(p[2] for p in kept.values()), max(p[3] for p in kept.values()), max(p[4] for p in kept.values())

    def grown():
        for p in pieces:
            if p[6] and p[0] not in kept:
                x0, y0, x1, y1 = box()
                gx, gy = gap(p[1], p[3], x0, x1), gap(p[2], p[4], y0, y1)
                big, small = p[5] >= letter * letter / 8, max(p[3] - p[1], p[4] - p[2]) <= 3 * letter
                if gx == 0 and big or max(gx, gy) <= int(4 * letter) or (p[4] <= ay0 or p[2] >= ay1) and big and small and gx <= 12 * letter:
                    kept[p[0]] = p
                    return True
        return False

    while grown():
        pass
    tall = [p for p in kept.values() if p[4] - p[2] >= letter / 2]
    top, bottom = min((p[2] for p in tall), default=float("inf")), max((p[4] for p in tall), default=0)
    for p in pieces:
        if p[6] and p[0] not in kept and p[5] >= letter * letter / 8 and max(p[3] - p[1], p[4] - p[2]) <= 3 * letter and p[4] - p[2] >= letter / 2 and (p[2] < top + 1.5 * letter or p[4] > bottom - 1.5 * letter):
            column = [o for o in pieces if o[0] != p[0] and o[5] >= letter * letter / 8 and o[3] - o[1] <= 3 * letter and o[1] < p[3] and o[3] > p[1]]
            dotted = len(column) >= 3 and max(o[4] for o in [p, *column]) - min(o[2] for o in [p, *column]) > 0.25 * h
            x0, _, x1, _ = box()
            if gap(p[1], p[3], x0, x1) <= 24 * letter and not dotted:
                kept[p[0]] = p
    return set(kept)


def test_kept_pieces_by_loop(spark):
    rng = np.random.default_rng(7)
    rows, blocks = [], []
    for slot in range(60):
        for i in range(rng.integers(1, 60)):
            x, y = int(rng.integers(0, 1000)), int(rng.integers(0, 1400))
            w, h = (int(v) for v in rng.integers(2, 40 if rng.random() < 0.9 else 400, 2))
            rows.append((slot, i, x, y, x + w, y + h, int(rng.integers(0, w * h + 1)), bool(rng.random() < 0.1)))
        blocks.append((slot, 300, 400, 700, 900, 10.0, 1000, 1400))
    block = spark.createDataFrame(blocks, BLOCK)
    lively = boxes.live(spark.createDataFrame(rows, PIECES), block)
    by_slot = {}
    for r in lively.orderBy("slot", "id").collect():
        by_slot.setdefault(r["slot"], []).append((r["id"], r["x0"], r["y0"], r["x1"], r["y1"], r["area"], r["live"]))
    got = {}
    for r in boxes.kept_pieces(lively).collect():
        got.setdefault(r["slot"], set()).add(r["id"])
    assert got == {s: kept_by_loop(ps, blocks[s][1:]) for s, ps in by_slot.items()}


def test_reached_in_one_pass_as_by_its_parts(spark):
    """The pieces are dealt once, and what is taken in is what the parts say of all slots: numbers, lines, signs, in this order; ids need not be unique."""
    rng = np.random.default_rng(9)
    rows = [
        (slot, int(rng.integers(0, 24)), (x := int(rng.integers(0, 40)) * 9), (y := int(rng.choice([88, 640, 660]) + rng.integers(0, 7))), x + int(rng.integers(3, 12)), y + int(rng.integers(3, 17)), int(rng.integers(0, 60)), *(bool(v) for v in rng.random(3) < (0.8, 0.1, 0.3)))
        for slot in range(120) for _ in range(rng.integers(1, 30))
    ]
    pieces = spark.createDataFrame(rows, "slot int, id int, x0 int, y0 int, x1 int, y1 int, area int, out boolean, edge boolean, seed boolean")
    block = pieces.select("slot").distinct().selectExpr("slot", "100 ay0", "620 ay1", "50 kx0", "300 kx1", "100 top", "620 bottom", "10D letter", "800 h")
    found = ring.reached(pieces, block)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got = {(r["slot"], r["id"]): (r["why"], r["part"]) for r in found.collect()}
    letters = ring.ring_letters(pieces, block)
    wanted = ring.candidates(letters)
    own = boxes.clusters(letters.join(wanted, ["slot", "id"], "left_semi").withColumn("gap", ring.NUMBER_GAP * F.col("letter")), "gap")
    lines = ring.clipped_lines(letters, wanted)
    small = letters.where("area > 0 and out and not edge and greatest(x1 - x0, y1 - y0) <= 3 * letter and y1 - y0 <= 0.5 * letter").join(lines, ["slot", "id"], "left_anti")
    want = {(r["slot"], r["id"]): ("sign", None) for r in boxes.diacritics(small, lines, block, ring.SIGN).collect()}
    want |= {(r["slot"], r["id"]): ("line", r["line"]) for r in lines.collect()}
    want |= {(r["slot"], r["id"]): ("number", r["root"]) for r in own.join(ring.page_numbers(letters, wanted), ["slot", "root"], "left_semi").collect()}
    assert got == want and {why for why, _ in want.values()} == {"number", "line", "sign"}
