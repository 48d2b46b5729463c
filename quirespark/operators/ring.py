"""What a slot's cut sides cut off: page numbers and clipped lines in a ring around the slot.

The ring is the slot grown on its cut sides (not on the gutter's), thresholded again. Its pieces of ink (slot, id, x0, y0, x1, y1 in
the slot's own canvas, area) are marked out (a pixel outside the slot), edge (at the grown slot's cut side) and seed (a pixel that the slot
kept). A block has slot, ay0, ay1 (the text block), kx0, kx1 (the kept box), top, bottom (of kept letters), letter (height of one), h.

Pieces are linked twice: to rows, then rows to lines; what a page number or a line must be is asked of the clusters, not of their pieces.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boxes import HEAD, RULE, ZONE, clusters, linked
from .folds import fold_groups
from .raster import labelled

#: Fixed values, in letters: the ring's width as a share of the slot; clearance, least and most height and least width of a page number.
REACH, CLEAR, NUMBER_HEIGHT, NUMBER_WIDTH, NUMBER_PIECES, NUMBER_GAP = 0.02, 3.0, (1.2, 1.8), 0.5, 4, 0.3
#: Of a clipped line: gap between pieces, letters and their share of the ink; of a diacritic: height and distance.
LINE_GAP, LINE_LETTERS, LINE_INK, SIGN = 1.0, 3, 0.8, 0.5
#: White rows between a line and the kept ink: body below the first, headings below the second.
LINE_CLASSES = (1.25, 4.0)
#: Pieces that are held against all others of their slot at a time.
ASKED = 256


def grown_sides(cut: list[bool], split: bool, slot: int) -> list[bool]:
    """Which sides (left, top, right, bottom) the ring grows on: those that cut the page, but not the gutter between two slots."""
    return [cut[0] and not (split and slot == 1), cut[1], cut[2] and not (split and slot == 0), cut[3]]


def ring_source(page: np.ndarray, box: tuple[int, int, int, int], reach: int, grow: list[bool]) -> np.ndarray:
    """The page around a slot's box out to `reach` on the grown sides; white elsewhere."""
    x0, y0, x1, y1 = box
    out = np.ones((y1 - y0 + 2 * reach, x1 - x0 + 2 * reach))
    left, top, right, bottom = (reach if g else 0 for g in grow)
    u0, v0, u1, v1 = max(0, x0 - left), max(0, y0 - top), min(page.shape[1], x1 + right), min(page.shape[0], y1 + bottom)
    out[v0 - y0 + reach : v1 - y0 + reach, u0 - x0 + reach : u1 - x0 + reach] = page[v0:v1, u0:u1]
    return out


def ring_pieces(mask: np.ndarray, kept: np.ndarray, slot: tuple[int, int], reach: int, angle: float, grow: list[bool], cut: list[bool]) -> list[tuple]:
    """(id, x0, y0, x1, y1, area, out, edge, seed) of the ink of a ring. kept: the ink that the slot kept, on its canvas; slot: its width and
    height before it was turned by `angle` onto the canvas."""
    found, labels = labelled(mask)
    y, x = np.nonzero(mask)
    of = labels[y, x]
    x, y = x - reach, y - reach
    w, h = slot
    left, top = (kept.shape[1] - w) // 2, (kept.shape[0] - h) // 2
    u, v = x + 0.5 - left - w / 2, y + 0.5 - top - h / 2
    sin, cos = math.sin(math.radians(angle)), math.cos(math.radians(angle))
    sx, sy = w / 2 + u * cos - v * sin - 0.5, h / 2 + u * sin + v * cos - 0.5  # places in the slot before it was turned
    outside = (sx < -0.5) | (sy < -0.5) | (sx > w - 0.5) | (sy > h - 0.5)
    on_canvas = (x >= 0) & (y >= 0) & (x < kept.shape[1]) & (y < kept.shape[0])
    held = np.zeros(len(x), bool)
    held[on_canvas] = kept[y[on_canvas], x[on_canvas]]
    far = [reach if g else 0 for g in grow]
    at_cut = (cut[0] & (sx < 2 - far[0])) | (cut[1] & (sy < 2 - far[1])) | (cut[2] & (sx > w - 3 + far[2])) | (cut[3] & (sy > h - 3 + far[3]))
    has = lambda flag: np.bincount(of[flag], minlength=len(found)) > 0
    flags = (has(outside), has(at_cut), has(held & ~outside))
    return [(k, *(int(n) - reach for n in found[k, :4]), int(found[k, 4]), *(bool(f[k]) for f in flags)) for k in range(len(found))]


def _sides() -> tuple[Column, Column]:
    return F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")


def ring_letters(pieces: DataFrame, block: DataFrame) -> DataFrame:
    """pieces with the block's columns and online: a whole letter outside the slot that stands on the first or last kept line, or above or
    below the block within the reach of its columns."""
    joined = pieces.join(block, "slot")
    wide, tall = _sides()
    letter = F.col("letter")
    sideways = F.greatest(F.col("kx0") - F.col("x1"), F.col("x0") - F.col("kx1"), F.lit(0))
    whole = (F.col("area") >= letter * letter / 8) & (F.greatest(wide, tall) <= 3 * letter)
    head = (tall >= letter / 2) & (sideways <= HEAD * letter) & ((F.col("y0") < F.col("top") + 1.5 * letter) | (F.col("y1") > F.col("bottom") - 1.5 * letter))
    zone = ((F.col("y1") <= F.col("ay0")) | (F.col("y0") >= F.col("ay1"))) & (sideways <= ZONE * letter)
    return joined.withColumn("beside", sideways > 0).withColumn("online", (F.col("area") > 0) & F.col("out") & ~F.col("edge") & whole & (head | zone))


def candidates(letters: DataFrame) -> DataFrame:
    """slot, id of the letters on a line that are not, beside the kept box, of a dotted rule."""

    dot = _dots().alias("dot")
    return fold_groups(letters.select("slot", "id", "x0", "y0", "x1", "y1", dot, "beside", "online", F.col("h").cast("double").alias("h")), ["slot"], ["id"], lambda rows: [(i,) for i in undotted(rows)], "id int")


def _dots() -> Column:
    """Whether a piece may be a dot of a dotted rule."""
    letter = F.col("letter").cast("double")
    return (F.col("area") >= F.greatest(F.lit(1.0), letter * letter / 8)) & (_sides()[0] <= 3 * letter)


def undotted(rows: list[tuple]) -> list[int]:
    """candidates() of one slot: ids of rows id, x0, y0, x1, y1, dot, beside, online, h."""
    dots = np.array([bool(r[5]) for r in rows])
    asked = [k for k, r in enumerate(rows) if r[7] and r[6]] if dots.sum() >= 3 else []
    boxes = np.array([r[1:5] for r in rows], float) if asked else None
    ruled: set[int] = set()
    for at in range(0, len(asked), ASKED):
        of = np.array(asked[at : at + ASKED])
        column = dots & (boxes[:, 0] < boxes[of, 2][:, None]) & (boxes[:, 2] > boxes[of, 0][:, None])
        own = np.arange(len(of)), of
        column[own] = False
        many = column.sum(axis=1) >= 3
        column[own] = True
        high = np.where(column, boxes[:, 3], -np.inf).max(axis=1) - np.where(column, boxes[:, 1], np.inf).min(axis=1)
        ruled |= set(of[many & (high > RULE * rows[0][8])].tolist())
    return [r[0] for k, r in enumerate(rows) if r[7] and k not in ruled]


def crowded(online: DataFrame) -> DataFrame:
    """slot, root of the clusters that another letter on a line comes nearer than CLEAR. online: slot, id, x0, y0, x1, y1, root (null: of none), letter."""

    placed = online.select("slot", "id", "x0", "y0", "x1", "y1", "root", F.col("letter").cast("double").alias("letter"))
    return fold_groups(placed, ["slot"], ["x0", "id"], lambda rows: [(r,) for r in approached(rows)], "root int")


def approached(rows: list[tuple]) -> list[int]:
    """crowded() of one slot: roots of rows id, x0, y0, x1, y1, root, letter, which are in order of x0."""
    found: set[int] = set()
    limit = CLEAR * rows[0][6] if rows else 0
    for n, (_, x0, y0, x1, y1, root, _) in enumerate(rows):
        for m in range(n + 1, len(rows)):
            _, u0, v0, u1, v1, other, _ = rows[m]
            if u0 - x1 >= limit:  # and so are all that begin later
                break
            if other != root and max(u0 - x1, x0 - u1, v0 - y1, y0 - v1, 0) < limit:
                found |= {root, other}
    return sorted(found - {None})


def page_numbers(letters: DataFrame, wanted: DataFrame) -> DataFrame:
    """slot, root, x0, y0, x1, y1, n, tall (in letters): the clusters of candidates that look like one page number: few pieces, one of them anchored in kept
    ink, clear of other letters on the line, as tall and as wide as digits."""
    own = letters.join(wanted, ["slot", "id"], "left_semi")
    roots = clusters(own.withColumn("gap", NUMBER_GAP * F.col("letter")), "gap")
    online = letters.where("online").join(roots, ["slot", "id"], "left")
    wide, tall = _sides()
    whole = own.join(roots, ["slot", "id"]).groupBy("slot", "root").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("n"), F.bool_or("seed").alias("anchored"), (F.max(tall) / F.first("letter")).alias("tall"), F.first("letter").alias("letter")
    )
    fits = (F.col("n") <= NUMBER_PIECES) & F.col("anchored") & F.col("tall").between(*NUMBER_HEIGHT) & (F.col("x1") - F.col("x0") >= NUMBER_WIDTH * F.col("letter"))
    return whole.where(fits).join(crowded(online), ["slot", "root"], "left_anti").drop("anchored", "letter")


def clipped_lines(letters: DataFrame, wanted: DataFrame) -> DataFrame:
    """slot, id, line: the pieces of text lines that the slot's side clips. Pieces that share rows and stand a letter apart make rows; rows
    that hold a candidate anchored in kept ink and overlap by half the lesser height make a line; a line has letters with most of its ink."""
    wide, tall = _sides()
    pool = letters.where((F.col("area") > 0) & F.col("out") & ~F.col("edge") & (F.greatest(wide, tall) <= 3 * F.col("letter")))
    rows = pool.join(clusters(pool.withColumn("gap", LINE_GAP * F.col("letter")), "gap", share=0), ["slot", "id"])
    seeded = rows.join(wanted, ["slot", "id"], "left_semi").where("seed").select("slot", "root").distinct()
    held = rows.join(seeded, ["slot", "root"], "left_semi")
    bands = held.groupBy("slot", F.col("root").alias("id")).agg(F.min("y0").alias("y0"), F.max("y1").alias("y1")).withColumns({"x0": F.lit(0), "x1": F.lit(0)})
    lines = clusters(bands, 0.0).select("slot", F.col("id").alias("root"), F.col("root").alias("line"))
    placed = held.join(lines, ["slot", "root"])
    letter = (F.col("area") >= F.col("letter") * F.col("letter") / 8) & (tall >= F.col("letter") / 2)
    good = placed.groupBy("slot", "line").agg(F.count_if(letter).alias("n"), (F.sum(F.when(letter, F.col("area")).otherwise(0)) / F.sum("area")).alias("share")).where((F.col("n") >= LINE_LETTERS) & (F.col("share") >= LINE_INK))
    return placed.join(good, ["slot", "line"], "left_semi").select("slot", "id", "line", "x0", "y0", "x1", "y1", "letter")


def reached(pieces: DataFrame, block: DataFrame) -> DataFrame:
    """slot, id, why (number, line or sign), part (the cluster), x0, y0, x1, y1: the pieces of the ring that the slot takes in."""
    letters = ring_letters(pieces, block)
    wide, tall = _sides()
    letter = F.col("letter")
    pool = (F.col("area") > 0) & F.col("out") & ~F.col("edge") & (F.greatest(wide, tall) <= 3 * letter)
    whole = (F.col("area") >= letter * letter / 8) & (tall >= letter / 2)
    flags = {"dot": _dots(), "beside": F.col("beside"), "online": F.col("online"), "seed": F.col("seed"), "pool": pool, "whole": whole, "small": pool & (tall <= SIGN * letter)}
    marked = letters.select("slot", "id", "x0", "y0", "x1", "y1", "area", *[F.coalesce(v, F.lit(False)).alias(k) for k, v in flags.items()], letter.cast("double").alias("letter"), F.col("h").cast("double").alias("h"))
    # All that is asked of a slot is asked where its pieces are: they are dealt once.
    return fold_groups(marked, ["slot"], ["x0", "id"], taken_in, "id int, why string, part int, x0 int, y0 int, x1 int, y1 int")


class Piece(NamedTuple):
    """A piece of the ring, with what is asked of it alone."""

    id: int
    x0: int
    y0: int
    x1: int
    y1: int
    area: int
    dot: bool
    beside: bool
    online: bool
    seed: bool
    pool: bool
    whole: bool
    small: bool
    letter: float
    h: float


def _rooted(pieces: list[Piece], gap: float, share: float) -> dict[int, list[Piece]]:
    """The pieces of each cluster by its root; pieces are in order of x0."""
    root = dict(linked([(*p[:5], gap) for p in pieces], share))
    out: dict[int, list[Piece]] = {}
    for p in pieces:
        out.setdefault(root[p.id], []).append(p)
    return out


def _numbers(pieces: list[Piece], wanted: set[int]) -> dict[int, int]:
    """id: root of the pieces of page_numbers() of one slot."""
    letter = pieces[0].letter
    own = _rooted([p for p in pieces if p.id in wanted], NUMBER_GAP * letter, 0.5)
    fits = {
        root: held for root, held in own.items()
        if len(held) <= NUMBER_PIECES and any(p.seed for p in held) and NUMBER_HEIGHT[0] <= max(p.y1 - p.y0 for p in held) / letter <= NUMBER_HEIGHT[1] and max(p.x1 for p in held) - min(p.x0 for p in held) >= NUMBER_WIDTH * letter
    }
    if not fits:
        return {}
    of = {p.id: root for root, held in own.items() for p in held}
    near = set(approached([(*p[:5], of.get(p.id), letter) for p in pieces if p.online]))
    return {p.id: root for root, held in fits.items() if root not in near for p in held}


def _lines(pieces: list[Piece], wanted: set[int]) -> dict[int, int]:
    """id: line of the pieces of clipped_lines() of one slot."""
    rows = _rooted([p for p in pieces if p.pool], LINE_GAP * pieces[0].letter, 0)
    held = {root: own for root, own in rows.items() if any(p.seed and p.id in wanted for p in own)}
    bands = [(root, 0, min(p.y0 for p in held[root]), 0, max(p.y1 for p in held[root]), 0.0) for root in sorted(held)]
    lines: dict[int, list[Piece]] = {}
    for root, line in linked(bands, 0.5):
        lines.setdefault(line, []).extend(held[root])
    good = lambda own: sum(p.whole for p in own) >= LINE_LETTERS and sum(p.area for p in own if p.whole) / sum(p.area for p in own) >= LINE_INK
    return {p.id: line for line, own in lines.items() if good(own) for p in own}


def taken_in(rows: list[tuple]) -> list[tuple]:
    """reached() of one slot: rows are pieces in order of x0."""
    pieces = [Piece(*r) for r in rows]
    wanted = set(undotted([(*p[:5], p.dot, p.beside, p.online, p.h) for p in pieces]))
    if not wanted:
        return []  # numbers and lines begin with candidates, signs with lines
    numbers, lines = _numbers(pieces, wanted), _lines(pieces, wanted)
    hosts = [p for p in pieces if p.pool and p.id in lines]
    limit = SIGN * pieces[0].letter
    over = lambda p: any(k.x0 < p.x1 and p.x0 < k.x1 and max(k.y0 - p.y1, p.y0 - k.y1) <= limit for k in hosts)
    out: dict[int, tuple] = {}  # pieces that share an id are taken in as one
    for p in pieces:
        if p.id in out:
            continue
        if p.id in numbers:
            out[p.id] = (p.id, "number", numbers[p.id], *p[1:5])
        elif p.id in lines:
            if p.pool:
                out[p.id] = (p.id, "line", lines[p.id], *p[1:5])
        elif p.small and over(p):
            out[p.id] = (p.id, "sign", None, *p[1:5])
    return [*out.values()]


def reached_boxes(found: DataFrame) -> DataFrame:
    """slot, x0, y0, x1, y1: what the slot's kept box has to take in."""
    return found.groupBy("slot").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def line_classes(found: DataFrame, ink: DataFrame) -> DataFrame:
    """slot, part, x0, y0, x1, y1, class, white: for the diagnostics, the white rows (in letters) between a clipped line and the next kept ink towards the kept
    box, beyond the ink that adjoins it. ink: slot, rows (array of the rows that hold kept ink), ky0, ky1, letter, h."""
    lines = found.where("why = 'line'").groupBy("slot", "part").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))

    def fold(rows: list[tuple]) -> list[tuple]:
        out = []
        for part, x0, y0, x1, y1, inked, k0, k1, letter, h in rows:
            held = set(inked)
            down = (y0 + y1) / 2 < (k0 + k1) / 2
            ahead = range(y1, h) if down else range(y0 - 1, -1, -1)
            beyond = next((n for n, y in enumerate(ahead) if y not in held), len(ahead))
            white = next((n for n, y in enumerate(ahead[beyond:]) if y in held), len(ahead) - beyond) / letter
            kind = "body" if white < LINE_CLASSES[0] else "heading" if white < LINE_CLASSES[1] else "headfoot"
            out.append((part, x0, y0, x1, y1, kind, white))
        return out

    joined = lines.join(ink, "slot").select("slot", "part", "x0", "y0", "x1", "y1", "rows", "ky0", "ky1", F.col("letter").cast("double").alias("letter"), "h")
    return fold_groups(joined, ["slot"], ["part"], fold, "part int, x0 int, y0 int, x1 int, y1 int, class string, white double")
