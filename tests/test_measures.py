"""Order of words kept and ink residuals, against plain loops."""

import difflib
import random

import numpy as np
import pytest

from quirespark.operators import inks, order


@pytest.mark.parametrize("small", [order.SMALL, 40])
def test_order_kept_is_that_of_the_matcher(spark, small):
    rng = random.Random(small)
    pairs = []
    for k in range(40):
        a = [rng.choice("abcdefgh"[: rng.randint(1, 8)]) for _ in range(rng.randint(0, 60))]
        b = a[:]
        for _ in range(rng.randint(0, 12)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 4)] = [rng.choice("abcxyz") for _ in range(rng.randint(0, 4))]
        pairs.append((k, a, b))
    pairs += [(100, None, ["a"]), (101, [], []), (102, ["a"] * 30, ["a"] * 7)]
    found = {r["key"]: r for r in order.order_kept(spark.createDataFrame(pairs, "key int, a array<string>, b array<string>"), small).collect()}
    assert len(found) == len(pairs)
    for k, a, b in pairs:
        want = sum(m.size for m in difflib.SequenceMatcher(None, a or [], b or [], autojunk=False).get_matching_blocks())
        assert (found[k]["kept"], found[k]["n_a"], found[k]["n_b"]) == (want, len(a or []), len(b or [])) and found[k]["share"] == round(want / max(len(a or []), 1), 6)


def test_order_of_conversations(spark):
    from quirespark.plans import queries

    import __spark_entry__  # noqa: F401

    path = "/root/testdata/sf0.001"
    texts = {}
    for r in spark.read.parquet(f"{path}/conversations.parquet").orderBy("conv_id", "turn").collect():
        texts.setdefault(r["conv_id"], {}).setdefault(r["role"] == "assistant", []).extend((r["text"] or "").lower().split(" "))
    found = {r["conv_id"]: r for r in queries.QUERIES["order_kept"](spark, path).collect()}
    assert set(found) == set(texts)
    for k, sides in texts.items():
        a, b = ([w for w in sides.get(s, []) if w] for s in (False, True))
        assert found[k]["kept"] == sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())


def residual_by_loop(rgb):
    """rgb: points, coloured ones only."""
    colours, n = np.unique(rgb, axis=0, return_counts=True)
    colours = colours.astype(float)
    centres = [colours[np.lexsort((*colours.T[::-1], -n))[0]]]
    while len(centres) < 4:
        d = np.min([((colours - c) ** 2).sum(axis=1) for c in centres], axis=0)
        centres.append(colours[np.flatnonzero(d == d.max())[0]])
    centres = np.array(centres)
    for _ in range(inks.ROUNDS):
        own = ((colours[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.array([(colours[own == j] * n[own == j, None]).sum(axis=0) / n[own == j].sum() if (own == j).any() else centres[j] for j in range(4)])
    return float((np.sqrt(((colours - centres[own]) ** 2).sum(axis=1)) * n).sum() / n.sum() / 255)


def test_ink_residual_and_tint(spark):
    rng = np.random.default_rng(4)
    pages = {}
    for k in range(8):
        base = rng.integers(0, 256, (rng.integers(1, 7), 3))
        pages[k] = np.clip(base[rng.integers(0, len(base), 400)] + rng.integers(-12, 13, (400, 3)), 0, 255)
    pages[8] = np.repeat(rng.integers(235, 256, (30, 1)), 3, axis=1)
    pages[9] = np.clip(225 + rng.integers(-30, 31, (200, 3)), 0, 255)
    rows = [(k, int(r), int(g), int(b), 1) for k, p in pages.items() for r, g, b in p]
    pixels = spark.createDataFrame(rows, "key int, r int, g int, b int, n long").repartition(3)
    fit = {r["key"]: r["fit4"] for r in inks.ink_residual(pixels).collect()}
    tint = {r["key"]: r for r in inks.tint_share(pixels).collect()}
    for k, p in pages.items():
        chroma = p.max(axis=1) - p.min(axis=1)
        coloured = p[chroma >= inks.CHROMA]
        assert fit[k] == pytest.approx(residual_by_loop(coloured) if len(coloured) >= inks.FEWEST else 0.0, abs=2e-6)
        light = p @ np.array([0.299, 0.587, 0.114]) / 255 >= inks.LIGHT
        assert tint[k]["tint"] == pytest.approx((light & (chroma >= inks.TINT[0]) & (chroma < inks.TINT[1])).sum() / max(1, light.sum()), abs=1e-6)
        assert tint[k]["col_area"] == pytest.approx(len(coloured) / len(p), abs=1e-6)


def test_coverage_makes_no_row_of_a_point(spark):
    """Boxes that overlap, touch, reach out of the region or lie apart; regions of one number count together; a million points are one row."""
    from quirespark.operators.evaluate import coverage

    boxes = [(1, 0, 0, 35, 50), (1, 20, 20, 70, 90), (1, 35, 0, 40, 100), (1, -30, 95, 500, 300), (1, 400, 400, 500, 500), (1, 5, 5, 5, 50), (2, 0, 0, 9, 9)]
    regions = [(1, 1, 3, 7, 98, 121), (1, 2, 0, 0, 10, 10), (1, 2, 60, 60, 100, 103), (2, 1, 0, 0, 20, 20), (2, 2, 11, 0, 21, 10), (3, 1, 0, 0, 10_000, 10_000), (None, 1, 0, 0, 10, 10)]
    want: dict = {}
    for page, no, x0, y0, x1, y1 in regions:
        grid = [(x, y) for x in range(x0, x1, 10) for y in range(y0, y1, 10)]
        n, hit = want.get((page, no), (0, 0))
        want[page, no] = n + len(grid), hit + sum(any(p == page and a <= x < c and b <= y < d for p, a, b, c, d in boxes) for x, y in grid)
    ddl = "x0 int, y0 int, x1 int, y1 int"
    found = coverage(spark.createDataFrame(regions, f"page long, no int, {ddl}"), spark.createDataFrame(boxes, f"page long, {ddl}"))
    assert {(r["page"], r["no"]): r["covered"] for r in found.collect()} == {k: round(h / n, 6) for k, (n, h) in want.items()}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
