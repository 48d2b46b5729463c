"""Covers are read twice, all else once; figures at two resolutions."""

import zlib

import numpy as np

from quirespark.operators import slots


def page_of_text(rng, frames=0):
    v = np.full((600, 400), 255, np.uint8)
    for y in range(100, 500, 24):
        for x in range(80, 320, 14):
            v[y : y + 12, x : x + 8] = 0
    for k in range(frames):  # big pieces at the left side, which is cut
        v[20 + 25 * k : 35 + 25 * k, 0:50] = 0
    return v


def test_covers_are_read_twice(spark):
    rng = np.random.default_rng(1)
    rasters = {1: page_of_text(rng), 2: page_of_text(rng, 20), 3: page_of_text(rng, 3), 4: page_of_text(rng, 22), 5: np.full((50, 40), 255, np.uint8)}
    rows = [(k, v.shape[1], v.shape[0], v.tobytes(), [True, False, False, False]) for k, v in rasters.items()]
    table = spark.createDataFrame(rows, "slot int, w int, h int, px binary, cut array<boolean>").repartition(3)
    counted = spark.sparkContext.accumulator(0)
    pieces, kept = slots.kept_ink(table, counted.add)
    sigma = {r["slot"]: r["sigma"] for r in pieces.select("slot", "sigma").distinct().collect()}
    assert sigma == {1: 30.0, 2: 1000.0, 3: 30.0, 4: 1000.0}
    found = {}
    for r in kept.join(pieces, ["slot", "id"]).collect():
        found.setdefault(r["slot"], []).append((r["x0"], r["y0"], r["x1"], r["y1"]))
    text = sorted((x, y, x + 8, y + 12) for y in range(100, 500, 24) for x in range(80, 320, 14))
    assert sorted(found[1]) == sorted(found[3]) == text and set(text) < set(found[2])
    assert counted.value == 5 + 2


def picture(rng, scale):
    """A page with a coloured picture at 20..60 points, a drawing of thin lines at 80..120, both scaled."""
    k = lambda v: int(round(v * scale))
    rgb = np.full((k(200), k(200), 3), 255, np.uint8)
    rgb[k(20) : k(60), k(20) : k(60)] = (200, 40, 30)
    for x in range(k(80), k(120), 6):
        rgb[k(80) : k(120), x] = 0
    return rgb


def test_figures_at_two_resolutions(spark):
    rng = np.random.default_rng(2)
    coarse, fine = (picture(rng, s) for s in (100 / 72, 150 / 72))
    raster = lambda v: [("d", 0, v.shape[1], v.shape[0], v.tobytes())]
    kinds = "doc string, page int, w int, h int, px binary"
    boxes = [("d", 0, 1, 25.0, 25.0, 55.0, 60.0), ("d", 0, 2, 80.0, 80.0, 120.0, 120.0), ("d", 0, 3, 300.0, 300.0, 310.0, 310.0)]
    found = slots.page_figures(spark.createDataFrame(raster(coarse), kinds), spark.createDataFrame(raster(fine), kinds), spark.createDataFrame(boxes, "doc string, page int, n int, x0 double, y0 double, x1 double, y1 double"))
    by = {r["n"]: r for r in found.collect()}
    assert set(by) == {1, 2} and by[2]["dropped"] and by[2]["content"] is None
    r = by[1]
    assert r["grown"] and not r["dropped"] and abs(r["x0"] - 20) < 4 and abs(r["x1"] - 60) < 4 and 60 <= r["y1"] < 64
    content = bytes(r["content"])
    rows = zlib.decompress(content[content.index(b"IDAT") + 4 : content.index(b"IEND") - 8])
    cut = np.frombuffer(rows, np.uint8).reshape(r["h"], 1 + 3 * r["w"])[:, 1:].reshape(r["h"], r["w"], 3)
    x0, y0 = round(r["x0"] * 150 / 72), round(r["y0"] * 150 / 72)
    assert (cut == fine[y0 : y0 + r["h"], x0 : x0 + r["w"]]).all()
    assert [(f["n"], f["fig"]) for f in slots.drawn_in_order(found).collect()] == [(1, 1)]


def test_rasters_of_vectors_are_not_dealt(spark):
    """A raster is drawn in its page's row and goes through no join or shuffle, where a task would sort many of them."""
    from quirespark.plans import scoring

    plan = scoring.figures_two_scales(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
