"""Slots of pages: the ink that stays, with a second pass for covers, and figures cut at two resolutions.

Rasters meet their boxes by equi-joins with one row a page or slot; none is collected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import small_batches, written
from ..sources.writers import png
from .boxes import kept_pieces, letter_heights, live
from .colour import grow_box, is_line_art
from .raster import FLATTEN_SIGMA, clear_edge_bands, content_box, flatten, labelled, threshold

#: A cover is flattened against light falling off only, for fills wider than the usual blur would turn white.
COVER_SIGMA = 1000.0
#: How near a cut side a piece of ink touches it.
AT_CUT = 2

_PIECE = "struct<id:int,x0:int,y0:int,x1:int,y1:int,area:int,edge:boolean>"


def slot_pieces(slots: DataFrame, sigma: float, seen: Callable[[int], None] | None = None) -> DataFrame:
    """slot, w, h, ax0, ay0, ax1, ay1 (the text block), pieces, sigma of each slot's raster, flattened by a blur of sigma. slots: slot, w, h, px (grey), cut
    (array of four: left, top, right, bottom). seen, for tests, is called with 1 for every raster that is read."""
    kind = dict(slots.dtypes)["slot"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                if seen:
                    seen(1)
                ink = clear_edge_bands(threshold(flatten(np.frombuffer(r.px, np.uint8).reshape(r.h, r.w) / 255.0, sigma)))
                box = content_box(ink) or (0, 0, r.w, r.h)
                found = labelled(ink)[0]
                at = (found[:, 0] < AT_CUT) & r.cut[0] | (found[:, 1] < AT_CUT) & r.cut[1] | (found[:, 2] > r.w - AT_CUT) & r.cut[2] | (found[:, 3] > r.h - AT_CUT) & r.cut[3]
                pieces = [dict(zip(("id", "x0", "y0", "x1", "y1", "area", "edge"), (k, *map(int, f), bool(e)), strict=True)) for k, (f, e) in enumerate(zip(found, at, strict=True))]
                rows.append((r.slot, r.w, r.h, *map(int, box), pieces, sigma))
            if rows:
                yield pd.DataFrame(rows, columns=["slot", "w", "h", "ax0", "ay0", "ax1", "ay1", "pieces", "sigma"])

    return slots.select("slot", "w", "h", "px", "cut").mapInPandas(run, f"slot {kind}, w int, h int, ax0 int, ay0 int, ax1 int, ay1 int, pieces array<{_PIECE}>, sigma double")


def _lively(found: DataFrame) -> DataFrame:
    """live() rows of slot_pieces(), with sigma."""
    pieces = found.select("slot", "sigma", F.inline("pieces"))
    block = found.drop("pieces", "sigma")
    return live(pieces, block.join(letter_heights(pieces, block), "slot"))


def kept_ink(slots: DataFrame, seen: Callable[[int], None] | None = None) -> tuple[DataFrame, DataFrame]:
    """The pieces of each slot as live() gives them, with sigma, and those (slot, id) that stay.

    Slots whose cut sides hold many big pieces are covers: they alone are read again and flattened anew, and what is found then takes
    their place. Both passes are written once, so that no raster is read oftener.
    """
    first = written(slot_pieces(slots, FLATTEN_SIGMA, seen))
    before = _lively(first)
    covers = written(before.where("cover").select("slot").distinct())
    second = written(slot_pieces(slots.join(covers, "slot", "left_semi"), COVER_SIGMA, seen))
    after = first.join(covers, "slot", "left_anti").unionByName(second)
    pieces = _lively(after)
    return pieces, kept_pieces(pieces)


def page_figures(pages: DataFrame, finer: DataFrame, boxes: DataFrame, scale: float = 100 / 72, finer_scale: float = 150 / 72, step: float = 3.0) -> DataFrame:
    """doc, page, n, dropped, grown, x0, y0, x1, y1 (points), w, h, content (PNG) of the figures of pages.

    A box (doc, page, n, x0, y0, x1, y1 in points) grows to its picture's edge on the coarser raster; line art without colour is dropped; the
    rest is cut from the finer raster of the same page, where a side that did not grow keeps its own place. Rasters: doc, page, w, h, px
    (RGB, row by row); the boxes of a page come as one array.
    """
    own = boxes.groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.struct("n", "x0", "y0", "x1", "y1"))).alias("boxes"))  # of one page
    other = finer.select("doc", "page", F.col("w").alias("fw"), F.col("h").alias("fh"), F.col("px").alias("fpx"))
    joined = own.join(pages.select("doc", "page", "w", "h", "px"), ["doc", "page"]).join(other, ["doc", "page"])
    return figures_of(joined, scale, finer_scale, step)


def figures_of(pages: DataFrame, scale: float = 100 / 72, finer_scale: float = 150 / 72, step: float = 3.0) -> DataFrame:
    """page_figures() of pages whose row holds all: doc, page, boxes (array of n, x0, y0, x1, y1), and the rasters w, h, px and fw, fh, fpx.
    Nothing is dealt, so no task holds more than a batch of pages."""
    small_batches(pages.sparkSession)
    kind = dict(pages.dtypes)

    def pixels(box: list[float], k: float, w: int, h: int) -> list[int]:
        """Outwards to whole pixels, inside the raster."""
        low, high = np.floor(np.array(box[:2]) * k), np.ceil(np.array(box[2:]) * k)
        return [int(v) for v in np.clip(np.r_[low, high], 0, [w, h, w, h])]

    def figure(box: dict, coarse: np.ndarray, fine: np.ndarray) -> tuple | None:
        given = [box[c] for c in ("x0", "y0", "x1", "y1")]
        at = pixels(given, scale, coarse.shape[1], coarse.shape[0])
        if at[2] <= at[0] or at[3] <= at[1]:
            return None
        grown = grow_box(coarse, tuple(at), int(np.ceil(step * scale)))
        if is_line_art(coarse[grown[1] : grown[3], grown[0] : grown[2]]):
            return (box["n"], True, grown != tuple(at), *[None] * 4, None, None, None)
        edges = [g / scale if g != a else b for g, a, b in zip(grown, at, given, strict=True)]
        x0, y0, x1, y1 = pixels(edges, finer_scale, fine.shape[1], fine.shape[0])
        if x1 <= x0 or y1 <= y0:
            return None
        cut = png(x1 - x0, y1 - y0, np.ascontiguousarray(fine[y0:y1, x0:x1]).tobytes())
        return (box["n"], False, grown != tuple(at), *(v / finer_scale for v in (x0, y0, x1, y1)), x1 - x0, y1 - y0, cut)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["doc", "page", "n", "dropped", "grown", "x0", "y0", "x1", "y1", "w", "h", "content"]
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                coarse, fine = (np.frombuffer(px, np.uint8).reshape(h, w, 3) for px, w, h in ((r.px, r.w, r.h), (r.fpx, r.fw, r.fh)))
                rows += [(r.doc, r.page, *f) for b in r.boxes if (f := figure(b, coarse, fine))]
            if rows:
                frame = pd.DataFrame(rows, columns=names)
                yield frame.astype({"w": "Int64", "h": "Int64"})

    return pages.select("doc", "page", "w", "h", "px", "fw", "fh", "fpx", "boxes").mapInPandas(run, f"doc {kind['doc']}, page {kind['page']}, n int, dropped boolean, grown boolean, x0 double, y0 double, x1 double, y1 double, w int, h int, content binary")


def drawn_in_order(figures: DataFrame) -> DataFrame:
    """figures with fig (from 1 in each page): by top, then left; the order that their names and places in the text go by."""
    from pyspark.sql import Window

    return figures.where("not dropped").withColumn("fig", F.row_number().over(Window.partitionBy("doc", "page").orderBy("y0", "x0", "n")))
