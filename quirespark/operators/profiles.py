"""Runs, gaps and valleys of density profiles: one row per (key, i, d), n values of a key, i from 0."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .folds import fold_groups


def quantised(x: F.Column) -> F.Column:
    """A share as its nearest multiple of 1/255."""
    return F.round(x * 255) / 255


def density_runs(profile: DataFrame, lo: float, hi: float, gap: float, least: float) -> DataFrame:
    """key, start, stop (exclusive): places with lo <= d <= hi, merged over gaps of at most `gap`, at least `least` long."""
    w = Window.partitionBy("key").orderBy("i")
    inside = profile.where(F.col("d").between(lo, hi))
    new = F.coalesce(F.col("i") - F.lag("i").over(w) - 1 > gap, F.lit(True))
    runs = inside.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(w)).groupBy("key", "run").agg(F.min("i").alias("start"), (F.max("i") + 1).alias("stop"))
    return runs.where(F.col("stop") - F.col("start") >= least).select("key", "start", "stop")


def without_bands(runs: DataFrame, n: int, outer: float = 0.1) -> DataFrame:
    """Without a first or last run that lies wholly in the outer tenth, where there are two runs or more."""
    w = Window.partitionBy("key")
    band = (F.col("start") == F.min("start").over(w)) & (F.col("stop") <= outer * n) | (F.col("stop") == F.max("stop").over(w)) & (F.col("start") >= (1 - outer) * n)
    return runs.withColumn("band", band & (F.count("*").over(w) > 1)).where("not band").drop("band")


def near_extension(profile: DataFrame, runs: DataFrame, n: int, reach: float = 0.08, lo: float = 0.004, hi: float = 0.55, pad: float = 0.012) -> DataFrame:
    """key, lo, hi: the runs' extent, out to the farthest place within reach that is inked at all, and padded."""
    extent = runs.groupBy("key").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    near = profile.join(extent, "key").where(F.col("d").between(lo, hi))
    first = F.min(F.when((F.col("i") < F.col("start")) & (F.col("i") >= F.col("start") - reach * n), F.col("i")))
    last = F.max(F.when((F.col("i") >= F.col("stop")) & (F.col("i") < F.col("stop") + reach * n), F.col("i") + 1))
    found = near.groupBy("key").agg(first.alias("first"), last.alias("last"))
    out = extent.join(found, "key", "left").withColumn("a", F.coalesce("first", "start")).withColumn("b", F.coalesce("last", "stop"))
    return out.select("key", F.greatest(F.lit(0), F.col("a") - F.lit(pad * n).cast("int")).cast("int").alias("lo"), F.least(F.lit(n), F.col("b") + F.lit(pad * n).cast("int")).cast("int").alias("hi"))


def widest_gap(profile: DataFrame, ink: float, lo: float, hi: float, n: int) -> DataFrame:
    """key, start, len: the longest run of places below `ink` whose middle lies in lo..hi of n; of equals the first."""
    gaps = density_runs(profile, float("-inf"), ink, 0, 1)
    inside = gaps.where((F.col("start") + F.col("stop")).between(2 * lo * n, 2 * hi * n))
    return inside.groupBy("key").agg(F.max(F.struct((F.col("stop") - F.col("start")).alias("len"), (-F.col("start")).alias("minus"))).alias("g")).select("key", (-F.col("g.minus")).alias("start"), F.col("g.len").alias("len"))


def valley(profile: DataFrame, n: int, radius: int, lo: float = 0.2, hi: float = 0.8, near: float = 0.03, far: float = 0.15) -> DataFrame:
    """key, i, depth: the least moving mean in the window (of equals the first), if it is at most half of both sides' means."""
    w = Window.partitionBy("key").orderBy("i").rowsBetween(-radius, radius)
    smooth = profile.withColumn("m", F.round(F.avg("d").over(w), 9))
    least = smooth.where(F.col("i").between(lo * n, hi * n)).groupBy("key").agg(F.min(F.struct("m", "i")).alias("v")).select("key", F.col("v.m").alias("depth"), F.col("v.i").alias("at"))
    step = F.col("i") - F.col("at")
    sides = smooth.join(least, "key").groupBy("key", "depth", "at").agg(F.avg(F.when(step.between(-far * n, -near * n), F.col("m"))).alias("left"), F.avg(F.when(step.between(near * n, far * n), F.col("m"))).alias("right"))
    return sides.where("depth <= left / 2 and depth <= right / 2").select("key", F.col("at").alias("i"), "depth")


def sharpness(profile: DataFrame) -> DataFrame:
    """key, sharpness: squared steps over squared values."""
    w = Window.partitionBy("key").orderBy("i")
    step = F.col("d") - F.lag("d").over(w)
    return profile.withColumn("step", step).groupBy("key").agg((F.sum(F.col("step") * F.col("step")) / F.greatest(F.sum(F.col("d") * F.col("d")), F.lit(1e-12))).alias("sharpness"))


def plateau_middle(profile: DataFrame) -> DataFrame:
    """key, middle: between the first and the last place that has the largest value."""
    return profile.withColumn("most", F.max("d").over(Window.partitionBy("key"))).where("d = most").groupBy("key").agg(((F.min("i") + F.max("i")) / 2).alias("middle"))


def tile_signals(tiles: DataFrame) -> DataFrame:
    """key and the mean, deviation, midtone share, 64-bin entropy (bits) and dark share of each tile's values d (0 to 1)."""
    bins = tiles.groupBy("key", F.least(F.floor(F.col("d") * 64), F.lit(63)).alias("bin")).agg(
        F.count("*").alias("c"), F.sum("d").alias("s"), F.sum(F.col("d") * F.col("d")).alias("q"), F.count_if(F.col("d").between(0.2, 0.8)).alias("mid"), F.count_if(F.col("d") <= 0.6).alias("dark")
    )
    n = F.sum("c")
    whole = bins.groupBy("key").agg(n.alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("mid").alias("mid"), F.sum("dark").alias("dark"), F.sum(F.col("c") * F.log2("c")).alias("e"))
    mean = F.col("s") / F.col("n")
    return whole.select(
        "key", F.round(mean, 6).alias("lum_mean"), F.round(F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))), 6).alias("lum_std"),
        F.round(F.col("mid") / F.col("n"), 6).alias("midtone"), F.round(F.log2("n") - F.col("e") / F.col("n"), 6).alias("entropy"), F.round(F.col("dark") / F.col("n"), 6).alias("ink"),
    )


def grid_components(cells: DataFrame) -> DataFrame:
    """key, x, y, root: components of the flagged cells of each page's grid (8 neighbours), named by their least y * 1000 + x."""

    def fold(rows: list[tuple]) -> list[tuple]:
        root: dict[tuple, int] = {}
        cells = {(x, y) for y, x in rows}
        for y, x in rows:  # the least of a component comes first
            if (x, y) in root:
                continue
            root[x, y], todo = y * 1000 + x, [(x, y)]
            while todo:
                cx, cy = todo.pop()
                for near in ((cx + i, cy + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                    if near in cells and near not in root:
                        root[near] = y * 1000 + x
                        todo.append(near)
        return [(x, y, r) for (x, y), r in root.items()]

    return fold_groups(cells.select("key", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x")).distinct(), ["key"], ["y", "x"], fold, "x int, y int, root int")


def component_boxes(grouped: DataFrame, pages: DataFrame, tile: int) -> DataFrame:
    """key, root, x0, y0, x1, y1: the box around each component of tiles and half a tile more, clipped to its page (key, w, h)."""
    half = tile // 2
    boxes = grouped.groupBy("key", "root").agg(*[f(c).alias(n) for f, c, n in ((F.min, "x", "ax"), (F.min, "y", "ay"), (F.max, "x", "bx"), (F.max, "y", "by"))])
    edge = lambda c, n: F.least(F.col(c), (F.col(n) + 1) * tile + half)
    return boxes.join(pages, "key").select("key", "root", F.greatest(F.lit(0), F.col("ax") * tile - half).alias("x0"), F.greatest(F.lit(0), F.col("ay") * tile - half).alias("y0"), edge("w", "bx").alias("x1"), edge("h", "by").alias("y1"))


def local_minima(profile: DataFrame, least: int = 3) -> DataFrame:
    """key, i: where a profile (key, i, d), smoothed over three, is cut into lines: at its first place, at local minima at least
    `least` after the cut before, and at its last place."""
    w = Window.partitionBy("key").orderBy("i")
    smooth = profile.select("key", "i", F.round(F.sum("d").over(w.rowsBetween(-1, 1)) / 3, 9).alias("m"))
    low = (F.col("m") <= F.lag("m").over(w)) & (F.col("m") < F.lead("m").over(w))
    ends = F.lag("m").over(w).isNull() | F.lead("m").over(w).isNull()
    places = smooth.withColumn("low", F.coalesce(low, F.lit(False))).withColumn("end", ends).where("low or end").select("key", "i", "end")

    def fold(rows: list[tuple]) -> list[tuple]:
        out = [rows[0][0]]
        for i, end in rows[1:]:
            if end or i - out[-1] >= least:
                out.append(i)
        return [(i,) for i in out]

    return fold_groups(places, ["key"], ["i"], fold, "i int")


def usable_tiles(profiles: DataFrame, darkest: float = 0.4) -> DataFrame:
    """Tiles (key, rows, cols: arrays of mean darkness) of which no row and no column is darker than a line of text gets."""
    return profiles.where(~F.exists("rows", lambda v: v > darkest) & ~F.exists("cols", lambda v: v > darkest))
