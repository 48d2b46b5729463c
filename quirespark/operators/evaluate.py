"""Scoring of detectors: areas under curves, cuts, leave-one-file-out, policies, region coverage, differences of facts.

A scored table has file, label (boolean) and v.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import composed


def _counts(scored: DataFrame, by: list[str]) -> DataFrame:
    """Positives and negatives of each value: all that follows works on distinct values."""
    return scored.groupBy(*by, "v").agg(F.count_if("label").alias("p"), F.count_if(~F.col("label")).alias("n"))


def auc(scored: DataFrame, by: list[str]) -> DataFrame:
    """by, pos, neg, auc: Mann-Whitney with average ranks for ties; the better of both directions."""
    key = by or ["all"]
    counts = _counts(scored if by else scored.withColumn("all", F.lit(1)), key)
    before = Window.partitionBy(*key).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("below", F.coalesce(F.sum(F.col("p") + F.col("n")).over(before), F.lit(0)))
    ranks = F.sum(F.col("p") * (F.col("below") + (F.col("p") + F.col("n") + 1) / 2))
    sums = ranked.groupBy(*key).agg(F.sum("p").alias("pos"), F.sum("n").alias("neg"), ranks.alias("ranks")).where("pos > 0 and neg > 0")
    u = (F.col("ranks") - F.col("pos") * (F.col("pos") + 1) / 2) / (F.col("pos") * F.col("neg"))
    return sums.select(*by, "pos", "neg", F.round(F.greatest(u, 1 - u), 6).alias("auc"))


def best_cut(scored: DataFrame, by: list[str]) -> DataFrame:
    """by, cut, balanced: the distinct value c (of equals the least) with the best balanced accuracy of v > c, or of its reverse."""
    counts = _counts(scored, by)
    upto = Window.partitionBy(*by).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*by)
    rates = counts.withColumn("tpr", 1 - F.try_divide(F.sum("p").over(upto), F.sum("p").over(every))).withColumn("tnr", F.try_divide(F.sum("n").over(upto), F.sum("n").over(every))).where("tpr is not null and tnr is not null")
    both = (F.col("tpr") + F.col("tnr")) / 2
    scoredcut = rates.withColumn("b", F.round(F.greatest(both, 1 - both), 9))
    return scoredcut.groupBy(*by).agg(F.max(F.struct("b", (-F.col("v")).alias("minus"))).alias("x")).select(*by, (-F.col("x.minus")).alias("cut"), F.round("x.b", 6).alias("balanced"))


def recall_cut(scored: DataFrame, by: list[str], recall: float) -> DataFrame:
    """by, cut: the largest value that at least `recall` of the positives reach."""
    w = Window.partitionBy(*by)
    placed = scored.where("label").withColumn("n", F.count("*").over(w)).withColumn("k", F.row_number().over(w.orderBy("v")) - 1)
    return placed.where(F.col("k") == F.least(F.col("n") - 1, ((1 - recall) * F.col("n")).cast("long"))).select(*by, F.col("v").alias("cut"))


def leave_one_out(scored: DataFrame) -> DataFrame:
    """file, cut, caught, positives, flagged, negatives: the cut that keeps all positives of the other files, on this one.

    The least of the others is the least of all, or the next where this file has it: no file meets another's rows.
    """
    least = scored.where("label").groupBy("file").agg(F.min("v").alias("least"))
    two = least.agg(F.slice(F.array_sort(F.collect_list(F.struct("least", "file"))), 1, 2).alias("two"))  # one row a file
    cuts = scored.select("file").distinct().withColumn("one", F.lit(1)).join(F.broadcast(two.withColumn("one", F.lit(1))), "one").select("file", F.when(F.get("two", F.lit(0))["file"] == F.col("file"), F.get("two", F.lit(1))["least"]).otherwise(F.get("two", F.lit(0))["least"]).alias("cut"))
    hit = F.col("v") >= F.col("cut")
    return scored.join(cuts.where("cut is not null"), "file").groupBy("file", "cut").agg(F.count_if(hit & F.col("label")).alias("caught"), F.count_if("label").alias("positives"), F.count_if(hit & ~F.col("label")).alias("flagged"), F.count_if(~F.col("label")).alias("negatives"))


def policy_prices(scored: DataFrame, cuts: list[tuple[str, float]], size: str) -> DataFrame:
    """policy, file (null: all files), kept, lost, bytes: what each cut keeps, what it loses, and what it costs."""
    rules = F.array(*[F.struct(F.lit(name).alias("policy"), F.lit(cut).alias("cut")) for name, cut in cuts])
    each = scored.select("file", "label", "v", F.col(size).alias("size"), F.explode(rules).alias("rule"))
    keep = F.col("v") >= F.col("rule.cut")
    priced = each.select(F.col("rule.policy").alias("policy"), "file", "label", keep.alias("keep"), "size")
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    sums = priced.groupBy("policy", "file").agg(one(F.col("label") & F.col("keep")).alias("kept"), one(F.col("label") & ~F.col("keep")).alias("lost"), F.sum(F.when(F.col("keep"), F.col("size")).otherwise(F.col("size").cast("long") / 10).cast("long")).alias("bytes"))
    total = sums.groupBy("policy").agg(*[F.sum(c).alias(c) for c in ("kept", "lost", "bytes")]).withColumn("file", F.lit(None).cast("string"))
    return sums.unionByName(total)


def region_labels(tiles: DataFrame, regions: DataFrame, share: float = 0.75) -> DataFrame:
    """Tiles (page, tile, x0, y0, x1, y1) with class: that of the last region of the page (no) that covers `share` of the
    tile, `rest` if none touches it, null if one does but not enough."""
    region = regions.select("page", F.col("class"), "no", *[F.col(c).alias(f"r_{c}") for c in ("x0", "y0", "x1", "y1")])
    overlap = (F.least("x1", "r_x1") - F.greatest("x0", "r_x0")) * (F.least("y1", "r_y1") - F.greatest("y0", "r_y0"))
    touch = "r_x0 < x1 and r_x1 > x0 and r_y0 < y1 and r_y1 > y0"
    met = tiles.join(region, "page").where(touch).withColumn("covers", overlap >= share * (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    found = met.groupBy("page", "tile").agg(F.max_by(F.when(F.col("covers"), F.col("class")), F.when(F.col("covers"), F.col("no"))).alias("class"), F.lit(True).alias("met"))
    return tiles.join(found, ["page", "tile"], "left").select(*tiles.columns, F.when(F.col("met").isNull(), "rest").otherwise(F.col("class")).alias("class"))


def coverage(regions: DataFrame, boxes: DataFrame, step: int = 10) -> DataFrame:
    """page, no, covered: the share of a region's grid points (every `step`) that lie in a box of its page.

    No point is a row: at each x of a region's grid, the boxes over it are intervals of the numbers of its points from top to
    bottom, and their union is counted.
    """
    own = boxes.where("x0 < x1 and y0 < y1").groupBy("page").agg(F.collect_list(F.struct(*[F.col(c).alias(f"b{c}") for c in ("x0", "y0", "x1", "y1")])).alias("boxes"))  # of one page
    number = lambda c, start: F.ceil((c - start) / step).cast("long")  # noqa: E731  of grid points before c
    sized = regions.select("page", "no", "x0", "y0", number(F.col("x1"), F.col("x0")).alias("nx"), number(F.col("y1"), F.col("y0")).alias("ny")).where("nx > 0 and ny > 0").join(own, "page", "left")
    spans = F.transform("boxes", lambda b: F.struct(
        F.greatest(number(b["by0"], F.col("y0")), F.lit(0)).alias("a"), F.least(number(b["by1"], F.col("y0")), F.col("ny")).alias("b"),
        F.greatest(number(b["bx0"], F.col("x0")), F.lit(0)).alias("i"), F.least(number(b["bx1"], F.col("x0")), F.col("nx")).alias("j"),
    ))
    spanned = sized.select("page", "no", "nx", "ny", F.array_sort(F.filter(spans, lambda s: (s["a"] < s["b"]) & (s["i"] < s["j"]))).alias("spans"))

    def points(i: Column) -> Column:
        """How many points of the i-th column are covered: its spans are in order of their beginnings."""
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
        union = lambda t, s: F.struct((t["n"] + F.greatest(s["b"] - F.greatest(s["a"], t["end"]), F.lit(0))).alias("n"), F.greatest(s["b"], t["end"]).alias("end"))
        return F.aggregate(F.filter("spans", lambda s: (s["i"] <= i) & (i < s["j"])), start, union, lambda t: t["n"])

    # Columns between the same edges of boxes have the same points.
    edges = F.array_sort(F.array_distinct(F.concat(F.transform("spans", lambda s: s["i"]), F.transform("spans", lambda s: s["j"]))))
    cut = spanned.withColumn("edges", edges)
    hit = F.aggregate(F.transform("edges", lambda e, k: F.when(k + 1 < F.size("edges"), (F.get("edges", k + 1) - e) * points(e)).otherwise(0)), F.lit(0).cast("long"), lambda t, x: t + x)
    each = cut.select("page", "no", (F.col("nx") * F.col("ny")).alias("n"), F.coalesce(hit, F.lit(0)).alias("hit"))
    return each.groupBy("page", "no").agg(F.round(F.sum("hit") / F.sum("n"), 6).alias("covered"))


def multiset_overlap(left: DataFrame, right: DataFrame, by: list[str], item: str) -> DataFrame:
    """by, common: the sum over items of the lesser of both counts."""
    a = left.groupBy(*by, item).agg(F.count("*").alias("a"))
    b = right.groupBy(item).agg(F.count("*").alias("b"))
    return a.join(b, item).groupBy(*by).agg(F.sum(F.least("a", "b")).alias("common"))


def facts_difference(expected: DataFrame, measured: DataFrame, key: str, columns: list[str], tolerance: float) -> DataFrame:
    """Rows of a key that one side lacks or that differ by more than the tolerance: key, column, expected, measured."""
    other = measured.select(key, *[F.col(c).alias(f"m_{c}") for c in columns])
    both = expected.join(other, key, "full_outer")
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("expected"), F.col(f"m_{c}").cast("double").alias("measured")) for c in columns])
    each = both.select(key, F.inline(pairs))
    return each.where((F.abs(F.col("expected") - F.col("measured")) > tolerance) | (F.col("expected").isNull() != F.col("measured").isNull()))


def margins(facts: DataFrame) -> DataFrame:
    """doc, widest difference of left and right margins, and how much corners stray."""
    left, right = F.col("x0"), F.col("w") - F.col("x1")
    return facts.groupBy("doc").agg(F.max(F.abs(left - right)).alias("uneven"), F.round(F.stddev_pop("x0"), 6).alias("x_stray"), F.round(F.stddev_pop("y0"), 6).alias("y_stray"), F.count_distinct(F.struct("w", "h")).alias("sizes"))


def figure_anchors(figures: DataFrame, lines: DataFrame) -> DataFrame:
    """Each figure (doc, fig, x0, x1, top) with the first line (doc, line, x0, x1, base) below its top that it overlaps in x."""
    below = lines.select("doc", "line", F.col("x0").alias("l_x0"), F.col("x1").alias("l_x1"), "base")
    met = figures.join(below, "doc").where("base > top and l_x0 < x1 and l_x1 > x0")
    found = met.groupBy("doc", "fig").agg(F.min(F.struct("base", "line"))["line"].alias("line"))
    return figures.join(found, ["doc", "fig"], "left")


def counts_by_label(labelled: DataFrame) -> DataFrame:
    """scope, label, n."""
    return labelled.groupBy("scope", "label").agg(F.count("*").alias("n"))


def figure_totals(figures: DataFrame) -> DataFrame:
    """One row: how many figures, their bytes, how many have grown and how many were dropped."""
    return figures.agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.count_if("grown").alias("grown"), F.count_if("dropped").alias("dropped"))


def file_names(files: DataFrame) -> DataFrame:
    """file, name: f1, f2, ... in alphabetical order; one row a file."""
    each = files.distinct()
    return each.select("file", F.concat(F.lit("f"), F.dense_rank().over(Window.orderBy("file")).cast("string")).alias("name"))  # one row a file


def last_by_label(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of the rows of each key the last."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def joined_pages(pages: DataFrame) -> DataFrame:
    """pages (file, page from 1) with place: the page's number when files follow each other in order."""
    sizes = pages.groupBy("file").agg(F.max("page").alias("n"))
    before = sizes.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # one row a file
    return pages.join(before, "file").withColumn("place", F.col("before") + F.col("page")).drop("before")


def colour_lists(pages: DataFrame) -> DataFrame:
    """doc, pages: `12` for a whole page, `12a` or `12b` for a half of one that is split, joined by commas; `none` without any. pages: doc,
    page, a, b (whether the left and the right slot are in colour), split."""
    a, b = F.coalesce("a", F.lit(False)), F.coalesce("b", F.lit(False))
    name = F.concat(F.col("page").cast("string"), F.when(a & b, "").when(a & ~F.col("split"), "").when(a, "a").otherwise("b"))
    listed = F.array_sort(F.collect_list(F.when(a | b, F.struct("page", name.alias("name")))))  # of one document
    return pages.groupBy("doc").agg(F.coalesce(F.nullif(F.array_join(F.transform(listed, lambda p: p["name"]), ","), F.lit("")), F.lit("none")).alias("pages"))


def class_matrix(scored: DataFrame, by: list[str]) -> DataFrame:
    """by, positive, negative, auc of each ordered pair of classes (label: the class, v), the better of both directions.

    Each class is counted by distinct values once; a pair meets on those counts, not on rows.
    """
    counts = scored.groupBy(*by, "label", "v").agg(F.count("*").alias("n"))
    values = counts.select(*by, "v").distinct()
    classes = counts.select(*by, F.col("label").alias("c")).distinct()
    pairs = classes.join(classes.withColumnRenamed("c", "d"), by).where("c < d")  # a few classes of one file
    side = lambda name, n: counts.select(*by, F.col("label").alias(name), "v", F.col("n").alias(n))
    met = values.join(pairs, by).join(side("c", "p"), [*by, "c", "v"], "left").join(side("d", "m"), [*by, "d", "v"], "left").fillna(0, ["p", "m"])
    key = [*by, "c", "d"]
    before = Window.partitionBy(*key).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = met.withColumn("below", F.coalesce(F.sum("m").over(before), F.lit(0)))
    sums = ranked.groupBy(*key).agg(F.sum("p").alias("pos"), F.sum("m").alias("neg"), F.sum(F.col("p") * (F.col("below") + F.col("m") / 2)).alias("u"))
    u = F.col("u") / (F.col("pos") * F.col("neg"))
    return sums.select(*by, F.col("c").alias("positive"), F.col("d").alias("negative"), F.round(F.greatest(u, 1 - u), 6).alias("auc"))


def markers_in_place(a: DataFrame, b: DataFrame, last: int = 10) -> DataFrame:
    """doc, label, in_place: for markers of the same label in two notes (doc, label, w: the words before), whether the last words are the same."""
    other = b.select("doc", "label", F.slice("w", -F.least(F.lit(last), F.size("w")), last).alias("o"))
    end = F.slice("w", -F.least(F.lit(last), F.size("w")), last)
    return a.where(F.size("w") > 0).select("doc", "label", end.alias("e")).join(other, ["doc", "label"]).select("doc", "label", (F.col("e") == F.col("o")).alias("in_place"))


def composed_files(rows: DataFrame) -> DataFrame:
    """rows with their file's name in composed form; the names, not the rows, are composed."""
    names = rows.select("file").distinct().withColumn("name", composed(F.col("file")))
    return rows.join(names, "file").drop("file").withColumnRenamed("name", "file")


def with_labels(signals: DataFrame, labels: DataFrame) -> DataFrame:
    """signals (file, page, ...) with the labels (file, page, ...) of their page, however either writes the file's name."""
    return composed_files(signals).join(composed_files(labels), ["file", "page"])
