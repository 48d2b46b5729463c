"""Which output pages become colour pages: decisions, their price, and what becomes of the regions of each page.

Slots are output pages: file, out, page, x0, y0, x1, y1 (their part of the input page), text_bytes, image_bytes. Regions: file,
page, no, class, x0, y0, x1, y1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The classes of regions that are to be kept.
KEEP = ["picture", "diagram", "coloured-text", "cover"]
#: Classes that a 1-bit page loses; others it only degrades.
LOST = ["picture", "cover"]


def meeting(slots: DataFrame, boxes: DataFrame) -> DataFrame:
    """The slots that a box of their page overlaps."""
    box = boxes.select("file", "page", *[F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")])
    over = (slots["file"] == box["file"]) & (slots["page"] == box["page"]) & (F.least(slots["x1"], box["b_x1"]) > F.greatest(slots["x0"], box["b_x0"])) & (F.least(slots["y1"], box["b_y1"]) > F.greatest(slots["y0"], box["b_y0"]))
    return slots.join(box, over, "left_semi")


def kept_classes(regions: DataFrame) -> DataFrame:
    """file, page, classes: those of a page's classes that are to be kept, for pages that have any."""
    sets = regions.groupBy("file", "page").agg(F.collect_set("class").alias("all"))  # of one page
    return sets.select("file", "page", F.array_sort(F.array_intersect("all", F.array(*[F.lit(c) for c in KEEP]))).alias("classes")).where(F.size("classes") > 0)


def page_classes(labelled: DataFrame, regions: DataFrame) -> DataFrame:
    """file, page, keep (the page has a class that is to be kept), whole (it does, and no region says where). labelled: file, page, classes."""
    keep = F.arrays_overlap(F.col("classes"), F.array(*[F.lit(c) for c in KEEP]))
    boxed = regions.where(F.col("class").isin(KEEP)).select("file", "page").distinct().withColumn("boxed", F.lit(True))
    kept = labelled.select("file", "page", F.coalesce(keep, F.lit(False)).alias("keep")).groupBy("file", "page").agg(F.bool_or("keep").alias("keep"))
    return kept.join(boxed, ["file", "page"], "left").select("file", "page", "keep", (F.col("keep") & F.col("boxed").isNull()).alias("whole"))


def with_facts(slots: DataFrame, pages: DataFrame, labelled: DataFrame, regions: DataFrame, safe: DataFrame, balanced: DataFrame) -> DataFrame:
    """slots with what the rules ask: hasler (does the page reach the least value of the other files' keep pages), share (of the file's
    pages that do), rgb, first, labelled (a region to be kept meets the slot, or its page is to be kept and has no such region), keep_page (its page has
    a class that is to be kept), safe and balanced (a found box meets it). labelled: file, page, classes."""
    classes = page_classes(labelled, regions)
    least = pages.join(classes.where("keep"), ["file", "page"]).groupBy("file").agg(F.min("hasler").alias("least"))
    # The least of the other files: of all, or the next where this file has it. Two rows are enough.
    two = least.agg(F.slice(F.array_sort(F.collect_list(F.struct("least", "file"))), 1, 2).alias("two"))  # one row a file
    cut = F.when(F.get("two", F.lit(0))["file"] == F.col("file"), F.get("two", F.lit(1))["least"]).otherwise(F.get("two", F.lit(0))["least"])
    files = pages.select("file").distinct().withColumn("one", F.lit(1)).join(F.broadcast(two.withColumn("one", F.lit(1))), "one").select("file", cut.alias("cut"))
    scored = pages.join(files, "file").withColumn("reaches", F.coalesce(F.col("hasler") >= F.col("cut"), F.lit(False)))
    shares = scored.groupBy("file").agg(F.avg(F.col("reaches").cast("double")).alias("share"))
    out = slots.join(scored.select("file", "page", "rgb", F.col("reaches").alias("hasler")), ["file", "page"]).join(shares, "file").withColumn("first", F.col("page") == 1)
    for name, boxes in (("labelled", regions.where(F.col("class").isin(KEEP))), ("safe", safe), ("balanced", balanced)):
        hit = meeting(slots, boxes).select("file", "out").withColumn(name, F.lit(True))
        out = out.join(hit, ["file", "out"], "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out.join(classes, ["file", "page"], "left").withColumns({"labelled": F.col("labelled") | F.coalesce("whole", F.lit(False)), "keep_page": F.coalesce("keep", F.lit(False))}).drop("keep", "whole")


#: Rules by name, as conditions on the columns of with_facts().
RULES = {
    "text": "false", "labels": "labelled", "tiles safe": "safe", "tiles balanced": "balanced", "page": "hasler", "rgb": "rgb", "document 0.5": "share >= 0.5 or hasler", "document 0.8": "share >= 0.8 or hasler",
    "first": "first", "tiles safe or first": "safe or first", "page or first": "hasler or first",
}


def decisions(facts: DataFrame) -> DataFrame:
    """policy and the columns of facts, with colour: what each rule decides on each slot."""
    rules = F.array(*[F.struct(F.lit(name).alias("policy"), F.expr(rule).alias("colour")) for name, rule in RULES.items()])
    return facts.withColumn("rule", F.explode(rules)).select("rule.policy", *facts.columns, "rule.colour")


def prices(decided: DataFrame) -> DataFrame:
    """policy, bytes, grey (bytes if colour pages were grey ones, by the ratio of both re-encoded: grey_bytes over colour_bytes), n_colour, n_needless
    (colour pages that nothing asks for) and n_plain (slots that nothing asks for, in all)."""
    plain = ~F.col("labelled") & ~F.col("keep_page")
    size = lambda c: F.sum(F.when(F.col("colour"), c).otherwise(F.col("text_bytes")))
    grey = F.col("image_bytes") * F.col("grey_bytes") / F.col("colour_bytes")
    return decided.groupBy("policy").agg(size(F.col("image_bytes")).alias("bytes"), F.round(size(grey), 1).alias("grey"), F.count_if("colour").alias("n_colour"), F.count_if(F.col("colour") & plain).alias("n_needless"), F.count_if(plain).alias("n_plain"))


def region_outcomes(decided: DataFrame, labelled: DataFrame, regions: DataFrame) -> DataFrame:
    """policy, outcome, n: a region is kept if all slots that it meets are colour pages, partial if some are, else lost or degraded. A page to be
    kept that has no region counts as one of coloured text, as large as the page."""
    region = regions.where(F.col("class").isin(KEEP)).select("file", "page", "no", "class", *[F.col(c).alias(f"r_{c}") for c in ("x0", "y0", "x1", "y1")])
    met = decided.join(region, ["file", "page"]).where("least(x1, r_x1) > greatest(x0, r_x0) and least(y1, r_y1) > greatest(y0, r_y0)").select("policy", "file", "page", F.col("no").cast("long").alias("no"), "class", "colour")
    whole = decided.join(page_classes(labelled, regions).where("whole").select("file", "page"), ["file", "page"], "left_semi").select("policy", "file", "page", F.lit(-1).cast("long").alias("no"), F.lit("coloured-text").alias("class"), "colour")
    each = met.unionByName(whole).groupBy("policy", "file", "page", "no", "class").agg(F.bool_and("colour").alias("every"), F.bool_or("colour").alias("some"))
    outcome = F.when(F.col("every"), "kept").when(F.col("some"), "partial").when(F.col("class").isin(LOST), "lost").otherwise("degraded")
    return each.groupBy("policy", outcome.alias("outcome")).agg(F.count("*").alias("n"))


def same_pages(decided: DataFrame, a: str, b: str) -> DataFrame:
    """One row, same: whether two rules choose the same slots."""
    chosen = lambda p: decided.where((F.col("policy") == p) & F.col("colour")).select("file", "out")
    return chosen(a).exceptAll(chosen(b)).unionByName(chosen(b).exceptAll(chosen(a))).agg((F.count("*") == 0).alias("same"))


def either(decided: DataFrame, a: str, b: str) -> DataFrame:
    """The slots that one of two rules chooses."""
    chosen = lambda p: decided.where((F.col("policy") == p) & F.col("colour")).select("file", "out")
    return chosen(a).unionByName(chosen(b)).distinct()


def orientation_scores(found: DataFrame, least: float) -> DataFrame:
    """turn, pages, alone, final: of pages (doc, page, turn, own, conf), turned by `turn`, how many a detector sets upright by itself, and
    how many if an unsure page (conf below `least`) takes the turn that most sure pages of its document and turn have (a tie: 0)."""
    votes = found.where(F.col("conf") >= least).groupBy("doc", "turn", "own").agg(F.count("*").alias("n"))
    most = votes.groupBy("doc", "turn").agg(F.max("n").alias("n"))
    won = votes.join(most, ["doc", "turn", "n"]).groupBy("doc", "turn").agg(F.count("*").alias("ties"), F.min("own").alias("vote"))
    vote = won.select("doc", "turn", F.when(F.col("ties") == 1, F.col("vote")).otherwise(0).alias("vote"))
    right = (360 - F.col("turn")) % 360
    final = F.when(F.col("conf") >= least, F.col("own")).otherwise(F.coalesce("vote", F.lit(0)))
    return found.join(vote, ["doc", "turn"], "left").groupBy("turn").agg(F.count("*").alias("pages"), F.count_if(F.col("own") == right).alias("alone"), F.count_if(final == right).alias("final"))


#: Ink colours: bins of the hue circle, the least share of a bin that counts, and of a cluster.
HUE_BINS, HUE_LEAST, HUE_CLUSTER = 36, 0.02, 0.05


def hue_bins(pixels: DataFrame, chroma: int) -> DataFrame:
    """key, bin, n, share: how the hues of a page's coloured points (chroma or more between their largest and least part) are spread.

    pixels: key, r, g, b, and n (how many points are so).
    """
    r, g, b = (F.col(c).cast("double") for c in "rgb")
    most, d = F.greatest(r, g, b), F.greatest(r, g, b) - F.least(r, g, b)
    sixth = F.when(most == r, F.pmod((g - b) / d, F.lit(6.0))).when(most == g, (b - r) / d + 2).otherwise((r - g) / d + 4)
    coloured = pixels.where(d >= chroma).select("key", F.pmod(F.floor(sixth * 60 / (360 / HUE_BINS)), F.lit(HUE_BINS)).cast("int").alias("bin"), "n")
    counted = coloured.groupBy("key", "bin").agg(F.sum("n").alias("n"))
    return counted.join(counted.groupBy("key").agg(F.sum("n").alias("all")), "key").select("key", "bin", "n", (F.col("n") / F.col("all")).alias("share"))


def hue_clusters(bins: DataFrame) -> DataFrame:
    """key, k (runs of the circle, smoothed by 1, 2, 1, that hold HUE_LEAST in each bin and HUE_CLUSTER together) and top2 (the share of the
    best three neighbouring bins and of the best others that do not touch them)."""
    filled = bins.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"), F.sum("n").alias("all"))  # of one page
    around = F.sequence(F.lit(0), F.lit(HUE_BINS - 1))
    hist = filled.select("key", "all", F.transform(around, lambda i: F.coalesce(F.element_at("m", i), F.lit(0).cast("long"))).alias("h"))
    at = lambda i: F.get("h", F.pmod(i, F.lit(HUE_BINS)))
    drawn = hist.select("key", "all", "h", F.transform(around, lambda i: (at(i - 1) + 2 * at(i) + at(i + 1)) / 4 >= HUE_LEAST * F.col("all")).alias("on"), F.transform(around, lambda i: F.struct((at(i - 1) + at(i) + at(i + 1)).alias("w"), (-i).alias("minus"))).alias("windows"))
    on = lambda i: F.get("on", F.pmod(i, F.lit(HUE_BINS)))
    # A run is told by its first bin; its length is how far the bins after it are on.
    length = lambda i: F.coalesce(F.array_min(F.filter(F.sequence(F.lit(1), F.lit(HUE_BINS)), lambda k: ~on(i + k))), F.lit(HUE_BINS))
    mass = lambda i: F.aggregate(F.sequence(F.lit(0), length(i) - 1), F.lit(0).cast("long"), lambda s, k: s + at(i + k))
    starts = F.filter(around, lambda i: on(i) & (~on(i - 1) | (F.forall("on", lambda o: o) & (i == 0))))
    k = F.size(F.filter(starts, lambda i: mass(i) >= HUE_CLUSTER * F.col("all")))
    best = F.array_max("windows")
    apart = lambda i: F.least(F.pmod(i + best["minus"], F.lit(HUE_BINS)), F.pmod(-i - best["minus"], F.lit(HUE_BINS))) > 2
    second = F.array_max(F.transform(F.filter("windows", lambda x: apart(-x["minus"])), lambda x: x["w"]))
    return drawn.select("key", k.alias("k"), F.round((best["w"] + second) / F.col("all"), 6).alias("top2"))
