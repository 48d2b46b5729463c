"""Ink colours of pages: the tint of their paper, and how far their coloured points lie from four inks.

Pixels are counted colours: key (a page or region), r, g, b (0 to 255), n.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import written

#: A point is coloured from this chroma on; a light point is tinted between these; luma of light paper; inks; rounds; fewest points.
CHROMA, TINT, LIGHT, INKS, ROUNDS, FEWEST = 60, (20, 60), 0.7, 4, 20, 50


def _chroma() -> F.Column:
    return F.greatest("r", "g", "b") - F.least("r", "g", "b")


def tint_share(pixels: DataFrame) -> DataFrame:
    """key, col_area (share of coloured points), tint (share of tinted among light points)."""
    luma = (0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b")) / 255
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    light = luma >= LIGHT
    sums = pixels.groupBy("key").agg(F.sum("n").alias("n"), count(_chroma() >= CHROMA).alias("coloured"), count(light).alias("light"), count(light & (_chroma() >= TINT[0]) & (_chroma() < TINT[1])).alias("tinted"))
    return sums.select("key", F.round(F.col("coloured") / F.col("n"), 6).alias("col_area"), F.round(F.col("tinted") / F.greatest(F.col("light"), F.lit(1)), 6).alias("tint"))


def _distance(c: F.Column) -> F.Column:
    return sum(((F.col(x) - c[x]) * (F.col(x) - c[x]) for x in "gb"), (F.col("r") - c["r"]) * (F.col("r") - c["r"]))


def _colour(*also: F.Column) -> F.Column:
    return F.struct(*also, *[F.col(x).cast("double").alias(x) for x in "rgb"])


def first_inks(coloured: DataFrame) -> DataFrame:
    """key, inks (array): the commonest colour of each key, then, one by one, the colour farthest from those so far (of equals the first by r, g, b)."""
    least = F.struct(*[(-F.col(x)).alias(x) for x in "rgb"])
    back = lambda s: F.struct(*[(-s[x]).cast("double").alias(x) for x in "rgb"])
    inks = coloured.groupBy("key").agg(F.max(F.struct("n", least.alias("c")))["c"].alias("c")).select("key", F.array(back(F.col("c"))).alias("inks"))
    for _ in range(INKS - 1):
        far = coloured.join(inks, "key").withColumn("d", F.array_min(F.transform("inks", _distance)))
        nxt = far.groupBy("key").agg(F.max(F.struct("d", least.alias("c")))["c"].alias("c"))
        inks = written(inks.join(nxt, "key").select("key", F.array_append("inks", back(F.col("c"))).alias("inks")))
    return inks


def ink_residual(pixels: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """key, fit4: the mean distance (of 255) of a key's coloured points from the nearest of four inks, found from first_inks() by rounds of
    assigning points and averaging them; 0 for keys with fewer than FEWEST coloured points. A round is an aggregate by key and
    ink; what goes from one to the next is four colours a key."""
    coloured = pixels.where(_chroma() >= CHROMA).groupBy("key", "r", "g", "b").agg(F.sum("n").alias("n"))
    enough = coloured.groupBy("key").agg(F.sum("n").alias("all")).where(F.col("all") >= FEWEST).select("key")
    coloured = written(coloured.join(enough, "key", "left_semi"))
    inks = first_inks(coloured)
    nearest = lambda: F.array_min(F.transform("inks", lambda c, i: F.struct(_distance(c).alias("d"), i.alias("i"))))["i"]
    for k in range(rounds):
        assigned = coloured.join(inks, "key").withColumn("i", nearest())
        means = assigned.groupBy("key", "i").agg(*[(F.sum(F.col("n") * F.col(x)) / F.sum("n")).alias(x) for x in "rgb"])
        found = means.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("i", _colour()))).alias("m"))  # of four at most
        moved = inks.join(found, "key").select("key", F.transform("inks", lambda c, i: F.coalesce(F.element_at("m", i), c)).alias("new"), "inks")
        if k < rounds - 1:
            inks = written(moved.select("key", F.col("new").alias("inks")))
    # The last round's points keep the ink that they were given, at the place to which it has moved.
    last = coloured.join(moved, "key").withColumn("i", nearest())
    apart = F.sqrt(_distance(F.get("new", F.col("i"))))
    fit = last.groupBy("key").agg((F.sum(F.col("n") * apart) / F.sum("n") / 255).alias("fit4"))
    return pixels.select("key").distinct().join(fit, "key", "left").select("key", F.round(F.coalesce("fit4", F.lit(0.0)), 6).alias("fit4"))
