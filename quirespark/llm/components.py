"""Connected components of a table of links, by contraction.

Each round, every node takes for its label the neighbour, or itself, that comes first in a pseudo-random order that is
new in each round; links are rewritten to labels, and what has become a loop or a repetition goes. A constant part of the
nodes is expected to go in each round, whatever the shape of the graph. Labels are then followed back. All of it is joins
and partial aggregates; a node with many links is spread by Spark's handling of skewed joins, since both sides of each
join are written tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_scratch, materialize

MAX_ROUNDS = 100
#: Tables of so few rows are joined by broadcast, and need none of the stages of their own that adaptive execution would give each step.
FEW = 10_000
ADAPTIVE = "spark.sql.adaptive.enabled"


@contextmanager
def _planned_once(spark: SparkSession, few: bool) -> Iterator[None]:
    """Adaptive execution off, if the tables are small."""
    before = spark.conf.get(ADAPTIVE, None)
    if few:
        spark.conf.set(ADAPTIVE, "false")
    try:
        yield
    finally:
        if few:
            spark.conf.unset(ADAPTIVE) if before is None else spark.conf.set(ADAPTIVE, before)


def connected_components(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """node, root for every node that some link joins to another; root is one node of the component, the same for all.

    Null ends and loops are ignored; repeated links do no harm; without links the result is empty.
    """
    ends = links.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v")
    edges = materialize(ends.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links")
    left = edges.count()
    labels: list[tuple[DataFrame, bool]] = []
    for n in range(MAX_ROUNDS):
        few = left <= FEW
        small = F.broadcast if few else lambda t: t
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        place = lambda c: F.struct(F.xxhash64(c, F.lit(n)).alias("at"), F.col(c).alias("node"))  # noqa: E731, B023
        first = both.groupBy("u").agg(F.min(place("v")).alias("near"))
        with _planned_once(edges.sparkSession, few):
            label = materialize(first.select(F.col("u").alias("node"), F.least("near", place("u"))["node"].alias("label")), "labels")
            labels.append((label, few))
            of_u = label.select(F.col("node").alias("u"), F.col("label").alias("lu"))
            of_v = label.select(F.col("node").alias("v"), F.col("label").alias("lv"))
            joined = edges.join(small(of_u), "u").join(small(of_v), "v").where("lu <> lv")
            rest = materialize(joined.select(F.least("lu", "lv").alias("u"), F.greatest("lu", "lv").alias("v")).distinct(), "links")
        drop_scratch(edges)
        edges = rest
        left = edges.count()
        if not left:
            break
    else:
        raise RuntimeError("the links did not contract")
    out, few = labels[-1][0].withColumnRenamed("label", "root"), labels[-1][1]
    for label, small_too in labels[-2::-1]:
        known = out.select(F.col("node").alias("label"), "root")
        out = label.join(F.broadcast(known) if few else known, "label", "left").select("node", F.coalesce("root", "label").alias("root"))
        few = small_too
    if len(labels) == 1:
        return out
    with _planned_once(out.sparkSession, few):
        return materialize(out, "components")


def smallest_member(nodes: DataFrame, value: str) -> DataFrame:
    """nodes: node, root, value -> node, root and the smallest value of all nodes of that root."""
    least = materialize(nodes.groupBy("root").agg(F.min(value).alias(f"{value}_least")), "least")
    return nodes.join(least, "root")
