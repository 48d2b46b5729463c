"""Links between the members of buckets without forming all pairs of a bucket.

In each round every bucket has a pivot, the member that meets most others in all its buckets; the others are compared
with it, and what has been found is contracted to components. The pivot has then been compared with its whole bucket and
leaves it, and so do buckets whose members are all in one component. A round's work is in proportion to the members, and
the first finds most of what copies of one text share. What is left after ROUNDS are members of different components that
share a bucket by chance or are similar, but not enough; `finish` rules on those, in blocks or by a condition inside a
join, and gives rows for links only. No pair of a bucket is given up: it is compared, or its two members are known to be
connected.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, materialize
from .components import connected_components

ROUNDS = 1


def link_members(members: DataFrame, verify: Callable[[DataFrame], DataFrame], finish: Callable[[DataFrame], DataFrame], rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """members: bucket, node (no row twice). verify keeps of pairs u, v those that are links; finish makes links u, v from
    rows bucket, node, root, size (of the bucket), between members of a bucket with different roots.

    Returns the links found (enough to connect all that any link within a bucket connects) and the components of
    connected_components() over them; both empty if there are none.
    """
    found: list[DataFrame] = []
    rest = members
    for n in range(rounds):
        sizes = rest.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
        sized = materialize(rest.join(sizes, "bucket").select("bucket", "node", "size"), "sized")
        # A node that meets many in its buckets is likely to be what those are copies of.
        weights = sized.groupBy("node").agg(F.sum("size").alias("weight"))
        pivots = sized.join(weights, "node").groupBy("bucket").agg(F.max(F.struct("weight", "node"))["node"].alias("pivot"))
        around = materialize(sized.join(pivots, "bucket").where("node <> pivot").select("bucket", "node", "pivot"), "around")
        drop_scratch(sized)
        pairs = around.select(F.least("node", "pivot").alias("u"), F.greatest("node", "pivot").alias("v")).distinct()
        found.append(materialize(verify(pairs), "links"))
        components = connected_components(reduce(DataFrame.unionByName, found))
        rooted = around.select("bucket", "node").join(components, "node", "left").withColumn("root", F.coalesce("root", "node"))
        rooted = materialize(rooted, "rooted")
        drop_scratch(around)
        sizes = rooted.groupBy("bucket").agg(F.count("*").alias("size"), F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("bucket", "size")
        rest = materialize(rooted.join(sizes, "bucket"), "rest")
        drop_scratch(rooted)
        if rest.isEmpty():
            return reduce(DataFrame.unionByName, found), components
        if n + 1 < rounds:
            rest = rest.select("bucket", "node")
    found.append(materialize(finish(rest), "links"))
    drop_scratch(rest)
    links = reduce(DataFrame.unionByName, found)
    return links, connected_components(links)
