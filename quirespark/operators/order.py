"""How much of the order of words two texts share: the words in their matching blocks.

The longest common run is a block, then the longest on its left and on its right, and so on (of equal runs the one that begins first
in the first text, then in the second). Rounds: a pair of pieces is one row; a round finds its longest run and leaves a row for either side, so
the sides of a long pair go to different tasks. A pair of pieces small enough is finished where it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..scratch import written

#: Pieces whose lengths multiply to no more are finished in one go.
SMALL = 4_000_000


def longest_run(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Where the longest common run begins in a and in b, and its length (0: none)."""
    best = (0, 0, 0)
    before = np.zeros(len(b) + 1, np.int64)
    for i, word in enumerate(a):
        now = np.zeros(len(b) + 1, np.int64)
        at = np.flatnonzero(b == word)
        now[at + 1] = before[at] + 1
        if len(at) and (most := int(now.max())) > best[2]:
            best = (i - most + 1, int(now.argmax()) - most, most)
        before = now
    return best


def blocks(a: np.ndarray, b: np.ndarray) -> int:
    """The words in all matching blocks of two pieces."""
    total, open_ = 0, [(a, b)]
    while open_:
        a, b = open_.pop()
        if len(a) and len(b):
            i, j, n = longest_run(a, b)
            if n:
                total += n
                open_ += [(a[:i], b[:j]), (a[i + n :], b[j + n :])]
    return total


def order_kept(pairs: DataFrame, small: int = SMALL) -> DataFrame:
    """key, n_a, n_b, kept (words in matching blocks), share (of the words of a). pairs: key, a, b (arrays of words; null: none)."""
    none = F.array().cast("array<string>")
    sized = pairs.select("key", F.coalesce("a", none).alias("a"), F.coalesce("b", none).alias("b"))
    open_ = written(sized.select("key", F.size("a").alias("n_a"), F.size("b").alias("n_b"), "a", "b"))
    facts = open_.select("key", "n_a", "n_b")
    kind = dict(pairs.dtypes)["key"]
    schema = f"key {kind}, kept long, a array<string>, b array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, kept, left, right = [], [], [], []
            for key, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                numbers: dict[str, int] = {}
                x, y = (np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64) for words in (a, b))
                if len(x) * len(y) <= small:
                    found = [(blocks(x, y), [], [])]
                else:
                    i, j, n = longest_run(x, y)
                    found = [(n, [], []), (0, a[:i], b[:j]), (0, a[i + n :], b[j + n :])] if n else [(0, [], [])]
                for n, p, q in found:
                    keys.append(key)
                    kept.append(n)
                    left.append(p)
                    right.append(q)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((keys, kept, left, right), kinds, strict=True)], schema=kinds)

    todo = open_.where("n_a > 0 and n_b > 0").select("key", "a", "b")
    kinds = to_arrow_schema(pairs.sparkSession.createDataFrame([], schema).schema)
    done: DataFrame | None = None
    while True:
        found = written(todo.mapInArrow(run, schema))
        sums = found.groupBy("key").agg(F.sum("kept").alias("kept"))
        done = sums if done is None else done.unionByName(sums)
        todo = found.where("size(a) > 0 and size(b) > 0").select("key", "a", "b")
        if todo.isEmpty():
            break
    whole = facts.join(done.groupBy("key").agg(F.sum("kept").alias("kept")), "key", "left").withColumn("kept", F.coalesce("kept", F.lit(0).cast("long")))
    return whole.withColumn("share", F.round(F.col("kept") / F.greatest(F.col("n_a"), F.lit(1)), 6))
