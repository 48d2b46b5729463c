"""Similar vectors by an epsilon grid order join.

Unit vectors with cosine >= c lie within eps = sqrt(2 - 2c) of each other. They are turned so that their leading
principal directions come first, laid on a grid of cells eps wide along those, and sorted by cell, coordinate by
coordinate. The sorted sequence is cut into blocks. Two blocks can hold a link only if some of their cells are equal
or neighbours in the first GRID dimensions: an equi-join on cells finds those pairs of blocks, never of vectors. Blocks are
dealt to pairs of groups of GROUP neighbouring blocks, in waves whose rows take no more bytes than the blocks themselves (or
WAVE_BYTES), so disk follows the vectors though the pairs of blocks can grow with their square. A pair of blocks is joined recursively: intervals of the two sequences are halved, those whose bounding boxes are farther
apart than eps are skipped, and small intervals are compared by one matrix product in double precision.

Equal vectors are collapsed first and count as often as they occur. Of the links within a pair of intervals only the
counts and a spanning forest leave the task, so a group of near copies never becomes a table of pairs.

The directions are fitted on a bounded sample (SAMPLE vectors); they decide speed alone: any rotation gives the same links.

Defined cases: vectors that are null, empty or zero, or that hold a null or non-finite component link with nothing and are
their own component; vectors of different lengths never link; repeated rows link with each other; a null id gives a null
component if all of the component's ids are null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_scratch, materialize, small_batches
from .components import connected_components, smallest_member

SAMPLE = 4_096
LEADING = 8
GRID = 3
BLOCK = 2_048
LEAF = 512
#: A task holds the blocks of two groups at once.
GROUP = 4
WAVE_BYTES = 32 << 20


def _keyed(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, key (null if the vector can't link), n, data: the components as float64 bytes, -0 as 0."""
    schema = T.StructType([T.StructField("id", vectors.schema[id_col].dataType), T.StructField("key", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("data", T.BinaryType())])

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, data = [], [], []
            for x in batch.column(1):
                v = np.empty(0) if not x.is_valid or x.values.null_count else x.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
                ok = len(v) > 0 and np.isfinite(v).all() and v.any()
                data.append(v.tobytes() if ok else None)
                keys.append(hashlib.md5(data[-1]).hexdigest() if ok else None)
                sizes.append(len(v))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.string()), pa.array(sizes, pa.int32()), pa.array(data, pa.binary())], names=schema.names)

    return vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).mapInArrow(key, schema)


def _unit(data: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(data), np.float64).reshape(len(data), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal_directions(distinct: DataFrame, sample: int = SAMPLE, leading: int = LEADING) -> dict[int, np.ndarray]:
    """By vector length, the leading directions of a sample of at most `sample` vectors (those with the first keys)."""
    by_size: dict[int, list[bytes]] = {}
    for r in distinct.select("key", "n", "data").orderBy("key").limit(sample).collect():
        by_size.setdefault(r["n"], []).append(bytes(r["data"]))
    out = {}
    for n, data in by_size.items():
        x = _unit(data)
        out[n] = np.linalg.svd(x - x.mean(axis=0), full_matrices=len(data) < n)[2][: min(leading, n)].T
    return out


def _leading(unit: np.ndarray, directions: dict[int, np.ndarray]) -> np.ndarray:
    n = unit.shape[1]
    return unit @ (directions[n] if n in directions else np.eye(n)[:, : min(LEADING, n)])


def _blocks(distinct: DataFrame, shared, eps: float, block: int) -> DataFrame:
    """The vectors in grid order, as blocks: block, at (its part of the order), n, keys, copies, data, lo, hi, cells."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells: list[list[int]] = []
            for n, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                at = np.floor(_leading(_unit([data]), shared.value)[0] / eps).astype(int)
                cells.append(([*map(int, at)] + [0] * LEADING)[:LEADING])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int32()))], names=["key", "n", "data", "copies", "cell"])

    order = ["n", *[F.col("cell")[i] for i in range(LEADING)], "key"]
    rows = distinct.select("key", "n", "data", "copies").mapInArrow(place, "key string, n int, data binary, copies long, cell array<int>")
    placed = materialize(rows, "placed")
    parts = max(1, -(-placed.count() // block))
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.string())]
    names = ["block", "at", "n", "keys", "copies", "data", "lo", "hi", "cells"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done() -> pa.RecordBatch:
            keys, sizes, data, copies, cell = zip(*held, strict=True)
            held.clear()
            lead = _leading(_unit(list(data)), shared.value)
            cells = sorted({",".join(map(str, [sizes[0], *c[:GRID]])) for c in cell})
            row = [keys[0], TaskContext.get().partitionId(), sizes[0], list(keys), list(copies), b"".join(data), lead.min(axis=0).tolist(), lead.max(axis=0).tolist(), cells]
            return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, kinds, strict=True)], names)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (len(held) >= block or held[-1][1] != row[1]):
                    yield done()
                held.append(row)
        if held:
            yield done()

    sorted_rows = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    blocks = sorted_rows.mapInArrow(cut, "block string, at int, n int, keys array<string>, copies array<long>, data binary, lo array<double>, hi array<double>, cells array<string>")
    blocks = materialize(blocks, "blocks")
    drop_scratch(placed)
    return blocks


def block_pairs(blocks: DataFrame, eps: float) -> DataFrame:
    """a, b (a <= b): blocks with equal or neighbouring cells whose boxes are not farther apart than eps."""
    small = blocks.select("block", "lo", "hi", F.explode("cells").alias("cell"))
    parts = F.split("cell", ",")
    near = small.withColumn("parts", parts)
    for i in range(GRID):
        step = F.explode(F.array(*[F.lit(s) for s in (-1, 0, 1)])).alias("step")
        near = near.select("*", step).withColumn("parts", F.concat(F.slice("parts", 1, i + 1), F.array((F.get("parts", F.lit(i + 1)).cast("int") + F.col("step")).cast("string")), F.slice("parts", i + 3, GRID))).drop("step")
    left = near.select(F.array_join("parts", ",").alias("cell"), F.col("block").alias("a"), F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"))
    right = small.select("cell", F.col("block").alias("b"), F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"))
    gap = lambda lo, hi: F.zip_with(lo, hi, lambda x, y: F.greatest(x - y, F.lit(0.0)))
    apart = F.aggregate(F.concat(gap("a_lo", "b_hi"), gap("b_lo", "a_hi")), F.lit(0.0), lambda s, x: s + x * x)
    return left.join(right, "cell").where("a <= b").where(apart <= (eps + 1e-9) ** 2).select("a", "b").distinct()


def join_intervals(a: np.ndarray, b: np.ndarray, lead_a: np.ndarray, lead_b: np.ndarray, same: bool, cosine: float, eps: float, leaf: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Where the intervals that are not provably distant start, with the matrix of their links."""
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if same and a0 >= b1:
            continue  # below the diagonal: its mirror image is joined
        x, y = lead_a[a0:a1], lead_b[b0:b1]
        gap = np.maximum(0, np.maximum(x.min(axis=0) - y.max(axis=0), y.min(axis=0) - x.max(axis=0)))
        if gap @ gap > (eps + 1e-9) ** 2:
            continue
        if max(a1 - a0, b1 - b0) <= leaf:
            links = a[a0:a1] @ b[b0:b1].T >= cosine
            if same:
                links &= np.arange(a0, a1)[:, None] < np.arange(b0, b1)[None, :]
            if links.any():
                yield a0, b0, links
            continue
        ma, mb = (a0 + a1) // 2, (b0 + b1) // 2
        halves_a = [(a0, ma), (ma, a1)] if a1 - a0 > leaf else [(a0, a1)]
        halves_b = [(b0, mb), (mb, b1)] if b1 - b0 > leaf else [(b0, b1)]
        todo += [(*p, *q) for p in halves_a for q in halves_b]


def forest(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and each column with links, the first row of its component; -1 for those without."""
    none = len(links)
    rows, before = np.where(links.any(axis=1), np.arange(none), none), None
    while before is None or (rows != before).any():
        before = rows
        cols = np.where(links, rows[:, None], none).min(axis=0)
        rows = np.minimum(rows, np.where(links, cols[None, :], none).min(axis=1))
    return np.where(rows < none, rows, -1), np.where(cols < none, cols, -1)


def dealt_blocks(pairs: DataFrame, blocks: DataFrame, group: int) -> DataFrame:
    """ga, gb, block, others: the blocks that each pair of groups needs, a row each, with the blocks that each is to be joined with there.

    pairs: a, b; blocks: block, at. Blocks of neighbouring parts of the order are a group.
    """
    of = lambda s: blocks.select(F.col("block").alias(s), F.expr(f"at div {group}").alias(f"g{s}"))
    named = pairs.join(of("a"), "a").join(of("b"), "b").select(F.least("ga", "gb").alias("ga"), F.greatest("ga", "gb").alias("gb"), "a", "b")
    first, second = named.select("ga", "gb", F.col("a").alias("block"), F.col("b").alias("other")), named.select("ga", "gb", F.col("b").alias("block"), F.lit(None).cast("string").alias("other"))
    return first.unionByName(second).groupBy("ga", "gb", "block").agg(F.collect_set("other").alias("others"))  # of two groups


def _join_blocks(dealt: DataFrame, shared, cosine: float, eps: float, leaf: int) -> DataFrame:
    """From rows ga, gb, block, others, n, keys, copies, data in order of ga and gb, rows key, other, links: a link of the forest, or (other null)
    a count of links."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple] = {}  # blocks of two groups
        groups = None

        def pair(name_a: str, name_b: str) -> Iterator[pa.RecordBatch]:
            (_, keys_a, ca, a, lead_a), (_, keys_b, cb, b, lead_b) = held[name_a], held[name_b]
            na, nb = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
            edges: set[tuple[str, str]] = set()
            for a0, b0, links in join_intervals(a, b, lead_a, lead_b, name_a == name_b, cosine, eps, leaf):
                na[a0 : a0 + links.shape[0]] += links @ cb[b0 : b0 + links.shape[1]]
                nb[b0 : b0 + links.shape[1]] += ca[a0 : a0 + links.shape[0]] @ links
                rows, cols = forest(links)
                edges.update((keys_a[a0 + i], keys_a[a0 + r]) for i, r in enumerate(rows) if r >= 0 and r != i)
                edges.update((keys_b[b0 + j], keys_a[a0 + r]) for j, r in enumerate(cols) if r >= 0)
            out = [(keys_a[i], None, int(na[i])) for i in np.flatnonzero(na)] + [(keys_b[j], None, int(nb[j])) for j in np.flatnonzero(nb)] + [(u, v, 0) for u, v in edges]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int64()))], ["key", "other", "links"])

        def done() -> Iterator[pa.RecordBatch]:
            for name, (others, *_) in held.items():
                for other in others:
                    yield from pair(name, other)
            held.clear()

        for batch in batches:
            for row in range(batch.num_rows):
                ga, gb, block, others, n, keys, copies, data = (c[row].as_py() for c in batch.columns)
                if (ga, gb) != groups:
                    yield from done()
                    groups = ga, gb
                x = np.frombuffer(data, np.float64).reshape(-1, n)
                unit = _unit([v.tobytes() for v in x])
                held[block] = others, keys, np.array(copies), unit, _leading(unit, shared.value)
        yield from done()

    return dealt.mapInArrow(join, "key string, other string, links long")


def similar_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """id_col, n_links, component_id and kept for every row of vectors."""
    spark = vectors.sparkSession
    small_batches(spark)
    eps = math.sqrt(2 - 2 * cosine)
    rows = materialize(_keyed(vectors, id_col, vector_col), "vectors")
    distinct = materialize(rows.where("key is not null").groupBy("key").agg(F.first("n").alias("n"), F.first("data").alias("data"), F.count("*").alias("copies"), F.min("id").alias("least")), "distinct")
    ids = materialize(rows.select("id", "key"), "vector-ids")
    drop_scratch(rows)
    shared = spark.sparkContext.broadcast(principal_directions(distinct))
    blocks = _blocks(distinct, shared, eps, block)
    classes = materialize(distinct.select("key", "copies", "least"), "vector-keys")
    drop_scratch(distinct)
    weighed = blocks.select("block", "at", (F.length("data") + 40 * F.size("keys")).alias("bytes"))
    dealt = materialize(dealt_blocks(block_pairs(blocks, eps), weighed, GROUP), "dealt")
    whole = weighed.agg(F.sum("bytes")).first()[0] or 0
    waves = math.ceil((dealt.join(weighed, "block").agg(F.sum("bytes")).first()[0] or 0) / max(WAVE_BYTES, whole))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = []
    for wave in range(max(1, waves)):
        # The pairs of any one group are spread over all waves.
        own = dealt.where((F.col("ga") + F.col("gb")) % max(1, waves) == wave).join(blocks.drop("at", "lo", "hi", "cells"), "block")
        own = own.select("ga", "gb", "block", "others", "n", "keys", "copies", "data").repartition(parts, "ga", "gb").sortWithinPartitions("ga", "gb")
        found.append(materialize(_join_blocks(own, shared, cosine, eps, leaf), "vector-links"))
    for part in (blocks, dealt):
        drop_scratch(part)
    each, found = found, reduce(DataFrame.unionByName, found)
    counts = found.where("other is null").groupBy("key").agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("other is not null"), "key", "other")
    nodes = classes.join(roots.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    of_key = materialize(smallest_member(nodes, "least").join(counts, "key", "left").select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("least_least").alias("component_id")), "vector-classes")
    for part in (*each, classes):
        drop_scratch(part)
    linked = ids.where("key is not null").join(of_key, "key").select("id", "n_links", "component_id")
    alone = ids.where("key is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
