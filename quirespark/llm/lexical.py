"""Ranked lexical search: the best documents for each item of a query set, by branch and bound over trees of maxima.

Two passes over the documents: one sums N, L and how many documents hold each query term; the other searches. Each task
lays its documents in segments. In a segment, documents with the same commonest term stand side by side and are cut into ranges
of FAN, those into ranges of FAN and so on to one root; for every query term and range the tree keeps the largest impact of a document
in it. A search opens ranges best first: the bound of a range is the sum of its terms' maxima, and it ends when no bound
reaches the k-th score so far. Ranges whose bound equals that score are opened too, for a document in them may come first by its
id. A segment's best k go to a window by item, so what is shuffled is k rows for each item and segment.

The items are a query set against all documents: they come to the driver a block at a time, of at most BLOCK_TERMS terms over
all its items (a longer item is a block of its own), and each block is searched for in its own passes. Nothing else than a
block's terms with their weights is broadcast.

Scores are 64-bit integers throughout: weight * (10^9 tf div (1000 tf + 12 m)), m = 75 + 25 n N div L, summed over an item's terms with repeats.

Defined cases: null and empty texts have no terms; an item without terms, or whose terms no document holds, has no
rows; rows that repeat are documents (or items) of their own; equal scores are ordered by document id, null ids last; an
empty table on either side gives an empty result; other columns are left out, so their names can't clash.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import small_batches

#: Terms of a block of items, with repeats across items.
BLOCK_TERMS = 200_000
#: Postings of a segment; a document is never split, so one with more of the query's terms is a segment of its own.
SEGMENT_POSTINGS = 4_000_000
FAN = 32
#: 1000 * tf / (tf + 0.012 * m) in millionths.
SCALE, TF, LENGTH, FLAT, SHARE = 10**9, 1000, 12, 75, 25

_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """Maximal stretches of letters, digits and bytes beyond ASCII, A-Z lower-cased."""
    return (text or b"").translate(_TERM_BYTES).split()


def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """item_col, terms, counts of each row that has terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted = [Counter(terms_of(t)) for t in batch.column(1).to_pylist()]
            columns = [pa.array([sorted(c) for c in counted], pa.list_(pa.binary())), pa.array([[c[t] for t in sorted(c)] for c in counted], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[item_col, "terms", "counts"])

    schema = T.StructType([items.schema[item_col], *T.StructType.fromDDL("terms array<binary>, counts array<long>").fields])
    return items.select(item_col, F.col(text_col).cast("binary").alias("scanned_text")).mapInArrow(count, schema).where("size(terms) > 0")


def blocks_of(rows: Iterable[tuple], most: int) -> Iterator[list[tuple]]:
    """(item, terms, counts) in blocks of at most `most` terms, but of one item at least."""
    block, n = [], 0
    for row in rows:
        if block and n + len(row[1]) > most:
            yield block
            block, n = [], 0
        block.append(row)
        n += len(row[1])
    if block:
        yield block


def corpus_statistics(docs: DataFrame, vocabulary: Broadcast) -> tuple[int, int, dict[int, int]]:
    """Documents with terms, their terms, and for each number of a query term the documents that hold it. docs: the text's bytes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = vocabulary.value
        held: Counter = Counter()
        n_docs = n_terms = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if terms := terms_of(text):
                    n_docs, n_terms = n_docs + 1, n_terms + len(terms)
                    held.update(numbers.keys() & set(terms))
        found = {-1: n_docs, -2: n_terms} | {numbers[t]: n for t, n in held.items()}
        yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.int64())], names=["term", "n"])

    sums = {r["term"]: r["n"] for r in docs.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}  # one row a query term
    return sums.pop(-1, 0), sums.pop(-2, 0), sums


def weight(n_docs: int, held: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held + 1)))


class MaxTree:
    """Impacts of documents by query term, and the maxima over ranges of FAN of them, of FAN ranges, and so on.

    A level holds rows (range, term, child, value) in this order: the children of a range that have a term, and their
    impact or maximum.
    """

    def __init__(self, doc: np.ndarray, term: np.ndarray, value: np.ndarray) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        child, n = doc, int(doc.max()) + 1
        while True:
            n = -(-n // FAN)
            parent = child // FAN
            by = np.lexsort((child, term, parent))
            parent, term, child, value = parent[by], term[by], child[by], value[by]
            self.levels.append((np.searchsorted(parent, np.arange(n + 1)), term, child - parent * FAN, value))
            if n == 1:
                return
            heads = np.flatnonzero(np.r_[True, (parent[1:] != parent[:-1]) | (term[1:] != term[:-1])])
            child, term, value = parent[heads], term[heads], np.maximum.reduceat(value, heads)

    def children(self, level: int, node: int, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The bounds (at level 0 the scores) of a range's children."""
        starts, all_terms, child, value = self.levels[level]
        a, b = starts[node], starts[node + 1]
        first = np.searchsorted(all_terms[a:b], terms, "left")
        n = np.searchsorted(all_terms[a:b], terms, "right") - first
        at = a + np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        sums = np.zeros(FAN, np.int64)
        np.add.at(sums, child[at], np.repeat(weights, n) * value[at])
        return sums

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, order: list) -> list[tuple[int, int]]:
        """(document, score) of the k highest scores above 0; of equal scores those that come first in `order`, a key for each document."""
        kept: list[tuple[int, int]] = []
        least = 1
        open_ = [(-np.iinfo(np.int64).max, len(self.levels) - 1, 0)]
        while open_ and -open_[0][0] >= least:
            _, level, node = heapq.heappop(open_)
            bounds = self.children(level, node, terms, weights)
            good = np.flatnonzero(bounds >= least)
            if level:
                for c, bound in zip((good + node * FAN).tolist(), bounds[good].tolist(), strict=True):
                    heapq.heappush(open_, (-bound, level - 1, c))
            elif len(good):
                kept += zip((good + node * FAN).tolist(), bounds[good].tolist(), strict=True)
                if len(kept) >= k:
                    kept = sorted(kept, key=lambda d: (-d[1], order[d[0]]))[:k]
                    least = kept[-1][1]
        return sorted(kept, key=lambda d: (-d[1], order[d[0]]))


class Segment:
    """Documents of a task, until they are searched together."""

    def __init__(self) -> None:
        self.docs: list[tuple] = []  # id, commonest term, number of terms
        self.terms: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: object, text: bytes | None, numbers: dict[bytes, int]) -> None:
        terms = terms_of(text)
        counted = Counter(terms)
        common = numbers.keys() & counted.keys()
        if common:
            own = np.array([(numbers[t], counted[t]) for t in common], np.int64)
            self.docs.append((doc_id, int(own[np.lexsort((own[:, 0], -own[:, 1]))[0], 0]), len(terms)))
            self.terms.append(own[:, 0])
            self.counts.append(own[:, 1])
            self.size += len(own)

    def search(self, queries: list[tuple[np.ndarray, np.ndarray]], n_docs: int, n_terms: int, k: int) -> Iterator[tuple[int, object, int]]:
        """(query, document id, score): each query's best k."""
        by = sorted(range(len(self.docs)), key=lambda d: self.docs[d][1:])
        docs = [self.docs[d] for d in by]
        m = FLAT + SHARE * np.array([d[2] for d in docs], np.int64) * n_docs // n_terms
        doc = np.repeat(np.arange(len(docs)), [len(self.terms[d]) for d in by])
        tf = np.concatenate([self.counts[d] for d in by])
        tree = MaxTree(doc, np.concatenate([self.terms[d] for d in by]), SCALE * tf // (TF * tf + LENGTH * m[doc]))
        order = [(d[0] is None, d[0]) for d in docs]
        for q, (terms, weights) in enumerate(queries):
            for d, score in tree.best(terms, weights, k, order):
                yield q, docs[d][0], score


def _searched(docs: DataFrame, block: list[tuple], item_field: T.StructField, k: int, segment_postings: int) -> DataFrame:
    """item, doc_id, score, item_no: the best k of each segment for each item of the block. docs: doc_id, the text's bytes."""
    spark = docs.sparkSession
    numbers = {t: n for n, t in enumerate(sorted({t for _, terms, _ in block for t in terms}))}
    vocabulary = spark.sparkContext.broadcast(numbers)  # of one block
    n_docs, n_terms, held = corpus_statistics(docs.select("scanned_text"), vocabulary)
    weights = {n: weight(n_docs, held[n]) for n in held}

    def query(terms: list[bytes], counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
        used = [(numbers[t], c * w) for t, c in zip(terms, counts, strict=True) if (w := weights.get(numbers[t], 0))]
        return np.array([n for n, _ in used], np.int64), np.array([w for _, w in used], np.int64)

    shared = spark.sparkContext.broadcast(([item for item, *_ in block], [query(terms, counts) for _, terms, counts in block]))
    schema = T.StructType([T.StructField("item", item_field.dataType), T.StructField("doc_id", docs.schema["doc_id"].dataType), *T.StructType.fromDDL("score long, item_no int").fields])
    kinds = to_arrow_schema(schema)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, queries = shared.value

        def found(segment: Segment) -> pa.RecordBatch:
            rows = list(segment.search(queries, n_docs, n_terms, k))
            columns = ([items[q] for q, *_ in rows], [d for _, d, _ in rows], [s for *_, s in rows], [q for q, *_ in rows])
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

        segment = Segment()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                segment.add(doc_id, text, vocabulary.value)
                if segment.size >= segment_postings:
                    yield found(segment)
                    segment = Segment()
        if segment.docs:
            yield found(segment)

    return docs.mapInArrow(search, schema)


def top_documents(
    docs: DataFrame,
    items: DataFrame,
    k: int = 20,
    doc_col: str = "doc_id",
    item_col: str = "item_id",
    text_col: str = "text",
    block_terms: int = BLOCK_TERMS,
    segment_postings: int = SEGMENT_POSTINGS,
) -> DataFrame:
    """item_col, rank (int, from 1), doc_col, score: each item's k best documents with scores above 0."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(doc_col).alias("doc_id"), F.col(text_col).cast("binary").alias("scanned_text"))
    field = items.schema[item_col]
    rows = ((r[0], [bytes(t) for t in r[1]], r[2]) for r in item_terms(items, item_col, text_col).toLocalIterator())
    place = Window.partitionBy("item_no").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    found = [_searched(texts, block, field, k, segment_postings).withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k) for block in blocks_of(rows, block_terms)]
    if not found:
        return docs.sparkSession.createDataFrame([], T.StructType([field, T.StructField("rank", T.IntegerType()), docs.schema[doc_col], T.StructField("score", T.LongType())]))
    return reduce(DataFrame.unionByName, found).select(F.col("item").alias(item_col), "rank", F.col("doc_id").alias(doc_col), "score")
