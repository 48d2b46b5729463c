"""Periodic runs of words, by longest Lyndon words.

A run is a maximal stretch of words with smallest period q. By the runs theorem each has a Lyndon root that is the longest
Lyndon word at its place under one of two opposite orders of the words; the longest Lyndon word at a place reaches to the
next smaller value (or, under the other order, the next larger) of the inverse suffix array. Each such root is extended by
common prefixes of suffixes (LCP array, range minima by a sparse table over blocks): to the right directly, to the left by
halving, since a first root lies less than a period from the run's beginning.

The suffixes of all texts of an Arrow batch are ordered together, each text with its own letters, by prefix doubling in which
only suffixes that still tie are sorted again. A run has at least LEAST_LENGTH words and LEAST_POWER periods, so two
of its suffixes share five words or more; texts whose suffixes are all told apart by four words have none, and the
passes after the suffix array are left out for them.

A text passes through one task whole, with some 150 bytes for each of its words; texts meet no other.

Defined cases: a null or empty text has no words and no runs, and becomes the empty text; white space between kept words becomes one
space; rows that repeat are treated alike; an empty table gives an empty result; columns to be passed on are named by
`keep`, those whose names the result gives anew are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import small_batches, without

LEAST_LENGTH = 6
LEAST_POWER = 4
#: Two suffixes of a run share so many words at least, whatever its period.
LEAST_SHARED = 5
BLOCK = 16

_RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
_FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(_RUN)), T.StructField("text", T.StringType())])


def words_of(text: bytes | None) -> list[bytes]:
    """The maximal stretches without white space (space, and tab to carriage return)."""
    return (text or b"").split()  # bytes, so that only these six bytes separate


def suffix_order(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffix array, its inverse, and places whose suffix shares four letters or more with another.

    letters: texts end to end, each ended by a letter that is its own and less than its others.
    """
    n = len(letters)
    order = np.argsort(letters, kind="stable")
    tied = np.arange(n)
    rank = np.empty(n, np.int64)
    ranked, shared, alike = letters[order], 1, np.empty(0, np.int64)
    while True:
        heads = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
        sizes = np.diff(np.r_[heads, len(ranked)])
        rank[order[tied]] = np.repeat(tied[heads], sizes)
        tied = tied[np.repeat(sizes > 1, sizes)]
        if shared == 4:
            alike = order[tied]
        if not len(tied):
            return order, rank, alike
        members = order[tied]
        ranked = rank[members] * n + rank[members + shared]  # a suffix that ties doesn't reach its text's end
        by = np.argsort(ranked, kind="stable")
        ranked, order[tied] = ranked[by], members[by]
        shared *= 2


def common_prefixes(letters: list[int], order: np.ndarray) -> np.ndarray:
    """lcp[k]: how many letters the suffixes at k - 1 and k of the order share; 0 for the first."""
    before = np.full(len(letters), -1, np.int64)
    before[order[1:]] = order[:-1]
    found, h = [0] * len(letters), 0
    for i, j in enumerate(before.tolist()):
        if j < 0:
            h = 0
            continue
        while letters[i + h] == letters[j + h]:
            h += 1
        found[i] = h
        h -= h > 0
    return np.array(found, np.int64)[order]


def next_smaller(values: list[int]) -> np.ndarray:
    """For each place the next whose value is smaller; the length where there is none."""
    found, open_ = [len(values)] * len(values), []
    for i, v in enumerate(values):
        while open_ and values[open_[-1]] > v:
            found[open_.pop()] = i
        open_.append(i)
    return np.array(found, np.int64)


class RangeMinima:
    """Minima of intervals of an array, by a sparse table over blocks of BLOCK elements and minima from block edges."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = values
        cells = np.pad(values, (0, -len(values) % BLOCK), constant_values=np.iinfo(np.int64).max).reshape(-1, BLOCK)
        self.left = np.minimum.accumulate(cells, axis=1).ravel()
        self.right = np.minimum.accumulate(cells[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = [cells.min(axis=1)]
        while (half := 1 << (len(self.table) - 1)) * 2 <= len(self.table[0]):
            self.table.append(np.minimum(self.table[-1][:-half], self.table[-1][half:]))

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        a, b = first // BLOCK, last // BLOCK
        found = np.minimum(self.right[first], self.left[last])
        inside = np.flatnonzero(a == b)
        if len(inside):
            lo, hi = first[inside], last[inside]
            least = self.values[lo]
            for step in range(1, BLOCK):
                least = np.minimum(least, self.values[np.minimum(lo + step, hi)])
            found[inside] = least
        far = np.flatnonzero(b - a > 1)
        if len(far):
            lo, hi = a[far] + 1, b[far]
            level = np.frexp(hi - lo)[1] - 1
            for k in np.unique(level):
                own = level == k
                at = far[own]
                found[at] = np.minimum(found[at], np.minimum(self.table[k][lo[own]], self.table[k][hi[own] - (1 << int(k))]))
        return found


def runs_of(letters: np.ndarray, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """(start, length, period) of the runs, by start, then period. letters: of one text, with its last; order and rank: its suffixes'."""
    none = np.empty((0, 3), np.int64)
    lcp = common_prefixes(letters.tolist(), order)
    if lcp.max() < LEAST_SHARED:
        return none
    minima = RangeMinima(lcp)

    def shared(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = rank[i], rank[j]
        return minima(np.minimum(a, b) + 1, np.maximum(a, b))

    longest = np.maximum(lcp, np.r_[lcp[1:], 0])[rank]
    roots = []
    for values in (rank, -rank):
        i = np.arange(len(letters))
        p = next_smaller(values.tolist()) - i
        i = np.flatnonzero((i + p < len(letters)) & (longest >= np.maximum(LEAST_SHARED, 2 * p + 1)))
        p = p[i]
        right = shared(i, i + p)
        far = right >= np.maximum(LEAST_SHARED, 2 * p + 1)  # as far as the run's first root reaches
        roots.append(np.stack([p, i + p + right, i], axis=1)[far])
    found = np.concatenate(roots)
    if not len(found):
        return none
    found = found[np.lexsort(found.T[::-1])]
    p, end, i = found[np.r_[True, (found[1:, :2] != found[:-1, :2]).any(axis=1)]].T  # the first root of each run
    least, most = np.zeros_like(i), np.minimum(p - 1, i)
    while (least < most).any():
        half = (least + most + 1) // 2
        reaches = shared(i - half, i - half + p) >= half
        least, most = np.where(reaches, half, least), np.where(reaches, most, half - 1)
    start = i - least
    out = np.stack([start, end - start, p], axis=1)
    out = out[out[:, 1] >= np.maximum(LEAST_LENGTH, LEAST_POWER * p)]
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def runs_of_texts(texts: list[list[bytes]]) -> list[np.ndarray]:
    """The runs of each text's words."""
    letters, starts, base = [], [0], 0
    for words in texts:
        numbers: dict[bytes, int] = {}
        own = [numbers.setdefault(w, len(numbers)) for w in words]
        letters.append(np.array([*own, -1], np.int64) + (base + 1))
        base += len(numbers) + 1
        starts.append(starts[-1] + len(own) + 1)
    found = [np.empty((0, 3), np.int64)] * len(texts)
    if not texts:
        return found
    every = np.concatenate(letters)
    order, rank, alike = suffix_order(every)
    for k in np.unique(np.searchsorted(starts, alike, side="right") - 1).tolist():
        a, b = starts[k], starts[k + 1]  # a text's suffixes are together in the order, for its letters are its own
        found[k] = runs_of(every[a:b], order[a:b] - a, rank[a:b] - a)
    return found


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words without those that lie in a run after its first period, joined by single spaces."""
    if len(runs):
        edges = np.zeros(len(words) + 1, np.int64)
        np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
        np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
        gone = np.cumsum(edges)[:-1] > 0
        words = [w for w, out in zip(words, gone.tolist(), strict=True) if not out]
    return b" ".join(words)


def collapse_runs(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns keep, n_words, runs (array<struct<start, length, period>>, in words from 0) and text, without the words
    that repeat a run's first period."""
    small_batches(docs.sparkSession)
    keep = without(docs.columns if keep is None else keep, _FOUND.names)
    schema = T.StructType([docs.schema[c] for c in keep] + _FOUND.fields)
    run = to_arrow_schema(_RUN)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [words_of(t) for t in batch.column(len(keep)).to_pylist()]
            runs = runs_of_texts(texts)
            offsets = np.r_[0, np.cumsum([len(r) for r in runs])].astype(np.int32)
            flat = np.concatenate([np.empty((0, 3), np.int64), *runs])
            columns = [
                pa.array([len(words) for words in texts], pa.int64()),
                pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(flat[:, c].copy()) for c in range(3)], fields=list(run))),
                pa.array([collapsed(words, r) for words, r in zip(texts, runs, strict=True)], pa.binary()).cast(pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *columns], names=schema.names)

    return docs.select(*keep, F.col(text_col).cast("binary").alias("scanned_text")).mapInArrow(scan, schema)
