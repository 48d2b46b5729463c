"""Rows, fragments and gutters of pages from their glyphs in one pass.

The same as baseline_rows() with fragments() or gutter_bins(), for tables of many glyphs: they are dealt by page and sorted by it
once, and whole pages go through a task as arrays, so that no window and no join is over single glyphs. Where a row holds a page (a text to be
set, a page of a file), fragments_of() and gutters_of() read its glyphs where the row is, and nothing is dealt at all.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .glyphs import BREAK, GUTTER, SPACE, level_rows

#: Glyphs that go through at once, but for a page of more.
ROWS = 200_000
_BLANKS = re.compile(r"[ \t\n\x0b\f\r]+")


def whole_pages(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole pages (rows sorted by the first column), and where each page begins."""
    held: list[pa.RecordBatch] = []

    def starts(table: pa.Table) -> np.ndarray:
        key = table.column(0).combine_chunks()
        parts = key.flatten() if pa.types.is_struct(key.type) else [key]
        change = np.zeros(max(len(key) - 1, 0), bool)
        for part in parts:
            codes = np.asarray(pc.dictionary_encode(part, null_encoding="encode").indices)
            change |= codes[1:] != codes[:-1]
        return np.r_[0, np.flatnonzero(change) + 1] if len(key) else np.empty(0, int)

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            table = pa.Table.from_batches(held)
            at = starts(table)
            if len(at) > 1:
                yield table.slice(0, at[-1]), at[:-1]
                held = table.slice(int(at[-1])).combine_chunks().to_batches()
    if held and sum(b.num_rows for b in held):
        table = pa.Table.from_batches(held)
        yield table, starts(table)


def in_order(*keys: np.ndarray) -> np.ndarray:
    """np.lexsort(keys), the last key first; what is in order already, as most texts are, is only looked through."""
    open_ = np.ones(max(len(keys[0]) - 1, 0), bool)
    for key in reversed(keys):
        if (open_ & ~(key[1:] >= key[:-1])).any():
            return np.lexsort(keys)
        open_ &= key[1:] == key[:-1]
        if not open_.any():
            break
    return np.arange(len(keys[0]))


class Rows:
    """The glyphs of whole pages by page, row and place: page, row (a number over all pages), own_row (in its page), x0, x1, y, size, blank, s."""

    def __init__(self, starts: np.ndarray, values: list[str], codes: np.ndarray, x0: np.ndarray, x1: np.ndarray, y: np.ndarray, size: np.ndarray) -> None:
        """starts: where each page begins; values and codes: the different letters, and which of them each glyph is."""
        page = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(x0)]))
        rank = np.empty(len(values), int)
        rank[sorted(range(len(values)), key=lambda k: values[k].encode())] = np.arange(len(values))
        row = self._rows(page, x0, y, size)
        order = in_order(rank[codes], x1, x0, row, page)
        self.page, self.own_row, self.x0, self.x1, self.y, self.size = (a[order] for a in (page, row, x0, x1, y, size))
        self.starts = starts
        self.first = np.r_[True, (self.page[1:] != self.page[:-1]) | (self.own_row[1:] != self.own_row[:-1])] if len(order) else np.empty(0, bool)
        self.row = np.cumsum(self.first) - 1
        self.blank = np.array([v.strip(" ") == "" for v in values], bool)[codes[order]] if values else np.empty(0, bool)
        self.s = [values[k] for k in codes[order].tolist()]

    @classmethod
    def of_table(cls, table: pa.Table, starts: np.ndarray) -> Rows:
        letters = table.column("s").combine_chunks().dictionary_encode()
        return cls(starts, letters.dictionary.to_pylist(), letters.indices.to_numpy(), *(table.column(c).to_numpy() for c in ("x0", "x1", "y", "size")))

    @staticmethod
    def _rows(page: np.ndarray, x0: np.ndarray, y: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Each glyph's row in its page; only distinct baselines and sizes are gone through one by one."""
        by = in_order(x0, size, y, page)
        p, b, s = page[by], y[by], size[by]
        level = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (b[1:] != b[:-1]) | (s[1:] != s[:-1])]) if len(by) else np.empty(0, int)
        levels: dict[int, list] = {}
        for k in level.tolist():
            levels.setdefault(int(p[k]), []).append((float(b[k]), float(x0[by[k]]), float(s[k])))
        before: dict[tuple, tuple] = {}
        for own, found in levels.items():
            for base, row, split in level_rows(sorted(found)):
                before[own, base] = (row, np.inf if split is None else split)
        baseline = np.r_[True, (p[1:] != p[:-1]) | (b[1:] != b[:-1])] if len(by) else np.empty(0, bool)
        heads = np.flatnonzero(baseline)
        rows = np.array([before[int(p[k]), float(b[k])] for k in heads.tolist()]).reshape(-1, 2)[np.cumsum(baseline) - 1]
        out = np.empty(len(by), np.int64)
        out[by] = rows[:, 0].astype(np.int64) + (x0[by] >= rows[:, 1])
        return out

    def right(self) -> np.ndarray:
        """The farthest end of what is not blank before each glyph of its row; nan where there is none."""
        if not len(self.row):
            return np.empty(0)
        ends, rank = np.unique(self.x1, return_inverse=True)
        n = len(ends) + 1
        most = np.maximum.accumulate(self.row * n + np.where(self.blank, 0, rank + 1)) % n  # ranks, so that rows don't mix and ends stay exact
        before = np.where(self.first, 0, np.r_[0, most[:-1]])
        return np.where(before > 0, np.r_[np.nan, ends][before], np.nan)


def _gutters(rows: Rows, least: int, share: float, gap: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each page the bins inside gaps of enough rows: bins, how many rows have a gap there, how many reach over it."""
    keep = ~rows.blank
    right, x0, x1, size, page, row = (a[keep] for a in (rows.right(), rows.x0, rows.x1, rows.size, rows.page, rows.row))
    place = lambda v: np.floor(np.maximum(v, 0.0)).astype(np.int64)
    with np.errstate(invalid="ignore"):
        wide = (x0 - right >= gap * size) & (place(x0) > place(np.nan_to_num(right)) + 1)
    first = np.r_[True, row[1:] != row[:-1]] if len(row) else np.empty(0, bool)
    last = np.r_[first[1:], True] if len(row) else first
    out = []
    edges = np.searchsorted(page, np.arange(len(rows.starts) + 1))  # glyphs are in order of pages
    for own in map(slice, edges[:-1].tolist(), edges[1:].tolist()):
        if own.start == own.stop:
            out.append((np.empty(0, int),) * 3)
            continue
        bins = int(place(np.maximum(x0[own].max(), x1[own].max()))) + 2
        free, over = np.zeros(bins + 1, np.int64), np.zeros(bins + 1, np.int64)
        w = wide[own]
        np.add.at(free, place(right[own][w]) + 1, 1)
        np.add.at(free, place(x0[own][w]), -1)
        np.add.at(over, place(x0[own][first[own]]), 1)
        np.add.at(over, place(x1[own][last[own]]), -1)
        free, over = np.cumsum(free), np.cumsum(over)
        at = np.flatnonzero((free >= least) & (free >= share * over))
        out.append((at, free[at], over[at]))
    return out


def _fragments(rows: Rows, gutters: bool, least: int = 5, share: float = 0.6) -> tuple[np.ndarray, list]:
    """The page of each fragment, and the columns row, frag, x0, x1, base, text."""
    right = rows.right()
    with np.errstate(invalid="ignore"):
        gap = np.where(rows.blank, np.nan, rows.x0 - right)
        broken = gap > BREAK * rows.size
        if gutters:
            wide = np.flatnonzero(gap >= GUTTER * rows.size)
            edges = np.searchsorted(rows.page[wide], np.arange(len(rows.starts) + 1))
            for p, (bins, *_) in enumerate(_gutters(rows, least, share, GUTTER)):
                own = wide[edges[p] : edges[p + 1]]
                low, high = np.floor(np.maximum(right[own], 0.0)), np.floor(rows.x0[own])
                broken[own] |= np.searchsorted(bins, high) > np.searchsorted(bins, low)
    same = ~rows.first
    step = np.where(same, rows.x0 - np.r_[0.0, rows.x1[:-1]], -np.inf)
    spaced = same & ~broken & (step > SPACE * np.maximum(rows.size, np.r_[0.0, rows.size[:-1]]))
    letters = rows.s
    for k in np.flatnonzero(spaced).tolist():
        letters[k] = " " + letters[k]
    heads = np.flatnonzero(rows.first | broken)
    stops = np.r_[heads[1:], len(letters)]
    texts = [_BLANKS.sub(" ", "".join(letters[a:b])).strip(" ") for a, b in zip(heads.tolist(), stops.tolist(), strict=True)]
    cuts = np.cumsum(broken)
    frag = cuts[heads] - (cuts - broken)[np.flatnonzero(rows.first)][rows.row[heads]]
    left = np.minimum.reduceat(np.where(rows.blank, np.inf, rows.x0), heads)
    end = np.maximum.reduceat(np.where(rows.blank, -np.inf, rows.x1), heads)
    base = np.minimum.reduceat(rows.y, heads)
    keep = np.flatnonzero(np.array([t != "" for t in texts], bool))
    return rows.page[heads[keep]], [rows.own_row[heads[keep]], frag[keep], left[keep], end[keep], base[keep], [texts[k] for k in keep.tolist()]]


def _bins(rows: Rows, least: int, share: float, gap: float) -> tuple[np.ndarray, list]:
    """The page of each gutter bin, and the columns bin, n_free, n_over."""
    found = _gutters(rows, least, share, gap)
    return np.repeat(np.arange(len(found)), [len(f[0]) for f in found]), [np.concatenate([f[k] for f in found]) for k in range(3)]


_FRAGMENT = [("row", T.LongType()), ("frag", T.LongType()), ("x0", T.DoubleType()), ("x1", T.DoubleType()), ("base", T.DoubleType()), ("text", T.StringType())]
_BIN = [("bin", T.IntegerType()), ("n_free", T.LongType()), ("n_over", T.LongType())]
#: values, codes, x0, x1, y, size of a page's glyphs, from what its row holds.
Reader = Callable[..., tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def _schema(pages: DataFrame, fields: list) -> T.StructType:
    return T.StructType([pages.schema["doc"], *[T.StructField(n, k) for n, k in fields]])


def _batch(docs: pa.Array, columns: list, kinds: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([docs, *(pa.array(c, f.type) for c, f in zip(columns, list(kinds)[1:], strict=True))], schema=kinds)


def _dealt(glyphs: DataFrame, fields: list, step: Callable[[Rows], tuple[np.ndarray, list]], at_once: int) -> DataFrame:
    schema = _schema(glyphs, fields)
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_pages(batches, at_once):
            page, columns = step(Rows.of_table(table, starts))
            yield _batch(table.column(0).combine_chunks().take(pa.array(starts[page])), columns, kinds)

    return glyphs.select("doc", "s", "x0", "x1", "y", "size").repartition("doc").sortWithinPartitions("doc").mapInArrow(run, schema)


def _read(pages: DataFrame, read: Reader, fields: list, step: Callable[[Rows], tuple[np.ndarray, list]], at_once: int) -> DataFrame:
    schema = _schema(pages, fields)
    kinds = to_arrow_schema(schema)

    def rows_of(found: list[tuple]) -> Rows:
        every = {v: k for k, v in enumerate(dict.fromkeys(v for values, *_ in found for v in values))}
        codes = np.concatenate([np.array([every[v] for v in values], int)[codes] if values else codes for values, codes, *_ in found])
        starts = np.cumsum([0, *[len(f[1]) for f in found]])[:-1]
        return Rows(starts, list(every), codes, *(np.concatenate([f[k] for f in found]) for k in range(2, 6)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, at, n = [c.to_pylist() for c in batch.columns[1:]], 0, 0
            found: list[tuple] = []
            for k in range(batch.num_rows):
                found.append(read(*(c[k] for c in columns)))
                n += len(found[-1][1])
                if n >= at_once or k == batch.num_rows - 1:
                    if n:
                        page, out = step(rows_of(found))
                        yield _batch(batch.column(0).slice(at).take(pa.array(page)), out, kinds)
                    at, n, found = k + 1, 0, []

    return pages.mapInArrow(run, schema)


def column_gutters(glyphs: DataFrame, least: int = 5, share: float = 0.6, gap: float = GUTTER, at_once: int = ROWS) -> DataFrame:
    """doc, bin, n_free, n_over: gutter_bins() of the rows of glyphs."""
    return _dealt(glyphs, _BIN, lambda rows: _bins(rows, least, share, gap), at_once)


def gutters_of(pages: DataFrame, read: Reader, least: int = 5, share: float = 0.6, gap: float = GUTTER, at_once: int = ROWS) -> DataFrame:
    """column_gutters() of pages (doc, and what `read` takes), a row each."""
    return _read(pages, read, _BIN, lambda rows: _bins(rows, least, share, gap), at_once)


def page_fragments(glyphs: DataFrame, gutters: bool = False, at_once: int = ROWS) -> DataFrame:
    """doc, row, frag, x0, x1, base, text: fragments() of the rows of glyphs; with `gutters`, also cut at the page's own."""
    return _dealt(glyphs, _FRAGMENT, lambda rows: _fragments(rows, gutters), at_once)


def fragments_of(pages: DataFrame, read: Reader, gutters: bool = False, at_once: int = ROWS) -> DataFrame:
    """page_fragments() of pages (doc, and what `read` takes), a row each."""
    return _read(pages, read, _FRAGMENT, lambda rows: _fragments(rows, gutters), at_once)


def set_text(text: str | None) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The glyphs of a text as glyphs.from_lines() sets it: line i at y = 100 + 12 i, letter j at x = 50 + 5 j."""
    letters = np.frombuffer((text or "").encode("utf-32-le"), np.uint32)
    feeds = letters == 10
    line = np.cumsum(feeds) - feeds
    begins = np.r_[0, np.flatnonzero(feeds) + 1]
    place = np.arange(len(letters)) - begins[line]
    shown = ~feeds & (letters != 32)
    values, codes = np.unique(letters[shown], return_inverse=True)
    x0 = 50.0 + 5 * place[shown]
    return [chr(v) for v in values.tolist()], codes, x0, x0 + 5, 100.0 + 12 * line[shown], np.full(len(x0), 10.0)


def page_glyphs(glyphs: list[dict] | None) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The visible upright glyphs of a page of sources.pdf (its column glyphs)."""
    own = [g for g in glyphs or [] if g["s"] and g["visible"] and g["a"] > 0 > g["d"] and abs(g["b"]) <= 0.05 * g["a"] and abs(g["c"]) <= -0.05 * g["d"]]
    numbers: dict[str, int] = {}
    codes = np.array([numbers.setdefault(g["s"], len(numbers)) for g in own], int)
    return list(numbers), codes, *(np.array([g[c] for g in own], float) for c in ("x0", "x1", "y", "size"))
