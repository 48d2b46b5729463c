"""Benchmark decontamination with one Aho-Corasick automaton.

Texts and items are normalised alike: A-Z in lower case, words of ASCII letters, digits and all bytes above 0x7F, one
space between words. A window is WINDOW consecutive words of an item, or all the words of an item that has fewer. All
windows go into one automaton over the normalised bytes, which reads each text once; the place of a match gives the
words that it covers, and those are mapped back to characters of the original text.

Defined cases: a null text or item has no words; an item without words or without text is never found; a null item id
is reported as the empty string; windows that several items share count for each of them; repeated rows are each
judged; empty tables give no windows or no rows; other columns of docs are kept, but for any
named n_words, n_hit, items, spans or runs, which are replaced or left out; keep= chooses among them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, small_batches, without

WINDOW = 10
#: Windows in one automaton; a larger benchmark is scanned in as many passes as it needs.
MAX_WINDOWS = 200_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))),
    ]
)


def words_of(raw: bytes | None) -> list[bytes]:
    return raw.translate(_LOWER).split() if raw else []


def windows_of(words: list[bytes], size: int = WINDOW) -> list[bytes]:
    """The distinct windows of an item, each as its words with one space between."""
    if not words:
        return []
    return list(dict.fromkeys(b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))))


def benchmark_windows(benchmark: DataFrame, size: int = WINDOW, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row per distinct window: window binary, items array<string> (sorted)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(w, i or "") for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for w in windows_of(words_of(t), size)]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in out], pa.binary()), pa.array([i for _, i in out], pa.string())], ["window", "item"])

    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(cut, "window binary, item string").groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))


_built: dict[str, tuple] = {}


def automaton(windows: list[tuple[bytes, list[str]]]) -> tuple[ahocorasick.Automaton, list[tuple[int, int, list[str]]]]:
    """The automaton, and per window its length, its words and its items; kept for the life of a Python worker."""
    key = hashlib.sha1(repr(windows).encode()).hexdigest()
    if key not in _built:
        _built.clear()
        auto = ahocorasick.Automaton()
        for n, (window, _) in enumerate(windows):
            auto.add_word(f" {window.decode('latin-1')} ", n)
        auto.make_automaton()
        _built[key] = auto, [(len(w) + 2, w.count(b" ") + 1, items) for w, items in windows]
    return _built[key]


def _original_spans(raw: bytes, runs: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Runs of words as half-open intervals of characters of the original text."""
    # Word edges in bytes, then the characters before each byte.
    is_word = np.frombuffer(raw.translate(_LOWER), np.uint8) != 32
    edge = np.diff(is_word.astype(np.int8), prepend=0, append=0)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return [{"start": int(chars[first[a]]), "stop": int(chars[last[b]])} for a, b in runs]


def find_runs(raw: bytes | None, auto: ahocorasick.Automaton, windows: list[tuple[int, int, list[str]]]) -> tuple[list[tuple[int, int]], set[str]]:
    """Runs of words (first, last) that lie in occurrences of windows, and the items that those belong to."""
    words = words_of(raw)
    if not words or not windows:
        return [], set()
    text = b" " + b" ".join(words) + b" "
    found = list(auto.iter(text.decode("latin-1")))
    if not found:
        return [], set()
    spaces = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
    runs, items = [], set()
    for end, n in found:
        length, n_words, of = windows[n]
        at = int(np.searchsorted(spaces, end - length + 1))
        runs.append((at, at + n_words - 1))
        items.update(of)
    return merge_runs(runs), items


def merge_runs(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(runs):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def _scan(docs: DataFrame, windows: list[tuple[bytes, list[str]]], keep: list[str], again: bool) -> DataFrame:
    """One pass. docs: keep, the text's bytes, and if again the items and runs of the passes before."""
    shared = docs.sparkSession.sparkContext.broadcast(windows)  # at most MAX_WINDOWS windows
    run = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    schema = T.StructType([docs.schema[c] for c in keep] + [docs.schema[docs.columns[len(keep)]], *_FOUND.fields[2:], T.StructField("runs", _FOUND["spans"].dataType), *_FOUND.fields[:2]])
    n = len(keep)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto, known = automaton(shared.value)
        for batch in batches:
            raws = batch.column(n).to_pylist()
            found = [find_runs(raw, auto, known) for raw in raws]
            if again:
                older = zip(batch.column(n + 1).to_pylist(), batch.column(n + 2).to_pylist(), strict=True)
                found = [(merge_runs(runs + [(r["start"], r["stop"]) for r in old]), items | set(had)) for (runs, items), (had, old) in zip(found, older, strict=True)]
            columns = [
                pa.array([sorted(items) for _, items in found], pa.list_(pa.string())),
                pa.array([_original_spans(raw, runs) if runs else [] for raw, (runs, _) in zip(raws, found, strict=True)], run),
                pa.array([[{"start": a, "stop": b} for a, b in runs] for runs, _ in found], run),
                pa.array([len(words_of(raw)) for raw in raws], pa.int64()),
                pa.array([sum(b - a + 1 for a, b in runs) for runs, _ in found], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[: n + 1], *columns], names=schema.names)

    return docs.mapInArrow(scan, schema)


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    keep: list[str] | None = None,
    size: int = WINDOW,
    max_windows: int = MAX_WINDOWS,
) -> DataFrame:
    """Add n_words, n_hit, items (ids found, sorted) and spans (hit passages, half-open, in characters of text_col)."""
    small_batches(docs.sparkSession)
    keep = without(docs.columns if keep is None else keep, [*_FOUND.names, "runs"])
    raw = fresh("scanned_text", keep)
    windows = benchmark_windows(benchmark, size)
    passes = -(-windows.count() // max_windows)
    # Too many windows for one automaton: a pass for each bounded slice of them.
    slices = 1 if passes <= 1 else 2 * passes
    out = docs.select(*keep, F.col(text_col).cast("binary").alias(raw))
    for i in range(slices):
        rows = windows.where(F.pmod(F.xxhash64("window"), F.lit(slices)) == i).orderBy("window").collect()
        out = _scan(out, [(bytes(r["window"]), list(r["items"])) for r in rows], keep, again=i > 0)
        if i + 1 < slices:
            out = out.select(*keep, raw, "items", "runs")
    return out.select(*keep, *_FOUND.names)
