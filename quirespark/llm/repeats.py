"""Repeated byte strings, found by parsing texts into phrases at triggers of a rolling hash.

A string of LENGTH bytes has LENGTH - GRAM + 1 grams of GRAM bytes; the gram with the least rolling hash (of equals the last)
is its trigger, which its own bytes decide. Consecutive strings with the same trigger form a phrase; each text is so parsed
into phrases, and equal passages into equal phrases, but for their edges. What counts is decided by stages:

1. A trigger whose hash occurs once in the corpus begins no repeat: its phrases are done.
2. Equal phrases, told by a 128-bit hash as is usual for the dictionary of a parse, are one entry. All strings of a phrase that occurs
   twice are repeated.
3. Phrases that share their trigger with another, where one of them is single, are put in two orders over the whole corpus: that of
   the suffixes of the parse, which begin at a trigger, and that of the dictionary's phrases read backwards from the trigger. Both are
   suffix arrays with the lengths of common prefixes between neighbours, cut at LENGTH bytes.
4. A string that begins o bytes before its trigger is an interval of the second order (those that share o bytes before the trigger)
   and one of the first (those that share LENGTH - o bytes from it on). Both intervals together are its place in the order of the
   corpus: two strings are equal if and only if they have both in common. No hash decides that.

The orders are made by Spark's range partitioning and sort. An interval may reach over partitions, so each partition tells, for each
length, where it is first and last broken; those few rows of ORDER_PARTITIONS at most are carried along on the driver. Intervals of one
string are left out, so a phrase has a row for each interval that it shares, not for each of its strings. Matches never cross
texts.

Defined cases: a null text is empty; texts shorter than LENGTH have nothing to remove but count in nothing either; repeated
rows are texts of their own, so both lose what they share; ids may be null or repeat; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_scratch, materialize, small_batches, with_row_key

LENGTH = 400
GRAM = 48
#: The orders have at most so many partitions, which bounds what is carried along them.
ORDER_PARTITIONS = 2_000
#: Rows of an order that are looked at together.
ORDER_ROWS = 1_024
#: A text is parsed in stretches of so many strings.
STRETCH = 1 << 20
_PLACE = np.uint64((1 << 24) - 1)
_BASE = 0x5851F42D4C957F2D
_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_power_cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _both_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, (n - 1).bit_length())
    if size not in _power_cache:
        _power_cache[size] = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
    up, down = _power_cache[size]
    return up[:n], down[:n]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each run of `gram` bytes, from one prefix sum."""
    up, down = _both_powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:-1], out=sums[1:])
    x = (sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1]
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def parse(raw: bytes, length: int, gram: int) -> Iterator[tuple[int, int, int, int]]:
    """The phrases of a text: first string, number of strings, trigger's place after the first, trigger's hash."""
    for begin in range(0, len(raw) - length + 1, STRETCH):
        data = np.frombuffer(raw, np.uint8)[begin : begin + STRETCH + length - 1]
        hashes = gram_hashes(data, gram)
        wide = length - gram + 1
        key = (hashes & ~_PLACE) | (_PLACE - np.arange(len(hashes), dtype=np.uint64))
        padded = np.full(-(-len(key) // wide) * wide, np.uint64(0xFFFFFFFFFFFFFFFF))
        padded[: len(key)] = key
        block = padded.reshape(-1, wide)
        ahead = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
        behind = np.minimum.accumulate(block, axis=1).ravel()
        n = len(data) - length + 1
        trigger = (_PLACE - (np.minimum(ahead[:n], behind[wide - 1 : wide - 1 + n]) & _PLACE)).astype(np.int64)
        first = np.flatnonzero(np.diff(trigger, prepend=-1))
        counts = np.diff(first, append=n)
        at = trigger[first]
        yield from zip((first + begin).tolist(), counts.tolist(), (at - first).tolist(), hashes[at].view(np.int64).tolist(), strict=True)


def _parsed(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """row, raw -> row, start, n, at, trigger, phrase (MD5 of the phrase's bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(i, a, n, at, g, hashlib.md5(raw[a : a + n + length - 1]).digest()) for i, raw in enumerate(batch.column(1).to_pylist()) for a, n, at, g in parse(raw, length, gram)]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
            columns = [pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(columns[0]), *columns[1:]], ["row", "start", "n", "at", "trigger", "phrase"])

    schema = T.StructType([texts.schema["row"], *T.StructType.fromDDL("start long, n int, at int, trigger long, phrase binary").fields])
    return texts.where(F.length("raw") >= length).mapInArrow(run, schema)


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(flags.astype(np.int8), prepend=0, append=0)
    return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist(), strict=True))


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))
    return int(differ[0]) if len(differ) else n


def _ordered(keyed: DataFrame) -> DataFrame:
    """phrase, at, low, high, key -> phrase, at, low, high, part, place (in the part), common (with the key before; -1 for a part's
    first), edge (the key of a part's first and last row), all in the order of key."""
    parts = min(ORDER_PARTITIONS, int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = keyed.repartitionByRange(parts, "key", "phrase").sortWithinPartitions("key", "phrase").withColumn("part", F.spark_partition_id())
    names = ["phrase", "at", "low", "high", "part", "place", "common", "edge"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last row so far, which may be a part's last
        before, place = b"", 0
        for batch in batches:
            keys = batch.column(5).to_pylist()
            if not keys:
                continue
            common = [_common(x, y) for x, y in zip([before, *keys], keys, strict=False)]
            if not place:
                common[0] = -1
            edge = [k if place == i == 0 else None for i, k in enumerate(keys)]
            columns = [*(batch.column(i) for i in range(5)), pa.array(range(place, place + len(keys)), pa.int64()), pa.array(common, pa.int32()), pa.array(edge, pa.binary())]
            ready = pa.RecordBatch.from_arrays(columns, names)
            if held is not None:
                yield held
            yield ready.slice(0, len(keys) - 1)
            held, before, place = ready.slice(len(keys) - 1), keys[-1], place + len(keys)
        if held is not None:
            yield pa.RecordBatch.from_arrays([*held.columns[:-1], pa.array([before], pa.binary())], names)

    ddl = "phrase binary, at int, low int, high int, part int, place long, common int, edge binary"
    return materialize(order.select("phrase", "at", "low", "high", "part", "key").mapInArrow(run, ddl), "order")


def _carried(order: DataFrame, most: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each part and each length from 0 to `most`, the first row of the interval that holds the part's first row, and the last
    row of that which holds its last row. What is read has a row for each part and length at most."""
    sizes = {r["part"]: r["n"] for r in order.groupBy("part").agg(F.count("*").alias("n")).collect()}
    edges = {(r["part"], r["place"]): bytes(r["edge"]) for r in order.where("edge is not null").select("part", "place", "edge").collect()}
    first = {p: np.full(most + 1, -1, np.int64) for p in sizes}  # where an interval of that length is broken, -1 if nowhere
    last = {p: np.full(most + 1, -1, np.int64) for p in sizes}
    for r in order.where("place > 0").groupBy("part", "common").agg(F.min("place").alias("a"), F.max("place").alias("b")).collect():
        f, z = first[r["part"]][r["common"] + 1 :], last[r["part"]][r["common"] + 1 :]
        f[:] = np.where((f < 0) | (r["a"] < f), r["a"], f)
        z[:] = np.maximum(z, r["b"])
    parts = sorted(sizes)
    name = lambda p, at: (np.int64(p) << 40) + at
    lengths = np.arange(most + 1)
    meet = {q: _common(edges[p, sizes[p] - 1], edges[q, 0]) for p, q in zip(parts, parts[1:], strict=False)}
    begin: dict[int, np.ndarray] = {}
    for k, p in enumerate(parts):
        own = np.full(most + 1, name(p, 0))
        if k:
            q = parts[k - 1]
            reaching = np.where(last[q] >= 0, name(q, last[q]), begin[q])
            own = np.where(lengths <= meet[p], reaching, own)
        begin[p] = own
    end: dict[int, np.ndarray] = {}
    for k in range(len(parts) - 1, -1, -1):
        p = parts[k]
        own = np.full(most + 1, name(p, sizes[p] - 1))
        if k + 1 < len(parts):
            q = parts[k + 1]
            reaching = np.where(first[q] >= 0, name(q, first[q] - 1), end[q])
            own = np.where(lengths <= meet[q], reaching, own)
        end[p] = own
    return {p: (begin[p], end[p]) for p in parts}


def shared_intervals(part: int, common: np.ndarray, low: np.ndarray, high: np.ndarray, begin: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """For the rows of a part: row, from, to, first, last of each interval of several rows that holds the row at the lengths from `from`
    to `to`, between low and high. begin, end: the intervals of the part's first and last row, by length."""
    n, lengths = len(common), np.arange(len(begin))
    name = np.int64(part) << 40
    blocks = list(range(0, n, ORDER_ROWS))
    ends: list[np.ndarray] = [end] * len(blocks)  # of the interval that holds a block's last row
    for k in range(len(blocks) - 1, 0, -1):
        rows = common[blocks[k] : blocks[k] + ORDER_ROWS]
        broken = rows[:, None] < lengths[None, :]
        at = broken.argmax(axis=0)
        ends[k - 1] = np.where(broken.any(axis=0), name + blocks[k] + at - 1, ends[k])
    first = begin
    for k, start in enumerate(blocks):
        rows = common[start : start + ORDER_ROWS]
        names = (name + start + np.arange(len(rows)))[:, None]
        broken = rows[:, None] < lengths[None, :]
        if not k:
            broken[0] = False
        lo = np.where(broken, names, -1)
        lo[0] = np.maximum(lo[0], first)
        lo = np.maximum.accumulate(lo, axis=0)
        hi = np.full(lo.shape, np.iinfo(np.int64).max)
        hi[:-1] = np.where(broken[1:], names[:-1], hi[:-1])
        hi[-1] = ends[k]
        hi = np.minimum.accumulate(hi[::-1], axis=0)[::-1]
        first = lo[-1]
        inside = (lengths >= low[start : start + len(rows), None]) & (lengths <= high[start : start + len(rows), None]) & (lo < hi)
        same = np.zeros_like(inside)
        same[:, 1:] = inside[:, 1:] & inside[:, :-1] & (lo[:, 1:] == lo[:, :-1]) & (hi[:, 1:] == hi[:, :-1])
        starts = np.nonzero(inside & ~same)
        after = np.zeros_like(same)
        after[:, :-1] = same[:, 1:]
        stops = np.nonzero(inside & ~after)
        yield starts[0] + start, starts[1], stops[1], lo[starts], hi[starts]


def _intervals(keyed: DataFrame, most: int) -> DataFrame:
    """phrase, at, low, high, key -> phrase, at, a, b, first, last: the intervals of the order of keys that a phrase shares with others, at
    common lengths from a to b within low and high."""
    order = _ordered(keyed)
    carried = _carried(order, most)
    kinds = (pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> Iterator[pa.RecordBatch]:
            part = held[0].column(0)[0].as_py()
            own = pa.Table.from_batches(held)
            common, low, high = (own.column(c).to_numpy().astype(np.int32) for c in ("common", "low", "high"))
            phrases, at = own.column("phrase").combine_chunks(), own.column("at").combine_chunks()
            held.clear()
            for row, a, b, lo, hi in shared_intervals(part, common, low, high, *carried[part]):
                rows = pa.array(row)
                for i in range(0, len(row), 10_000):
                    cut = slice(i, i + 10_000)
                    some = rows[cut]
                    yield pa.RecordBatch.from_arrays([phrases.take(some), at.take(some), *(pa.array(x[cut], kind) for x, kind in zip((a, b, lo, hi), kinds[2:], strict=True))], ["phrase", "at", "a", "b", "first", "last"])

        for batch in batches:
            parts = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
            for i, j in zip(edges, edges[1:], strict=False):
                if i == j:
                    continue
                if held and held[0].column(0)[0].as_py() != parts[i]:
                    yield from done()
                held.append(batch.slice(i, j - i))
        if held:
            yield from done()

    rows = order.select("part", "place", "phrase", "at", "low", "high", "common").repartition("part").sortWithinPartitions("part", "place")
    found = materialize(rows.mapInArrow(run, "phrase binary, at int, a int, b int, first long, last long"), "intervals")
    drop_scratch(order)
    return found


def _contents(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """wanted: row, start, phrase, n, at -> phrase, n, at, ahead (the phrase's bytes from its trigger on), back (those before it, the last
    first), each read at one of its places."""
    by_text = wanted.groupBy("row").agg(F.collect_list(F.struct("phrase", "n", "at", "start")).alias("places"))  # of one text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        for batch in batches:
            for raw, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for i in range(0, len(places), 2_000):
                    out = []
                    for p in places[i : i + 2_000]:
                        trigger = p["start"] + p["at"]
                        out.append((p["phrase"], p["n"], p["at"], raw[trigger : p["start"] + p["n"] + length - 1], raw[p["start"] : trigger][::-1]))
                    yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], ["phrase", "n", "at", "ahead", "back"])

    return texts.join(by_text, "row").select("raw", "places").mapInArrow(run, "phrase binary, n int, at int, ahead binary, back binary")


def _shared_strings(contents: DataFrame, length: int) -> DataFrame:
    """phrase, first, last: the runs of strings of a phrase that other phrases have as well."""
    first = F.col("at") - F.col("n") + 1  # bytes before the trigger in the last string
    ahead = contents.select("phrase", "at", (length - F.col("at")).alias("low"), (length - first).alias("high"), F.col("ahead").alias("key"))
    back = contents.select("phrase", "at", first.alias("low"), F.col("at").alias("high"), F.col("back").alias("key"))
    right, left = _intervals(ahead, length), _intervals(back, length)
    other = right.select("phrase", (length - F.col("b")).alias("from"), (length - F.col("a")).alias("to"), F.col("first").alias("r_first"), F.col("last").alias("r_last"))
    pairs = left.join(other, "phrase").where("a <= to and from <= b")
    pairs = pairs.select("phrase", (F.col("at") - F.least("b", "to")).alias("start"), (F.col("at") - F.greatest("a", "from")).alias("stop"), "first", "last", "r_first", "r_last")
    names = ["first", "last", "r_first", "r_last"]
    pairs = materialize(pairs, "string-intervals")
    for part in (left, right):
        drop_scratch(part)
    several = pairs.groupBy(*names).count().where("count > 1").select(*names)
    return pairs.join(several, names).select("phrase", F.col("start").alias("first"), F.col("stop").alias("last"))


def find_repeats(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """row, raw -> row, start, runs: for each phrase with repeated strings the place of its first string, and the runs
    (first, last; from start) of strings of `length` bytes that occur twice or more."""
    runs = materialize(_parsed(texts, length, gram), "phrases")
    # Joins with written tables on both sides: a trigger of very many phrases is then split over tasks.
    again = materialize(runs.groupBy("trigger").count().where("count > 1").select("trigger"), "repeated-triggers")
    parts = materialize(runs.join(again, "trigger"), "repeat-candidates")
    for part in (runs, again):
        drop_scratch(part)
    phrases = parts.groupBy("phrase").agg(*[F.first(c).alias(c) for c in ("trigger", "n", "at")], F.count("*").alias("times"), F.min(F.struct("row", "start")).alias("place"))
    phrases = materialize(phrases.select("phrase", "trigger", "n", "at", "times", "place.row", "place.start"), "dictionary")
    open_triggers = phrases.groupBy("trigger").agg(F.count("*").alias("variants"), F.min("times").alias("fewest")).where("variants > 1 and fewest = 1").select("trigger")
    open_triggers = materialize(open_triggers, "open-triggers")
    wanted = materialize(phrases.join(open_triggers, "trigger").select("row", "start", "phrase", "n", "at"), "open-phrases")
    contents = materialize(_contents(texts, wanted, length), "phrase-contents")
    for part in (wanted, open_triggers):
        drop_scratch(part)
    known = _shared_strings(contents, length)
    whole = phrases.where("times > 1").select("phrase", F.lit(0).alias("first"), (F.col("n") - 1).alias("last"))
    found = known.unionByName(whole).groupBy("phrase").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    found = materialize(found, "repeated-strings")
    for part in (phrases, contents):
        drop_scratch(part)
    return parts.join(found, "phrase").select("row", "start", "runs")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """id_col, n_bytes, n_removed, spans (removed runs of bytes, half-open, maximal) and kept (the remaining bytes)."""
    small_batches(docs.sparkSession)
    keyed = with_row_key(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "row")
    texts = keyed.select("row", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("raw"))
    gone = find_repeats(texts, length, gram).groupBy("row").agg(F.collect_list(F.struct("start", "runs")).alias("gone"))  # of one text
    named = keyed.select("row", "id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("raw"))
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", span), T.StructField("kept", T.BinaryType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                step = np.zeros(len(raw) + 1, np.int64)
                for s in spans or ():
                    for r in s["runs"]:
                        step[s["start"] + r["first"]] += 1
                        step[s["start"] + r["last"] + length] -= 1
                hit = np.cumsum(step[:-1]) > 0
                kept = np.frombuffer(raw, np.uint8)[~hit].tobytes() if spans else raw
                rows.append((len(raw), int(hit.sum()), [{"start": a, "stop": b + 1} for a, b in _runs(hit)] if spans else [], kept))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]], names=schema.names)

    return named.join(gone, "row", "left").select("id", "raw", "gone").mapInArrow(cut, schema)
