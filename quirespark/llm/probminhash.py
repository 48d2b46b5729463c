"""Near-duplicate texts by ProbMinHash over weighted word shingles, banding and verification.

A text's shingles are its runs of SHINGLE words (all its words, if fewer), weighted by how often they occur. Each
shingle is the source of a Poisson process whose rate is its weight, drawn from the shingle's hash alone; an arrival
falls on one of BANDS x ROWS registers, and a register keeps the shingle that arrives first. A process is followed only
while it can still be first somewhere, that is up to the latest of the registers' first arrivals. Two texts agree in a register with the probability that is their
probability Jaccard similarity,

    J(x, y) = sum over d in both of 1 / sum over e of max(x_e / x_d, y_e / y_d),

which is the Jaccard similarity of the shingle sets where all weights are one. Registers are grouped to bands, texts that
share a band's hash are candidates, and candidates are links if their exact similarity is at least the threshold.

Texts with the same weighted shingles are one node, whatever their number. Within a band's bucket no pairs are formed
(linkage.py). The texts of candidates are read again for verification, once each; their shingles are the only large
table that is written.

Words: A-Z in lower case, runs of ASCII letters, digits and all bytes above 0x7F.

Defined cases: a null text, or one without words, is linked with nothing and is its own class; repeated rows are in one
class; a null id is smaller than any other, and a class of null ids has a null class_id; an empty table gives an empty
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

from .common import drop_scratch, fresh, materialize, small_batches, with_row_key
from .components import smallest_member
from .linkage import link_members

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 5
#: Texts in a block, and shingles that are compared at a time.
BLOCK = 256
COLUMNS = 1 << 14

_SPACED = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A well spread permutation of 64-bit numbers (splitmix64's)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles_of(raw: bytes | None, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles, in order, and their weights."""
    words = raw.translate(_SPACED).split() if raw else []
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int32)
    data = np.frombuffer(b"".join(words), np.uint8).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths) - lengths
    place = (np.arange(len(data)) - np.repeat(starts, lengths)).astype(np.uint64)
    word = mix(np.add.reduceat(mix(data + (place << np.uint64(8)) + _ODD), starts) + lengths.astype(np.uint64))
    size = min(size, len(words))
    code = np.full(len(words) - size + 1, np.uint64(size))
    for i in range(size):
        code = mix(code * _ODD + word[i : i + len(code)])
    found, weights = np.unique(code, return_counts=True)
    return found, weights.astype(np.int32)


def signatures(texts: list[tuple[np.ndarray, np.ndarray]], registers: int) -> np.ndarray:
    """A row of registers for each text (none without shingles): the shingle that arrives first in each."""
    n = len(texts)
    first = np.full(n * registers, np.inf)
    holder = np.zeros(n * registers, np.uint64)
    of = np.repeat(np.arange(n), [len(s) for s, _ in texts])
    shingle = np.concatenate([s for s, _ in texts])
    rate = np.concatenate([w for _, w in texts]).astype(np.float64)
    time = np.zeros(len(shingle))
    alone = np.array([len(s) == 1 for s, _ in texts])
    holder.reshape(n, registers)[alone] = np.array([s[0] if len(s) else 0 for s, _ in texts], np.uint64)[alone][:, None]
    active = np.flatnonzero(~alone[of])
    latest = np.full(n, np.inf)
    step = 0
    while len(active):
        step += 1
        draw = mix(shingle[active] + np.uint64(step * int(_ODD) % 2**64))
        time[active] -= np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate[active]
        active = active[time[active] < latest[of[active]]]
        at = of[active] * registers + (mix(shingle[active] * _ODD + np.uint64(step)) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(first, at, time[active])
        won = time[active] == first[at]
        holder[at[won]] = shingle[active[won]]
        latest = first.reshape(n, registers).max(axis=1)
        active = active[time[active] < latest[of[active]]]
    return holder.reshape(n, registers)


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    code = np.arange(bands, dtype=np.uint64)[None, :] + np.zeros((len(signature), 1), np.uint64)
    for i in range(rows):
        code = mix(code * _ODD + signature[:, i::rows])
    return code


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The exact probability Jaccard similarity of two weighted shingle sets."""
    (sa, wa), (sb, wb) = a, b
    both, ia, ib = np.intersect1d(sa, sb, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    if (wa == 1).all() and (wb == 1).all():
        return len(both) / (len(sa) + len(sb) - len(both))
    x, y = wa[ia].astype(np.float64), wb[ib].astype(np.float64)
    # By the ratio x/y: what has a ratio at least as large counts by x, the rest by y.
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    ratio = x / y
    only_x, only_y = wa.sum() - x.sum(), wb.sum() - y.sum()
    from_x = only_x + np.cumsum(x[::-1])[::-1]
    below_y = only_y + np.concatenate([[0.0], np.cumsum(y)])
    at = np.searchsorted(ratio, ratio, side="left")
    return float((1.0 / (from_x[at] / x + below_y[at] / y)).sum())


def _node(shingles: np.ndarray, weights: np.ndarray) -> bytes | None:
    return hashlib.md5(shingles.tobytes() + weights.tobytes()).digest() if len(shingles) else None


def _sketches(texts: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """row, id, sha, text -> row, id, sha, node (null without words), bands."""
    schema = T.StructType([*[texts.schema[c] for c in ("row", "id", "sha")], T.StructField("node", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles_of(raw, size) for raw in batch.column(3).to_pylist()]
            some = [i for i, f in enumerate(found) if len(f[0])]
            codes: list[np.ndarray | None] = [None] * len(found)
            if some:
                for i, code in zip(some, band_hashes(signatures([found[i] for i in some], bands * rows), bands, rows).view(np.int64), strict=True):
                    codes[i] = code
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([_node(*f) for f in found], pa.binary()), pa.array(codes, pa.list_(pa.int64()))], names=schema.names)

    return texts.mapInArrow(sketch, schema)


def _shingle_table(texts: DataFrame, size: int) -> DataFrame:
    """text -> node, shingles, weights as bytes."""

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles_of(raw, size) for raw in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_node(*f) for f in found], pa.binary()), pa.array([f[0].tobytes() for f in found], pa.binary()), pa.array([f[1].tobytes() for f in found], pa.binary())], ["node", "shingles", "weights"])

    return texts.mapInArrow(shingle, "node binary, shingles binary, weights binary")


def _verified(pairs: DataFrame, threshold: float) -> DataFrame:
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [[np.frombuffer(x, kind) for x in batch.column(i).to_pylist()] for i, kind in ((2, np.uint64), (3, np.int32), (4, np.uint64), (5, np.int32))]
            keep = [similarity((a, wa), (b, wb)) >= threshold for a, wa, b, wb in zip(*sets, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], ["u", "v"])

    return pairs.mapInArrow(verify, "u binary, v binary")


def block_links(sets: list[tuple[np.ndarray, np.ndarray]], roots: list, left: np.ndarray, right: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Links (indexes) between a left and a right text of different roots, of which none connects what others have."""
    roots_number = np.unique(np.array(roots, dtype=object), return_inverse=True)[1]
    rows = np.repeat(np.arange(len(sets)), [len(s) for s, _ in sets])
    known, columns = np.unique(np.concatenate([s for s, _ in sets]), return_inverse=True)
    weight = np.concatenate([w for _, w in sets]).astype(np.float32)
    total = np.array([w.sum() for _, w in sets], np.float32)
    share = weight / total[rows]
    a, b = np.flatnonzero(left), np.flatnonzero(right)
    both, of_a, of_b = (np.zeros((len(a), len(b)), np.float32) for _ in range(3))
    order = np.argsort(columns, kind="stable")
    rows, columns, share = rows[order], columns[order], share[order]
    for start in range(0, len(known), COLUMNS):
        i, j = np.searchsorted(columns, (start, start + COLUMNS))
        width = min(COLUMNS, len(known) - start)
        has, part = np.zeros((len(sets), width), np.float32), np.zeros((len(sets), width), np.float32)
        has[rows[i:j], columns[i:j] - start] = 1
        part[rows[i:j], columns[i:j] - start] = share[i:j]
        both += has[a] @ has[b].T
        of_a += part[a] @ has[b].T
        of_b += has[a] @ part[b].T
    size = np.array([len(s) for s, _ in sets], np.float32)
    plain = total == size
    exact = plain[a][:, None] & plain[b][None, :]
    jaccard = both / (size[a][:, None] + size[b][None, :] - both)
    # A term of the similarity is at most the lesser of the two shares, so the sums bound it.
    maybe = np.where(exact, jaccard >= threshold - 1e-5, np.minimum(of_a, of_b) >= threshold - 1e-4)
    maybe &= roots_number[a][:, None] != roots_number[b][None, :]
    out = []
    for x, y in np.argwhere(maybe):
        i, j = a[x], b[y]
        if roots_number[i] != roots_number[j] and similarity(sets[i], sets[j]) >= threshold:
            out.append((int(i), int(j)))
            roots_number[roots_number == roots_number[j]] = roots_number[i]
    return out


def _finish(rest: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Compare what pivots have left, block by block: a bucket's members are dealt to blocks of about BLOCK, and a task
    gets two blocks at a time. Links leave it, not pairs."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = rest.select("bucket", "node", "root", blocks.alias("blocks"), F.pmod(F.xxhash64("node", F.lit("block")), blocks).cast("int").alias("own"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = dealt.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "root").join(sets, "node")
    rows = rows.select("bucket", "i", "j", "own", "node", "root", "shingles", "weights")
    grouped = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done() -> pa.RecordBatch:
            _, i, j, own, nodes, roots, shingles, weights = zip(*held, strict=True)
            held.clear()
            place = np.array(own)
            found = block_links([(np.frombuffer(s, np.uint64), np.frombuffer(w, np.int32)) for s, w in zip(shingles, weights, strict=True)], list(roots), place == i[0], place == j[0], threshold)
            return pa.RecordBatch.from_arrays([pa.array([nodes[p[k]] for p in found], pa.binary()) for k in (0, 1)], ["u", "v"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[-1][:3] != row[:3]:
                    yield done()
                held.append(row)
        if held:
            yield done()

    return grouped.mapInArrow(compare, "u binary, v binary").distinct()


def _near_duplicates(docs: DataFrame, row: str, id_col: str, text_col: str, size: int, threshold: float, bands: int, rows: int) -> DataFrame:
    """row, id, class_id, kept of docs that have a row key."""
    small_batches(docs.sparkSession)
    text = F.col(text_col).cast("binary")
    texts = docs.select(F.col(row).alias("row"), F.col(id_col).alias("id"), F.unhex(F.md5(text)).alias("sha"), text.alias("raw"))
    sketched = materialize(_sketches(texts, size, bands, rows), "sketches")
    nodes = materialize(sketched.where("node is not null").groupBy("node").agg(F.min("sha").alias("sha"), F.min(F.struct("id", "row")).alias("of"), F.first("bands").alias("bands")), "nodes")
    members = nodes.select(F.explode("bands").alias("bucket"), "node")
    shared = members.groupBy("bucket").count().where("count > 1").select("bucket")
    members = materialize(members.join(shared, "bucket"), "members")
    wanted = members.select("node").distinct().join(nodes, "node").select("sha")
    # Copies of a text meet in partial aggregates; then only texts of candidates go on.
    read = docs.select(F.unhex(F.md5(text)).alias("sha"), text.alias("raw")).where("raw is not null").dropDuplicates(["sha"])
    sets = materialize(_shingle_table(read.join(wanted, "sha", "left_semi").select("raw"), size), "shingles")
    side = lambda s: sets.select(F.col("node").alias(s), F.col("shingles").alias(f"s{s}"), F.col("weights").alias(f"w{s}"))
    verify = lambda pairs: _verified(pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "su", "wu", "sv", "wv"), threshold)
    _, found = link_members(members, verify, lambda rest: _finish(rest, sets, threshold))
    for part in (members, sets):
        drop_scratch(part)
    rooted = nodes.select("node", "of").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = materialize(smallest_member(rooted, "of").select("node", F.col("of_least").alias("first")), "classes")
    drop_scratch(nodes)
    with_words = sketched.where("node is not null").select("row", "id", "node").join(classes, "node").select("row", "id", F.col("first.id").alias("class_id"), (F.col("row") == F.col("first.row")).alias("kept"))
    without = sketched.where("node is null").select("row", "id", F.col("id").alias("class_id"), F.lit(True).alias("kept"))
    return with_words.unionByName(without)


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SHINGLE,
    threshold: float = SIMILARITY,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """row (the row's key in its files), id_col, class_id (the class's smallest id), kept (one row of each class)."""
    row = fresh("text_row", docs.columns)
    return _near_duplicates(with_row_key(docs, row), row, id_col, text_col, size, threshold, bands, rows).withColumnRenamed("id", id_col)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, threshold: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """docs with one document of each class, that with the smallest id."""
    row = fresh("text_row", docs.columns)
    keyed = with_row_key(docs, row)
    stay = _near_duplicates(keyed, row, id_col, text_col, size, threshold, bands, rows).where("kept").select(F.col("row").alias(row))
    return keyed.join(stay, row, "left_semi").select(*docs.columns)
