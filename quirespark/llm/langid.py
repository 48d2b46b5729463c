"""Language identification by prediction by partial matching (PPM) over bytes.

Each language has a tree of byte contexts of up to ORDER bytes, learned from a bounded sample of its labelled texts and
then frozen. A byte is predicted from the longest context that the tree knows; what was not seen there escapes to the
next shorter context, with the escape probability of method C (the number of distinct followers over that number plus
the count), and below the empty context every byte has probability 1/256. Symbols are not excluded after an escape. The
code length of a text is the exact sum over all its bytes; the language with the least wins, ties go to the first by
name. The score is the winner's posterior probability under equal priors.

The sample: of each language at most SAMPLE_BYTES bytes of distinct whole texts, in order of a hash of the text; a
text that exceeds what is left ends the sample and is learned as far as the bound. Every byte of every text is scored.

Scoring looks up the code length of (context, byte) for all languages at once, in one table per order; the tables are
derived from the trees and hold a gram if any language has seen it.

Defined cases: a null text, or one without a letter, is `und` with score 0; without any labelled text every prediction
is `und`; repeated rows get the same prediction; empty tables give empty results; the columns in keep are passed on, but
for any named lang_pred, score or bits_per_byte, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, small_batches, without

ORDER = 4
SAMPLE_BYTES = 1 << 20
UNKNOWN = "und"
#: Texts are scored together up to so many bytes.
BLOCK_BYTES = 1 << 18


class _Table:
    """Rows of floats by a 64-bit key, open addressing."""

    MULT = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        bits = max(4, int(2 * len(keys) + 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.rows = np.zeros((1 << bits, rows.shape[1]), np.float32)
        todo = np.arange(len(keys))
        at = self._home(keys)
        while len(todo):
            free = self.keys[at] == 0xFFFFFFFFFFFFFFFF
            self.keys[at[free]] = keys[todo[free]]
            placed = self.keys[at] == keys[todo]
            self.rows[at[placed]] = rows[todo[placed]]
            todo, at = todo[~placed], (at[~placed] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * self.MULT) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row's place, or -1."""
        at = self._home(keys)
        have = self.keys[at]
        out = np.where(have == keys, at, -1)
        todo = np.flatnonzero((have != keys) & (have != 0xFFFFFFFFFFFFFFFF))
        at = at[todo]
        while len(todo):
            at = (at + 1) & self.mask
            have = self.keys[at]
            same = have == keys[todo]
            out[todo[same]] = at[same]
            on = ~same & (have != 0xFFFFFFFFFFFFFFFF)
            todo, at = todo[on], at[on]
        return out


def _codes(data: np.ndarray, length: int) -> np.ndarray:
    """The last `length` bytes up to each place as one number; those before the start are 0."""
    code = np.zeros(len(data), np.uint64)
    for back in range(length - 1, -1, -1):
        code <<= np.uint64(8)
        code[back:] |= data[: len(data) - back].astype(np.uint64)
    return code


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, each one's place in its text, and where the texts start."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(lengths) - lengths
    data = np.frombuffer(b"".join(texts), np.uint8)
    return data, np.arange(len(data)) - np.repeat(starts, lengths), starts


class Model:
    """The frozen trees of all languages, as tables of code lengths in bits."""

    def __init__(self, samples: dict[str, list[bytes]], order: int = ORDER):
        self.languages, self.order = sorted(samples), order
        self.grams: list[_Table] = []  # by order: (context, byte) -> bits
        self.escapes: list[_Table] = []  # by order: context -> bits of the escape, 0 where the context is unknown
        joined = [_joined([t for t in samples[name] if t]) for name in self.languages]
        shorter = np.full((1, len(joined)), 8.0)
        shorter_keys = np.zeros(1, np.uint64)
        for d in range(order + 1 if joined else 0):
            counted = []
            for data, place, _ in joined:
                grams, n = np.unique(_codes(data, d + 1)[place >= d], return_counts=True)
                contexts, first, followers = np.unique(grams >> np.uint64(8), return_index=True, return_counts=True)
                counted.append((grams, n, contexts, np.add.reduceat(n, first) if len(n) else n, followers))
            keys = reduce(np.union1d, [c[0] for c in counted]).astype(np.uint64)
            contexts = reduce(np.union1d, [c[2] for c in counted]).astype(np.uint64)
            suffix = keys & np.uint64((1 << 8 * d) - 1)
            below = shorter[np.searchsorted(shorter_keys, suffix)] if d else np.repeat(shorter, len(keys), 0)
            bits, escape = below.copy(), np.zeros((len(contexts), len(joined)))
            for k, (grams, n, known, total, followers) in enumerate(counted):
                if not len(grams):
                    continue
                escape[np.searchsorted(contexts, known), k] = np.log2(total + followers) - np.log2(followers)
                bits[:, k] += escape[np.searchsorted(contexts, keys >> np.uint64(8)), k]
                of = np.searchsorted(known, grams >> np.uint64(8))
                bits[np.searchsorted(keys, grams), k] = np.log2(total[of] + followers[of]) - np.log2(n)
            self.grams.append(_Table(keys, bits))
            self.escapes.append(_Table(contexts, escape))
            shorter, shorter_keys = bits, keys

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code lengths, a row for each text (none empty) and a column for each language."""
        data, place, starts = _joined(texts)
        codes = _codes(data, self.order + 1)
        out = np.zeros((len(data), len(self.languages)), np.float32)
        at = np.arange(len(data))
        for d in range(self.order, -1, -1):
            far = place[at] >= d
            own = at if far.all() else at[far]
            gram = codes[own] & np.uint64((1 << 8 * (d + 1)) - 1)
            row = self.grams[d].find(gram)
            seen = row >= 0
            out[own[seen]] += self.grams[d].rows[row[seen]]
            lost = own[~seen]
            if len(lost):
                row = self.escapes[d].find(gram[~seen] >> np.uint64(8))
                out[lost[row >= 0]] += self.escapes[d].rows[row[row >= 0]]
            at = np.concatenate([lost, at[~far]])
            if not len(at):
                break
        out[at] += 8.0
        return np.add.reduceat(out, starts, axis=0, dtype=np.float64)

    def predict(self, texts: list[bytes]) -> list[tuple[str, float, float]]:
        """Language, score and bits a byte under that language; texts without bytes are unknown."""
        out = [(UNKNOWN, 0.0, 0.0)] * len(texts)
        if not self.languages:
            return out
        block: list[int] = []
        size = 0
        for i, text in enumerate([*texts, None]):
            if text is None or size >= BLOCK_BYTES:
                if block:
                    bits = self.bits([texts[j] for j in block])
                    best = bits.argmin(axis=1)
                    least = bits[np.arange(len(block)), best]
                    score = 1 / np.exp2(least[:, None] - bits).sum(axis=1)
                    for j, k, s, b in zip(block, best, score, least, strict=True):
                        out[j] = (self.languages[k], float(s), float(b) / len(texts[j]))
                block, size = [], 0
            if text:
                block.append(i)
                size += len(text)
        return out


def sample(labelled: DataFrame, text_col: str, lang_col: str, sample_bytes: int) -> dict[str, list[bytes]]:
    """At most sample_bytes bytes of each language, on the driver: the labelled sample that the bound allows.

    Copies count once, and no text counts for more than sample_bytes; longer ones are cut before they are collected.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & (F.octet_length(text_col) > 0)).select(
        F.col(lang_col).alias("lang"), F.substring(text_col, 1, sample_bytes).alias("text"), F.shiftrightunsigned(F.xxhash64(text_col), 2).alias("at")
    )
    each = rows.select("lang", "at", F.least(F.octet_length("text"), F.lit(sample_bytes)).cast("long").alias("n")).dropDuplicates(["lang", "at"])
    sizes = {r["lang"]: r["bytes"] for r in each.groupBy("lang").agg(F.sum("n").alias("bytes")).collect()}
    if not sizes:
        return {}
    limit = F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, int(min(1.0, 2 * sample_bytes / n) * (1 << 62)))])
    chosen = rows.where(F.col("at") <= limit[F.col("lang")]).dropDuplicates(["lang", "at"])
    found: dict[str, list[tuple[int, str]]] = {name: [] for name in sizes}
    for r in chosen.collect():
        found[r["lang"]].append((r["at"], r["text"]))
    if missing := [name for name, texts in found.items() if not texts]:
        first = F.min_by("text", "at")
        for r in rows.where(F.col("lang").isin(missing)).groupBy("lang").agg(first.alias("text")).collect():
            found[r["lang"]].append((0, r["text"]))
    out: dict[str, list[bytes]] = {}
    for name, texts in found.items():
        left, out[name] = sample_bytes, []
        for _, text in sorted(texts):
            out[name].append(text.encode()[:left])
            left -= len(out[name][-1])
            if left <= 0:
                break
    return out


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", order: int = ORDER, sample_bytes: int = SAMPLE_BYTES) -> Model:
    return Model(sample(labelled, text_col, lang_col, sample_bytes), order)


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add lang_pred, score and bits_per_byte to the columns in keep (all of them if None)."""
    small_batches(docs.sparkSession)
    keep = without(docs.columns if keep is None else keep, ["lang_pred", "score", "bits_per_byte"])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by languages x sample_bytes
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())]
    schema = T.StructType([docs.schema[c] for c in keep] + fields)
    scored = F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col)).cast("binary")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = own.predict([t or b"" for t in batch.column(len(keep)).to_pylist()])
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *columns], names=schema.names)

    return docs.select(*keep, scored.alias(fresh("scored_text", keep))).mapInArrow(predict, schema)


def held_out(id_col: str = "doc_id") -> F.Column:
    """Rows that are never learned from: crc32 of the id as text, modulo 4, is 2. False for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
