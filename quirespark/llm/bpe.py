"""Byte-level BPE over texts of any length, by overlapping chunks.

A text of more than chunk_chars characters is cut into chunks that overlap. Each chunk is split into pre-tokens on its
own, in parallel; near its start it may be out of step, because it began in the middle of a pre-token. Where a chunk and
its predecessor have a pre-token boundary in common inside their overlap they have resynchronised, since the split from
a boundary on depends on nothing before it. The first common boundaries cut the text into pieces, the pieces are encoded
in parallel, and their ids are joined in order. Shorter texts are one piece and are never shuffled. Decoding joins the
bytes of the ids.

Long texts are keyed by their SHA-256, so that a copy costs nothing more and repeated or null ids do no harm. Where two
chunks have no boundary in common (one pre-token longer than the overlap), the text is encoded as one piece.

Defined cases: a null text is the empty text and has no ids; repeated rows each get their ids; an empty table gives an
empty result; other columns stay as they are, but for any with the name of a column that is added, which are replaced.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, small_batches, without

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 512
#: A pre-token boundary is certain if so many characters follow it in the chunk: the pattern looks no further ahead.
LOOKAHEAD = 4
DIGESTS = ["n_tokens", "ids_sha256", "decoded_sha256"]
#: Runs longer than this are merged here and not by the library, whose matcher may run out of stack on them.
LONG_RUN = 2_048
_LONG = re.compile(rf"\S{{{LONG_RUN}}}|\s{{{LONG_RUN}}}")


class Vocabulary:
    """Ranks and pattern; plain data that a broadcast carries, with the library's coder built where it is used."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern

    @classmethod
    def read(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}, pattern)

    def __getstate__(self):
        return self.ranks, self.pattern

    def __setstate__(self, state):
        self.ranks, self.pattern = state

    def coder(self) -> tiktoken.Encoding:
        if "_coder" not in self.__dict__:
            self._coder = tiktoken.Encoding("quirespark", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})
        return self._coder

    def splitter(self) -> regex.Pattern:
        if "_splitter" not in self.__dict__:
            self._splitter = regex.compile(self.pattern)
        return self._splitter

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        if len(text) < LONG_RUN or not _LONG.search(text):
            return np.asarray(self.coder().encode_ordinary(text), np.int32)
        out: list[int] = []
        for word in self.splitter().findall(text):
            out += self.merge(word.encode()) if len(word) >= LONG_RUN else self.coder().encode_ordinary(word)
        return np.asarray(out, np.int32)

    def merge(self, word: bytes) -> list[int]:
        """The merges of one pre-token: always the pair of lowest rank, the leftmost of equals; n log n in its bytes."""
        if word in self.ranks:
            return [self.ranks[word]]
        n = len(word)
        stop, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n

        def pair(i: int) -> tuple[int, int, int] | None:
            j = after[i]
            rank = self.ranks.get(word[i : stop[j]]) if j < n else None
            return None if rank is None else (rank, i, stop[j])

        heap = [p for i in range(n) if (p := pair(i))]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or stop[j] != end:
                continue
            alive[j], stop[i], after[i] = False, end, after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (p := pair(k)):
                    heapq.heappush(heap, p)
        return [self.ranks[word[i : stop[i]]] for i in range(n) if alive[i]]

    def boundaries(self, text: str, last: bool) -> np.ndarray:
        """Starts of pre-tokens in a chunk, as far as they are certain."""
        found = np.fromiter((m.start() for m in self.splitter().finditer(text)), np.int64)
        return found if last else found[found <= len(text) - LOOKAHEAD]

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of all tokens end to end, and where each id's bytes start and how many they are."""
        if "_table" not in self.__dict__:
            size = max(self.ranks.values()) + 1
            tokens = [b""] * size
            for token, rank in self.ranks.items():
                tokens[rank] = token
            lengths = np.fromiter(map(len, tokens), np.int64, size)
            self._table = np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(lengths) - lengths, lengths
        return self._table


def broadcast_vocabulary(spark: SparkSession, path: str, pattern: str):
    """The vocabulary file is read once on the driver; its size is that of the file, not of the data."""
    return spark.sparkContext.broadcast(Vocabulary.read(path, pattern))


def _int_lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    values = np.concatenate(arrays) if arrays else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))


def _encode_text(docs: DataFrame, text_col: str, vocabulary) -> DataFrame:
    """Replace text_col by ids, each text as one piece."""
    others = [c for c in docs.columns if c != text_col]
    schema = T.StructType([docs.schema[c] for c in others] + [T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary.value
        for batch in batches:
            ids = [own.encode(t) for t in batch.column(len(others)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _int_lists(ids)], names=schema.names)

    return docs.select(*others, text_col).mapInArrow(encode, schema)


def cut_chunks(texts: DataFrame, chunk_chars: int, overlap_chars: int) -> DataFrame:
    """sha, text -> sha, chunk, chunks, chunk_text; chunk i has chunk_chars characters and those of the overlap."""
    starts = F.sequence(F.lit(0), F.lit(0) + F.ceil((F.char_length("text") / F.lit(chunk_chars))).cast("int") - 1)
    return texts.select("sha", "text", F.explode(starts).alias("chunk"), F.size(starts).alias("chunks")).select(
        "sha", "chunk", "chunks", F.substring("text", F.col("chunk") * chunk_chars + 1, F.lit(chunk_chars + overlap_chars)).alias("chunk_text")
    )


def _edges(chunks: DataFrame, chunk_chars: int, overlap_chars: int, vocabulary) -> DataFrame:
    """Per chunk the boundaries in its first overlap (from its start) and beyond its end (from the next one's start)."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary.value
        for batch in batches:
            heads, tails = [], []
            for chunk, of, text in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                at = own.boundaries(text, chunk + 1 == of)
                heads.append(at[at < overlap_chars].astype(np.int32))
                tails.append((at[at >= chunk_chars] - chunk_chars).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], _int_lists(heads), _int_lists(tails)], names=["sha", "chunk", "head", "tail"])

    return chunks.mapInArrow(split, "sha string, chunk int, head array<int>, tail array<int>")


def encode_long(texts: DataFrame, vocabulary, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """Distinct long texts (sha, text) -> sha, ids."""
    spark = texts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Dealt out by chunk once; the split and the encoding both start from this exchange.
    chunks = cut_chunks(texts, chunk_chars, overlap_chars).repartition(parts, "sha", "chunk")
    in_text = Window.partitionBy("sha").orderBy("chunk")
    cuts = (
        _edges(chunks, chunk_chars, overlap_chars, vocabulary)
        .withColumn("first", F.when(F.col("chunk") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect("head", F.lag("tail").over(in_text)))))
        .withColumn("next_first", F.lead("first").over(in_text))
        .withColumn("in_step", F.min(F.col("first").isNotNull()).over(Window.partitionBy("sha")))
        .select("sha", "chunk", "first", "next_first", "in_step")
    )
    start = F.col("first") + 1
    length = F.coalesce(F.lit(chunk_chars) + F.col("next_first") - F.col("first"), F.lit(chunk_chars + overlap_chars))
    pieces = chunks.join(cuts.where("in_step"), ["sha", "chunk"]).select("sha", "chunk", F.substring("chunk_text", start, length).alias("piece"))
    # Texts out of step, whole; the join keeps only those few.
    whole = texts.join(cuts.where("not in_step and chunk = 0").select("sha"), "sha", "left_semi").select("sha", F.lit(0).alias("chunk"), F.col("text").alias("piece"))
    encoded = _encode_text(pieces.unionByName(whole), "piece", vocabulary)
    return encoded.groupBy("sha").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "ids"))), lambda p: p["ids"])).alias("ids"))


def encode(docs: DataFrame, vocabulary, text_col: str = "text", chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS, digest: bool = False) -> DataFrame:
    """Replace text_col by ids array<int>: the token ids of the whole text, without special tokens.

    digest: what the callers of long texts join is then not the ids but what digest_ids() makes of them.
    """
    if not LOOKAHEAD < overlap_chars <= chunk_chars:
        raise ValueError("the overlap must be larger than the pattern's lookahead and not larger than a chunk")
    small_batches(docs.sparkSession)
    others = without(docs.columns, [text_col, "ids", *DIGESTS * digest])
    key = fresh("long_text_sha", [*others, text_col])
    rows = docs.select(*others, F.coalesce(F.col(text_col), F.lit("")).alias(text_col))
    is_long = F.char_length(text_col) > chunk_chars
    short = _encode_text(rows.where(~is_long), text_col, vocabulary)
    long_rows = rows.where(is_long).withColumn(key, F.sha2(F.col(text_col).cast("binary"), 256))
    distinct = long_rows.select(F.col(key).alias("sha"), F.col(text_col).alias("text")).dropDuplicates(["sha"])
    ids = encode_long(distinct, vocabulary, chunk_chars, overlap_chars)
    if digest:
        short, ids = digest_ids(short, vocabulary), digest_ids(ids, vocabulary)
    long = long_rows.drop(text_col).join(ids.withColumnRenamed("sha", key), key).drop(key)
    return short.unionByName(long)


def decode(encoded: DataFrame, vocabulary, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Add out_col binary: the bytes of the ids, end to end. Null ids have no bytes."""
    small_batches(encoded.sparkSession)
    others = without(encoded.columns, [out_col])
    schema = T.StructType([encoded.schema[c] for c in others] + [T.StructField(out_col, T.BinaryType())])
    at = others.index(ids_col)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, starts, lengths = vocabulary.value.table()
        for batch in batches:
            out = []
            for ids in batch.column(at):
                ids = ids.values.to_numpy(zero_copy_only=False).astype(np.int64) if ids.is_valid else np.empty(0, np.int64)
                n = lengths[ids]
                ends = np.cumsum(n)
                out.append(data[np.repeat(starts[ids] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)].tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=schema.names)

    return encoded.select(*others).mapInArrow(join, schema)


def digest_ids(encoded: DataFrame, vocabulary) -> DataFrame:
    """Replace ids by n_tokens, ids_sha256 (of the decimal ids with a space between) and decoded_sha256."""
    decoded = decode(encoded, vocabulary)
    return decoded.select(
        *[c for c in encoded.columns if c != "ids"],
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
