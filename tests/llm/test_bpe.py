import hashlib

import public_tokenizers
import pytest
import tiktoken

from quirespark.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = [
    "Hello world, it's a test.  Two  spaces\n\n\tand tabs ",
    "Überraschung! Ça va? ñandú 漢字 😀 é   x",
    "'re'll'd ''s 123 4567 a1b2  ",
    "x" * 700 + " " * 700 + "y" * 3 + "!" * 300,
    "the cat sat on the mat\n" * 200,
]


@pytest.fixture(scope="module")
def vocabulary(spark):
    return bpe.broadcast_vocabulary(spark, PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    own = bpe.Vocabulary.read(PATH, public_tokenizers.PATTERN)
    return tiktoken.Encoding("test", pat_str=own.pattern, mergeable_ranks=own.ranks, special_tokens={})


@pytest.mark.parametrize("chunk,overlap", [(40, 20), (64, 33), (512, 64), (32_768, 512)])
def test_chunks_give_the_ids_of_whole_texts(spark, vocabulary, library, chunk, overlap):
    rows = [(i, t, "k", 1) for i, t in enumerate([*TEXTS, TEXTS[0], "", None])] + [(None, TEXTS[4], None, 2), (0, TEXTS[0], "k", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sha string, chunk int")  # names that the operator uses itself
    found = bpe.decode(bpe.encode(docs, vocabulary, chunk_chars=chunk, overlap_chars=overlap), vocabulary).collect()
    assert len(found) == len(rows)
    want = sorted(((r[0], r[2], library.encode_ordinary(r[1] or ""), (r[1] or "").encode()) for r in rows), key=repr)
    assert sorted(((r["doc_id"], r["sha"], r["ids"], bytes(r["decoded"])) for r in found), key=repr) == want


def test_digest(spark, vocabulary, library):
    docs = spark.createDataFrame([(1, TEXTS[4]), (2, "short"), (3, None)], "doc_id long, text string")
    for r in bpe.encode(docs, vocabulary, chunk_chars=100, overlap_chars=30, digest=True).collect():
        text = {1: TEXTS[4], 2: "short", 3: ""}[r["doc_id"]]
        ids = library.encode_ordinary(text)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_long_runs_are_merged_as_the_library_does(library):
    own = bpe.Vocabulary.read(PATH, public_tokenizers.PATTERN)
    for word in ("a" * 3000, "abcab" * 600, "é" * 2500, "!?" * 1500, "1" * 2100, " " * 2500):
        assert own.merge(word.encode()) == library.encode_ordinary(word)
        assert own.encode(f"x {word}y z").tolist() == library.encode_ordinary(f"x {word}y z")
    assert len(own.encode(" " * 1_500_000 + "a")) > 0  # the library's own matcher fails here


def test_empty_table(spark, vocabulary):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(docs, vocabulary), vocabulary).collect() == []
