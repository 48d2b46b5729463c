import math

import numpy as np
import pytest

from quirespark.llm import langid

SAMPLES = {"en": [b"the cat sat on the mat and the dog ran", b"then they went home"], "de": [b"die katze sass auf der matte und der hund lief", "größer über".encode()]}


def slow_bits(text: bytes, texts: list[bytes], order: int) -> float:
    """Method C without exclusion, from nested dictionaries."""
    tree: dict[bytes, dict[int, int]] = {}
    for t in texts:
        for i, b in enumerate(t):
            for d in range(min(order, i) + 1):
                followers = tree.setdefault(t[i - d : i], {})
                followers[b] = followers.get(b, 0) + 1
    total = 0.0
    for i, b in enumerate(text):
        for d in range(min(order, i), -1, -1):
            known = tree.get(text[i - d : i])
            if known:
                n, q = sum(known.values()), len(known)
                if b in known:
                    total -= math.log2(known[b] / (n + q))
                    break
                total -= math.log2(q / (n + q))
        else:
            total += 8
    return total


@pytest.mark.parametrize("order", [0, 1, 4])
def test_code_lengths_are_exact(order):
    model = langid.Model(SAMPLES, order)
    texts = [b"the hund", b"x", "völlig andere Wörter: 漢字".encode(), b"die die die", b"\x00\x00\x00\x00\x00", b"the cat sat on the mat" * 50]
    want = [[slow_bits(t, SAMPLES[name], order) for name in model.languages] for t in texts]
    assert np.allclose(model.bits(texts), want, rtol=1e-5)


def test_prediction(spark):
    rows = [(i, t.decode(), name) for name, texts in SAMPLES.items() for i, t in enumerate(texts)] * 3
    labelled = spark.createDataFrame([*rows, (1, "nothing", None), (2, None, "fr"), (3, "", "fr")], "doc_id int, text string, lang string")
    model = langid.fit(labelled)
    assert model.languages == ["de", "en"]
    docs = spark.createDataFrame([(1, "the mat", 5), (2, "der hund", 6), (3, None, 7), (4, "", 8), (5, "12 34 !", 9), (None, "the " * 50_000, 1), (1, "the mat", 5)], "doc_id int, text string, scored_text int")
    found = langid.identify(docs, model).collect()
    assert sorted((r["doc_id"] or 0, r["lang_pred"]) for r in found) == [(0, "en"), (1, "en"), (1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und")]
    assert all(0 <= r["score"] <= 1 for r in found)
    assert langid.identify(docs.where("false"), model).collect() == []
    nothing = langid.fit(labelled.where("false"))
    assert {r["lang_pred"] for r in langid.identify(docs, nothing).collect()} == {"und"}


def test_sample_is_bounded(spark):
    labelled = spark.createDataFrame([(f"text {i} " * 20, "en") for i in range(300)] + [("ein " * 5000, "de")], "text string, lang string")
    found = langid.sample(labelled, "text", "lang", 2_000)
    assert all(0 < sum(map(len, texts)) <= 2_000 for texts in found.values()) and set(found) == {"en", "de"}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held_out", langid.held_out())
    model = langid.fit(docs.where("not held_out"))
    found = langid.identify(docs.where("held_out"), model).select((langid.F.col("lang") == langid.F.col("lang_pred")).cast("int").alias("right")).agg({"right": "avg"}).first()[0]
    assert found > 0.98
