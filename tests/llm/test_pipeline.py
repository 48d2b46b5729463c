import random

import public_tokenizers
import pytest

import corpus_pipeline
from quirespark.llm import bpe

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed, n):
    pick = random.Random(seed)
    return " ".join("".join(pick.choices("etaoinshrdlu", k=pick.randint(2, 9))) for _ in range(n))


@pytest.fixture
def tables(spark, tmp_path):
    item = words(1, 30)
    texts = {
        1: words(2, 80) + "\n" + words(3, 40), 2: words(4, 60), 3: words(4, 59) + " changed", 4: "boilerplate of five words here\n" + words(5, 50), 5: "Boilerplate, of five words here!\n" + words(6, 50),
        6: words(7, 20) + " " + item + " " + words(8, 20), 7: None, 8: "", 9: "123 456 !!", 10: words(2, 80) + "\n" + words(3, 40), 11: "tiny text", 12: item.upper(),
    }
    rows = [(k, t, "en", "s", len(t or "")) for k, t in texts.items()]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), texts


def test_run(spark, tables):
    path, texts = tables
    found = {r["doc_id"]: r for r in corpus_pipeline.run(spark, path).collect()}
    # 2 and 3 are near copies; 10 repeats the lines of 1; 6 and 12 hold the item; 7, 8 and 9 have no language.
    assert set(found) == {1, 2, 4, 5, 11}
    assert all(r["round_trip"] for r in found.values())
    own = bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    want = {k: texts[k] for k in found} | {5: texts[5].split("\n")[1]}
    assert {k: r["ids"] for k, r in found.items()} == {k: own.encode(t).tolist() for k, t in want.items()}


def test_stages_keep_the_columns(spark, tables):
    path, _ = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).columns == docs.columns
        assert stage(spark, docs.where("false"), path).collect() == []
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "minhash_neardup", "decontamination", "byte_bpe"]


def test_stages_leave_the_callers_columns(spark, tables):
    """Columns named as what operators add pass through, whatever their case; a very long text and repeated rows do no harm."""
    path, texts = tables
    long = words(99, 30_000)
    rows = [(k, t, "en", "s", len(t or ""), f"own {k}", k, [k], k + 0.5) for k, t in [*texts.items(), (20, long), (20, long)]]
    names = "n_words, Score, items, n_lines, N_removed, bits_per_byte".split(", ")
    docs = spark.createDataFrame([(*r, r[5], r[6]) for r in rows], SCHEMA + ", n_words string, Score long, items array<long>, n_lines double, N_removed string, bits_per_byte long")
    docs.write.parquet(f"{path}/wide.parquet")
    docs = spark.read.parquet(f"{path}/wide.parquet")
    own = {(r["doc_id"], *(str(r[c]) for c in names)) for r in docs.collect()}
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.schema.names == docs.schema.names
        kept = out.collect()
        assert {(r["doc_id"], *(str(r[c]) for c in names)) for r in kept} <= own
        left[name] = sorted(r["doc_id"] for r in kept)
    assert left["language_id"] == [1, 2, 3, 4, 5, 6, 10, 11, 12, 20, 20]
    assert left["minhash_neardup"] == [1, 2, 4, 5, 6, 7, 8, 9, 11, 12, 20]
    assert left["decontamination"] == [1, 2, 3, 4, 5, 7, 8, 9, 10, 11, 20, 20]
    assert left["line_dedup"] == [1, 2, 3, 4, 5, 6, 7, 8, 9, 11, 12, 20] or left["line_dedup"] == [1, 2, 4, 5, 6, 7, 8, 9, 11, 12, 20]
