"""Queries that once left part of their tables out, on small tables of their own."""

import duckdb
import pytest

from quirespark.plans import queries as plans
from quirespark.plans import scoring


@pytest.fixture(scope="module")
def labelled(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("labelled"))
    spark.createDataFrame([(k, "x" * (k + 1), "en", "s", k + 1) for k in range(14)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, k % 2, 0) for k in range(14)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.mark.parametrize(("name", "n"), [("slots_meeting_regions", 16), ("kept_classes", 11)])
def test_labels_of_low_quality_are_regions_too(spark, labelled, name, n):
    """Half of the labels have quality 0."""
    connection = duckdb.connect()
    for t in ("documents", "labels"):
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{labelled}/{t}.parquet/*.parquet'")
    want = sorted(connection.execute(plans.ORACLE_SQL[name]).fetchall())
    found = scoring.__dict__[name](spark, labelled)
    assert sorted(map(tuple, found.collect())) == want
    assert len(want) == n


def test_written_tables_are_compressed(spark):
    """What is kept between steps is compressed."""
    import pathlib
    import urllib.parse

    from pyspark.sql import functions as F

    from quirespark.scratch import written

    rows = spark.range(100_000).select((F.col("id") % 10).alias("k"), F.lit("the same words " * 20).alias("text"), F.array(F.struct("id")).alias("a"))
    kept = written(rows.repartition(4, "k"))
    files = [pathlib.Path(urllib.parse.unquote(f.removeprefix("file:"))) for f in kept.inputFiles()]
    assert files and sum(f.stat().st_size for f in files) < 3_000_000  # 300 bytes of text a row: 30 MB as rows
    assert kept.dtypes == rows.dtypes
    assert kept.groupBy("k").agg(F.count("*").alias("n"), F.sum(F.col("a")[0]["id"]).alias("s")).where("n = 10000").count() == 10
