"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches to Python workers hold at most so many bytes, however long the texts are.
ARROW_BATCH_BYTES = "8m"
ARROW_BATCH_ROWS = "2000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers get, in rows and in bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BATCH_BYTES)


def without(columns: list[str], added: list[str]) -> list[str]:
    """The columns that an operator passes on: not those whose names it gives anew."""
    taken = {c.lower() for c in added}
    return [c for c in columns if c.lower() not in taken]


def fresh(name: str, columns: list[str]) -> str:
    """A name for a helper column that none of the columns has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; only a local session may lack it."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quirespark/{name}-{uuid.uuid4().hex}"


#: Shuffle files of a query are deleted when it ends (Spark's own setting); set while a scratch table is written.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df to the shared folder and read it back, so that a lost executor costs a read.

    The shuffles that led to it have no other reader, so their files go when the table is written.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def _plain_scan(df: DataFrame) -> bool:
    """Whether df only reads files, filters and projects, so that each row is one row of a file."""
    node = df._jdf.queryExecution().analyzed()
    while node.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias", "View"):
        node = node.children().head()
    return node.getClass().getSimpleName() == "LogicalRelation"


def with_row_key(df: DataFrame, name: str) -> DataFrame:
    """df with a key of each row, struct<file: long, index: long>, that is the same whenever and wherever it is read.

    Rows of files are told by file and place in the file, whatever splits or executors read them. Of any other table a
    numbered copy is written first.
    """
    if _plain_scan(df):
        try:
            return df.select("*", F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("index")).alias(name))
        except AnalysisException:
            pass  # a format without row numbers
    return materialize(df.withColumn(name, F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("index"))), "input")


#: Bits of the filter of maybe_in(): at most 262,144 longs, whatever the size of the tables.
FILTER_BITS = 24


def maybe_in(df: DataFrame, keys: DataFrame, key: str, bits: int = FILTER_BITS, rest: bool = False) -> DataFrame | tuple[DataFrame, DataFrame]:
    """The rows of df that can have a partner in keys: the others are told by a bitmap of hashed keys, before any shuffle.

    The bitmap has a bound; where the keys outgrow it, it only lets more rows through to the join that must follow. With
    `rest`, also the rows that have none.
    """
    word, bit, bitmap_col = (fresh(c, df.columns) for c in ("filter_word", "filter_bit", "filter_bits"))
    word_of = F.shiftright(F.shiftrightunsigned(F.xxhash64(key), 64 - bits), 6)
    bit_of = F.expr(f"shiftleft(1L, int(shiftrightunsigned(xxhash64({key}), {64 - bits}) & 63))")
    bitmap = keys.select(word_of.alias(word), bit_of.alias(bit)).groupBy(word).agg(F.bit_or(bit).alias(bitmap_col))
    marked = df.withColumn(word, word_of).join(F.broadcast(bitmap), word, "left" if rest else "inner")
    found = F.coalesce(F.col(bitmap_col).bitwiseAND(bit_of) != 0, F.lit(False))
    inside = marked.where(found).drop(word, bitmap_col)
    return (inside, marked.where(~found).drop(word, bitmap_col)) if rest else inside


def drop_scratch(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more."""
    spark = df.sparkSession
    files = df.inputFiles()
    if files:
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        if "/quirespark/" in folder.toString():
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


