"""Contiguous shards of nearly equal byte size, cut from global prefix sums.

The rows are laid in one global order, by key, checksum, size and place in the scan. Each range partition adds up
its bytes; a prefix sum over those totals (one row a partition) gives where each partition begins, and a running sum
within a partition gives where each row begins. A row goes to the shard in whose equal share of all bytes the row's
middle lies. DataFrame functions only; the texts themselves are never shuffled.

Defined cases: a null text counts no bytes and has the checksum of the empty text; null keys come first; rows that
repeat or tie are told apart by their place in the scan, so any number of equal rows spreads over partitions; an empty
table gives an empty result; other columns are left out, so their names can't clash; a row larger than a share leaves
the shards that it spans empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: What each row costs besides its text.
ROW_BYTES = 8


def shard_by_bytes(docs: DataFrame, n_shards: int = 24, key_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Return key_col, size, text_crc32, law, shard, slot and grown_shard (null: the law is not by key)."""
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    spark = docs.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "text_crc32", "size", "at"]
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = docs.select(
        F.col(key_col).alias("key"),
        (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.monotonically_increasing_id().alias("at"),
    )
    # Written once, so that the partition a row is in is the same wherever it is used below.
    ranged = materialize(
        sized.repartitionByRange(partitions, *[F.col(c).asc_nulls_first() for c in order]).withColumn("part", F.spark_partition_id()),
        "shard-ranges",
    )

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        ranged.groupBy("part")
        .agg(F.sum("size").alias("part_bytes"), F.count("*").alias("part_rows"))
        .select(
            "part",
            F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("bytes_before"),
            F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"),
            F.sum("part_bytes").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all_bytes"),
        )
    )
    running = Window.partitionBy("part").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    placed = (
        ranged.withColumn("end_in_part", F.sum("size").over(running.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("row_in_part", F.row_number().over(running))
        .join(F.broadcast(totals), "part")  # one row a partition
        .withColumn("row", F.col("rows_before") + F.col("row_in_part") - 1)
        .withColumn("shard", F.least(F.lit(n_shards - 1), F.expr(f"int((2 * (bytes_before + end_in_part) - size) * {int(n_shards)} div (2 * all_bytes))")))
    )
    starts = placed.groupBy("shard").agg(F.min("row").alias("first_row"))
    return placed.join(F.broadcast(starts), "shard").select(  # n_shards rows
        F.col("key").alias(key_col),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("row") - F.col("first_row")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
