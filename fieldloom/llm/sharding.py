"""Sharding: contiguous shards of nearly equal bytes, cut from global prefix sums. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.session import cut, shuffle_partitions


def text_size(text: Column, overhead: int = 8) -> Column:
    """UTF-8 bytes of the text (null: none) plus a fixed overhead."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(overhead)).cast("long")


def shard_by_bytes(
    docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text", overhead: int = 8
) -> DataFrame:
    """Put every row into one of ``shards`` contiguous runs of the ``doc_id`` order with nearly equal bytes.

    Rows are range-partitioned by (doc_id, digest, size); each range is summed, the few range totals are prefix-summed,
    and a window inside each range adds the local running sum. A row goes to shard
    ``floor(bytes before it * shards / all bytes)``, so a shard differs from the target by less than one row.

    Equal texts aren't kept together: contiguous cuts at equal bytes decide alone.

    Only ids, sizes and digests are shuffled, never texts. Null ids come first; equal ids are ordered by
    digest and size, fully equal rows are interchangeable. Empty table: no rows. Other columns are ignored.
    Returns doc_id, size, text_crc32, shard, slot (place within the shard, from 0).
    """
    spark = docs.sparkSession
    slim = cut(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            text_size(F.col(text), overhead).alias("size"),
            F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        )
    )
    ranged = cut(  # the checkpoint fixes which row is in which range
        slim.repartitionByRange(4 * shuffle_partitions(spark), "doc_id", "text_crc32", "size").withColumn(
            "range", F.spark_partition_id()
        )
    )
    totals = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)  # over the range totals: a fixed count
    everything = W.orderBy("range").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    totals = totals.select(
        "range",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(everything).alias("all_bytes"),
    )
    order = W.partitionBy("range").orderBy("doc_id", "text_crc32", "size")
    placed = cut(
        ranged.select(
            "*",
            F.coalesce(F.sum("size").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("local_bytes"),
            (F.row_number().over(order) - 1).alias("local_rows"),
        )
        .join(F.broadcast(totals), "range")  # at most 4 x shuffle partitions rows
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.expr(
                f"cast(least({shards - 1}, cast(bytes_before + local_bytes as decimal(38,0)) * {shards} div all_bytes) as int)"
            ).alias("shard"),
            (F.col("rows_before") + F.col("local_rows")).cast("long").alias("place"),
        )
    )
    firsts = placed.groupBy("shard").agg(F.min("place").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select(  # at most one row a shard
        "doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot")
    )
