"""Contiguous shards of nearly equal bytes, from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Store, bucket_of, crc32_of, documents, parallelism, range_bounds

ROW_BYTES = 8
SHARDS = 24


def shard_by_bytes(spark: SparkSession, docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows in ascending key order, cut at equal byte targets.

    Each range bucket of keys is one partition; its byte and row totals (one row a bucket) give every bucket its
    start, so a row's global start is that plus its running sum. A row goes to the shard in which its middle byte
    falls; shards are contiguous and differ from the target by at most one row at either end.

    Returns key, size (UTF-8 bytes plus 8), text_crc32, shard, slot (gapless from 0 in key order), start (bytes
    before the row). Null text: size 8, crc 0. Null keys come first. Rows with one key keep an order by crc and size;
    equal rows are interchangeable. An empty table gives an empty table; other columns are ignored.
    """
    store = Store(spark, "shards")
    rows = store.write(
        docs.select(
            F.col(key).alias("k"),
            (F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + ROW_BYTES).alias("size"),
            crc32_of(F.col(text)).alias("text_crc32"),
        ),
        "sizes",
    )
    bounds = range_bounds(rows, "k", parallelism(spark))
    rows = rows.withColumn("b", bucket_of(F.col("k"), bounds))
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # over one row a bucket
    everything = Window.partitionBy(F.lit(1))
    totals = (
        rows.groupBy("b")
        .agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
        .select(
            "b",
            F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"),
            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base_n"),
            F.sum("bytes").over(everything).alias("total"),
        )
    )
    inside = Window.partitionBy("b").orderBy("k", "text_crc32", "size")
    placed = (
        rows.withColumn("run", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("nth", F.row_number().over(inside))
        .join(F.broadcast(totals), "b")  # as many rows as there are buckets
        .select(
            "k",
            "size",
            "text_crc32",
            (F.col("base") + F.col("run") - F.col("size")).alias("start"),
            (F.col("base_n") + F.col("nth") - 1).alias("rank"),
            "total",
        )
        .withColumn("shard", F.least(F.lit(shards - 1), F.floor((F.col("start") + F.col("size") / 2) / F.col("total") * shards)).cast("int"))
    )
    placed = store.write(placed.drop("total"), "placed")
    firsts = placed.groupBy("shard").agg(F.min("rank").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select(
        F.col("k").alias(key), "size", "text_crc32", "shard", (F.col("rank") - F.col("first")).alias("slot"), "start"
    )


def op10_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(spark, documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
