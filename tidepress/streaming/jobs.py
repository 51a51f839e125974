"""The streams run to their end over the tables at hand, each into a written table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepress.operators import archive as A
from tidepress.storage import work_folder

from . import state


def _to_end(df: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over all there is and returns its rows."""
    spark = df.sparkSession
    name = f"stream_{uuid.uuid4().hex}"
    where = f"{work_folder(spark)}/{name}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{where}/rows/batch={number}")  # again after a failure: the same folder

    q = df.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{where}/rows/batch=*")


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    where = f"{sf_dir}/{name}.parquet"
    # A streaming file source takes folders: a lone file is named by a pattern.
    return spark.readStream.schema(spark.read.parquet(where).schema).parquet(where if spark._jvm.java.io.File(where).isDirectory() else f"{where}*")


def feed_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _stream(spark, sf_dir, "events")
    log = e.select(F.col("user_id").cast("string").alias("key"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("ok"))
    rows = _to_end(state.backoff_stream(log), "update")
    return rows.groupBy("key").agg(F.max_by(F.struct("fail_count", "last_ms", "next_retry_at"), "last_ms").alias("x")).select("key", "x.*")


def dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _stream(spark, sf_dir, "documents").select(F.sha1(F.coalesce("text", F.lit(""))).alias("guid"), "doc_id", F.timestamp_millis(F.lit(A.NOW_MS)).alias("arrived"))
    return _to_end(state.dedupe_stream(d), "append").select("guid")


def watches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each micro-batch of arriving documents is searched by the standing queries, whose markers then move on."""
    listed = spark.createDataFrame([(1, "common", "the", None, None), (2, "licenses", "license apache", None, None)], "watch_id int, name string, query string, last_run long, last_hits long")
    _, hits = run_watches(_stream(spark, sf_dir, "documents"), listed, A.NOW_MS)
    return hits.groupBy("watch_id").agg(F.sum("hits").alias("hits"))


def run_watches(documents: DataFrame, listed: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """The watches after the stream's end, and watch_id, hits, batch of every micro-batch.

    Both are written by batch number: a batch that runs again after a failure reads the watches of the batch before and
    writes the same folders. In a live job now_ms would be the batch's time; articles count by their publication.
    """
    spark = documents.sparkSession
    where = f"{work_folder(spark)}/watches-{uuid.uuid4().hex}"
    listed.write.parquet(f"{where}/list/0")
    last = [0]

    def search(batch: DataFrame, number: int) -> None:
        known = spark.read.schema(listed.schema).parquet(f"{where}/list/{number}")
        rows = batch.select(F.col("doc_id").alias("id"), F.lit(now_ms + number).alias("pub_date"), F.substring(F.split("text", "\n")[0], 1, 80).alias("title"), F.col("text").alias("content"))
        state.watch_hits(rows, known, now_ms + number).write.mode("overwrite").parquet(f"{where}/hits/batch={number}")
        hits = spark.read.parquet(f"{where}/hits/batch={number}")
        state.advanced(known, hits).write.mode("overwrite").parquet(f"{where}/list/{number + 1}")
        last[0] = number + 1

    q = documents.writeStream.foreachBatch(search).option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    hits = spark.read.option("basePath", f"{where}/hits").parquet(f"{where}/hits") if last[0] else spark.createDataFrame([], "watch_id int, hits long, batch int")
    return spark.read.schema(listed.schema).parquet(f"{where}/list/{last[0]}"), hits.select("watch_id", "hits", "batch")
