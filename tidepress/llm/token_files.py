"""Token ids in ORC: run-length coded stripes with row indexes and Bloom filters on document ids."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Store, bound_batches, documents, parallelism
from .tokens import encoder

END_ID = 2
STRIPE_BYTES = 16 << 20
INDEX_ROWS = 1000


def write_token_files(spark: SparkSession, docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Writes doc_id, part, pos, n_tokens, ids in ascending doc_id order, one ORC file a range of ids.

    pos is the number of ids before the document in its file, so a file is written in one pass with nothing held back.
    Integers are run-length coded by the format (version 2); every stripe has a row index each INDEX_ROWS rows and a
    Bloom filter on doc_id. Null text counts as empty (just the end id), null ids come first, rows with one id lie in
    order of their text's hash; other columns are ignored. An empty table gives no rows.
    """
    bound_batches(spark)
    rows = docs.select("doc_id", "text")
    ranged = rows.repartitionByRange(parallelism(spark), "doc_id")
    sorted_rows = ranged.sortWithinPartitions("doc_id", F.xxhash64("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, pos = encoder(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4")
        for batch in batches:
            found = words.encode(batch.column(1).to_pylist())
            sizes = np.array([len(x) + 1 for x in found], np.int64)
            ids = np.concatenate([y for x in found for y in (x, end)]) if found else np.zeros(0, "<u4")
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.full(len(sizes), part, np.int32)),
                    pa.array(pos + offsets[:-1]),
                    pa.array(sizes),
                    pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.view("<i4"))),
                ],
                ["doc_id", "part", "pos", "n_tokens", "ids"],
            )
            pos += int(offsets[-1])

    (
        sorted_rows.mapInArrow(encode, "doc_id long, part int, pos long, n_tokens long, ids array<int>")
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.row.index.stride", INDEX_ROWS)
        .option("orc.stripe.size", STRIPE_BYTES)
        .option("compression", "zstd")
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """All rows, or those of some documents: the filter reaches the files, whose statistics and Bloom filters prune."""
    df = spark.read.orc(path)
    return df if doc_ids is None else df.filter(F.col("doc_id").isin(doc_ids))


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, part, pos, n_tokens and start (ids of all documents before it), read from the files without their ids."""
    rows = spark.read.orc(path).select("doc_id", "part", "pos", "n_tokens")
    return rows.join(F.broadcast(part_starts(spark, path)), "part").withColumn("start", F.col("base") + F.col("pos")).drop("base")


def part_starts(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: part, base (ids in the files before it)."""
    totals = spark.read.orc(path).groupBy("part").agg(F.max(F.col("pos") + F.col("n_tokens")).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def stripes(spark: SparkSession, path: str) -> DataFrame:
    """file, stripe, first_doc, last_doc, rows: one row a stripe, a task a stripe; no rows where there are no files.

    The files are listed by their folder; how many stripes each has comes from its footer, the rest from the column of
    document ids alone.
    """
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)
    names = [(x.getPath().toUri().toString(),) for x in found if x.getPath().getName().endswith(".orc")]
    files = spark.createDataFrame(names, "file string").repartition(max(1, len(names)))

    def opened(uri: str):
        from pyarrow import fs, orc

        system, name = fs.FileSystem.from_uri(uri if uri.startswith("file:///") or not uri.startswith("file:/") else "file://" + uri[5:])
        return orc.ORCFile(system.open_input_file(name))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(uri, i) for uri in batch.column(0).to_pylist() for i in range(opened(uri).nstripes)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.int32())], ["file", "stripe"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for batch in batches:
            out = []
            for uri, i in zip(*(batch.column(j).to_pylist() for j in (0, 1)), strict=True):
                ids = opened(uri).read_stripe(i, columns=["doc_id"]).column(0)
                ends = pc.min_max(ids)
                out.append((uri, i, ends["min"].as_py(), ends["max"].as_py(), len(ids)))
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], k) for j, k in enumerate(kinds)], ["file", "stripe", "first_doc", "last_doc", "rows"])

    found = files.mapInArrow(count, "file string, stripe int")
    return found.repartition(parallelism(spark), "file", "stripe").mapInArrow(look, "file string, stripe int, first_doc long, last_doc long, rows long")


def with_crc32(tokens: DataFrame) -> DataFrame:
    """doc_id, part, pos, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers).

    A row each, repeated and null doc_ids too; no rows for an empty table. ids must not be null.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            at = ids.offsets.to_numpy()
            raw = memoryview(ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(3)), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())],
                ["doc_id", "part", "pos", "n_tokens", "ids_crc32"],
            )

    return tokens.select("doc_id", "part", "pos", "ids").mapInArrow(digest, "doc_id long, part int, pos long, n_tokens long, ids_crc32 long")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Store(spark, "tokens").path("orc")
    write_token_files(spark, documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"))
    rows = with_crc32(read_tokens(spark, path)).join(F.broadcast(part_starts(spark, path)), "part")
    return rows.select("doc_id", (F.col("base") + F.col("pos")).alias("start"), "n_tokens", "ids_crc32")
