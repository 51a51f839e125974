"""SimHash near-duplicates: a grid over segment popcounts finds candidates, exact bit counts decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Store, bound_batches, documents, parallelism
from .components import components

SEED = 42
MAX_BITS = 2
#: Cells of more members are refined to single bits instead of compared in pairs.
CELL = 48
ROWS = "fp long, other long"


def shingles(text: str | None, width: int) -> list[bytes]:
    """Runs of width words, repeats included; all words where they are fewer; none without words.

    A-Z become a-z; words are parted by the blank and the bytes 9 to 13, just what bytes.split() takes.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) < width:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)))


def fingerprint(hashes: np.ndarray) -> int:
    """64 bits, each set where it is in over half the hashes; 0 without any."""
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        part = hashes[i : i + (1 << 16)].astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(spark: SparkSession, docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long). Null, empty and wordless texts have fingerprint 0."""
    bound_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            out = np.empty(batch.num_rows, np.uint64)
            for i, t in enumerate(batch.column(1).to_pylist()):
                out[i] = fingerprint(np.array([digest(s, SEED) for s in shingles(t, width)], np.uint64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def grid_rows(prints: DataFrame) -> DataFrame:
    """cell, fp: every fingerprint in each cell within Manhattan distance 1 of its vector of 16 nibble popcounts.

    Popcounts of segments differ in sum by at most the differing bits, so two fingerprints of at most 2 differing bits
    have vectors at most 2 apart, and those share a cell: 33 cells at most each, whatever the table's size. A cell's
    16 counts are packed into one long.
    """
    counts = [F.bit_count(F.shiftrightunsigned("fp", 4 * i).bitwiseAND(15)) for i in range(16)]
    packed = F.lit(0).cast("long")
    for i, c in enumerate(counts):
        packed = packed.bitwiseOR(F.shiftleft(c.cast("long"), 4 * i))
    at = prints.select("fp", packed.alias("v"))
    moves = [F.col("v")]
    for i in range(16):
        count = F.shiftrightunsigned("v", 4 * i).bitwiseAND(15)
        for d in (1, -1):
            moved = F.col("v").bitwiseXOR(F.shiftleft(count, 4 * i)).bitwiseOR(F.shiftleft(count + d, 4 * i))
            moves.append(F.when(count < 4 if d > 0 else count > 0, moved))
    return at.select("fp", F.explode(F.array(*moves)).alias("cell")).filter("cell is not null").select("cell", "fp")


def links(spark: SparkSession, prints: DataFrame, store: Store, max_bits: int = MAX_BITS, cell: int = CELL) -> DataFrame:
    """Edges (a, b) between distinct fingerprints of at most max_bits (0 to 2) differing bits that keep all components.

    Cells of up to `cell` members are compared pair by pair as they stream by, sorted; members of larger ones are
    linked through the finest grid, of single bits: all that lie within one bit of a word are within 2 bits of each
    other, so a star to the least of them loses no connection and makes no pairs. Stars are only exact for 2 bits;
    below, larger cells are linked through shared words instead.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("the grid finds up to 2 differing bits")
    rows = grid_rows(prints).repartition(2 * parallelism(spark), "cell").sortWithinPartitions("cell", "fp")
    bound_batches(spark)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs (fp, other) of small cells; (fp, null) for the members of large ones."""

        def pairs(c: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else np.zeros(0, int)
            size = np.diff(np.concatenate([first, [len(c)]]))
            large = np.repeat(size > cell, size)
            left, right = [], []
            x, y = c[~large], f[~large]
            for d in range(1, cell):
                same = x[d:] == x[:-d]
                if not same.any():
                    break
                near = same & (np.bitwise_count((y[d:] ^ y[:-d]).view(np.uint64)) <= max_bits)
                left.append(y[:-d][near])
                right.append(y[d:][near])
            p, q = (np.concatenate([*z, np.zeros(0, np.int64)]) for z in (left, right))
            if len(p):
                p, q = np.unique(np.stack([p, q]), axis=1)
            alone = np.unique(f[large])
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([p, alone])), pa.concat_arrays([pa.array(q), pa.nulls(len(alone), pa.int64())])], ["fp", "other"]
            )

        held_c, held_f = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for c, f in _gathered(batches, 1 << 14):
            c, f = np.concatenate([held_c, c]), np.concatenate([held_f, f])
            last = int(np.searchsorted(c, c[-1])) if len(c) else 0
            if len(c) - last > 4 * cell:  # a large cell goes on: its members so far are marked, more than `cell` stay to show its size
                mark = np.unique(f[last : len(f) - cell - 1])
                yield pa.RecordBatch.from_arrays([pa.array(mark), pa.nulls(len(mark), pa.int64())], ["fp", "other"])
                yield pairs(c[:last], f[:last])
                held_c, held_f = c[-cell - 1 :], f[-cell - 1 :]
            else:
                yield pairs(c[:last], f[:last])
                held_c, held_f = c[last:], f[last:]
        yield pairs(held_c, held_f)

    found = store.write(rows.mapInArrow(compare, ROWS), "pairs")
    crowded = found.filter("other is null").select("fp").distinct()
    if max_bits == 2:
        words = crowded.select("fp", F.explode(F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(_bit(i)) for i in range(64)))).alias("word"))
    elif max_bits == 1:  # two words one bit apart are equal but for that bit, set in both
        words = crowded.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseOR(_bit(i)).alias("w")) for i in range(64)))).alias("word"))
    else:
        words = crowded.select("fp", F.col("fp").alias("word"))
    hubs = words.groupBy("word").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    stars = words.join(hubs, "word").select(F.col("fp").alias("a"), F.col("hub").alias("b")).filter("a <> b").distinct()
    return found.filter("other is not null").select(F.col("fp").alias("a"), F.col("other").alias("b")).union(stars)


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[list[np.ndarray]]:
    """The columns of at least `rows` rows at a time, as arrays: small batches cost more than their rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield [np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(batch.num_columns)]
            held, n = [], 0
    if held:
        yield [np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(held[0].num_columns)]


def _bit(i: int):
    return F.lit((1 << i) - (1 << 64) * (i == 63))


def near_duplicates(spark: SparkSession, docs: DataFrame, width: int = 3, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable over links, itself included.

    Equal fingerprints are one node, so copies never make pairs. Rows with null doc_id keep their row and link others,
    but aren't counted as smallest; a component without any doc_id has component_id null. Repeated rows keep theirs.
    An empty table gives no rows; other columns are ignored.
    """
    store = Store(spark, "simhash")
    of_docs = store.write(fingerprints(spark, docs, width), "docs")
    nodes = store.write(of_docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    joined = components(store, links(spark, nodes.select("fp"), store, max_bits))
    named = nodes.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_print = store.write(named.select("fp", "component").join(least, "component").select("fp", "component_id"), "labels")
    return of_docs.join(by_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, documents(spark, sf_dir))
