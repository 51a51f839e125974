"""Near copies by exact Jaccard similarity of word shingles, with SimHash and min-wise candidates.

Two bits of a 64-bit SimHash reach texts that differ in a word or so of hundreds; at a shingle similarity of 0.8 the
fingerprints mostly lie 5 to 16 bits apart. So SimHash links are joined by min-wise band candidates, and both are verified;
a crowded band's members that stay in several groups are then compared by an exact prefix join. Different texts are
different nodes: a node is numbered by its text's 128-bit digest, never by a hash that two texts may share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Store, bound_batches, free_name, parallelism
from .components import components
from .simhash import SEED, fingerprint, links, shingles

WIDTH = 5
SIMILARITY = 0.8
#: A pair at similarity 0.8 agrees in a band with probability 0.8^4 = 0.41, so misses all 20 once in 38,000 times.
BANDS, ROWS = 20, 4
#: Keys are broadcast up to this many, each of at most 40 bytes (digest, node, doc_id); beyond, the join shuffles.
BROADCAST_ROWS = 500_000
#: Members verified against one copy of a centre's text.
SHARE = 500
_MIX = np.random.default_rng(2024).integers(1, 1 << 62, (2, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _hashes(text: str | None, width: int) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, SEED) for s in shingles(text, width)], np.uint64)


def bands_of(hashes: np.ndarray) -> np.ndarray:
    """A key for each band: equal where ROWS minima over the set are equal. None for an empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 4096):
        h = hashes[i : i + 4096, None]
        x = (h ^ (h >> np.uint64(29))) * _MIX[0] + _MIX[1]
        low = np.minimum(low, (x ^ (x >> np.uint64(32))).min(axis=0))
    key = np.arange(BANDS, dtype=np.uint64)
    for m in low.reshape(BANDS, ROWS).T:
        key = (key ^ m) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def digest_of(text: Column) -> Column:
    """16 bytes that tell texts apart; null and empty text are alike."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _sketch(spark: SparkSession, docs: DataFrame, width: int) -> DataFrame:
    bound_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_hashes(t, width) for t in batch.column(2).to_pylist()]
            fp = np.array([fingerprint(h) for h in found], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(fp), pa.array([bands_of(h) for h in found], pa.list_(pa.int64()))], ["doc_id", "digest", "fp", "bands"]
            )

    return docs.select("doc_id", "digest", "text").mapInArrow(run, "doc_id long, digest binary, fp long, bands array<long>")


def candidates(spark: SparkSession, store: Store, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rep, node: first pairs to verify; key, n, node: the members of shared band buckets and how many a bucket has.

    Each bucket links its members to two of them: the one that shares most buckets (the centre of its copies) and the
    one of the smallest doc_id; so the pairs grow with the rows, not their square. The buckets' other pairs are left to
    `remainder`."""
    rows = store.write(nodes.select("node", F.explode("bands").alias("key")), "bands")
    shared = rows.join(rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "key")
    live = store.write(shared.join(nodes.select("node", "least"), "node"), "live")
    score = live.groupBy("node").agg(F.sum("n").alias("s"))
    centre = (
        live.join(score, "node")
        .groupBy("key")
        .agg(F.max_by("node", F.struct("s", (-F.coalesce("least", F.lit(0))).alias("l"), "node")).alias("c"), F.min_by("node", F.struct("least", "node")).alias("f"))
    )
    by_band = live.select("key", "node").join(centre, "key").select(F.explode(F.array("c", "f")).alias("rep"), "node")
    heads = nodes.groupBy("fp").agg(F.min("node").alias("head"))
    same = nodes.join(heads, "fp").select(F.col("head").alias("rep"), "node")
    near = links(spark, heads.select("fp"), store)  # with the stars of crowded cells: candidates besides the bands, not instead of them
    by_print = (
        near.join(heads.select(F.col("fp").alias("a"), F.col("head").alias("rep")), "a").join(heads.select(F.col("fp").alias("b"), F.col("head").alias("node")), "b").select("rep", "node")
    )
    return by_band.union(same).union(by_print).filter("rep <> node").distinct(), live.select("key", "n", "node")


def _texts(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, text of the wanted nodes: of equal texts one row goes on, that of the smallest doc_id."""
    keys = nodes.select("node", "digest", "least").join(wanted, "node")
    if wanted.count() <= BROADCAST_ROWS:  # only their texts cross the network
        keys = F.broadcast(keys)
    return docs.join(keys, "digest").filter(F.col("doc_id").eqNullSafe(F.col("least"))).select("node", "text")


def remainder(spark: SparkSession, store: Store, docs: DataFrame, nodes: DataFrame, live: DataFrame, joined: DataFrame, width: int, similarity: float) -> DataFrame | None:
    """rep, node: the pairs still to verify, given the groups that the first pairs joined. None where there are none.

    Only a bucket of more than two members and more than one group can hide a pair. The members of all these buckets
    are joined by prefixes, which loses no pair: with shingles ordered rarest first, sets of that similarity share one
    among the first size - ceil(similarity x size) + 1 of each, and their sizes are as near. Boilerplate is frequent, so
    it comes last and pairs nobody. Groups are paired before their members are, so a large group that shares a shingle
    with a few other texts makes its members times those few pairs, and none within itself.
    """
    grouped = live.filter("n > 2").join(joined, "node", "left").withColumn("group", F.coalesce("component", "node"))
    several = lambda rows, key: rows.groupBy(key).agg(F.min("group").alias("a"), F.max("group").alias("b")).filter("a <> b").select(key)
    left = store.write(grouped.join(several(grouped, "key"), "key").select("node", "group").distinct(), "left")
    if left.isEmpty():
        return None
    bound_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(_hashes(t, width)).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(h) for h in found], pa.int32()), pa.array(found, pa.list_(pa.int64()))], ["node", "size", "hashes"])

    sets = store.write(_texts(docs, nodes, left.select("node")).mapInArrow(run, "node long, size int, hashes array<long>"), "sets")
    rows = sets.select("node", "size", F.explode("hashes").alias("hash"))
    # A shingle of one set alone takes its place in the prefix but pairs nobody.
    often = rows.groupBy("hash").agg(F.count("*").alias("often")).filter("often > 1")
    own = Window.partitionBy("node")
    place = rows.join(often, "hash").withColumn("place", F.row_number().over(own.orderBy("often", "hash"))).withColumn("shared", F.count("*").over(own))
    long = F.col("size") - F.ceil(similarity * F.col("size") - 1e-6) + 1
    prefix = place.filter(F.col("place") + F.col("size") - F.col("shared") <= long).select("hash", "node", "size").join(left, "node")
    prefix = store.write(prefix.select("hash", "group", "node", "size"), "prefixes")
    prefix = prefix.join(several(prefix, "hash"), "hash")
    ranges = prefix.groupBy("hash", "group").agg(F.min("size").alias("lo"), F.max("size").alias("hi"))
    apart = ranges.alias("x").join(ranges.alias("y"), "hash").filter("x.group < y.group")
    apart = apart.filter(F.expr(f"x.hi >= {similarity} * y.lo - 1e-6 and y.hi >= {similarity} * x.lo - 1e-6")).select("hash", F.col("x.group").alias("group"), F.col("y.group").alias("g"))
    other = prefix.select("hash", F.col("group").alias("g"), F.col("node").alias("rep"), F.col("size").alias("s"))
    near = F.least("size", "s") >= similarity * F.greatest("size", "s") - 1e-6
    pairs = apart.join(prefix, ["hash", "group"]).join(other, ["hash", "g"]).filter(near)
    return store.write(pairs.select("rep", "node").distinct(), "pairs-left")


def verified(spark: SparkSession, store: Store, docs: DataFrame, nodes: DataFrame, pairs: DataFrame, width: int, similarity: float) -> DataFrame:
    """Edges (a, b) of the pairs whose shingle sets have at least that Jaccard similarity, over whole texts.

    Members stream past their centre's set, at most SHARE to a copy of the centre, so no group is held anywhere and a
    hot one spreads over tasks.
    """
    parts = pairs.groupBy("rep").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / SHARE)).cast("int").alias("parts"))
    member = pairs.join(parts, "rep").select("rep", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), "node")
    centre = parts.select("rep", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("rep").alias("node"))
    wanted = store.write(member.union(centre), "wanted")
    named = _texts(docs, nodes, wanted.select("node").distinct())
    texts = named.join(wanted, "node").select("rep", "part", (F.col("node") != F.col("rep")).cast("int").alias("turn"), "node", "text")
    ordered = texts.repartition(2 * parallelism(spark), "rep", "part").sortWithinPartitions("rep", "part", "turn")
    bound_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, own, size = None, None, 0
        for batch in batches:
            rep, part, turn, node = (batch.column(i).to_pylist() for i in range(4))
            a, b = [], []
            for i, text in enumerate(batch.column(4).to_pylist()):
                here = np.unique(_hashes(text, width))
                if (rep[i], part[i]) != group:
                    if turn[i]:
                        raise ValueError("a member comes before its centre")
                    group, own, size = (rep[i], part[i]), here, len(here)
                elif turn[i]:
                    both = len(np.intersect1d(own, here, assume_unique=True))
                    if both >= similarity * (size + len(here) - both):
                        a.append(rep[i]), b.append(node[i])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return store.write(ordered.mapInArrow(run, "a long, b long"), "edges")


def drop_near_copies(spark: SparkSession, docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """docs without near copies: of each group linked by verified pairs or equal texts, the row of smallest doc_id.

    All columns are kept, whatever their names. Null text counts as empty, and texts without a word are copies of each
    other; null doc_ids come last; of rows with one doc_id and text one stays. An empty table stays empty.
    """
    store = Store(spark, "near-copies")
    slim = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", digest_of(F.col("text")))
    sketches = store.write(_sketch(spark, slim, width), "sketches")
    nodes = sketches.groupBy("digest").agg(F.min("doc_id").alias("least"), F.any_value("fp").alias("fp"), F.any_value("bands").alias("bands"))
    nodes = store.write(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")  # written: the numbers stay
    pairs, live = candidates(spark, store, nodes)
    pairs = store.write(pairs, "pairs-to-verify")
    edges = verified(spark, store, slim, nodes, pairs, width, similarity)
    joined = components(store, edges)
    later = Store(spark, "near-copies-left")
    rest = remainder(spark, later, slim, nodes, live, joined, width, similarity)
    if rest is not None:
        joined = components(later, edges.union(verified(spark, later, slim, nodes, rest, width, similarity)))
    grouped = nodes.join(joined, "node", "left").select("digest", "least", F.coalesce("component", "node").alias("group"))
    order = F.struct(F.col("least").isNull(), "least", "digest")
    stays = grouped.groupBy("group").agg(F.min_by(F.struct("digest", "least"), order).alias("x")).select("x.digest", "x.least", F.lit(True).alias("x"))
    stays = store.write(stays, "stays")
    rows = sketches.groupBy("digest", "doc_id").agg(F.count("*").alias("n"))
    stay = F.coalesce(F.col("doc_id").eqNullSafe(F.col("least")) & F.col("x").isNotNull(), F.lit(False))
    fate = store.write(rows.join(stays, "digest", "left").withColumn("stay", stay).select("digest", "doc_id", "n", "stay"), "fate")
    gone, repeated = fate.filter("not stay"), fate.filter("stay and n > 1")
    own, turn = free_name(docs.columns, "own_digest"), free_name(docs.columns, "own_turn")
    keyed = docs.withColumn(own, digest_of(F.col("text")))
    same = lambda o: (F.col(own) == o["digest"]) & docs["doc_id"].eqNullSafe(o["doc_id"])
    if repeated.isEmpty() and gone.count() <= BROADCAST_ROWS:
        lost = F.broadcast(gone.select("digest", "doc_id"))
        return keyed.join(lost, same(lost), "left_anti").select(*docs.columns)
    kept = fate.filter("stay").select("digest", "doc_id")
    once = Window.partitionBy(own).orderBy("doc_id")
    return keyed.join(kept, same(kept), "left_semi").withColumn(turn, F.row_number().over(once)).filter(F.col(turn) == 1).select(*docs.columns)
