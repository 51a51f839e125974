"""Retrieval quality, feed health, near-duplicate pairs."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepress.functions import text as T

#: Keys of fingerprints that one task sorts.
TASK_KEYS = 500_000


def retrieval_metrics(ranked: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """Means over the queries with relevant rows: recall at 1, 3, 5 and k, reciprocal rank, binary nDCG at k."""
    rel = qrels.groupBy("query_id").agg(F.count("*").alias("n"))
    hit = ranked.filter(F.col("rank") <= k).join(qrels, ["query_id", "chunk_id"]).select("query_id", "rank")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    m = rel.join(hit, "query_id", "left").groupBy("query_id", "n").agg(*(F.count_if(F.col("rank") <= i).alias(f"a{i}") for i in (1, 3, 5)), F.count("rank").alias("b"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    m = m.select(*((F.col(f"a{i}") / F.col("n")).alias(f"r{i}") for i in (1, 3, 5)), (F.col("b") / F.col("n")).alias("r10"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"), (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"))
    return m.agg(F.count("*").alias("queries"), *(F.round(F.avg(a), 6).alias(b) for a, b in (("r1", "recall_1"), ("r3", "recall_3"), ("r5", "recall_5"), ("r10", "recall_10"), ("rr", "mrr"), ("ndcg", "ndcg_10"))))


def regressions(rows: DataFrame, allowed: float = 0.05) -> DataFrame:
    return rows.select("metric", (F.col("current") - F.col("baseline") < -allowed).alias("regressed"))


def nearest_rank(rows: DataFrame, group: str, value: str) -> DataFrame:
    pick = lambda p: F.round(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})"), 6)
    return rows.groupBy(group).agg(pick(0.5).alias("p50"), pick(0.95).alias("p95"), F.count("*").alias("n"))


def feed_health(log: DataFrame, now_ms: int) -> DataFrame:
    last = log.groupBy("key").agg(F.max_by("ok", F.struct("at_ms", "seq")).alias("ok"), F.max("at_ms").alias("at"))
    rate = log.agg(F.round(F.count_if(~F.col("ok")) / F.nullif(F.count("*"), F.lit(0)), 6).alias("error_rate"))
    return last.agg(F.count("*").alias("feeds"), F.round(F.avg(F.col("ok").cast("int")), 6).alias("success"), F.round((F.lit(now_ms) - F.max("at")) / 3_600_000, 6).alias("freshness_hours")).crossJoin(rate)


def banded_pairs(prints: DataFrame, bits: int = 4, segments: int = 6) -> DataFrame:
    """id, other, bits: distinct fingerprints' pairs of at most `bits` differing bits, then rows by fingerprint.

    Of `segments` parts of the 64 bits a pair agrees in all but `bits` at least, so every choice of that many parts is
    a key: at 6 and 4, fifteen keys of 21 bits a fingerprint. Equal fingerprints are one node (its smallest id), so
    copies make no pairs among each other but one each to the first of them.
    """
    if not 0 <= bits < segments:
        raise ValueError("there must be more segments than bits")
    known = prints.filter("simhash is not null").select("id", "simhash")
    heads = known.groupBy("simhash").agg(F.min("id").alias("head"))
    edges = [64 * i // segments for i in range(segments + 1)]
    masks = [sum(((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in part) for part in combinations(range(segments), segments - bits)]
    signed = [m - (1 << 64) * (m >> 63) for m in masks]
    keys = F.explode(F.array(*(F.struct(F.lit(i).alias("band"), F.col("simhash").bitwiseAND(F.lit(m)).alias("value")) for i, m in enumerate(signed))))
    # As many parts as keep a task's share the same, whatever the rows: left to itself, the join is cut by bytes.
    parts = max(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-prints.count() * len(masks) // TASK_KEYS))
    a = heads.select(F.col("head").alias("id"), "simhash", keys.alias("b")).select("id", "simhash", "b.*").repartition(parts, "band", "value")
    o = a.select(F.col("id").alias("other"), F.col("simhash").alias("s2"), "band", "value")
    far = F.bit_count(F.col("simhash").bitwiseXOR(F.col("s2")))
    between = a.join(o, ["band", "value"]).filter((F.col("id") < F.col("other")) & (far <= bits)).select("id", "other", far.alias("bits")).distinct()
    copies = known.join(heads, "simhash").filter("id <> head").select(F.col("head").alias("id"), F.col("id").alias("other"), F.lit(0).alias("bits"))
    return between.union(copies)


def likeness_pairs(rows: DataFrame, at_least: float = 0.6) -> DataFrame:
    """id, other, likeness: pairs of Jaccard likeness of at least `at_least` between word sets (id, words), one row a pair.

    Rows of equal sets are one class, its smallest id: each of the others is paired with that one only. Classes are
    found by a prefix join: with words ordered rarest first, sets that alike share one of the first
    size - ceil(at_least x size) + 1 of each, so frequent words pair nobody. Empty sets are like nothing.
    """
    sets = rows.select("id", F.array_sort("words").alias("words")).filter(F.size("words") > 0)
    classes = sets.groupBy("words").agg(F.min("id").alias("head")).withColumn("size", F.size("words"))
    copies = sets.join(classes, "words").filter("id <> head").select(F.col("head").alias("id"), F.col("id").alias("other"), F.lit(1.0).alias("likeness"))
    each = classes.select("head", F.explode("words").alias("word"))
    ranked = each.join(each.groupBy("word").agg(F.count("*").alias("often")), "word").groupBy("head").agg(F.array_sort(F.collect_list(F.struct("often", "word"))).alias("ranked"))
    named = ranked.select("head", F.size("ranked").alias("size"), F.col("ranked.word").alias("words"))
    first = named.select("head", "size", "words", F.posexplode(F.slice("words", F.lit(1), (F.col("size") - F.ceil(at_least * F.col("size") - 1e-9) + 1).cast("int"))).alias("place", "word"))
    other = first.select("word", F.col("head").alias("other"), F.col("size").alias("other_size"), F.col("words").alias("other_words"), F.col("place").alias("other_place"))
    # At their first common word two sets have at most what lies from there on in common. Sets are compared where they meet, so
    # that only pairs that are alike leave the join.
    most = F.least(F.col("size") - F.col("place"), F.col("other_size") - F.col("other_place"))
    common = F.size(F.array_intersect("words", "other_words"))
    alike = lambda n: n / (F.col("size") + F.col("other_size") - n)
    fits = (F.col("head") < F.col("other")) & (F.least("size", "other_size") >= at_least * F.greatest("size", "other_size") - 1e-9) & (alike(most) >= at_least - 1e-9)
    near = first.join(other, "word").filter(fits).filter(alike(common) >= at_least - 1e-9)
    return near.select(F.col("head").alias("id"), "other", alike(common).alias("likeness")).distinct().union(copies)


def passages_in(texts: DataFrame, passages: DataFrame) -> DataFrame:
    """query_id, chunk_id: the texts (chunk_id, text) that contain a passage (query_id, query) letter by letter.

    A passage's inner words stand whole in such a text, so its rarest one leads to the texts that are compared. Passages
    of fewer than three words have none and are compared with every text.
    """
    inner = passages.withColumn("inner", F.array_distinct(F.expr("slice(words, 2, greatest(size(words) - 2, 0))"))) if "words" in passages.columns else None
    if inner is None:
        return passages_in(texts, passages.withColumn("words", T.tokens(F.col("query"))))
    asked = inner.select("query_id", F.explode("inner").alias("word"))
    found = texts.select("chunk_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("word")).join(asked.select("word").distinct(), "word", "left_semi")
    often = found.groupBy("word").agg(F.count("*").alias("often"))
    lead = asked.join(often, "word").groupBy("query_id").agg(F.min_by("word", F.struct("often", "word")).alias("word"))
    near = found.join(lead, "word").join(passages.select("query_id", "query"), "query_id").join(texts.select("chunk_id", "text"), "chunk_id")
    exact = near.filter(F.col("text").contains(F.col("query"))).select("query_id", "chunk_id")
    short = inner.filter(F.size("inner") == 0).select("query_id", "query")
    return exact.union(texts.join(short, F.col("text").contains(F.col("query"))).select("query_id", "chunk_id"))


def fingerprint(lines: DataFrame) -> DataFrame:
    """One row: 8 hexadecimal digits that stand for the column `line` of all rows, whatever their order."""
    part = F.conv(F.substring(F.sha2("line", 256), 1, 15), 16, 10).cast("bigint")
    total = lines.agg(F.count("*").alias("n"), F.coalesce(F.sum(part.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("s"), F.coalesce(F.bit_xor(part), F.lit(0).cast("bigint")).alias("x"))
    return total.select(F.substring(F.sha2(F.concat_ws("|", F.col("n").cast("string"), F.col("s").cast("string"), F.col("x").cast("string")), 256), 1, 8).alias("fingerprint"))


def hamming_pairs(prints: DataFrame, bits: int, block: int = 2000) -> DataFrame:
    """vec_id, other, bits: all pairs of prints (vec_id, halves lo and hi) of at most `bits` differing bits, compared block by block."""
    n = max(1, -(-prints.count() // block))
    rows = prints.withColumn("at", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int"))
    a = rows.withColumn("i", F.col("at")).withColumn("j", F.explode(F.sequence(F.col("at"), F.lit(n - 1)))).drop("at")
    o = rows.withColumn("j", F.col("at")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("at"))))
    o = o.select("i", "j", F.col("vec_id").alias("v"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    far = F.bit_count(F.col("lo").bitwiseXOR(F.col("lo2"))) + F.bit_count(F.col("hi").bitwiseXOR(F.col("hi2")))
    near = a.join(o, ["i", "j"]).filter(((F.col("i") < F.col("j")) | (F.col("vec_id") < F.col("v"))) & (F.col("vec_id") != F.col("v")) & (far <= bits))
    return near.select(F.least("vec_id", "v").alias("vec_id"), F.greatest("vec_id", "v").alias("other"), far.alias("bits"))
