"""Embedding of chunks by a pluggable model, what still lacks a vector, and the guard against mixed models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepress.functions import text as T

STYLE = "contextual-v2"
#: Takes texts, gives (index, vector) pairs in any order.
Embedder = Callable[[list[str]], list[tuple[int, list[float]]]]


def char_hash(dim: int = 16) -> Embedder:
    """The deterministic stand-in for a model: code point plus one added up at the position modulo dim, of unit length."""

    def run(texts: list[str]) -> list[tuple[int, list[float]]]:
        out = []
        for i, t in enumerate(texts):
            v = np.bincount(np.arange(len(t)) % dim, [ord(c) + 1 for c in t], dim)
            out.append((i, (v / max(float(np.linalg.norm(v)), 1e-300)).tolist()))
        return out[::-1]

    return run


def embed(rows: DataFrame, embedder: Embedder, text: str = "text", batch: int = 16) -> DataFrame:
    """rows with embedding (array of doubles), `batch` texts a call, put in order by the answer's index.

    A batch that fails, or leaves a text out, gives nulls and the others go on, so a later run can fill the gaps; null
    texts have no vector. How many calls run at once is the number of partitions.
    """
    names = rows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "embedding") + ", embedding array<double>"
    kept = [c for c in names if c != "embedding"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            vectors: list[list[float] | None] = [None] * len(pdf)
            some = [i for i, t in enumerate(pdf[text]) if t is not None]
            for at in range(0, len(some), batch):
                part = some[at : at + batch]
                try:
                    for i, v in embedder([pdf[text].iloc[j] for j in part]):
                        vectors[part[i]] = v
                except Exception:  # noqa: BLE001 - any model error leaves a gap that is filled later
                    continue
            out = pdf[kept].copy()
            out["embedding"] = pd.Series(vectors, index=out.index, dtype=object)
            yield out

    return rows.select(kept).mapInPandas(run, schema)


def inputs(chunks: DataFrame, articles: DataFrame, model: str | None = None, is_query: bool = False) -> DataFrame:
    """chunk_id, entry_id, text, input: what the model is given, title and heading in front, by the model's prefix."""
    return titled(chunks.join(articles.select(F.col("id").alias("entry_id"), "title"), "entry_id"), model, is_query)


def titled(chunks: DataFrame, model: str | None = None, is_query: bool = False) -> DataFrame:
    """inputs() of chunks that have their article's title."""
    prefix = T.embed_prefix(F.lit(model).cast("string"), F.lit(is_query))
    return chunks.select("chunk_id", "entry_id", "text", F.concat(prefix, T.contextual(F.col("title"), F.col("heading"), F.col("text"))).alias("input"))


def gaps(articles: DataFrame, chunks: DataFrame, style: str = STYLE) -> DataFrame:
    """id, gap: chunks without a vector or of another style (by entry), and articles without any chunk."""
    gap = F.when(F.col("embedding").isNull(), "no-vector").when(F.coalesce("embed_style", F.lit("")) != style, "stale-style")
    bare = articles.select("id").join(chunks.select(F.col("entry_id").alias("id")), "id", "left_anti").select("id", F.lit("no-chunks").alias("gap"))
    return chunks.select(F.col("entry_id").alias("id"), gap.alias("gap")).filter("gap is not null").union(bare)


def fill(spark: SparkSession, chunks: DataFrame, articles: DataFrame, embedder: Embedder, limit: int | None = None, style: str = STYLE, model: str | None = None) -> DataFrame:
    """chunks (chunk_id, entry_id, text, heading, embedding, embed_style) with vectors for those that lack one.

    The first `limit` gaps by chunk_id are filled (all without one); what fails stays a gap. Run again until `gaps` is
    empty or the count stays: each run is a bounded batch of a backfill.
    """
    stale = chunks.filter(F.col("embedding").isNull() | (F.coalesce("embed_style", F.lit("")) != style)).select("chunk_id")
    chosen = stale.orderBy("chunk_id").limit(limit) if limit is not None else stale
    made = embed(inputs(chunks.join(chosen, "chunk_id", "left_semi"), articles, model), embedder, "input").select("chunk_id", F.col("embedding").alias("fresh"))
    j = chunks.join(made, "chunk_id", "left")
    return j.select(*(c for c in chunks.columns if c not in ("embedding", "embed_style")), F.coalesce("fresh", F.col("embedding").cast("array<double>")).alias("embedding"), F.when(F.col("fresh").isNotNull(), F.lit(style)).otherwise(F.col("embed_style")).alias("embed_style"))


def cleared(chunks: DataFrame) -> DataFrame:
    """All vectors taken away, as a change of models asks for: then fill() makes them anew."""
    return chunks.withColumns({"embedding": F.lit(None).cast("array<double>"), "embed_style": F.lit(None).cast("string")})


def coverage(chunks: DataFrame, style: str = STYLE) -> DataFrame:
    """chunks, embedded, stale, dims: one row; more than one dim means that models were mixed."""
    return chunks.agg(
        F.count("*").alias("chunks"), F.count("embedding").alias("embedded"), F.count_if(F.col("embedding").isNotNull() & (F.coalesce("embed_style", F.lit("")) != style)).alias("stale"), F.count_distinct(F.size("embedding")).alias("dims")
    )


def guard(meta: DataFrame, model: str, dim: int) -> DataFrame:
    """ok, reason: whether vectors of this model and size may join those that meta (model, dim: one row or none) tells of."""
    asked = meta.sparkSession.createDataFrame([(model, dim)], "asked string, asked_dim int")
    reason = F.when(F.col("model").isNull(), F.lit(None)).when(F.col("dim") != F.col("asked_dim"), "dimension").when(F.col("model") != F.col("asked"), "model")
    return asked.join(meta, F.lit(True), "left").select(reason.isNull().alias("ok"), reason.cast("string").alias("reason"))


def last_refresh(meta: DataFrame, articles: DataFrame) -> DataFrame:
    """at_ms: the marker of meta (key, value), a number or JSON with a timestamp; without one the newest cached_at; else 0."""
    value = F.coalesce(F.get_json_object("value", "$.timestamp").try_cast("bigint"), F.col("value").try_cast("bigint"))
    mark = meta.filter("key = 'last_refresh'").agg(F.max(value).alias("mark"))
    return mark.crossJoin(articles.agg(F.max("cached_at").alias("newest"))).select(F.coalesce("mark", "newest", F.lit(0)).cast("bigint").alias("at_ms"))


def first_rows(rows: DataFrame, group: str, order: str, most: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(order)
    return rows.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= most).drop("nth")
