"""A written index of chunks that all searches share: postings, vocabulary with stems, chunk lengths; kept up by deltas."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepress.functions import text as T
from tidepress.functions.stemming import stem
from tidepress.sources import parsers
from tidepress.storage import Tables, bound_batches, spread

#: Chunks of one entry have ids from entry id x SPAN on.
SPAN = 1 << 20
#: Ids of chunks that went are broadcast up to so many.
GONE = 2_000_000


def chunk_rows(rows: DataFrame, size: int = 800, overlap: int = 120, titled: bool = False) -> DataFrame:
    """chunk_id, entry_id, chunk_index, text, heading (and the article's title) of articles id, title, summary, content."""
    made = parsers.chunks(spread(rows.select("id", "title", "summary", "content")), size, overlap, titled)
    return made.select((F.col("entry_id") * SPAN + F.col("chunk_index")).alias("chunk_id"), "entry_id", "chunk_index", "text", "heading", *(["title"] if titled else []))


def _stems(terms: DataFrame) -> DataFrame:
    return terms.withColumn("stem", F.pandas_udf(lambda s: pd.Series([stem(x) for x in s], index=s.index, dtype=object), "string")("term"))


def postings_of(chunks: DataFrame) -> DataFrame:
    """term, chunk_id, dl, tf: a row for each word of each chunk, counted where the chunk lies, each batch in order of term."""
    bound_batches(chunks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(1).value_lengths().to_numpy()
            words = batch.column(1).flatten().dictionary_encode()
            if not len(words):
                continue
            order = pc.sort_indices(words.dictionary).to_numpy()
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            cells, tf = np.unique(place[words.indices.to_numpy()] * len(size) + np.repeat(np.arange(len(size)), size), return_counts=True)
            term, row = np.divmod(cells, len(size))
            columns = [words.dictionary.take(pa.array(order[term])), batch.column(0).take(pa.array(row)), pa.array(size[row], pa.int32()), pa.array(tf, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["term", "chunk_id", "dl", "tf"])

    kind = chunks.schema["chunk_id"].dataType.simpleString()
    return chunks.select("chunk_id", T.tokens(F.col("text")).alias("words")).mapInArrow(run, f"term string, chunk_id {kind}, dl int, tf long")


def vocabulary_of(postings: DataFrame) -> DataFrame:
    """term, stem, df: the stemmer runs once a word."""
    return _stems(postings.groupBy("term").agg(F.count("*").alias("df")))


def lengths_of(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", F.size(T.tokens(F.col("text"))).alias("dl"), F.greatest(F.length("text") - 2, F.lit(0)).alias("width"))


@dataclass
class Index:
    chunks: DataFrame
    postings: DataFrame
    vocabulary: DataFrame
    lengths: DataFrame

    @staticmethod
    def build(spark: SparkSession, chunks: DataFrame, path: str | None = None) -> Index:
        """Writes the index of chunks (chunk_id, entry_id, chunk_index, text, heading): one pass to tokenise, nothing shuffled."""
        out = Tables(spark, "index", path)
        kept = out.write(chunks, "chunks")
        postings = out.write(postings_of(kept), "postings")
        return Index(kept, postings, out.write(vocabulary_of(postings), "vocabulary"), out.write(lengths_of(kept), "lengths"))

    @staticmethod
    def open(spark: SparkSession, path: str) -> Index:
        out = Tables(spark, "index", path)
        return Index(*(out.read(x) for x in ("chunks", "postings", "vocabulary", "lengths")))

    def changed(self, spark: SparkSession, fresh: DataFrame, gone: DataFrame, path: str | None = None) -> Index:
        """The index after `fresh` chunks came (those of a known chunk_id replace it) and those of `gone` (chunk_id) went.

        Only fresh chunks are tokenised and only new words are stemmed. With a path what stays is copied there; without
        one the chunks, postings and lengths read the old tables, less what went, and the new ones.
        """
        out = Tables(spark, "index", path)
        new = out.write(fresh, "fresh")
        away = out.write(gone.select("chunk_id").union(new.select("chunk_id")).distinct(), "away")
        away = F.broadcast(away) if away.count() <= GONE else away
        left = lambda df: df.join(away, "chunk_id", "left_anti")
        kept = (lambda df, name: out.write(df, name)) if path else (lambda df, name: df)
        chunks = kept(left(self.chunks).unionByName(new), "chunks")
        postings = kept(left(self.postings).unionByName(out.write(postings_of(new), "new_postings")), "postings")
        counts = postings.groupBy("term").agg(F.count("*").alias("df"))
        stemmed = F.pandas_udf(lambda t, s: pd.Series([stem(x) if y is None else y for x, y in zip(t, s, strict=True)], index=t.index, dtype=object), "string")
        words = counts.join(self.vocabulary.select("term", "stem"), "term", "left").select("term", "df", stemmed("term", "stem").alias("stem"))
        return Index(chunks, postings, out.write(words, "vocabulary"), kept(left(self.lengths).unionByName(lengths_of(new)), "lengths"))
