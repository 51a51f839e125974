"""From raw documents to packed training sequences: five stages, each written and read again before the next.

Every stage takes null, empty and repeated rows, empty tables and any further columns; its docstring says what becomes
of them. All but the last return the columns they got.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidepress.llm import langid, near_copies, packing, pii, quality
from tidepress.llm.common import Store, documents

#: A document stays with at least this probability of label 1.
GOOD = quality.THRESHOLD
#: Pieces a sequence: what an attention kernel takes as boundaries in one row.
MAX_DOCUMENTS = 256


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines' random field gives a score of at least GOOD.

    Null, empty and blank texts are judged as without evidence, by the share of label 1 among the labelled; repeated
    rows fare alike. Without labels of both kinds nothing is known against any document: all stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = quality.fit(spark, docs, labels)
    return quality.keep_good(spark, docs, model, GOOD)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language, by their best mixture: those far less likely than its training texts go.

    Null and empty texts and those without a letter go; repeated rows fare alike. Without a row of known lang there is
    no language to be in: nothing stays.
    """
    model = langid.fit(spark, docs)
    return langid.keep_known(spark, docs, model, langid.floors(spark, docs, model))


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies: five words a shingle, similarity 0.8 or more.

    The smallest doc_id stays, null last. Null, empty and wordless texts are copies of each other; of wholly repeated
    rows one stays.
    """
    return near_copies.drop_near_copies(spark, docs)


def privacy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with pseudonyms in their texts; n_chars counts the new text. Null texts stay null."""
    return pii.with_pseudonyms(spark, docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids, sequence_id, offset of every token sequence: MAX_DOCUMENTS pieces in one at most.

    Null and empty texts are a separator each; null and repeated ids are rows like any others.
    """
    return packing.pack(spark, docs, public_tokenizers.path("word_bpe_49k.json"), max_documents=MAX_DOCUMENTS)


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", near_copy_stage),
    ("privacy", privacy_stage),
    ("packing", packing_stage),
]

#: The stages' models and token ids can't be written in SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, docs = Store(spark, "pipeline"), documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = store.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
