"""The frozen evaluation: a labelled corpus through the whole hybrid search. `python -m tidepress.plans.evaluate corpus.json`."""

from __future__ import annotations

import json
import sys
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepress.operators import archive as A
from tidepress.operators import embedding as E
from tidepress.operators import metrics as M
from tidepress.operators.postings import Index, chunk_rows

from .hybrid import hybrid


def labelled(spark: SparkSession, corpus: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Articles, queries and relevant pairs of a corpus {entries, queries: [{query, relevant}]}."""
    ids = {e["guid"]: i for i, e in enumerate(corpus["entries"], 1)}
    rows = [(ids[e["guid"]], e["guid"], e.get("feed_url"), e["title"], e.get("link"), e.get("author"), e["pub_date"], e.get("summary"), e["content"], e.get("tags") or [], e.get("collection"), None, False, False) for e in corpus["entries"]]
    schema = "id long, guid string, feed_url string, title string, link string, author string, pub_date long, summary string, content string, tags array<string>, collection string, source_type string, starred boolean, is_read boolean"
    queries = [(i, q["query"]) for i, q in enumerate(corpus["queries"], 1)]
    pairs = [(i, ids[g]) for i, q in enumerate(corpus["queries"], 1) for g in q["relevant"]]
    return spark.createDataFrame(rows, schema), spark.createDataFrame(queries, "query_id long, query string"), spark.createDataFrame(pairs, "query_id long, chunk_id long")


def evaluate(spark: SparkSession, corpus: dict, settings: A.Settings | None = None, dim: int = 16, now_ms: int | None = None, limit: int = 10) -> DataFrame:
    """One row of metrics at `limit`; chunks of 400 and one of context unless set otherwise; now is the corpus's date."""
    settings = settings or A.Settings(chunk_size=400, context_chunks=1)
    rows, queries, relevant = labelled(spark, corpus)
    index = Index.build(spark, chunk_rows(rows, settings.chunk_size, settings.chunk_overlap))
    vectors = E.embed(E.inputs(index.chunks, rows), E.char_hash(dim), "input").select("chunk_id", "embedding")
    asked = E.embed(queries, E.char_hash(dim), "query").select("query_id", "embedding")
    found = hybrid(spark, rows, queries, settings, limit, now_ms=now_ms or corpus.get("referenceDate", A.NOW_MS), vectors=vectors, query_vectors=asked, index=index)
    return M.retrieval_metrics(found.select("query_id", F.col("entry_id").alias("chunk_id"), F.col("position").alias("rank")), relevant, limit)


def main() -> None:
    spark = SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
    start = time.time()
    row = evaluate(spark, json.loads(Path(sys.argv[1]).read_text())).first()
    print(json.dumps(row.asDict() | {"seconds": round(time.time() - start, 1)}))


if __name__ == "__main__":
    main()
