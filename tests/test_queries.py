"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import importlib
import itertools
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepress.operators import archive as A
from tidepress.operators import metrics as M
from tidepress.operators import search as S
from tidepress.operators.postings import Index, chunk_rows
from tidepress.plans import registry
from tidepress.plans.evaluate import evaluate
from tidepress.sources.parsers import body_simhash

DATA = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations events"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(df):
    def text(v):
        if v is None or v is pd.NA or v != v:
            return "null"
        return str(v) if isinstance(v, str | bool) or type(v).__name__ == "bool" else f"{float(v):.5f}"

    return sorted(tuple(text(v) for v in r) for r in df.reindex(sorted(df.columns), axis=1).astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", registry.ORACLE_SQL)
@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_same_rows_as_sql(spark, duck, name):
    assert rows(registry.QUERIES[name](spark, DATA).toPandas()) == rows(duck.sql(registry.ORACLE_SQL[name]).df())


def test_entry_imports():
    assert set(registry.QUERIES) <= set(importlib.import_module("__spark_entry__").queries())


def test_pages_of_diversified_results_are_disjoint(spark):
    data = [(1, i, f"Title number {i} about {'rain' if i % 2 else 'sun'}", 1 - i / 50, body_simhash(f"text {i} of many words {i * 7}")) for i in range(30)]
    pool = spark.createDataFrame(data, "query_id long, entry_id long, title string, combined double, simhash long")
    one, two = (S.diversify(pool, 5, o, bits=0).toPandas().entry_id.tolist() for o in (0, 5))
    assert len(one) == len(two) == 5 and not set(one) & set(two)


def test_filters_with_nothing_given_hold(spark):
    e = A.entries(spark, DATA)
    assert e.filter(A.article_filter(after="no date")).count() == e.count() and e.filter(A.article_filter(within=[])).count() == 0


def test_near_prints_pair_across_blocks(spark):
    r = np.random.default_rng(4)
    lo, hi = (r.integers(0, 1 << 32, 300).tolist() for _ in range(2))
    got = M.hamming_pairs(spark.createDataFrame(list(zip(range(300), lo, hi, strict=True)), "vec_id long, lo long, hi long"), 24, block=40)
    far = lambda i, j: (lo[i] ^ lo[j]).bit_count() + (hi[i] ^ hi[j]).bit_count()
    assert sorted(map(tuple, got.collect())) == [(i, j, far(i, j)) for i, j in itertools.combinations(range(300), 2) if far(i, j) <= 24]


def test_near_prints_pair_across_labels(spark):
    label = {r["vec_id"]: r["label"] for r in A.table(spark, DATA, "embeddings").select("vec_id", "label").collect()}
    assert any(label[r["vec_id"]] != label[r["other"]] for r in registry.QUERIES["hamming_pairs_all"](spark, DATA).collect())


def test_near_print_bands_equal_brute_force(spark):
    r = np.random.default_rng(8)
    seeds = r.integers(0, 1 << 63, 8, dtype=np.uint64).tolist()
    prints = [int(np.uint64(s ^ int(np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 64, n).astype(np.uint64))) if n else s).astype(np.int64)) for s in seeds for n in (0, 1, 2, 3, 4, 5, 6, 8)]
    prints += prints[:3]
    got = {tuple(x) for x in M.banded_pairs(spark.createDataFrame(list(enumerate(prints)), "id long, simhash long")).collect()}
    first = {p: i for i, p in reversed(list(enumerate(prints)))}
    far = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    want = {(first[p], i, 0) for i, p in enumerate(prints) if first[p] != i}
    want |= {(a, b, far(prints[a], prints[b])) for a, b in itertools.combinations(sorted(first.values()), 2) if far(prints[a], prints[b]) <= 4}
    assert got == want


@pytest.mark.parametrize("most", [0, 50_000])
def test_vector_topk_ties_fall_by_id_whatever_the_batches(spark, most):
    r = np.random.default_rng(1)
    base = r.normal(size=8)
    data = [(i, (base + (1e-9 * r.normal(size=8) if i % 2 else 0)).tolist()) for i in range(60)] + [(100 + i, r.normal(size=8).tolist()) for i in range(40)]
    vectors = spark.createDataFrame(data, "chunk_id long, embedding array<double>").repartition(7)
    asked = spark.createDataFrame([(1, base.tolist()), (2, data[70][1])], "query_id long, embedding array<double>")
    got = S.vector_topk(spark, vectors, asked, 5, block=16, most=most).toPandas().sort_values(["query_id", "rank"])
    m = np.array([v for _, v in data])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    for q, v in ((1, base), (2, np.array(data[70][1]))):
        sim = np.round(m @ (v / np.linalg.norm(v)), 9)
        best = sorted(range(len(data)), key=lambda i: (-sim[i], data[i][0]))[:5]
        assert got[got.query_id == q].chunk_id.tolist() == [data[i][0] for i in best]


def small_corpus():
    topics = {"reef": "Coral reefs bleach when oceans warm and marine surveys follow the fish", "market": "Share prices rose as quarterly earnings beat what investors feared", "qubit": "Qubits stay entangled longer with error correction in new chips", "alpine": "Crampons and ropes hold on steep alpine ice in cold wind", "coffee": "Espresso from arabica beans tastes of fruit when roasted light"}
    rows = [{"guid": g, "title": f"About {g}", "link": f"https://e/{g}", "pub_date": 1767225600000 - i * 86400000, "content": f"{t}. " * 3} for i, (g, t) in enumerate(topics.items())]
    asked = [("marine surveys of coral", "reef"), ("quarterly earnings", "market"), ("entangled qubits", "qubit"), ("steep alpine ice", "alpine"), ("arabica espresso", "coffee")]
    return {"referenceDate": 1767225600000, "entries": rows, "queries": [{"query": q, "relevant": [g]} for q, g in asked]}


def test_labelled_corpus_is_found(spark):
    row = evaluate(spark, small_corpus()).first()
    assert row["queries"] == 5 and row["recall_5"] == 1 and row["mrr"] >= 0.9


def test_archive_searches_reads_and_keeps_lists(spark):
    from tidepress.api import Archive
    from tidepress.operators.embedding import char_hash
    from tidepress.plans.evaluate import labelled

    a = Archive(spark, labelled(spark, small_corpus())[0].withColumn("cached_at", F.col("pub_date")), embedder=char_hash())
    top = a.search("quarterly earnings", limit=3).orderBy("position").first()
    assert top["title"] == "About market" and "earnings" in top["snippet"] and "earnings" in top["context"]
    dated = a.search("quarterly earnings", limit=3, sort="date").orderBy("position").toPandas()
    assert dated.published.is_monotonic_decreasing
    assert a.search("coral reefs", limit=3, rerank=lambda q, t: len(t)).count() == 3
    assert a.search("alpine", within=[2]).filter("title <> 'About market'").count() == 0
    plain = Archive(spark, a.articles)
    assert [(r["title"], r["score"]) for r in plain.search("y en", limit=2).collect()] == [("About qubit", None)] and plain.search("y zz", limit=2).count() == 0
    assert a.get_article("https://e/reef").first()["title"] == "About reef" and a.recent(2).count() == 2
    a.set_state(refs=["https://e/reef"], starred=True)
    assert a.articles.filter("starred").count() == 1
    f = a.feeds
    assert f.add("https://n.example/f/", tags="x") is None and f.add("https://n.example/f") == "listed already" and f.add("ftp://x") and f.add(" ")
    assert len(f.import_opml(registry.OPML)) == 2 and "https://a.example/f" in f.export_opml(spark) and f.list(spark).count() == 3
    assert f.remove("https://n.example/f") and not f.remove("https://n.example")
    log = spark.createDataFrame([("k", 1, 1, True)], "key string, at_ms long, seq long, ok boolean")
    row = a.diagnostics(log).first()
    assert (row["verdict"], row["embedded"]) == ("healthy", row["chunks_all"]) and plain.diagnostics(log).first()["verdict"] == "limited"
    assert len(a.fingerprint()) == 8 and a.debug_search("coral").count() > 0


def test_hybrid_lists_equal_searches_without_an_index(spark):
    e = A.entries(spark, DATA)
    chunks = chunk_rows(e)
    index, q = Index.build(spark, chunks), registry.bench_queries(spark, DATA)
    key = lambda df: sorted((r["query_id"], r["chunk_id"], r["rank"], round(r["score"], 5)) for r in df.collect())
    assert key(S.indexed_words(index, q)) == key(S.bm25_words(chunks, q)) and key(S.indexed_substrings(index, q)) == key(S.bm25_substrings(chunks, q))
    assert key(S.indexed_words(index, q, stems=True)) == key(S.bm25_words(chunks, q, stems=True))


def test_watches_of_a_stream_report_once_and_move_on(spark, tmp_path):
    from tidepress.streaming import jobs

    for n, text in enumerate(["rain news\nabout rain", "rain again"]):
        spark.createDataFrame([(n, text)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    listed = spark.createDataFrame([(1, "r", "rain", None, None), (2, "n", "none", None, None)], "watch_id int, name string, query string, last_run long, last_hits long")
    after, hits = jobs.run_watches(stream, listed, 1000)
    assert sorted((r["watch_id"], r["last_run"], r["last_hits"]) for r in after.collect()) == [(1, 1001, 1), (2, 1001, 0)]
    assert sorted(r["hits"] for r in hits.filter("watch_id = 1").collect()) == [1, 1]


def test_recorded_feeds_are_read_attempt_by_attempt(spark, tmp_path):
    import json

    from tidepress.sources.fetch import FeedDataSource, request_headers

    spark.dataSource.register(FeedDataSource)
    body = {"https://a/f": [{"status": 429, "headers": {"Retry-After": "1"}}, {"status": 200, "headers": {"ETag": '"x"'}, "body": registry.RSS}], "https://b/f": {"status": 403}}
    (tmp_path / "r.json").write_text(json.dumps(body))
    got = spark.read.format("feeds").option("urls", "https://a/f,https://b/f,https://c/f").option("recorded", str(tmp_path / "r.json")).load().toPandas()
    assert sorted(zip(got.url, got.attempt, got.status, strict=True)) == [("https://a/f", 0, 429), ("https://a/f", 1, 200), ("https://b/f", 0, 403), ("https://c/f", 0, 0), ("https://c/f", 1, 0), ("https://c/f", 2, 0)]
    assert request_headers("feed", "me@x", '"e"')["If-None-Match"] == '"e"' and "me@x" in request_headers("page", "me@x")["User-Agent"]


def test_failed_embedding_batches_leave_gaps(spark):
    from tidepress.operators import embedding as E

    def model(texts):
        if "bad" in texts:
            raise OSError("down")
        return E.char_hash(4)(texts)

    rows = spark.createDataFrame([(i, None if i == 1 else "bad" if i == 40 else f"t{i}") for i in range(48)], "id long, text string").coalesce(1)
    got = E.embed(rows, model).toPandas().set_index("id")
    assert got.embedding.isna().tolist() == [i == 1 or 33 <= i for i in range(48)]
    np.testing.assert_allclose(got.embedding[7], dict(E.char_hash(4)(["t7"]))[0])


def test_small_files_are_joined(spark, tmp_path):
    from tidepress.operators import upkeep

    spark.range(1000).repartition(12).write.parquet(f"{tmp_path}/many")
    assert upkeep.compact(spark, f"{tmp_path}/many", f"{tmp_path}/one") and not upkeep.compact(spark, f"{tmp_path}/one", f"{tmp_path}/no")
    assert spark.read.parquet(f"{tmp_path}/one").count() == 1000 and upkeep.file_sizes(spark, f"{tmp_path}/one").count() == 1


def test_passages_are_found_as_by_contains(spark):
    texts = [(1, "The quick brown fox."), (2, "quick brown"), (3, "Xquick brown foxY"), (4, None)]
    asked = [(1, "quick brown fox"), (2, "brown"), (3, "brown fo"), (4, "own fox")]
    got = M.passages_in(spark.createDataFrame(texts, "chunk_id long, text string"), spark.createDataFrame(asked, "query_id long, query string"))
    want = sorted((q, c) for q, x in asked for c, t in texts if t and x in t)
    assert sorted(map(tuple, got.collect())) == want


def test_one_pass_lists_equal_the_joins(spark, monkeypatch):
    texts = [(1, "The nations relate; relational nation"), (2, None), (3, ""), (4, "anana banana nation ANANA"), (5, "İstanbul ñandú 12 nations' the the"), (6, "relating nation, banana")] + [(10 + i, f"nation {'ana' * (i % 5)} the w{i}") for i in range(40)]
    asked = [(1, "nation"), (2, "ana"), (3, "the nations"), (4, "relate nation"), (5, ""), (6, "ñandú 12"), (7, "absent nation")]
    chunks, q = spark.createDataFrame(texts, "chunk_id long, text string"), spark.createDataFrame(asked, "query_id long, query string")
    keep = spark.createDataFrame([(i,) for i, _ in texts if i % 2 == 0], "id long")
    key = lambda df: sorted((r["query_id"], r["chunk_id"], r["rank"], round(r["score"], 5)) for r in df.collect())
    kinds = ("words", "stems", "substrings")
    monkeypatch.setattr(S, "KNOWN", 8)
    one = {(k, part is None): key(df) for part in (None, keep) for k, df in S.bm25_lists(chunks, q, kinds, 7, part).items()}
    assert all(one.values())
    monkeypatch.setattr(S, "SMALL", 0)
    assert one == {(k, part is None): key(df) for part in (None, keep) for k, df in S.bm25_lists(chunks, q, kinds, 7, part).items()}


def test_postings_are_counted_without_a_shuffle_and_deltas_copy_only_with_a_path(spark, tmp_path):
    from tidepress.operators.postings import postings_of

    data = [(1, 1, 0, "b a b", ""), (2, 2, 0, None, ""), (3, 3, 0, "A ñ a-c", ""), (4, 4, 0, "running b", "")]
    chunks = spark.createDataFrame(data, "chunk_id long, entry_id long, chunk_index int, text string, heading string")
    made = postings_of(chunks)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    want = [("a", 1, 3, 1), ("a", 3, 4, 2), ("b", 1, 3, 2), ("b", 4, 2, 1), ("c", 3, 4, 1), ("running", 4, 2, 1), ("ñ", 3, 4, 1)]
    assert sorted(tuple(r) for r in made.select("term", "chunk_id", "dl", "tf").collect()) == want
    index, fresh = Index.build(spark, chunks), spark.createDataFrame([(1, 1, 0, "jumping c", "")], chunks.schema)
    rows_of = lambda i: [sorted(map(tuple, x.select(*sorted(x.columns)).collect()), key=str) for x in (i.chunks, i.postings, i.vocabulary, i.lengths)]
    whole = rows_of(Index.build(spark, chunks.filter("chunk_id not in (1, 4)").union(fresh)))
    for path in (None, f"{tmp_path}/index"):
        assert rows_of(index.changed(spark, fresh, chunks.filter("chunk_id = 4"), path)) == whole
    assert rows_of(Index.open(spark, f"{tmp_path}/index")) == whole


def test_alike_word_sets_equal_brute_force_and_only_they_leave_the_join(spark):
    r = np.random.default_rng(3)
    sets = [(i, sorted({f"w{int(x)}" for x in r.zipf(1.4, r.integers(0, 9)) % 40})) for i in range(150)]
    got = {(x["id"], x["other"]): x["likeness"] for x in M.likeness_pairs(spark.createDataFrame(sets, "id long, words array<string>")).collect()}
    head = {}
    for i, w in sets:
        head.setdefault(tuple(w), i)
    want = {(head[tuple(w)], i): 1.0 for i, w in sets if w and head[tuple(w)] != i}
    for (a, i), (b, j) in itertools.combinations([x for x in head.items() if x[0]], 2):
        if (s := len({*a} & {*b}) / len({*a, *b})) >= 0.6:
            want[min(i, j), max(i, j)] = s
    assert got == want


def test_batches_of_pages_are_bounded(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    seen = F.pandas_udf(lambda s: pd.Series([len(s)] * len(s)), "long")
    for name in ("html_to_text", "readable_text", "web_backfill_articles", "vector_topk"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
        registry.QUERIES[name](spark, DATA)
        assert spark.range(3000).coalesce(1).select(seen("id").alias("n")).agg(F.max("n")).first()[0] <= 1000


def test_fingerprint_keys_of_a_task_stay_few(spark, monkeypatch):
    monkeypatch.setattr(M, "TASK_KEYS", 50, raising=False)
    prints = spark.createDataFrame([(i, i * 7919) for i in range(200)], "id long, simhash long")
    assert "hashpartitioning(band#" in (p := M.banded_pairs(prints)._jdf.queryExecution().optimizedPlan().toString()) or "RepartitionByExpression [band" in p
    assert ", 60" in p
