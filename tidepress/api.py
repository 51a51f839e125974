"""The archive as one object: searching, reading, feed lists and upkeep, each call a DataFrame or a plain value."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepress.functions import text as T
from tidepress.operators import archive as A
from tidepress.operators import embedding as E
from tidepress.operators import metrics as M
from tidepress.operators import search as S
from tidepress.operators import upkeep as U
from tidepress.operators.postings import Index, chunk_rows
from tidepress.plans.hybrid import hybrid, ranked_lists
from tidepress.sources import fetch, parsers
from tidepress.streaming import state


@dataclass
class Feeds:
    """The feed list (lines) and per-feed options."""

    lines: list[str] = field(default_factory=list)
    options: list[dict] = field(default_factory=list)

    def list(self, spark: SparkSession) -> DataFrame:
        schema = "url string, enabled boolean, tags string, collection string, refresh_hours int"
        rows = [tuple(o.get(c) for c in ("url", "enabled", "tags", "collection", "refresh_hours")) for o in self.options]
        return A.merge_feed_config(spark.createDataFrame([(x,) for x in self.lines], "line string"), spark.createDataFrame(rows, schema))

    def add(self, url: str, **options) -> str | None:
        """None where it was added, else the reason why not."""
        self.lines, why = U.add_feed(self.lines, url)
        if why is None and options:
            self.options = U.set_options(self.options, url.strip(), **options)
        return why

    def remove(self, url: str) -> bool:
        self.lines, self.options, found = U.remove_feed(self.lines, self.options, url)
        return found

    def configure(self, url: str, **options) -> None:
        self.options = U.set_options(self.options, url, **options)

    def test(self, answers: DataFrame, now_ms: int) -> DataFrame:
        return fetch.probe(answers, now_ms)

    def discover(self, results: DataFrame) -> DataFrame:
        return fetch.feed_candidates(results)

    def import_opml(self, xml: str, dry_run: bool = False) -> list[dict]:
        """The outline's feeds that are new, added with their tags unless dry_run."""
        new = []
        for x in parsers.parse_opml(xml):
            lines, why = U.add_feed(self.lines, x["url"])
            if why is None:
                new.append(x)
                if not dry_run:
                    self.lines = lines
                    if x["tags"]:
                        self.configure(x["url"], tags=x["tags"])
        return new

    def export_opml(self, spark: SparkSession) -> str:
        rows = self.list(spark).select("url", F.lit(None).cast("string").alias("title"), "collection")
        return fetch.export_opml(rows).first()["opml"]


@dataclass
class Archive:
    """articles: id, guid, feed_url, title, link, author, pub_date, summary, content, tags, collection, source_type, starred,
    is_read, cached_at. The index is built at the first search and kept for the next ones."""

    spark: SparkSession
    articles: DataFrame
    settings: A.Settings = field(default_factory=A.Settings)
    now_ms: int = A.NOW_MS
    feeds: Feeds = field(default_factory=Feeds)
    embedder: E.Embedder | None = None
    _index: Index | None = None
    _vectors: DataFrame | None = None

    def index(self) -> Index:
        if self._index is None:
            s = self.settings.clamped()
            self._index = Index.build(self.spark, chunk_rows(self.articles, s.chunk_size, s.chunk_overlap))
            if self.embedder:
                self._vectors = E.embed(E.inputs(self._index.chunks, self.articles), self.embedder, "input").select("chunk_id", "embedding")
        return self._index

    def _asked(self, query: str | list[str]) -> tuple[DataFrame, DataFrame | None]:
        texts = [query] if isinstance(query, str) else query
        rows = self.spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")
        return rows, E.embed(rows, self.embedder, "query").select("query_id", "embedding") if self.embedder else None

    def search(self, query: str | list[str], limit: int | None = None, offset: int = 0, sort: str = "relevance", rerank: Callable[[str, str], float] | None = None, **filters) -> DataFrame:
        """Hybrid search; filters: days, after, before, feed, author, tag, collection, starred, within."""
        asked, vectors = self._asked(query)
        return hybrid(self.spark, self.articles, asked, self.settings, limit, offset, self.now_ms, query_vectors=vectors, index=self.index(), vectors=self._vectors, sort=sort, rerank=rerank, **filters)

    def get_article(self, ref: int | str, offset: int = 0, max_chars: int = 12_000) -> DataFrame:
        return A.article_page(self.articles, ref, offset, max_chars)

    def recent(self, limit: int = 20) -> DataFrame:
        return A.recent(self.articles, limit)

    def set_state(self, ids: list[int] | None = None, refs: list[str] | None = None, starred: bool | None = None, is_read: bool | None = None) -> None:
        self.articles = A.set_state(self.articles, ids, refs, starred, is_read)

    def prune(self, feeds: DataFrame) -> None:
        """Articles of feeds that are no longer listed go; the index is made anew when it is next needed."""
        self.articles, self._index = A.prune(self.articles, feeds), None

    def retain(self, overrides: DataFrame, days: int | None = None) -> None:
        self.articles, self._index = A.retention(self.articles, overrides, self.now_ms, self.settings.retention_days if days is None else days, self.settings.web_retention_days), None

    def reembed(self, embedder: E.Embedder) -> None:
        self.embedder, self._index = embedder, None

    def debug_search(self, query: str) -> DataFrame:
        """query_id, chunk_id, rrf, score and the rank in each list."""
        asked, vectors = self._asked(query)
        index = self.index()
        fused = S.fuse(ranked_lists(self.spark, index, asked, self.settings.clamped(), None, self._vectors, vectors), self.settings.rrf_k)
        return fused.select("query_id", "chunk_id", F.round("rrf", 6).alias("rrf"), F.round("score", 3).alias("score"), "ranks")

    def run_watches(self, watches: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The watches with their markers moved on, and what each found."""
        hits = state.watch_hits(self.articles, watches, self.now_ms)
        return state.advanced(watches, hits), hits

    def diagnostics(self, log: DataFrame) -> DataFrame:
        """One row of indicators and a verdict; log: key, at_ms, seq, ok of fetches."""
        chunks = self.index().chunks.select("chunk_id", "entry_id", "text")
        chunks = chunks.join(self._vectors, "chunk_id", "left") if self._vectors is not None else chunks.withColumn("embedding", F.lit(None).cast("array<double>"))
        chunks = chunks.withColumn("embed_style", F.when(F.col("embedding").isNotNull(), E.STYLE))
        zero = F.lit(0)
        rates = U.search_rates(log.select(zero.alias("searches"), zero.alias("empty"), zero.alias("degraded_of"), zero.alias("degraded"), F.lit(1).alias("fetches"), F.when(F.col("ok"), 0).otherwise(1).alias("errors")))
        return U.diagnostics(A.cache_stats(self.articles, chunks), E.coverage(chunks), rates, M.feed_health(log, self.now_ms), A.age_report(self.articles, self.now_ms), self.embedder is not None)

    def fingerprint(self) -> str:
        line = F.concat(F.col("id").cast("string"), F.lit("|"), T.content_hash(F.col("title"), F.col("summary"), F.col("content")))
        return M.fingerprint(self.articles.select(line.alias("line"))).first()["fingerprint"]
