"""The archive's tables: views, filters, ingest, upkeep and reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepress.functions import text as T

NOW_MS = 1_767_225_600_000
DAY_MS = 86_400_000


@dataclass(frozen=True)
class Settings:
    """Defaults of the archive; clamped() keeps values in range."""

    chunk_size: int = 800
    chunk_overlap: int = 120
    top_k: int = 8
    rrf_k: int = 60
    fts_list: int = 60
    vector_list: int = 200
    recency_blend: float = 0.8
    recency_days: float = 30.0
    mmr_lambda: float = 0.7
    simhash_bits: int = 4
    snippet_size: int = 600
    context_chunks: int = 1
    retention_days: int = 90
    web_retention_days: int = 14

    def clamped(self) -> Settings:
        hold = lambda v, a, b: min(max(v, a), b)
        size = hold(self.chunk_size, 200, 4000)
        return Settings(
            size, hold(self.chunk_overlap, 0, size // 2), hold(self.top_k, 1, 100), hold(self.rrf_k, 1, 1000), hold(self.fts_list, 1, 200), hold(self.vector_list, 1, 500),
            hold(self.recency_blend, 0.0, 1.0), max(self.recency_days, 0.1), hold(self.mmr_lambda, 0.0, 1.0), hold(self.simhash_bits, 0, 64), hold(self.snippet_size, 80, 4000),
            hold(self.context_chunks, 0, 2), max(self.retention_days, 0), max(self.web_retention_days, 0),
        )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as articles of feeds; labels give the reader's marks."""
    d, marks = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    pub = F.lit(NOW_MS) - (F.col("doc_id") % 120) * DAY_MS - F.col("doc_id")
    return d.join(marks, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("guid"),
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example/feed")).alias("feed_url"),
        F.substring(F.split("text", "\n")[0], 1, 80).alias("title"),
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example/"), F.col("doc_id").cast("string")).alias("link"),
        F.col("source").alias("author"),
        pub.alias("pub_date"),
        F.lit(None).cast("string").alias("summary"),
        F.col("text").alias("content"),
        F.array("lang", "source").alias("tags"),
        F.col("lang").alias("collection"),
        F.when(F.col("doc_id") % 10 == 0, "web").alias("source_type"),
        F.coalesce(F.col("quality") == 1, F.lit(False)).alias("starred"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("is_read"),
        (pub + 3_600_000).alias("cached_at"),
    )


def article_filter(
    now_ms: int = NOW_MS,
    days: float | None = None,
    after: int | str | None = None,
    before: int | str | None = None,
    feed: str | None = None,
    author: str | None = None,
    tag: str | None = None,
    collection: str | None = None,
    starred: bool | str | int | None = None,
    within: list[int] | str | None = None,
) -> Column:
    """One predicate for all filters; those not given hold for every row, and dates that can't be read count as not given."""

    def ms(value: int | str | None) -> Column | None:
        if value is None or isinstance(value, int):
            return None if value is None else F.lit(value)
        return F.unix_millis(F.try_to_timestamp(F.lit(value)))

    def inside(column: str, value: str) -> Column:
        return F.lower(F.coalesce(F.col(column), F.lit(""))).contains(value.lower())

    hold = F.lit(True)
    when = F.coalesce(F.col("pub_date"), F.lit(0))
    if days:
        hold &= when >= F.lit(now_ms - int(days * DAY_MS))
    if (x := ms(after)) is not None:
        hold &= F.coalesce(when >= x, F.lit(True))
    if (x := ms(before)) is not None:
        hold &= F.coalesce(when <= x, F.lit(True))
    if feed:
        hold &= inside("feed_url", feed)
    if author:
        hold &= inside("author", author)
    if tag:
        hold &= F.coalesce(F.array_contains("tags", tag.lower()), F.lit(False))
    if collection:
        hold &= F.lower(F.coalesce("collection", F.lit(""))) == collection.lower()
    if starred in (True, "true", 1):
        hold &= F.col("starred")
    if within is not None:
        ids = within if isinstance(within, list) else [int(x) for x in within.split(",") if x.strip()]
        hold &= F.col("id").isin(ids) if ids else F.lit(False)
    return hold


def recent(rows: DataFrame, limit: int = 20) -> DataFrame:
    return rows.orderBy(F.desc("pub_date"), "id").limit(min(max(limit or 20, 1), 100)).select("id", "title", "feed_url", "pub_date")


def article_page(rows: DataFrame, ref: int | str, offset: int = 0, max_chars: int = 12_000) -> DataFrame:
    """One article by id, link or guid, and a page of its text."""
    size = min(max(max_chars or 12_000, 500), 50_000)
    own = F.col("id") == ref if isinstance(ref, int) else (F.col("link") == ref) | (F.col("guid") == ref)
    total = F.length("content")
    end = F.least(total, F.lit(offset + size))
    return rows.filter(own).orderBy("id").limit(1).select(
        "id", "title", F.expr(f"substring(content, {offset + 1}, {size})").alias("page"), total.cast("long").alias("total_chars"), (end < total).alias("has_more"), F.when(end < total, end.cast("long")).alias("next_offset")
    )


def set_state(rows: DataFrame, ids: list[int] | None = None, refs: list[str] | None = None, starred: bool | None = None, is_read: bool | None = None) -> DataFrame:
    own = F.lit(False)
    if ids:
        own |= F.col("id").isin(ids)
    if refs:
        own |= F.col("link").isin(refs) | F.col("guid").isin(refs)
    change = {k: F.when(own, F.lit(v)).otherwise(F.col(k)) for k, v in (("starred", starred), ("is_read", is_read)) if v is not None}
    return rows.withColumns(change) if change else rows


def like_search(rows: DataFrame, query: str, limit: int = 8, offset: int = 0, **filters) -> DataFrame:
    """The last resort of a search: the query as a substring of title, summary or content, newest first, no score."""
    q = query.lower()
    hit = F.lit(False)
    for c in ("title", "summary", "content"):
        hit |= F.lower(F.coalesce(c, F.lit(""))).contains(q)
    return rows.filter(hit & article_filter(**filters)).orderBy(F.desc("pub_date"), "id").offset(offset).limit(limit).select("id", "title", "pub_date", F.lit(None).cast("double").alias("score"))


# Ingest


def first_by(rows: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def classify(batch: DataFrame, cached: DataFrame) -> DataFrame:
    """batch with an action: insert, update, unchanged, skip.

    Rows without title and content and later ones of a guid are skipped. A known guid is unchanged or updated by its
    content hash. A new guid is skipped where its title key is cached or claimed by an earlier update or new row;
    an empty title key claims nothing.
    """
    b = batch.withColumns({"title_key": T.title_key(F.col("title")), "content_hash": T.content_hash(F.col("title"), F.col("summary"), F.col("content"))})
    void = (F.length(F.trim(F.coalesce("title", F.lit("")))) == 0) & (F.length(F.trim(F.coalesce("content", F.lit("")))) == 0)
    nth = F.row_number().over(Window.partitionBy("guid").orderBy("arrival"))
    b = b.withColumn("void", void).withColumn("again", F.when(void, F.lit(False)).otherwise(F.sum(F.when(void, 0).otherwise(1)).over(Window.partitionBy("guid").orderBy("arrival")) > 1)).withColumn("nth", nth)
    known = cached.select("guid", F.col("content_hash").alias("old_hash"))
    titles = cached.filter("title_key is not null").select("title_key").distinct().withColumn("cached_title", F.lit(True))
    j = b.join(known, "guid", "left").join(titles, "title_key", "left")
    state = F.when(F.col("void") | F.col("again"), "skip").when(F.col("old_hash") == F.col("content_hash"), "unchanged").when(F.col("old_hash").isNotNull(), "update").when(F.col("cached_title"), "skip").otherwise("new")
    j = j.withColumn("state", state)
    claim = F.col("title_key").isNotNull() & F.col("state").isin("update", "new")
    earlier = F.sum(F.when(claim, 1).otherwise(0)).over(Window.partitionBy("title_key").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1))
    action = F.when((F.col("state") == "new") & F.col("title_key").isNotNull() & (F.coalesce(earlier, F.lit(0)) > 0), "skip").when(F.col("state") == "new", "insert").otherwise(F.col("state"))
    return j.withColumn("action", action).select("arrival", "guid", "title", "summary", "content", "title_key", "content_hash", "action")


def upsert(cached: DataFrame, classified: DataFrame) -> DataFrame:
    """The snapshot after a batch: changed rows replace cached ones, new ones are added; nothing is written in place."""
    columns = ["guid", "title", "summary", "content", "title_key", "content_hash"]
    fresh = classified.filter(F.col("action").isin("insert", "update")).select(columns)
    return cached.select(columns).join(fresh.select("guid"), "guid", "left_anti").unionByName(fresh)


def last_writer(rows: DataFrame, key: str, order: str) -> DataFrame:
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(order, *others)).alias("x")).select(key, "x.*")


# Upkeep


def retention(rows: DataFrame, overrides: DataFrame, now_ms: int = NOW_MS, days: int = 90, web_days: int | None = 14, basis: str = "published") -> DataFrame:
    """Rows that stay. Feeds have their own limit, web pages theirs, all else the global one; just past it they go."""
    at = F.coalesce("pub_date", "cached_at") if basis == "published" else F.col("cached_at")
    own = rows.join(overrides.select("feed_url", F.col("days").alias("own_days")), "feed_url", "left")
    web = F.coalesce(F.col("source_type"), F.lit("rss")) != "rss"
    limit = F.when(web, F.lit(web_days if web_days and web_days > 0 else days)).otherwise(F.coalesce("own_days", F.lit(days)))
    return own.filter(~F.coalesce(at < F.lit(now_ms) - limit.cast("long") * DAY_MS, F.lit(False))).drop("own_days").select(*rows.columns)


def prune(rows: DataFrame, feeds: DataFrame) -> DataFrame:
    """Drops feed articles of feeds that are no longer listed; an empty list prunes nothing."""
    listed = feeds.select(T.url_key(F.col("url")).alias("__k")).distinct()
    some = listed.agg((F.count("*") > 0).alias("__some"))
    j = rows.withColumn("__k", T.url_key(F.col("feed_url"))).join(listed.withColumn("__in", F.lit(True)), "__k", "left").crossJoin(F.broadcast(some))
    web = F.coalesce(F.col("source_type"), F.lit("rss")) != "rss"
    return j.filter(~F.col("__some") | web | F.coalesce("__in", F.lit(False))).select(*rows.columns)


def orphans(chunks: DataFrame, rows: DataFrame) -> DataFrame:
    return chunks.join(rows.select(F.col("id").alias("entry_id")), "entry_id", "left_anti")


def due_feeds(feeds: DataFrame, state: DataFrame, now_ms: int, force: bool = False) -> DataFrame:
    """url, due, wait_minutes: a feed with an interval is due when it has passed since the last fetch."""
    j = feeds.join(state.select("url", "last_fetched"), "url", "left")
    left = F.col("last_fetched") + F.col("refresh_hours") * 3_600_000 - now_ms
    not_due = (F.coalesce("refresh_hours", F.lit(0)) > 0) & F.coalesce(left > 0, F.lit(False)) & (not force)
    return j.select("url", (~not_due).alias("due"), F.when(not_due, F.ceil(left / 60_000)).cast("long").alias("wait_minutes"))


def skip_reason(feeds: DataFrame, state: DataFrame, hosts: DataFrame, robots: DataFrame, now_ms: int, force: bool = False) -> DataFrame:
    """url, reason: host paused, then feed backing off (not when forced), then robots (pages only), else null."""
    j = (
        feeds.withColumn("host", T.url_host(F.col("url")))
        .join(state.select("url", F.col("next_retry_at").alias("feed_retry")), "url", "left")
        .join(hosts.select("host", F.col("next_retry_at").alias("host_retry")), "host", "left")
        .join(robots.select("url", "allowed"), "url", "left")
    )
    reason = F.when(F.coalesce(F.col("host_retry") > now_ms, F.lit(False)), "host-paused").when(F.coalesce(F.col("feed_retry") > now_ms, F.lit(False)) & (not force), "backoff").when(~F.col("is_feed") & ~F.coalesce("allowed", F.lit(True)), "robots")
    return j.select("url", reason.alias("reason"))


def merge_feed_config(listed: DataFrame, options: DataFrame) -> DataFrame:
    """Feeds of the text list and of the options table, keyed by URL without trailing slashes; enabled unless said otherwise."""
    a = listed.filter((F.length(F.trim("line")) > 0) & ~F.trim("line").startswith("#")).select(F.trim("line").alias("listed_url"), T.url_key(F.col("line")).alias("k")).dropDuplicates(["k"])
    o = options.withColumn("k", T.url_key(F.col("url")))
    return a.join(o, "k", "full_outer").select(
        F.coalesce("listed_url", "url").alias("url"), F.coalesce("enabled", F.lit(True)).alias("enabled"), T.tag_list(F.col("tags")).alias("tags"), T.blank_to_null(F.col("collection")).alias("collection"), "refresh_hours"
    )


# Reports


def cache_stats(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    web = F.coalesce(F.col("source_type"), F.lit("rss")) != "rss"
    a = rows.agg(
        F.count("*").alias("entries"), F.count_distinct("feed_url").alias("feeds"), F.count_if(web).alias("web_entries"), F.count_if(F.col("starred")).alias("starred"), F.count_if(~F.col("is_read")).alias("unread"),
        F.round(F.count_distinct("feed_url") / F.count("*"), 3).alias("diversity"), F.round(F.avg((F.length("content") > 0).cast("double")), 6).alias("full_text_share"), F.max("cached_at").alias("last_refresh"),
    )
    b = chunks.agg(F.count("*").alias("chunks"), F.count_if(F.col("embedding").isNull()).alias("missing"), F.round(F.count_if(F.col("embedding").isNull()) / F.count("*"), 6).alias("backlog"))
    c = rows.join(chunks.select(F.col("entry_id").alias("id")), "id", "left_anti").agg(F.count("*").alias("chunkless"))
    return a.crossJoin(b).crossJoin(c)


def age_report(rows: DataFrame, now_ms: int = NOW_MS) -> DataFrame:
    age = F.when(F.col("pub_date") > 0, (F.lit(now_ms) - F.col("pub_date")) / DAY_MS)
    return rows.agg(F.round(F.avg(age), 6).alias("mean_days"), F.round(F.percentile(age, F.lit(0.5)), 6).alias("median_days"), F.round(F.max(age), 6).alias("oldest_days"))
