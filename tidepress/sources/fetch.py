"""Fetching: a Python data source over recorded or live answers, OPML output, metasearch payloads."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidepress.functions import bans
from tidepress.functions import text as T
from tidepress.sources import parsers


AGENT = "Mozilla/5.0 (compatible; tidepress/1.0)"
_ACCEPT = {
    "feed": "application/atom+xml, application/rss+xml, application/xml;q=0.9, text/xml;q=0.9, */*;q=0.8",
    "page": "text/html, application/xhtml+xml, application/xml;q=0.9, */*;q=0.8",
    "plain": "text/plain, text/html;q=0.9, */*;q=0.5",
}


def request_headers(kind: str, contact: str = "", etag: str | None = None, last_modified: str | None = None) -> dict[str, str]:
    """Headers of a request for a feed, a page or plain text, with a contact for the site's owner and validators if given."""
    head = {"User-Agent": f"{AGENT} ({contact.strip()})" if contact.strip() else AGENT, "Accept": _ACCEPT[kind], "Accept-Language": "en-GB, en;q=0.9"}
    return head | ({"If-None-Match": etag} if etag else {}) | ({"If-Modified-Since": last_modified} if last_modified else {})


def retry_wait(status: int, attempt: int, retry_after: str | None, most: int = 2) -> int | None:
    """Milliseconds until the next attempt, None for no retry: the plain twin of bans.retry_wait_ms for whole seconds."""
    after = int(retry_after) * 1000 if retry_after and retry_after.strip().isdigit() else None
    if attempt >= most or not (status in (0, 429) or status >= 500 or (status == 403 and after is not None)):
        return None
    return 600 * (attempt + 1) if status == 0 else min(800 * (attempt + 1) if after is None else after, 15_000)


class FeedDataSource(DataSource):
    """spark.read.format("feeds").option("urls", "a,b").option("recorded", "answers.json").load(): url, attempt, status,
    headers, body, retry_after.

    `validators` (a JSON object url -> {etag, last_modified}) makes requests conditional. With `recorded` (a JSON object
    url -> an answer {status, headers, body} or a list of them by attempt) nothing is fetched. URLs of one host share a
    partition and keep gap_ms between requests; an attempt that isn't to be retried is the last.
    """

    @classmethod
    def name(cls) -> str:
        return "feeds"

    def schema(self) -> str:
        return "url string, attempt int, status int, headers string, body string, retry_after string"

    def reader(self, schema) -> DataSourceReader:
        return _FeedReader(self.options)


class _FeedReader(DataSourceReader):
    def __init__(self, options):
        self.urls = [u.strip() for u in options.get("urls", "").split(",") if u.strip()]
        self.recorded = json.loads(Path(options["recorded"]).read_text()) if options.get("recorded") else None
        self.validators = json.loads(options.get("validators", "{}"))
        self.timeout, self.gap = float(options.get("timeout", "20")), int(options.get("gap_ms", "1500"))
        self.contact = options.get("contact", "")

    def partitions(self) -> list[InputPartition]:
        hosts: dict[str, list[str]] = {}
        for u in self.urls:
            hosts.setdefault(u.split("/")[2].lower() if "://" in u else "", []).append(u)
        return [InputPartition(v) for v in hosts.values()] or [InputPartition([])]

    def _ask(self, url: str, attempt: int) -> tuple[int, dict[str, str], str | None]:
        if self.recorded is not None:
            got = self.recorded.get(url, {"status": 0})
            one = got[min(attempt, len(got) - 1)] if isinstance(got, list) else got
            return int(one["status"]), one.get("headers") or {}, one.get("body")
        request = urllib.request.Request(url, headers=request_headers("feed", self.contact, **self.validators.get(url, {})))
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as r:
                return r.status, dict(r.headers.items()), r.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as e:
            return e.code, dict(e.headers.items()), e.read().decode("utf-8", "replace")
        except OSError:
            return 0, {}, None

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for n, url in enumerate(partition.value):
            if n and self.recorded is None:
                time.sleep(self.gap / 1000)
            for attempt in range(3):
                status, headers, body = self._ask(url, attempt)
                after = next((v for k, v in headers.items() if k.lower() == "retry-after"), None)
                yield url, attempt, status, "\n".join(f"{k}: {v}" for k, v in headers.items()), body, after
                wait = retry_wait(status, attempt, after)
                if wait is None:
                    break
                if self.recorded is None:
                    time.sleep(wait / 1000)


def parse_answers(answers: DataFrame, now_ms: int) -> DataFrame:
    """Items of good answers (url, body): those of a feed, or a page's article links as items of their own."""

    def look(url: str, body: str | None) -> Iterator[dict]:
        head = (body or "").strip().lower()
        if not any(x in head for x in ("<rss", "<feed", "<?xml")) and head.startswith(("<!doctype", "<html")):
            for x in parsers.page_links(body or "", url):
                yield {"guid": x["link"], "feed_url": url, "title": x["title"], "link": x["link"], "author": "Web Scrape", "pub_date": now_ms, "summary": x["title"], "content": x["title"]}
        else:
            yield from parsers.parse_feed(body or "", url, now_ms)

    return parsers.explode_with(answers, ["url", "body"], look, parsers.ITEM)


def probe(answers: DataFrame, now_ms: int) -> DataFrame:
    """url, kind, items, sample (up to five titles), ban: what each answer (url, body) would give as a feed."""

    def look(url: str, body: str | None) -> Iterator[dict]:
        page = "<html" in (body or "")[:4000].lower() or "<!doctype html" in (body or "")[:4000].lower()
        found = parsers.page_links(body or "", url) if page else parsers.parse_feed(body or "", url, now_ms)
        yield {"url": url, "items": len(found), "sample": "|".join(x["title"] for x in found[:5])}

    counted = parsers.explode_with(answers, ["url", "body"], look, "url string, items int, sample string")
    seen = answers.select("url", bans.feed_type(F.col("body")).alias("kind"), bans.interstitial(F.col("body"))["kind"].alias("ban"))
    wall = F.col("ban").isNotNull()
    return seen.join(counted, "url").select("url", "kind", F.when(wall, 0).otherwise(F.col("items")).alias("items"), F.when(~wall, F.col("sample")).alias("sample"), "ban")


def feed_candidates(results: DataFrame, most: int = 8) -> DataFrame:
    """query, site, seed, position: where a topic's search results (query, position, url) may have feeds: each site once, by
    its root, most at most a query."""
    root = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
    sites = results.select("query", "position", root.alias("site")).filter("site <> ''").groupBy("query", "site").agg(F.min("position").alias("first"))
    place = F.row_number().over(Window.partitionBy("query").orderBy("first", "site"))
    return sites.withColumn("position", place).filter(F.col("position") <= most).select("query", "site", F.concat("site", F.lit("/")).alias("seed"), "position")


def backfilled(pages: DataFrame, now_ms: int, least: int = 200) -> DataFrame:
    """guid, feed_url, title, link, author, pub_date, summary, content, source_type of fetched pages (url, title, status,
    body): those with enough readable text and no bot wall, as web articles."""
    good = pages.filter((F.col("status") == 200) & bans.interstitial(F.col("body")).isNull()).withColumn("content", parsers.readable_udf("body"))
    text = F.lit(None).cast("string")
    return good.filter(F.length("content") >= least).select(
        F.concat(F.lit("web:"), "url").alias("guid"), T.url_host(F.col("url")).alias("feed_url"), "title", F.col("url").alias("link"), text.alias("author"), F.lit(now_ms).cast("long").alias("pub_date"), text.alias("summary"), "content", F.lit("web").alias("source_type")
    )


def export_opml(feeds: DataFrame) -> DataFrame:
    """One row `opml`: feeds without a collection first, then a folder for each collection, all in order of URL."""

    def safe(c: Column) -> Column:
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            c = F.replace(c, F.lit(a), F.lit(b))
        return c

    line = F.concat(F.lit('<outline type="rss" text="'), safe(F.coalesce("title", "url")), F.lit('" xmlUrl="'), safe(F.col("url")), F.lit('"/>'))
    group = feeds.withColumn("line", line).groupBy("collection").agg(F.array_join(F.array_sort(F.collect_list("line")), "").alias("lines"))
    block = F.when(F.col("collection").isNull(), F.col("lines")).otherwise(F.concat(F.lit('<outline text="'), safe(F.col("collection")), F.lit('">'), F.col("lines"), F.lit("</outline>")))
    rows = group.select(F.struct(F.coalesce("collection", F.lit("")).alias("c"), block.alias("b")).alias("x"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["b"]), "")
    return rows.agg(F.concat(F.lit('<opml version="2.0"><body>'), body, F.lit("</body></opml>")).alias("opml"))


def search_results(payloads: DataFrame) -> DataFrame:
    """query, position, title, url, content of recorded metasearch answers (query, payload); those without URL go."""
    kind = "struct<results: array<struct<title: string, url: string, content: string>>>"
    rows = payloads.select("query", F.posexplode(F.from_json("payload", kind)["results"]).alias("position", "r"))
    return rows.filter(F.length(F.coalesce("r.url", F.lit(""))) > 0).select("query", "position", "r.title", "r.url", "r.content")


def digest(results: DataFrame, most: int = 5, size: int = 280) -> DataFrame:
    """The first results of distinct URLs, with short snippets."""
    once = Window.partitionBy("query", "url").orderBy("position")
    order = Window.partitionBy("query").orderBy("position")
    rows = results.withColumn("__n", F.row_number().over(once)).filter("__n = 1").withColumn("rank", F.row_number().over(order))
    return rows.filter(F.col("rank") <= most).select("query", "rank", "title", "url", F.substring(F.trim(F.regexp_replace("content", T.SPACES, " ")), 1, size).alias("snippet"))


def backfill_choice(results: DataFrame, cached: DataFrame, limit: int = 5, per_host: int = 3) -> DataFrame:
    """URLs to fetch: distinct, at most per_host a host, neither cached as page nor as link."""
    once = Window.partitionBy("url").orderBy("position")
    rows = results.withColumn("__n", F.row_number().over(once)).filter("__n = 1").withColumn("host", T.url_host(F.col("url")))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("host").orderBy("position"))).filter(F.col("nth") <= per_host)
    known = cached.select(F.col("link").alias("url")).union(cached.filter("guid like 'web:%'").select(F.expr("substring(guid, 5)").alias("url"))).filter("url is not null").distinct()
    return rows.join(known, "url", "left_anti").orderBy("position", "url").limit(min(max(limit, 1), 25)).select("position", "url", "host")


def query_feed_url(base: str, query: Column) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/search?q="), F.url_encode(query), F.lit("&format=rss"))


def query_of_feed_url(url: Column) -> Column:
    """The query of a search feed's URL, null for other URLs."""
    return F.when(url.contains("/search?") & url.contains("format=rss"), F.url_decode(F.regexp_extract(url, r"[?&]q=([^&]*)", 1)))
