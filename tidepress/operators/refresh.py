"""A refresh pass as tables: what is asked and when, which attempt counts, what becomes of feeds, hosts and articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepress.functions import bans
from tidepress.functions import text as T
from tidepress.streaming.state import FEED_FIRST, FEED_MOST, HOST_FIRST, HOST_MOST

from . import archive as A

#: Bodies shorter than this are no answer.
LEAST_BODY = 50


def plan(feeds: DataFrame, state: DataFrame, hosts: DataFrame, robots: DataFrame, now_ms: int, force: bool = False) -> DataFrame:
    """url, host, mode, skip, wait_minutes, if_none_match, if_modified_since: a row a feed; skip is null where it is asked.

    Feeds not due come first, then paused hosts, feeds backing off and (pages only) robots rules. Pages are slow, feeds
    fast. Validators of the last answer make the request conditional. Force asks unconditionally, past all but robots.
    """
    j = (
        feeds.withColumns({"host": T.url_host(F.col("url")), "is_feed": bans.looks_like_feed(F.col("url"))})
        .join(state.select("url", "etag", "last_modified", "last_fetched", F.col("next_retry_at").alias("feed_retry")), "url", "left")
        .join(hosts.select("host", F.col("next_retry_at").alias("host_retry")), "host", "left")
        .join(robots.select("url", "allowed"), "url", "left")
    )
    late = lambda at: F.coalesce(F.col(at) > now_ms, F.lit(False)) & F.lit(not force)
    due_at = F.col("last_fetched") + F.col("refresh_hours") * 3_600_000
    early = (F.coalesce("refresh_hours", F.lit(0)) > 0) & F.coalesce(due_at > now_ms, F.lit(False)) & F.lit(not force)
    skip = F.when(early, "not-due").when(late("host_retry"), "host-paused").when(late("feed_retry"), "backoff").when(~F.col("is_feed") & ~F.coalesce("allowed", F.lit(True)), "robots")
    until = F.when(early, due_at).when(late("host_retry"), F.col("host_retry")).when(late("feed_retry"), F.col("feed_retry"))
    asked = F.lit(not force) & skip.isNull()
    return j.select(
        "url", "host", F.when(F.col("is_feed"), "fast").otherwise("slow").alias("mode"), skip.alias("skip"), F.ceil((until - now_ms) / 60_000).cast("long").alias("wait_minutes"),
        F.when(asked, F.col("etag")).alias("if_none_match"), F.when(asked, F.col("last_modified")).alias("if_modified_since"),
    )


def schedule(planned: DataFrame, gap_ms: int = 1500, jitter_ms: int = 1500) -> DataFrame:
    """url, host, start_ms: requests of one host follow each other by at least gap_ms, hosts don't wait for each other.

    The jitter of a request comes from a hash of its URL, so a plan can be made twice. Fast requests go first.
    """
    asked = planned.filter("skip is null")
    order = Window.partitionBy("host").orderBy("mode", "url")
    step = gap_ms + (F.pmod(F.crc32(F.col("url").cast("binary")), F.lit(max(jitter_ms, 1))) if jitter_ms else F.lit(0))
    return asked.select("url", "host", F.coalesce(F.sum(step).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("start_ms"))


def attempts(answers: DataFrame, now_ms: int) -> DataFrame:
    """answers (url, attempt, status, headers, body, retry_after) that are really made, with ban, wait_ms and terminal.

    An attempt is made where all before it are retried; one that isn't is terminal. A page that answers 200 with a
    challenge is a terminal ban.
    """
    wait = bans.retry_wait_ms(F.col("status"), F.col("attempt"), bans.retry_after_ms(F.col("retry_after"), F.lit(now_ms)))
    wait = F.when(F.col("status").isin(200, 304), F.lit(None)).otherwise(wait).cast("long")
    seen = answers.withColumns({"wait_ms": wait, "ban": bans.ban(F.col("status"), F.col("body"), F.col("headers"))}).withColumn("terminal", F.col("wait_ms").isNull())
    before = Window.partitionBy("url").orderBy("attempt").rowsBetween(Window.unboundedPreceding, -1)
    return seen.withColumn("stopped", F.coalesce(F.max("terminal").over(before), F.lit(False))).filter("not stopped").drop("stopped")


def outcomes(planned: DataFrame, made: DataFrame) -> DataFrame:
    """url, host, mode, result (skipped, ok, not-modified, failed), status, error, tries, waited_ms, ban_kind, ban_vendor,
    ban_terminal, etag, last_modified, body: a row a planned feed. The ban is the last one met, terminal where no retry
    got past it. Validators stand in headers as etag and last-modified."""
    last = made.groupBy("url").agg(F.max_by(F.struct("status", "headers", "body", "terminal"), "attempt").alias("x"), F.max_by("ban", F.when(F.col("ban").isNotNull(), F.col("attempt"))).alias("ban"), F.max(F.col("ban").isNotNull() & F.col("terminal")).alias("walled"), F.count("*").alias("tries"), F.coalesce(F.sum("wait_ms"), F.lit(0)).alias("waited_ms"))
    j = planned.join(last, "url", "left")
    status, body = F.col("x.status"), F.coalesce("x.body", F.lit(""))
    good = (status >= 200) & (status < 300)
    error = F.when(F.col("skip").isNotNull(), F.col("skip")).when(F.col("x").isNull() | (status == 0), "network").when(status == 304, F.lit(None)).when(~good, F.concat(F.lit("HTTP "), status.cast("string"))).when(F.length(body) < LEAST_BODY, "empty").when(F.col("walled"), "bot wall")
    result = F.when(F.col("skip").isNotNull(), "skipped").when(status == 304, "not-modified").when(error.isNull(), "ok").otherwise("failed")
    header = lambda name: F.nullif(F.regexp_extract("x.headers", rf"(?im)^{name}:\s*(.*?)\s*$", 1), F.lit(""))
    wall = F.when(F.col("skip").isNull(), F.col("ban"))
    return j.select(
        "url", "host", "mode", result.alias("result"), status.alias("status"), error.alias("error"), F.coalesce("tries", F.lit(0)).alias("tries"), F.coalesce("waited_ms", F.lit(0)).alias("waited_ms"),
        wall["kind"].alias("ban_kind"), wall["vendor"].alias("ban_vendor"), (F.col("skip").isNull() & F.coalesce("walled", F.lit(False))).alias("ban_terminal"),
        header("etag").alias("etag"), header("last-modified").alias("last_modified"), F.when(result == "ok", body).alias("body"),
    )


def feeds_after(state: DataFrame, done: DataFrame, now_ms: int) -> DataFrame:
    """The feeds' state after a pass: good answers clear the back-off, failures double it, what was skipped stays as it was.

    A 304 keeps validators that it doesn't repeat; a full answer replaces them.
    """
    d = done.filter("result <> 'skipped'").select("url", "result", F.col("status").alias("new_status"), F.col("error").alias("new_error"), F.col("etag").alias("new_etag"), F.col("last_modified").alias("new_modified"))
    j = state.join(d, "url", "full_outer")
    fails = F.when(F.col("result").isNull(), F.col("fail_count")).when(F.col("result") == "failed", F.coalesce("fail_count", F.lit(0)) + 1).otherwise(0).cast("long")
    kept = lambda old, new: F.when(F.col("result") == "ok", F.col(new)).otherwise(F.coalesce(F.when(F.col("result") == "not-modified", F.col(new)), F.col(old)))
    seen = F.col("result").isNotNull()
    return j.select(
        "url", kept("etag", "new_etag").alias("etag"), kept("last_modified", "new_modified").alias("last_modified"), F.when(seen, F.lit(now_ms)).otherwise(F.col("last_fetched")).cast("long").alias("last_fetched"),
        F.when(seen, F.col("new_status")).otherwise(F.col("last_status")).alias("last_status"), fails.alias("fail_count"),
        F.when(~seen, F.col("next_retry_at")).when(F.col("result") == "failed", now_ms + bans.backoff_ms(fails, FEED_FIRST, FEED_MOST)).cast("long").alias("next_retry_at"),
        F.when(seen, F.col("new_error")).otherwise(F.col("last_error")).alias("last_error"),
    )


def hosts_after(hosts: DataFrame, done: DataFrame, now_ms: int) -> DataFrame:
    """host, ban_kind, ban_count, last_ban_at, next_retry_at: terminal bans pause a host twice as long each time, a good
    answer without one clears it, bans that a retry got past only warn."""
    seen = done.filter("result <> 'skipped'").groupBy("host").agg(
        F.max("ban_terminal").alias("banned"), F.max(F.col("result").isin("ok", "not-modified")).alias("answered"), F.max_by("ban_kind", F.struct("ban_terminal", "url")).alias("kind")
    )
    j = hosts.select("host", "ban_kind", "ban_count", "last_ban_at", "next_retry_at").join(seen, "host", "full_outer")
    banned = F.coalesce("banned", F.lit(False))
    count = F.when(banned, F.coalesce("ban_count", F.lit(0)) + 1).otherwise(F.col("ban_count")).cast("long")
    after = j.select(
        "host", F.when(banned, F.col("kind")).otherwise(F.col("ban_kind")).alias("ban_kind"), count.alias("ban_count"), F.when(banned, F.lit(now_ms)).otherwise(F.col("last_ban_at")).cast("long").alias("last_ban_at"),
        F.when(banned, now_ms + bans.backoff_ms(count, HOST_FIRST, HOST_MOST)).otherwise(F.col("next_retry_at")).cast("long").alias("next_retry_at"), (F.coalesce("answered", F.lit(False)) & ~banned).alias("cleared"),
    )
    return after.filter("ban_count is not null and not cleared").drop("cleared")


def report(done: DataFrame, classified: DataFrame, hosts: DataFrame, now_ms: int) -> DataFrame:
    """One row of tallies: what was added and updated, and how the feeds fared by mode."""
    of = lambda result, mode=None: F.count_if((F.col("result") == result) & (F.lit(True) if mode is None else F.col("mode") == mode))
    got = F.col("result").isin("ok", "not-modified")
    a = done.agg(
        of("not-modified").alias("not_modified"), F.count_if(F.col("error") == "not-due").alias("not_due"), F.count_if((F.col("result") == "skipped") & (F.col("error") != "not-due")).alias("skipped"),
        F.count_if(got & (F.col("mode") == "fast")).alias("fast_ok"), of("failed", "fast").alias("fast_failed"), F.count_if(got & (F.col("mode") == "slow")).alias("slow_ok"), of("failed", "slow").alias("slow_failed"), F.count_if(F.col("ban_kind").isNotNull()).alias("bans"),
    )
    b = classified.agg(F.count_if(F.col("action") == "insert").alias("added"), F.count_if(F.col("action") == "update").alias("updated"))
    c = hosts.agg(F.count_if(F.col("next_retry_at") > now_ms).alias("paused_hosts"))
    return b.crossJoin(a).crossJoin(c)


def articles(done: DataFrame, feeds: DataFrame, parse, now_ms: int) -> DataFrame:
    """Items of the good answers, max_items a feed at most, with the feed's tags and collection and an arrival number.

    parse(df of url, body, mode) gives guid, feed_url, title, link, author, pub_date, summary, content.
    """
    items = parse(done.filter("result = 'ok'").select("url", "body", "mode"))
    options = feeds.select(F.col("url").alias("feed_url"), "tags", "collection", "max_items")
    place = F.row_number().over(Window.partitionBy("feed_url").orderBy(F.desc("pub_date"), "guid"))
    kept = items.join(options, "feed_url").withColumn("nth", place).filter("coalesce(max_items, 0) <= 0 or nth <= max_items")
    return kept.withColumn("arrival", F.xxhash64("feed_url", "nth")).drop("nth", "max_items").withColumn("cached_at", F.lit(now_ms).cast("long"))


def full_text(items: DataFrame, pages: DataFrame, readable) -> DataFrame:
    """items with the readable text of their own pages (link, status, headers, body) as content, where that is over 200
    characters and no bot wall; the summary becomes the first 500 of summary or title."""
    seen = pages.select(F.col("url").alias("link"), F.when((F.col("status") == 200) & bans.interstitial(F.col("body")).isNull(), F.col("body")).alias("page"))
    j = items.join(seen.filter("page is not null"), "link", "left").withColumn("read", readable(F.col("page")))
    whole = F.length(F.coalesce("read", F.lit(""))) > 200
    brief: Column = F.substring(F.coalesce(T.blank_to_null(F.col("summary")), F.col("title")), 1, 500)
    return j.withColumns({"content": F.when(whole, F.col("read")).otherwise(F.col("content")), "summary": F.when(whole, brief).otherwise(F.col("summary"))}).select(*items.columns)


def run(feeds: DataFrame, state: DataFrame, hosts: DataFrame, robots: DataFrame, answers: DataFrame, cached: DataFrame, parse, now_ms: int, force: bool = False) -> dict[str, DataFrame]:
    """A whole pass over recorded or fetched answers: tables plan, outcomes, articles, cached, feeds, hosts and report."""
    planned = plan(feeds, state, hosts, robots, now_ms, force)
    done = outcomes(planned, attempts(answers.join(planned.filter("skip is null").select("url"), "url", "left_semi"), now_ms))
    items = articles(done, feeds, parse, now_ms)
    classified = A.classify(items, cached)
    later = hosts_after(hosts, done, now_ms)
    return {"plan": planned, "outcomes": done, "articles": items, "cached": A.upsert(cached, classified), "feeds": feeds_after(state, done, now_ms), "hosts": later, "report": report(done, classified, later, now_ms)}
