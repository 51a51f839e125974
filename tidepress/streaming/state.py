"""Keyed state of feeds and hosts, as streams and as batch queries, and standing searches over arriving articles."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidepress.functions.bans import backoff_ms
from tidepress.operators.search import small

FEED_FIRST, FEED_MOST = 900_000, 86_400_000
HOST_FIRST, HOST_MOST = 1_800_000, 43_200_000


def backoff(log: DataFrame, first_ms: int = FEED_FIRST, most_ms: int = FEED_MOST) -> DataFrame:
    """key, fail_count, last_ms, next_retry_at after a log of key, at_ms, ok: failures since the last success."""
    run = Window.partitionBy("key").orderBy("at_ms", "seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = log.withColumn("wins", F.sum(F.when(F.col("ok"), 1).otherwise(0)).over(run))
    last = rows.groupBy("key").agg(F.max("wins").alias("top"), F.max("at_ms").alias("last_ms"))
    fails = rows.join(last.select("key", "top"), "key").filter((F.col("wins") == F.col("top")) & ~F.col("ok")).groupBy("key").agg(F.count("*").alias("fail_count"))
    j = last.join(fails, "key", "left").withColumn("fail_count", F.coalesce("fail_count", F.lit(0)))
    wait = backoff_ms(F.col("fail_count"), first_ms, most_ms)
    return j.select("key", "fail_count", "last_ms", F.when(F.col("fail_count") > 0, F.col("last_ms") + wait).alias("next_retry_at"))


def host_bans(log: DataFrame, first_ms: int = HOST_FIRST, most_ms: int = HOST_MOST) -> DataFrame:
    """host, ban_kind, ban_count, last_ban_at, next_retry_at of the hosts that are banned after a log of host, at_ms, seq,
    kind (null: a good answer), terminal. A good answer clears a host; bans that aren't terminal only warn."""
    rows = log.filter(F.col("kind").isNull() | F.col("terminal")).withColumn("stamp", F.struct("at_ms", "seq"))
    good = rows.filter("kind is null").groupBy("host").agg(F.max("stamp").alias("cleared"))
    left = rows.filter("kind is not null").join(good, "host", "left").filter("cleared is null or stamp > cleared")
    found = left.groupBy("host").agg(F.max_by("kind", "stamp").alias("ban_kind"), F.count("*").alias("ban_count"), F.max("at_ms").alias("last_ban_at"))
    return found.withColumn("next_retry_at", F.col("last_ban_at") + backoff_ms(F.col("ban_count"), first_ms, most_ms))


def backoff_stream(log: DataFrame, first_ms: int = FEED_FIRST, most_ms: int = FEED_MOST) -> DataFrame:
    """The same state kept over a stream of key, at_ms, seq, ok; a row for each key that a micro-batch touches."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fails, last = state.get if state.exists else (0, 0)
        rows = pd.concat(list(batches)).sort_values(["at_ms", "seq"])
        for ok in rows["ok"].tolist():
            fails = 0 if ok else fails + 1
        last = max(last, int(rows["at_ms"].max()))
        state.update((fails, last))
        wait = min(first_ms * 2.0 ** (fails - 1), float(most_ms)) if fails else 0
        yield pd.DataFrame({"key": [key[0]], "fail_count": [fails], "last_ms": [last], "next_retry_at": pd.array([last + int(wait) if fails else None], dtype="Int64")})

    return log.groupBy("key").applyInPandasWithState(
        step, "key string, fail_count long, last_ms long, next_retry_at long", "fails long, last long", "update", GroupStateTimeout.NoTimeout
    )


def dedupe_stream(items: DataFrame, delay: str = "30 days") -> DataFrame:
    """First arrival of each guid within the watermark of column arrived."""
    return items.withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["guid"])


def watch_hits(rows: DataFrame, watches: DataFrame, now_ms: int, look_back_ms: int = 30 * 86_400_000) -> DataFrame:
    """watch_id, hits, last_run, first_hit: articles that hold every word of a watch, newer than its last run (or a month)."""
    since = F.coalesce("last_run", F.lit(now_ms - look_back_ms))
    w = watches.select("watch_id", since.alias("since"), F.split(F.lower("query"), " +").alias("terms"))
    low = rows.select("id", "pub_date", F.lower(F.concat_ws(" ", "title", "content")).alias("low"))
    hit = low.join(small(w), (F.col("pub_date") > F.col("since")) & F.forall("terms", lambda t: F.col("low").contains(t)))
    found = hit.groupBy("watch_id").agg(F.count("*").alias("hits"), F.min("id").alias("first_hit"))
    return watches.select("watch_id").join(found, "watch_id", "left").select("watch_id", F.coalesce("hits", F.lit(0)).alias("hits"), F.lit(now_ms).cast("long").alias("last_run"), "first_hit")


def advanced(watches: DataFrame, hits: DataFrame) -> DataFrame:
    """watches (watch_id, name, query, last_run, last_hits) after a run: the marker always moves on, hit or not."""
    j = watches.join(hits.select("watch_id", F.col("hits").alias("new_hits"), F.col("last_run").alias("ran")), "watch_id", "left")
    return j.select("watch_id", "name", "query", F.coalesce("ran", "last_run").alias("last_run"), F.coalesce("new_hits", "last_hits").alias("last_hits"))
