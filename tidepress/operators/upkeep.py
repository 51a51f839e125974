"""Compaction, diagnostics and the edits of feed lists, reader's watches and the event log."""

from __future__ import annotations

import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepress.functions import text as T

SMALL_SHARE = 0.2


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """file, bytes of a table's Parquet files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    return files.select(F.col("path").alias("file"), F.col("length").alias("bytes"))


def compact(spark: SparkSession, path: str, to: str, target_bytes: int = 128 << 20) -> bool:
    """Rewrites the table at `path` into `to` in files of about target_bytes, where more than a fifth of its files are
    under a quarter of that; otherwise does nothing. Says whether it did; the caller points readers to the new folder."""
    few = F.count_if(F.col("bytes") < target_bytes / 4)
    seen = file_sizes(spark, path).agg(F.count("*").alias("n"), few.alias("small"), F.sum("bytes").alias("total")).first()
    if seen["n"] < 2 or seen["small"] / seen["n"] <= SMALL_SHARE:
        return False
    spark.read.parquet(path).repartition(max(1, -(-seen["total"] // target_bytes))).write.parquet(to)
    return True


def analyze(spark: SparkSession, table: str) -> None:
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR ALL COLUMNS")


# Diagnostics


def search_rates(counters: DataFrame) -> DataFrame:
    """empty_rate, degraded_rate, error_rate of counters (searches, empty, degraded_of, degraded, fetches, errors); null
    where nothing was counted."""
    rate = lambda a, b: F.round(F.sum(a) / F.nullif(F.sum(b), F.lit(0)), 3)
    return counters.agg(rate("empty", "searches").alias("empty_rate"), rate("degraded", "degraded_of").alias("degraded_rate"), rate("errors", "fetches").alias("error_rate"))


def watch_status(watches: DataFrame, most: int = 5) -> DataFrame:
    """total, position, name, last_run, last_hits: the watches that ran last."""
    last = watches.orderBy(F.desc_nulls_last("last_run"), "watch_id").limit(most)
    place = F.row_number().over(Window.orderBy(F.desc_nulls_last("last_run"), "watch_id"))  # over `most` rows
    return last.withColumn("position", place).crossJoin(F.broadcast(watches.agg(F.count("*").alias("total")))).select("total", "position", "name", "last_run", "last_hits")


def diagnostics(stats: DataFrame, coverage: DataFrame, rates: DataFrame, health: DataFrame, ages: DataFrame, has_model: bool) -> DataFrame:
    """One row of all indicators with a verdict: limited (keyword search only, or chunks without vectors), degraded (over a
    fifth of fetches fail), else healthy; notes say why."""
    gap = F.col("embedded") < F.col("chunks_all")
    row = (
        stats.withColumnRenamed("chunks", "stored_chunks").crossJoin(coverage.withColumnRenamed("chunks", "chunks_all")).crossJoin(rates.select("empty_rate", "degraded_rate", F.col("error_rate").alias("fetch_error_rate")))
        .crossJoin(health.select("feeds", "success", "freshness_hours").withColumnRenamed("feeds", "feeds_fetched")).crossJoin(ages)
    )
    failing = F.coalesce(F.col("fetch_error_rate") > 0.2, F.lit(False))
    verdict = F.when(F.lit(not has_model) | gap, "limited").when(failing, "degraded").otherwise("healthy")
    notes = F.concat_ws("; ", F.when(F.lit(not has_model), "keyword search only"), F.when(gap, "chunks without vectors"), F.when(failing, "many fetches fail"))
    return row.withColumns({"verdict": verdict, "notes": notes})


# Feed lists


def add_feed(lines: list[str], url: str) -> tuple[list[str], str | None]:
    """The list with the feed at its end, and why not where it can't be added: empty, not http(s), or there already."""
    url = url.strip()
    if not url:
        return lines, "empty"
    if not url.lower().startswith(("http://", "https://")) or not url.split("://", 1)[1].split("/")[0]:
        return lines, "not an http(s) URL"
    if _key(url) in {_key(x) for x in lines if x.strip() and not x.strip().startswith("#")}:
        return lines, "listed already"
    return [*lines, url], None


def remove_feed(lines: list[str], options: list[dict], url: str) -> tuple[list[str], list[dict], bool]:
    """List and options without the feed; trailing slashes don't count, parts of URLs never match. And whether it was there."""
    same = lambda x: bool(x.strip()) and not x.strip().startswith("#") and _key(x) == _key(url)
    left, opts = [x for x in lines if not same(x)], [o for o in options if _key(o.get("url") or "") != _key(url)]
    return left, opts, len(left) < len(lines) or len(opts) < len(options)


def set_options(options: list[dict], url: str, **change) -> list[dict]:
    """Options with the feed's changed ones; None takes one away."""
    old = next((o for o in options if _key(o.get("url") or "") == _key(url)), {"url": url})
    new = {k: v for k, v in (old | change).items() if v is not None}
    return [o for o in options if o is not old] + [new]


def _key(url: str) -> str:
    return url.strip().rstrip("/")


def edits(lines: DataFrame, changes: DataFrame) -> DataFrame:
    """url of the list (line) after changes (add, url): valid new URLs are in, removed ones out; keyed like the single edits."""
    old = lines.filter((F.length(F.trim("line")) > 0) & ~F.trim("line").startswith("#")).select(T.url_key(F.col("line")).alias("url"))
    new = changes.filter("add").select(T.url_key(F.col("url")).alias("url")).filter(F.lower("url").rlike("^https?://[^/]"))
    return old.union(new).distinct().join(changes.filter("not add").select(T.url_key(F.col("url")).alias("url")), "url", "left_anti")


# Event log


class JsonLines(logging.Handler):
    """Writes each event as a line of JSON: time, level, event, fields. A full disk never breaks what is logged."""

    def __init__(self, path: str):
        super().__init__()
        self.path = Path(path)

    def emit(self, record: logging.LogRecord) -> None:
        line = {"at_ms": int(record.created * 1000), "level": record.levelname.lower(), "event": record.getMessage()} | getattr(record, "fields", {})
        try:
            with self.path.open("a", encoding="utf-8") as f:
                f.write(json.dumps(line, default=str) + "\n")
        except OSError:
            self.handleError(record)


#: Which groups of calls an archive offers.
SURFACES = {"compact": ("search", "get_article", "recent", "feeds", "admin"), "full": ("search", "get_article", "recent", "feeds", "admin", "watches", "evaluate")}
