"""Every query by name, with the SQL it is held against where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepress.functions import bans
from tidepress.functions import text as T
from tidepress.operators import archive as A
from tidepress.operators import embedding as E
from tidepress.operators import metrics as M
from tidepress.operators import postings as P
from tidepress.operators import refresh as R
from tidepress.operators import search as S
from tidepress.operators import upkeep as U
from tidepress.plans.hybrid import hybrid
from tidepress.sources import fetch, parsers
from tidepress.storage import Tables, spread
from tidepress.streaming import jobs, state

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

NOW = A.NOW_MS
ENTRIES = """entries AS (SELECT d.doc_id AS id, 'doc:' || d.doc_id AS guid, 'https://' || source || '.example/feed' AS feed_url,
 substr(split_part(text, chr(10), 1), 1, 80) AS title, 'https://' || source || '.example/' || d.doc_id AS link, source AS author,
 1767225600000 - (d.doc_id % 120) * 86400000 - d.doc_id AS pub_date, text AS content, [lang, source] AS tags, lang AS collection,
 CASE WHEN d.doc_id % 10 = 0 THEN 'web' END AS source_type, coalesce(quality = 1, false) AS starred, coalesce(toxic = 1, false) AS is_read,
 1767225600000 - (d.doc_id % 120) * 86400000 - d.doc_id + 3600000 AS cached_at FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
KEY = "nullif(substr(trim(regexp_replace(lower(title), '[^\\p{L}\\p{N}]+', ' ', 'g')), 1, 200), '')"
TERMS = r"list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]{1,24}')[1:8])"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rows(spark: SparkSession, data: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(data, schema)


def values(data: list[tuple], names: str) -> str:
    """The same rows as a SQL table."""

    def one(v):
        return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"

    return f"(VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in data)}) AS t({names})"


# Text


@query(f"WITH {ENTRIES} SELECT id, {KEY} AS title_key FROM entries")
def norm_title_key(spark, d):
    return A.entries(spark, d).select("id", T.title_key(F.col("title")).alias("title_key"))


CSV = [(1, " News, ,TECH ,news"), (2, ""), (3, None), (4, " , "), (5, "a"), (6, "Ä,b ")]


@query(f"SELECT id, CASE WHEN len(tags) > 0 THEN array_to_string(tags, '|') END AS tags FROM (SELECT id, list_filter(list_transform(string_split(csv, ','), lambda x: lower(trim(x))), lambda x: x <> '') AS tags FROM {values(CSV, 'id, csv')})")
def norm_tags(spark, d):
    tags = T.tag_list(F.col("csv"))
    return rows(spark, CSV, "id int, csv string").select("id", F.when(tags.isNotNull(), F.array_join(tags, "|")).alias("tags"))


@query(f"WITH {ENTRIES} SELECT id, sha1(coalesce(title, '') || chr(10) || '' || chr(10) || coalesce(content, '')) AS content_hash FROM entries")
def content_hash(spark, d):
    return A.entries(spark, d).select("id", T.content_hash(F.col("title"), F.col("summary"), F.col("content")).alias("content_hash"))


@query(r"SELECT page_id, regexp_replace(trim(url), '/+$', '') AS url_key, regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)', 1) AS host FROM pages")
def url_host_key(spark, d):
    return A.table(spark, d, "pages").select("page_id", T.url_key(F.col("url")).alias("url_key"), T.url_host(F.col("url")).alias("host"))


@query(f"WITH {ENTRIES} SELECT id, strftime(make_timestamp(pub_date * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS published FROM entries")
def iso_dates(spark, d):
    return A.entries(spark, d).select("id", T.iso_date(F.col("pub_date")).alias("published"))


# Sources

BODIES = [(1, "<?xml version='1.0'?><RSS><channel/></RSS>"), (2, "<feed xmlns='x'/>"), (3, "<!DOCTYPE html><html></html>"), (4, "plain"), (5, None), (6, "<rdf:RDF>")]
TYPE = "CASE WHEN contains(h, '<rss') OR contains(h, '<rdf:rdf') THEN 'rss' WHEN contains(h, '<feed') THEN 'atom' WHEN contains(h, '<html') OR contains(h, '<!doctype html') THEN 'html' ELSE 'unknown' END"


@query(f"SELECT id, {TYPE} AS kind FROM (SELECT 1000000 + id AS id, lower(substr(coalesce(body, ''), 1, 4000)) AS h FROM {values(BODIES, 'id, body')} UNION ALL SELECT page_id, lower(substr(coalesce(html, ''), 1, 4000)) FROM pages)")
def classify_feed_type(spark, d):
    own = rows(spark, BODIES, "id long, html string").select((F.col("id") + 1_000_000).alias("id"), "html")
    return own.union(A.table(spark, d, "pages").select("page_id", "html")).select("id", bans.feed_type(F.col("html")).alias("kind"))


URLS = [(1, "https://a.example/feed"), (2, "https://a.example/x.RSS?y=1"), (3, "https://a.example/news"), (4, "https://feeds.feedburner.com/x"), (5, "https://s.example/search?q=a&format=rss"), (6, None), (7, "https://a.example/feeds/all"), (8, "https://a.example/feedback")]


@query(rf"SELECT id, regexp_matches(u, '\.(xml|rss|atom)([?#]|$)|/rss([/?#]|$)|/feed([/?#]|$)|feedburner|/feeds/') OR (contains(u, 'search') AND contains(u, 'format=rss')) AS is_feed FROM (SELECT id, lower(coalesce(url, '')) AS u FROM {values(URLS, 'id, url')})")
def classify_rss_url(spark, d):
    return rows(spark, URLS, "id int, url string").select("id", bans.looks_like_feed(F.col("url")).alias("is_feed"))


ASKED = [(1, "solar power"), (2, "a&b=c"), (3, "x")]


@query(f"SELECT id, 'https://s.example/search?q=' || replace(url_encode(q), '%20', '+') || '&format=rss' AS url, q AS back FROM {values(ASKED, 'id, q')}")
def query_feed_urls(spark, d):
    made = rows(spark, ASKED, "id int, q string").select("id", fetch.query_feed_url("https://s.example/", F.col("q")).alias("url"))
    return made.select("id", "url", fetch.query_of_feed_url(F.col("url")).alias("back"))


@query(r"SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) AS h1 FROM pages")
def html_title_h1(spark, d):
    part = lambda t: F.regexp_extract("html", rf"(?is)<{t}[^>]*>(.*?)</{t}>", 1)
    return A.table(spark, d, "pages").select("page_id", part("title").alias("title"), part("h1").alias("h1"))


@query()
def html_to_text(spark, d):
    return A.table(spark, d, "pages").select("page_id", parsers.decode_udf(T.html_to_text(F.col("html"))).alias("text"))


@query()
def readable_text(spark, d):
    return A.table(spark, d, "pages").select("page_id", parsers.readable_udf("html").alias("text"))


@query()
def html_links(spark, d):
    return parsers.explode_with(A.table(spark, d, "pages"), ["html", "url"], parsers.page_links, "page string, link string, title string, position int")


LINKS = """<html><body><nav><a href='/news/short'>Short</a></nav><article><h2><a href='/news/rain-floods'>Rain floods the old town</a> <a href='/news/second'>A second link of the heading</a></h2>
<a href='story/one'>Fifteen letters</a></article><a href='https://o.example/blog/x'>A long enough anchor text of another site</a><a href='/plain/y'>No pattern in the address of this one</a><a href='/news/z/'>Ends in a slash so it is no article</a>
<a href='https://x.com/news/1'>A social site's link that is long enough</a><a href='/post/q'>Subscribe to our newsletter for more of it</a><a href='/press/p'><h3>Heading inside of an anchor element</h3></a><a href='mailto:news@p.example'>Write to the news desk by mail, please do</a></body></html>"""


@query(f"""SELECT 'https://p.example/a/' AS page, link, title, position FROM {values([("https://p.example/news/rain-floods", "Rain floods the old town", 1), ("https://p.example/news/second", "A second link of the heading", 2), ("https://p.example/a/story/one", "Fifteen letters", 3), ("https://o.example/blog/x", "A long enough anchor text of another site", 4)], "link, title, position")}""")
def html_links_page(spark, d):
    return parsers.explode_with(rows(spark, [(LINKS, "https://p.example/a/")], "html string, url string"), ["html", "url"], parsers.page_links, "page string, link string, title string, position int")


@query()
def discover_feeds(spark, d):
    page = [("<html><link rel='alternate' type='application/rss+xml' href='/a.xml'><link rel=\"alternate\" type=\"application/atom+xml\" href=\"https://o.example/b\"></html>", "https://p.example/x/")]
    return parsers.explode_with(rows(spark, page, "html string, url string"), ["html", "url"], parsers.discover_feeds, "page string, feed string, position int")


RSS = "<rss><channel><item><title>First &amp; best story</title><link>https://a.example/1</link><guid>g1</guid><pubDate>Thu, 01 Jan 2026 00:00:00 GMT</pubDate><description>Brief</description></item><item><title>Second story</title><link>https://a.example/2</link></item></channel></rss>"
ATOM = "<feed xmlns='http://www.w3.org/2005/Atom'><entry><id>e1</id><title>Atom one</title><link rel='alternate' href='https://b.example/1'/><updated>2025-12-31T12:00:00Z</updated><author><name>Ann</name></author><summary>Short</summary></entry></feed>"


@query()
def rss_parse(spark, d):
    return parsers.feed_items(rows(spark, [(RSS, "https://a.example/feed"), (ATOM, "https://b.example/feed"), (RSS[:-10] + "<broken", "https://c.example/feed")], "body string, feed_url string"), NOW)


@query(f"SELECT i AS position, regexp_extract(b, '<title>(.*?)</title>', 1) AS title, regexp_extract(b, '<link>(.*?)</link>', 1) AS link, coalesce(nullif(regexp_extract(b, '<guid>(.*?)</guid>', 1), ''), regexp_extract(b, '<link>(.*?)</link>', 1)) AS guid FROM (SELECT unnest(l) AS b, generate_subscripts(l, 1) AS i FROM (SELECT regexp_extract_all(x, '<item>(.*?)</item>', 1) AS l FROM {values([(RSS,)], 'x')}))")
def rss_parse_regex(spark, d):
    part = lambda t: F.regexp_extract("b", f"<{t}>(.*?)</{t}>", 1)
    items = rows(spark, [(RSS,)], "x string").select(F.posexplode(F.regexp_extract_all("x", F.lit("<item>(.*?)</item>"), F.lit(1))).alias("i", "b"))
    return items.select((F.col("i") + 1).cast("long").alias("position"), part("title").alias("title"), part("link").alias("link"), F.coalesce(F.nullif(part("guid"), F.lit("")), part("link")).alias("guid"))


OPML = '<opml><body><outline text="News"><outline text="A" xmlUrl="https://a.example/f" category="x,Y"/><outline text="Deep"><outline title="B" xmlUrl="https://b.example/f"/></outline></outline><outline text="A2" xmlUrl="https://a.example/f"/></body></opml>'


@query()
def opml_import(spark, d):
    return parsers.explode_with(rows(spark, [(OPML,), ("<bad",)], "x string"), ["x"], parsers.parse_opml, "url string, title string, tags string")


FEEDS = [("https://a.example/f", "A & B", None), ("https://c.example/f", "C", "tech"), ("https://b.example/f", None, "tech"), ("https://d.example/f", "D", "arts")]
ESC = "replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@query(f"""SELECT '<opml version="2.0"><body>' || string_agg(b, '' ORDER BY c) || '</body></opml>' AS opml FROM (SELECT coalesce(collection, '') AS c, CASE WHEN collection IS NULL THEN l ELSE '<outline text="' || {ESC.format('collection')} || '">' || l || '</outline>' END AS b FROM (SELECT collection, string_agg(x, '' ORDER BY x) AS l FROM (SELECT collection, '<outline type="rss" text="' || {ESC.format('coalesce(title, url)')} || '" xmlUrl="' || {ESC.format('url')} || '"/>' AS x FROM {values(FEEDS, 'url, title, collection')}) GROUP BY collection))""")
def opml_export(spark, d):
    return fetch.export_opml(rows(spark, FEEDS, "url string, title string, collection string"))


LINES = [("# my feeds",), ("https://a.example/f/",), (" https://b.example/f",), ("",), ("https://a.example/f",)]
OPTIONS = [("https://a.example/f", False, "News, ,x", " tech ", 6), ("https://z.example/f//", None, None, "", None)]


@query(f"""WITH a AS (SELECT k, min(u) AS u FROM (SELECT trim(line) AS u, regexp_replace(trim(line), '/+$', '') AS k FROM {values(LINES, 'line')} WHERE trim(line) <> '' AND trim(line) NOT LIKE '#%') GROUP BY k),
 o AS (SELECT *, regexp_replace(trim(url), '/+$', '') AS ok FROM {values(OPTIONS, 'url, enabled, tags, collection, refresh_hours')})
 SELECT coalesce(k, ok) AS url, coalesce(enabled, true) AS enabled, array_to_string(list_filter(list_transform(string_split(tags, ','), lambda x: lower(trim(x))), lambda x: x <> ''), '|') AS tags, nullif(trim(collection), '') AS collection, refresh_hours FROM a FULL JOIN o ON k = ok""")
def feed_config_merge(spark, d):
    got = A.merge_feed_config(rows(spark, LINES, "line string"), rows(spark, OPTIONS, "url string, enabled boolean, tags string, collection string, refresh_hours int"))
    return got.select(T.url_key(F.col("url")).alias("url"), "enabled", F.when(F.col("tags").isNotNull(), F.array_join("tags", "|")).alias("tags"), "collection", "refresh_hours")


EVENTS = "ev AS (SELECT CAST(user_id AS VARCHAR) AS key, epoch_us(ts) // 1000 AS at_ms, event_id AS seq, event_type <> 'error' AS ok FROM events)"


def fetch_log(spark, d) -> DataFrame:
    """The events as a log of fetches: a user is a feed, an error a failed fetch."""
    return A.table(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("ok"))


@query(f"""WITH {EVENTS}, f AS (SELECT key AS url, max(at_ms) AS last_fetched, CAST(key AS BIGINT) % 48 AS h FROM ev GROUP BY key), n AS (SELECT max(at_ms) AS now FROM ev)
 SELECT url, NOT (h > 0 AND last_fetched + h * 3600000 - now > 0) AS due, CASE WHEN h > 0 AND last_fetched + h * 3600000 - now > 0 THEN CAST(ceil((last_fetched + h * 3600000 - now) / 60000) AS BIGINT) END AS wait_minutes FROM f, n""")
def feeds_due(spark, d):
    log = fetch_log(spark, d)
    now = log.agg(F.max("at_ms")).first()[0]
    st = log.groupBy(F.col("key").alias("url")).agg(F.max("at_ms").alias("last_fetched"))
    return A.due_feeds(st.select("url", (F.col("url").cast("long") % 48).alias("refresh_hours")), st, now)


SKIP_FEEDS = [("https://a.example/f", True), ("https://b.example/p", False), ("https://c.example/p", False), ("https://d.example/f", True)]
SKIP_STATE, SKIP_HOSTS, SKIP_ROBOTS = [("https://a.example/f", 2000), ("https://d.example/f", 500)], [("b.example", 5000)], [("https://c.example/p", False), ("https://d.example/f", False)]


@query(f"""SELECT f.url, CASE WHEN h.r > 1000 THEN 'host-paused' WHEN s.r > 1000 THEN 'backoff' WHEN NOT is_feed AND NOT coalesce(ok, true) THEN 'robots' END AS reason FROM {values(SKIP_FEEDS, 'url, is_feed').replace('AS t(', 'AS f(')}
 LEFT JOIN {values(SKIP_STATE, 'url, r').replace('AS t(', 'AS s(')} ON s.url = f.url LEFT JOIN {values(SKIP_HOSTS, 'host, r').replace('AS t(', 'AS h(')} ON h.host = regexp_extract(f.url, '://([^/]*)', 1) LEFT JOIN {values(SKIP_ROBOTS, 'url, ok').replace('AS t(', 'AS b(')} ON b.url = f.url""")
def fetch_skip_reason(spark, d):
    return A.skip_reason(rows(spark, SKIP_FEEDS, "url string, is_feed boolean"), rows(spark, SKIP_STATE, "url string, next_retry_at long"), rows(spark, SKIP_HOSTS, "host string, next_retry_at long"), rows(spark, SKIP_ROBOTS, "url string, allowed boolean"), 1000)


RETRY = [(i, s, a, r) for i, (s, a, r) in enumerate([(200, 0, None), (429, 0, "7"), (429, 2, "7"), (403, 0, None), (403, 1, "3"), (503, 1, None), (500, 0, "90"), (0, 1, None), (404, 0, "5"), (502, 0, "soon")])]
RETRY_SQL = """SELECT id, CASE WHEN attempt < 2 AND (status = 0 OR status = 429 OR status >= 500 OR (status = 403 AND ms IS NOT NULL)) THEN CASE WHEN status = 0 THEN 600 * (attempt + 1) ELSE least(coalesce(ms, 800 * (attempt + 1)), 15000) END END AS wait_ms
 FROM (SELECT *, CASE WHEN regexp_matches(retry_after, '^[0-9]+$') THEN TRY_CAST(retry_after AS BIGINT) * 1000 END AS ms FROM """


@query(RETRY_SQL + values(RETRY, "id, status, attempt, retry_after") + ")")
def retry_decision(spark, d):
    ms = bans.retry_after_ms(F.col("retry_after"), F.lit(NOW))
    return rows(spark, RETRY, "id int, status int, attempt int, retry_after string").select("id", bans.retry_wait_ms(F.col("status"), F.col("attempt"), ms).cast("long").alias("wait_ms"))


ANSWERS = [
    (i, s, b, h)
    for i, (s, b, h) in enumerate(
        [(200, "Hello", ""), (403, "", "cf-ray: 1"), (429, "", ""), (401, "recaptcha", ""), (407, None, None), (500, "<html>oops</html>", ""), (502, None, ""), (503, "<title>Just a moment...</title>", "server: cloudflare"), (503, "Service Unavailable", "server: nginx"),
         (503, "down", "date: x\nServer: AkamaiGHost"), (200, "please complete the reCAPTCHA", ""), (200, "the captcha debate", ""), (200, "recaptcha " + "x" * 16000, ""), (200, "Pardon Our Interruption", ""), (404, "Error 1020", ""), (403, "Reference #18.2f3a4b5c", ""),
         (200, "Attention Required! | Cloudflare", ""), (403, "x", "X-Sucuri-ID: 7"), (429, "", "x-datadome-cid: 1"), (200, "unusual traffic from your computer network", ""), (200, "DDoS protection by X", ""), (403, "px-captcha", ""), (403, "", "x-note: cf-ray: 1")]
    )
]
#: Written out from the rules, not from the lists the columns are built of.
SURE_SQL = r"""CASE WHEN regexp_matches({t}, '(?i)just a moment') THEN 'challenge cloudflare' WHEN regexp_matches({t}, '(?i)checking your browser before accessing|checking if the site connection is secure') THEN 'challenge cloudflare'
 WHEN regexp_matches({t}, '(?i)enable javascript and cookies to continue') THEN 'challenge cloudflare' WHEN regexp_matches({t}, '(?i)attention required!?\s*[|–-]?\s*cloudflare') THEN 'blocked cloudflare'
 WHEN regexp_matches({t}, '(?i)cf-chl-|__cf_chl|cf_chl_opt|cf-mitigated') THEN 'challenge cloudflare' WHEN regexp_matches({t}, '(?i)error\s*1020|access denied.*cloudflare') THEN 'blocked cloudflare'
 WHEN regexp_matches({t}, '(?i)request unsuccessful\.?\s*incapsula') THEN 'blocked imperva' WHEN regexp_matches({t}, '(?i)_incap_ses|incapsula incident id|incident id:\s*\d') THEN 'blocked imperva' WHEN regexp_matches({t}, '(?i)pardon our interruption') THEN 'blocked imperva'
 WHEN regexp_matches({t}, '(?i)reference\s*#\s*\d+\.[0-9a-f]{{6,}}') THEN 'blocked akamai' WHEN regexp_matches({t}, '(?i)akamai bot manager|_abck\b') THEN 'challenge akamai'
 WHEN regexp_matches({t}, '(?i)access denied - sucuri|sucuri website firewall|cloudproxy') THEN 'blocked sucuri' WHEN regexp_matches({t}, '(?i)datadome') THEN 'challenge datadome' WHEN regexp_matches({t}, '(?i)px-captcha|perimeterx') THEN 'challenge perimeterx'
 WHEN regexp_matches({t}, '(?i)distil_r_captcha|distil captcha') THEN 'challenge distil' ELSE {other} END"""
HINT_SQL = """CASE WHEN length({t}) > 15000 THEN NULL WHEN regexp_matches({t}, '(?i)g-recaptcha|hcaptcha|recaptcha') THEN 'challenge captcha' WHEN regexp_matches({t}, '(?i)are you a robot|verify you are human|are you a human') THEN 'challenge captcha'
 WHEN regexp_matches({t}, '(?i)unusual traffic from your computer network|automated queries') THEN 'blocked captcha' WHEN regexp_matches({t}, '(?i)ddos protection by|protected by cloudflare') THEN 'challenge cloudflare' END"""
HEADER_SQL = r"""CASE WHEN regexp_matches(seen, '(?im)^server:\s*cloudflare\b|^cf-ray:|^cf-mitigated:') THEN 'x cloudflare' WHEN regexp_matches(seen, '(?im)^server:\s*akamaighost\b|^x-akamai-') THEN 'x akamai' WHEN regexp_matches(seen, '(?im)^x-sucuri-(id|block|cache):') THEN 'x sucuri'
 WHEN regexp_matches(seen, '(?im)^x-datadome') THEN 'x datadome' WHEN regexp_matches(seen, '(?im)^x-iinfo:|^x-cdn:\s*incapsula|^server:.*incapsula') THEN 'x imperva' WHEN regexp_matches(seen, '(?im)^server:\s*zonealarm|^server:\s*wts/waf') THEN 'x waf' END"""
PAGE_SQL = SURE_SQL.format(t="body", other=HINT_SQL.format(t="body"))
BAN_SQL = f"""a AS (SELECT id, status, coalesce(body, '') AS body, coalesce(headers, '') || chr(10) || substr(coalesce(body, ''), 1, 8000) AS seen FROM {values(ANSWERS, 'id, status, body, headers')}),
 b AS (SELECT *, {PAGE_SQL} AS page, {SURE_SQL.format(t='seen', other=HEADER_SQL)} AS mark FROM a), c AS (SELECT *, split_part(mark, ' ', 2) AS v FROM b),
 bans AS (SELECT id, status, CASE WHEN status IN (401, 407) THEN NULL WHEN status = 429 THEN 'rate-limited' WHEN status = 403 THEN 'blocked' WHEN status = 503 THEN coalesce(split_part(page, ' ', 1), CASE WHEN v IS NOT NULL THEN 'challenge' END) WHEN status >= 500 THEN NULL ELSE split_part(page, ' ', 1) END AS kind,
  CASE WHEN status IN (401, 407) THEN NULL WHEN status IN (403, 429) THEN v WHEN status = 503 THEN coalesce(split_part(page, ' ', 2), v) WHEN status >= 500 THEN NULL ELSE split_part(page, ' ', 2) END AS vendor FROM c)"""


def _answers(spark) -> DataFrame:
    a = rows(spark, ANSWERS, "id int, status int, body string, headers string")
    return a.withColumn("ban", bans.ban(F.col("status"), F.col("body"), F.col("headers")))


@query(f"WITH {BAN_SQL} SELECT id, kind, vendor FROM bans")
def ban_classify(spark, d):
    return _answers(spark).select("id", "ban.kind", "ban.vendor")


@query(f"""WITH {BAN_SQL} SELECT id, CASE WHEN kind IS NULL THEN '' ELSE CASE status WHEN 429 THEN CASE WHEN vendor IS NULL THEN 'rate limited' ELSE 'rate limited by ' || vendor END || ' (HTTP 429)' WHEN 403 THEN CASE WHEN vendor IS NULL THEN 'request blocked' ELSE 'blocked by ' || vendor END || ' (HTTP 403)' ELSE vendor || ' ' || kind END
 || CASE WHEN vendor IS NULL THEN '' ELSE ' [' || vendor || ']' END || ' HTTP ' || status END AS said FROM bans""")
def ban_describe(spark, d):
    return _answers(spark).select("id", bans.describe(F.col("ban"), F.col("status")).alias("said"))


@query(f"SELECT page_id, split_part(page, ' ', 1) AS kind, split_part(page, ' ', 2) AS vendor FROM (SELECT page_id, {PAGE_SQL} AS page FROM (SELECT page_id, coalesce(html, '') AS body FROM pages))")
def interstitial_scan(spark, d):
    return A.table(spark, d, "pages").select("page_id", bans.interstitial(F.col("html")).alias("p")).select("page_id", "p.kind", "p.vendor")


ROBOTS = [("h.example", "User-agent: *\nDisallow: /p\nAllow: /page/1\nDisallow: /*.pdf$\n\nUser-agent: tide\nUser-agent: other\nDisallow: /page/2")]
RULES = [("h.example", "*", False, "/p", "^/p"), ("h.example", "*", True, "/page/1", "^/page/1"), ("h.example", "*", False, "/*.pdf$", r"^/.*\.pdf$"), ("h.example", "tide", False, "/page/2", "^/page/2"), ("h.example", "other", False, "/page/2", "^/page/2")]
PATHS = [(f"https://{h}{p}", h, p) for h in ("h.example", "none.example") for p in ("/page/1", "/page/2", "/p", "/x.pdf", "/x.pdf?y", "/")]


@query(f"""WITH r AS (SELECT * FROM {values(RULES, 'host, agent, allow, path, pattern')}), p AS (SELECT * FROM {values(PATHS, 'url, host, path')}), g AS (SELECT * FROM r WHERE agent = '*' OR starts_with('curl/8', agent)),
 b AS (SELECT p.url, g.allow, row_number() OVER (PARTITION BY p.url ORDER BY length(g.path) DESC, g.allow DESC) AS n FROM p JOIN g ON p.host = g.host AND regexp_matches(p.path, g.pattern))
 SELECT p.url, coalesce(b.allow, true) AS allowed FROM p LEFT JOIN b ON b.url = p.url AND b.n = 1""")
def robots_allowed(spark, d):
    own = parsers.explode_with(rows(spark, ROBOTS, "host string, text string"), ["host", "text"], lambda h, t: ({"host": h, **r} for r in parsers.robots_rules(t)), "host string, agent string, allow boolean, path string")
    return parsers.robots_allowed(own.withColumn("pattern", parsers.pattern_udf("path")), rows(spark, PATHS, "url string, host string, path string"), "curl/8")


# Ingest


def _halves(spark, d) -> tuple[DataFrame, DataFrame]:
    e = A.entries(spark, d)
    cached = A.first_by(e.filter("id % 3 <> 0").withColumns({"title_key": T.title_key(F.col("title")), "content_hash": T.content_hash(F.col("title"), F.col("summary"), F.col("content"))}).filter("title_key is not null"), "title_key", "id")
    cached = cached.select("guid", "title", "summary", "content", "title_key", "content_hash")
    batch = e.filter("id % 2 = 0").select(F.col("id").alias("arrival"), "guid", "title", "summary", F.when(F.col("id") % 8 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")).alias("content"))
    return cached, batch.union(batch.filter("arrival % 10 = 0").withColumn("arrival", F.col("arrival") + 10_000_000))


HALVES = f"""{ENTRIES}, c0 AS (SELECT guid, title, content, {KEY} AS title_key, sha1(coalesce(title, '') || chr(10) || chr(10) || coalesce(content, '')) AS content_hash, id FROM entries WHERE id % 3 <> 0),
 cached AS (SELECT guid, title_key, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY title_key ORDER BY id) AS n FROM c0 WHERE title_key IS NOT NULL) WHERE n = 1),
 b0 AS (SELECT id AS arrival, guid, title, CASE WHEN id % 8 = 0 THEN content || '!' ELSE content END AS content FROM entries WHERE id % 2 = 0),
 b1 AS (SELECT * FROM b0 UNION ALL SELECT arrival + 10000000, guid, title, content FROM b0 WHERE arrival % 10 = 0),
 b2 AS (SELECT *, {KEY} AS title_key, sha1(coalesce(title, '') || chr(10) || chr(10) || coalesce(content, '')) AS content_hash, trim(coalesce(title, '')) = '' AND trim(coalesce(content, '')) = '' AS void FROM b1),
 b3 AS (SELECT *, NOT void AND sum(CASE WHEN void THEN 0 ELSE 1 END) OVER (PARTITION BY guid ORDER BY arrival) > 1 AS again FROM b2),
 b4 AS (SELECT b3.*, CASE WHEN void OR again THEN 'skip' WHEN k.content_hash = b3.content_hash THEN 'unchanged' WHEN k.content_hash IS NOT NULL THEN 'update' WHEN b3.title_key IN (SELECT title_key FROM cached) THEN 'skip' ELSE 'new' END AS state FROM b3 LEFT JOIN cached k ON k.guid = b3.guid),
 b5 AS (SELECT *, CASE WHEN state = 'new' AND title_key IS NOT NULL AND coalesce(sum(CASE WHEN title_key IS NOT NULL AND state IN ('update', 'new') THEN 1 ELSE 0 END) OVER (PARTITION BY title_key ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 THEN 'skip' WHEN state = 'new' THEN 'insert' ELSE state END AS action FROM b4)"""


@query(f"WITH {HALVES} SELECT arrival, guid, action FROM b5")
def ingest_classify(spark, d):
    cached, batch = _halves(spark, d)
    return A.classify(batch, cached).select("arrival", "guid", "action")


@query(f"WITH {HALVES} SELECT guid, min(arrival) AS first_arrival FROM b2 WHERE NOT void GROUP BY guid")
def ingest_dedupe(spark, d):
    return A.first_by(_halves(spark, d)[1], "guid", "arrival").select("guid", F.col("arrival").alias("first_arrival"))


@query(f"WITH {HALVES}, fresh AS (SELECT guid, content_hash FROM b5 WHERE action IN ('insert', 'update')) SELECT guid, content_hash FROM cached WHERE guid NOT IN (SELECT guid FROM fresh) UNION ALL SELECT * FROM fresh")
def ingest_upsert(spark, d):
    cached, batch = _halves(spark, d)
    return A.upsert(cached, A.classify(batch, cached)).select("guid", "content_hash")


def doc_chunks(spark, d) -> DataFrame:
    """Every document as one chunk; a seventh of them without a vector, an eleventh without any chunk."""
    t = A.table(spark, d, "documents")
    return t.filter("doc_id % 11 <> 0").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("entry_id"), "text", F.when(F.col("doc_id") % 7 != 0, F.array(F.lit(1.0))).alias("embedding"), F.when(F.col("doc_id") % 5 != 0, "contextual-v2").alias("embed_style"))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 11 = 0 THEN 'no-chunks' WHEN doc_id % 7 = 0 THEN 'no-vector' ELSE 'stale-style' END AS gap FROM documents WHERE doc_id % 11 = 0 OR doc_id % 7 = 0 OR doc_id % 5 = 0")
def reindex_gaps(spark, d):
    return E.gaps(A.table(spark, d, "documents").select(F.col("doc_id").alias("id")), doc_chunks(spark, d))


@query()
def chunk_sections(spark, d):
    return parsers.chunks(spread(A.entries(spark, d).select("id", "title", "summary", "content")))


@query("SELECT conv_id, turn, CASE WHEN p IS NULL THEN text ELSE trim(right(p, 120) || ' ' || text) END AS text FROM (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations)")
def chunk_overlap(spark, d):
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return A.table(spark, d, "conversations").select("conv_id", "turn", F.when(before.isNull(), F.col("text")).otherwise(F.trim(F.concat(F.right(before, F.lit(120)), F.lit(" "), "text"))).alias("text"))


@query(f"WITH {ENTRIES} SELECT id, sha1(CASE WHEN trim(title) <> '' THEN trim(title) || ' | ' || collection || chr(10) || content ELSE collection || chr(10) || content END) AS digest FROM entries")
def contextual_text(spark, d):
    return A.entries(spark, d).select("id", F.sha1(T.contextual(F.col("title"), F.col("collection"), F.col("content"))).alias("digest"))


MODELS = [(i, m, q) for i, (m, q) in enumerate([("nomic-embed-text", True), ("nomic-embed-text", False), ("BGE-small", True), ("bge-small", False), ("mxbai-large", True), ("other", True), (None, True)])]


@query(f"SELECT id, CASE WHEN contains(m, 'nomic') THEN CASE WHEN q THEN 'search_query: ' ELSE 'search_document: ' END WHEN q AND (contains(m, 'bge') OR contains(m, 'mxbai') OR contains(m, 'snowflake')) THEN 'Represent this sentence for searching relevant passages: ' ELSE '' END AS prefix FROM (SELECT id, lower(coalesce(model, '')) AS m, q FROM {values(MODELS, 'id, model, q')})")
def embed_prefix(spark, d):
    return rows(spark, MODELS, "id int, model string, q boolean").select("id", T.embed_prefix(F.col("model"), F.col("q")).alias("prefix"))


@query("""WITH c AS (SELECT item_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) - 1 AS i FROM benchmark), s AS (SELECT item_id, i % 16 AS slot, sum(unicode(ch) + 1) AS x FROM c WHERE ch <> '' GROUP BY ALL), n AS (SELECT item_id, sqrt(sum(x * x)) AS norm FROM s GROUP BY item_id)
 SELECT s.item_id, CAST(slot AS INTEGER) AS slot, round(x / norm, 6) AS value FROM s JOIN n ON s.item_id = n.item_id""")
def char_hash_embedding(spark, d):
    v = A.table(spark, d, "benchmark").select("item_id", F.posexplode(T.char_hash_vector(F.col("text"))).alias("slot", "value"))
    return v.filter("value > 0").select("item_id", "slot", F.round("value", 6).alias("value"))


# Filters and readers


def _ids(spark, d, **f) -> DataFrame:
    return A.entries(spark, d).filter(A.article_filter(**f)).select("id", "pub_date")


@query(f"WITH {ENTRIES} SELECT id, pub_date FROM entries WHERE pub_date >= 1767225600000 - 7 * 86400000 AND pub_date <= epoch_ms(TIMESTAMP '2025-12-30')")
def filter_days(spark, d):
    return _ids(spark, d, days=7, before="2025-12-30", after="never")


@query(f"WITH {ENTRIES} SELECT id, pub_date FROM entries WHERE contains(lower(feed_url), 'src1') AND contains(lower(author), 'rc1')")
def filter_feed_author(spark, d):
    return _ids(spark, d, feed="SRC1", author="rc1")


@query(f"WITH {ENTRIES} SELECT id, pub_date FROM entries WHERE list_contains(tags, 'src1')")
def filter_tag_exact(spark, d):
    return _ids(spark, d, tag="SRC1")


@query(f"WITH {ENTRIES} SELECT id, pub_date FROM entries WHERE collection = 'en' AND starred")
def filter_collection_starred(spark, d):
    return _ids(spark, d, collection="EN", starred="true")


@query(f"WITH {ENTRIES} SELECT id, pub_date FROM entries WHERE id IN (1, 2, 3, 500) AND collection = 'en'")
def filter_within_ids(spark, d):
    return _ids(spark, d, within="1,2,3,500", collection="en")


@query(f"WITH {ENTRIES} SELECT id, title, feed_url, pub_date FROM entries ORDER BY pub_date DESC, id LIMIT 20")
def recent_articles(spark, d):
    return A.recent(A.entries(spark, d))


@query(f"WITH {ENTRIES} SELECT id, title, substr(content, 101, 500) AS page, length(content) AS total_chars, 600 < length(content) AS has_more, CASE WHEN 600 < length(content) THEN 600 END AS next_offset FROM entries WHERE guid = 'doc:3'")
def article_page(spark, d):
    return A.article_page(A.entries(spark, d), "doc:3", 100, 100)


@query("SELECT conv_id, turn, text FROM conversations WHERE conv_id = 3")
def article_chunks(spark, d):
    return A.table(spark, d, "conversations").filter("conv_id = 3").orderBy("turn").select("conv_id", "turn", "text")


@query(f"WITH {ENTRIES} SELECT id, starred OR id = 5 OR guid = 'doc:7' AS starred, is_read AND NOT (id = 5 OR guid = 'doc:7') AS is_read FROM entries")
def set_state(spark, d):
    return A.set_state(A.entries(spark, d), [5], ["doc:7"], starred=True, is_read=False).select("id", "starred", "is_read")


@query(f"WITH {ENTRIES} SELECT id, title, pub_date, NULL::DOUBLE AS score FROM entries WHERE (contains(lower(title), 'license') OR contains(lower(content), 'license')) AND collection = 'en' ORDER BY pub_date DESC, id LIMIT 8")
def fallback_like_search(spark, d):
    return A.like_search(A.entries(spark, d), "License", collection="en")


# Retrieval


def chunk_texts(spark, d) -> DataFrame:
    return spread(A.table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("entry_id"), "text"))


def bench_queries(spark, d) -> DataFrame:
    return A.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _bm25_sql(x: str, terms: str, hits: str, dl: str, tf: str, keep: str = "true") -> str:
    """Tables of a BM25 list, each with x behind its name; tf is counted for the rows that hold every term only."""
    return rf"""q{x} AS (SELECT item_id AS query_id, unnest({terms}) AS term FROM benchmark), wanted{x} AS (SELECT query_id, count(*) AS w FROM q{x} GROUP BY query_id),
 s{x} AS (SELECT count(*) AS n, avg({dl}) AS avgdl FROM docs), h{x} AS ({hits}), df{x} AS (SELECT term, count(*) AS df FROM h{x} GROUP BY term),
 whole{x} AS (SELECT query_id, chunk_id FROM h{x} JOIN q{x} USING (term) JOIN wanted{x} USING (query_id) WHERE {keep} GROUP BY query_id, chunk_id, w HAVING count(*) = w),
 tf{x} AS (SELECT query_id, chunk_id, df, {dl} AS dl, {tf} AS tf FROM whole{x} JOIN q{x} USING (query_id) JOIN df{x} USING (term) JOIN docs USING (chunk_id)),
 ranked{x} AS (SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM tf{x}, s{x} GROUP BY query_id, chunk_id),
 bm{x} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ranked{x} QUALIFY rank <= 60)"""


DOCS = r"docs AS (SELECT doc_id AS chunk_id, lower(text) AS low, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS words FROM documents)"
WORD_HITS = "SELECT DISTINCT term, chunk_id FROM (SELECT chunk_id, unnest(words) AS term FROM docs) WHERE term IN (SELECT term FROM q)"
WORD_TF = "len(list_filter(words, lambda z: z = term))"
SUB_HITS = "SELECT term, chunk_id FROM docs JOIN (SELECT DISTINCT term FROM q2) ON contains(low, term)"
SUB_TF = "len(list_filter(range(1, length(low) + 1), lambda i: substr(low, i, length(term)) = term))"
BM25_WORDS = _bm25_sql("", TERMS, WORD_HITS, "len(words)", WORD_TF)
BM25_SUBS = _bm25_sql("2", f"list_filter({TERMS}, lambda z: length(z) >= 3)", SUB_HITS, "greatest(length(low) - 2, 0)", SUB_TF)


@query(f"WITH {DOCS}, {BM25_WORDS} SELECT query_id, chunk_id, score, rank FROM bm")
def bm25_unicode(spark, d):
    return S.bm25_words(chunk_texts(spark, d), bench_queries(spark, d))


@query()
def bm25_porter(spark, d):
    return S.bm25_words(chunk_texts(spark, d), bench_queries(spark, d), stems=True)


@query(f"WITH {DOCS}, {BM25_SUBS} SELECT query_id, chunk_id, score, rank FROM bm2")
def trigram_search(spark, d):
    return S.bm25_substrings(chunk_texts(spark, d), bench_queries(spark, d))


@query(f"WITH {DOCS}, {_bm25_sql('', TERMS, WORD_HITS, 'len(words)', WORD_TF, 'chunk_id % 2 = 0')} SELECT query_id, chunk_id, score, rank FROM bm")
def bm25_filtered(spark, d):
    return S.bm25_words(chunk_texts(spark, d), bench_queries(spark, d), keep=A.entries(spark, d).filter("id % 2 = 0"))


VECTORS = """v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, round(list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)), 9) AS sim FROM v a, v b WHERE a.vec_id % 100 = 0 AND {keep})
 SELECT query_id, chunk_id, round(sim, 6) AS sim, row_number() OVER (PARTITION BY query_id ORDER BY p.sim DESC, chunk_id) AS rank FROM p WHERE p.sim > 0 QUALIFY rank <= 20"""


def vectors(spark, d) -> DataFrame:
    return A.table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def vector_queries(spark, d) -> DataFrame:
    return vectors(spark, d).filter("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "query_id")


@query("WITH " + VECTORS.format(keep="true"))
def vector_topk(spark, d):
    return S.vector_topk(spark, vectors(spark, d), vector_queries(spark, d), 20)


@query("WITH " + VECTORS.format(keep="b.vec_id % 3 = 0"))
def vector_topk_filtered(spark, d):
    return S.vector_topk(spark, vectors(spark, d), vector_queries(spark, d), 20, vectors(spark, d).filter("chunk_id % 3 = 0").select(F.col("chunk_id").alias("id")))


@query("SELECT count(*) AS n, round(avg(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS mean_norm, max(len(embedding)) AS dim FROM embeddings")
def cosine_matrix_stats(spark, d):
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return vectors(spark, d).agg(F.count("*").alias("n"), F.round(F.avg(norm), 6).alias("mean_norm"), F.max(F.size("embedding")).cast("long").alias("dim"))


FUSED = f"""{DOCS}, {BM25_WORDS}, {BM25_SUBS},
 lists AS (SELECT query_id, chunk_id, rank FROM bm UNION ALL SELECT query_id, chunk_id, rank FROM bm2), f0 AS (SELECT query_id, chunk_id, sum(1.0 / (60 + rank)) AS rrf FROM lists GROUP BY ALL), fused AS (SELECT *, rrf / max(rrf) OVER (PARTITION BY query_id) AS score FROM f0)"""


def _fused(spark, d) -> DataFrame:
    """Both lists of one pass over the texts, fused: a few hundred rows a query, written, so that joins may broadcast them."""
    lists = S.bm25_lists(chunk_texts(spark, d), bench_queries(spark, d), ("words", "substrings"))
    return Tables(spark, "fused").write(S.fuse({"words": lists["words"], "trigram": lists["substrings"]}), "fused")


def _fused_articles(spark, d) -> DataFrame:
    return S.blend(S.small(_fused(spark, d)).join(A.entries(spark, d), F.col("id") == F.col("chunk_id")))


@query(f"WITH {FUSED} SELECT query_id, chunk_id, round(rrf, 6) AS rrf, round(score, 6) AS score FROM fused")
def rrf_fuse(spark, d):
    return _fused(spark, d).select("query_id", "chunk_id", F.round("rrf", 6).alias("rrf"), F.round("score", 6).alias("score"))


@query(f"WITH {ENTRIES} SELECT id, round(exp(-greatest((1767225600000 - pub_date) / 86400000.0, 0) / 30), 6) AS recency FROM entries")
def recency_blend(spark, d):
    return A.entries(spark, d).select("id", F.round(S.recency(F.col("pub_date")), 6).alias("recency"))


@query(f"WITH {FUSED} SELECT query_id, chunk_id // 4 AS entry_id, round(max(score), 6) AS score, arg_min(chunk_id, (-score, chunk_id)) AS chunk_id FROM fused GROUP BY ALL")
def best_chunk_per_entry(spark, d):
    c = A.table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.floor(F.col("doc_id") / 4).alias("entry_id"))
    return S.best_chunk(S.small(_fused(spark, d)), c).select("query_id", "entry_id", F.round("score", 6).alias("score"), "chunk_id")


@query(f"WITH {ENTRIES}, {FUSED} SELECT query_id, id AS entry_id, row_number() OVER (PARTITION BY query_id ORDER BY pub_date DESC, 0.8 * score + 0.2 * exp(-greatest((1767225600000 - pub_date) / 86400000.0, 0) / 30) DESC, id) AS position FROM fused JOIN entries ON id = chunk_id QUALIFY position <= 8")
def search_by_date(spark, d):
    r = _fused_articles(spark, d)
    w = Window.partitionBy("query_id").orderBy(F.desc("pub_date"), F.desc("combined"), "id")
    return r.withColumn("position", F.row_number().over(w)).filter("position <= 8").select("query_id", F.col("id").alias("entry_id"), "position")


@query(f"WITH {FUSED} SELECT query_id, chunk_id, bm.rank AS words_rank, bm2.rank AS trigram_rank, round(rrf, 3) AS rrf FROM fused LEFT JOIN bm USING (query_id, chunk_id) LEFT JOIN bm2 USING (query_id, chunk_id)")
def search_debug(spark, d):
    return _fused(spark, d).select("query_id", "chunk_id", F.col("ranks")["words"].alias("words_rank"), F.col("ranks")["trigram"].alias("trigram_rank"), F.round("rrf", 3).alias("rrf"))


def _pool(spark, d) -> DataFrame:
    r = _fused_articles(spark, d)
    return r.select("query_id", F.col("id").alias("entry_id"), "title", "content", "combined", parsers.simhash_udf("content").alias("simhash"))


@query()
def hybrid_search(spark, d):
    return hybrid(spark, A.entries(spark, d), bench_queries(spark, d))


@query()
def mmr_diversify(spark, d):
    return S.diversify(_pool(spark, d)).select("query_id", "entry_id", "position")


@query()
def rerank_shortlist(spark, d):
    pool = _pool(spark, d).join(bench_queries(spark, d), "query_id").withColumn("summary", F.lit(None).cast("string"))
    ranked = pool.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("combined"), "entry_id")))
    return S.rerank_shortlist(ranked, lambda q, t: -abs(len(q or "") - len(t or ""))).select("query_id", "entry_id", "position", "reranked")


@query(rf"WITH {ENTRIES}, t AS (SELECT id, list_sort(list_distinct(regexp_extract_all(lower(coalesce(title, '')), '[\p{{L}}\p{{N}}]{{3,}}'))) AS w FROM entries), c AS (SELECT w, min(id) AS head FROM t WHERE len(w) > 0 GROUP BY w), p AS (SELECT a.head AS id, b.head AS other, len(list_intersect(a.w, b.w)) / len(list_distinct(a.w || b.w)) AS likeness FROM c a JOIN c b ON a.head < b.head) SELECT id, other, round(likeness, 6) AS likeness FROM p WHERE p.likeness >= 0.6 - 1e-9 UNION ALL SELECT head, t.id, 1.0 FROM t JOIN c USING (w) WHERE t.id <> head")
def title_jaccard_pairs(spark, d):
    t = A.entries(spark, d).select("id", T.title_tokens(F.col("title")).alias("words"))
    return M.likeness_pairs(t).withColumn("likeness", F.round("likeness", 6))


@query("""WITH f AS (SELECT doc_id, trim(regexp_replace(text, '[\\s ]+', ' ', 'g')) AS flat FROM documents), g AS (SELECT *, greatest(1, coalesce(nullif(instr(lower(flat), 'tion'), 0), 1) - 200) AS st FROM f)
 SELECT doc_id, CASE WHEN length(flat) <= 600 THEN flat ELSE (CASE WHEN st > 1 THEN '…' ELSE '' END) || trim(substr(flat, st, 600)) || (CASE WHEN st + 599 < length(flat) THEN '…' ELSE '' END) END AS snippet FROM g""")
def snippets(spark, d):
    return A.table(spark, d, "documents").select("doc_id", T.snippet(F.col("text"), F.array(F.lit("of"), F.lit("tion"))).alias("snippet"))


@query("SELECT h.conv_id, h.turn, string_agg(c.text, ' ' ORDER BY c.turn) AS context FROM conversations h JOIN conversations c ON c.conv_id = h.conv_id AND c.turn BETWEEN h.turn - 1 AND h.turn + 1 WHERE h.turn % 2 = 1 GROUP BY h.conv_id, h.turn")
def context_expand(spark, d):
    c = A.table(spark, d, "conversations").select(F.col("conv_id").alias("entry_id"), F.col("turn").alias("chunk_index"), "text")
    return S.neighbours(c, c.filter("chunk_index % 2 = 1")).select(F.col("entry_id").alias("conv_id"), F.col("chunk_index").alias("turn"), "context")


# Near-duplicates


@query()
def simhash_fingerprint(spark, d):
    return spread(A.table(spark, d, "documents").select("doc_id", "text")).select("doc_id", parsers.simhash_udf("text").alias("simhash"))


@query()
def near_dup_pairs(spark, d):
    prints = Tables(spark, "prints").write(simhash_fingerprint(spark, d).toDF("id", "simhash"), "prints")  # read twice
    return M.banded_pairs(prints, 4)


@query()
def near_dup_collapse(spark, d):
    """Every row of each query's shortlist that isn't a near copy of a better one, best first."""
    return S.diversify(_pool(spark, d), 2 * A.Settings().fts_list, lam=1.0).select("query_id", "entry_id", "position")


SIGNS = "s AS (SELECT vec_id, label, list_sum(list_transform(range(1, 33), lambda i: CASE WHEN embedding[i] > 0 THEN (1::BIGINT << (i - 1)) ELSE 0 END))::BIGINT AS lo, list_sum(list_transform(range(33, 65), lambda i: CASE WHEN embedding[i] > 0 THEN (1::BIGINT << (i - 33)) ELSE 0 END))::BIGINT AS hi FROM embeddings)"


PAIRED = "WITH " + SIGNS + " SELECT a.vec_id, b.vec_id AS other, bit_count(xor(a.lo, b.lo)) + bit_count(xor(a.hi, b.hi)) AS bits FROM s a JOIN s b ON a.vec_id < b.vec_id WHERE bit_count(xor(a.lo, b.lo)) + bit_count(xor(a.hi, b.hi)) <= {most}"


def _sign_pairs(spark, d, most: int) -> DataFrame:
    half = lambda a: F.aggregate(F.transform(F.slice("embedding", a, 32), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, x: s + x)
    return M.hamming_pairs(A.table(spark, d, "embeddings").select("vec_id", half(1).alias("lo"), half(33).alias("hi")), most)


@query(PAIRED.format(most=20))
def hamming_pairs(spark, d):
    return _sign_pairs(spark, d, 20)


@query(PAIRED.format(most=24))
def hamming_pairs_all(spark, d):
    return _sign_pairs(spark, d, 24)


# Upkeep and reports

LIMITS = [("https://src1.example/feed", 3), ("https://src2.example/feed", 110)]


@query(f"WITH {ENTRIES}, o AS (SELECT * FROM {values(LIMITS, 'feed_url, days')}) SELECT id FROM entries LEFT JOIN o USING (feed_url) WHERE pub_date >= 1767225600000 - (CASE WHEN source_type = 'web' THEN 14 ELSE coalesce(o.days, 90) END) * 86400000::BIGINT")
def retention_sweep(spark, d):
    return A.retention(A.entries(spark, d), rows(spark, LIMITS, "feed_url string, days int")).select("id")


LISTED = [(f"https://src{i}.example/feed/",) for i in range(10)]


@query(f"WITH {ENTRIES} SELECT id FROM entries WHERE source_type = 'web' OR feed_url IN (SELECT regexp_replace(u, '/+$', '') FROM {values(LISTED, 'u')})")
def prune_removed(spark, d):
    return A.prune(A.entries(spark, d), rows(spark, LISTED, "url string")).select("id")


@query("SELECT turn, conv_id AS entry_id FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0)")
def orphan_chunks(spark, d):
    c = A.table(spark, d, "conversations").select(F.col("conv_id").alias("entry_id"), "turn")
    return A.orphans(c, A.entries(spark, d).filter("id % 2 = 0")).select("turn", "entry_id")


def _backoff_sql(first: int, most: int) -> str:
    return f"""WITH {EVENTS}, w AS (SELECT *, sum(ok::INT) OVER (PARTITION BY key ORDER BY at_ms, seq) AS wins FROM ev), l AS (SELECT key, max(wins) AS top, max(at_ms) AS last_ms FROM w GROUP BY key), f AS (SELECT l.key, last_ms, count(w.key) FILTER (NOT ok) AS fail_count FROM l LEFT JOIN w ON w.key = l.key AND w.wins = l.top GROUP BY l.key, last_ms)
 SELECT key, fail_count, last_ms, CASE WHEN fail_count > 0 THEN last_ms + CAST(least({most}, {first} * pow(2, fail_count - 1)) AS BIGINT) END AS next_retry_at FROM f"""


@query(_backoff_sql(900_000, 86_400_000))
def feed_backoff(spark, d):
    return state.backoff(fetch_log(spark, d))


HOSTS = """h AS (SELECT 'h' || user_id % 40 || '.example' AS host, epoch_us(ts) // 1000 AS at_ms, event_id AS seq, CASE WHEN event_type <> 'error' THEN NULL WHEN event_id % 3 = 0 THEN 'rate-limited' WHEN event_id % 3 = 1 THEN 'blocked' ELSE 'challenge' END AS kind, event_type = 'error' AND event_id % 3 > 0 AS terminal FROM events)"""


@query(f"""WITH {HOSTS}, r AS (SELECT * FROM h WHERE terminal OR kind IS NULL), w AS (SELECT *, count(*) FILTER (kind IS NULL) OVER (PARTITION BY host ORDER BY at_ms, seq) AS wins FROM r), l AS (SELECT host, max(wins) AS top FROM w GROUP BY host), f AS (SELECT w.host, count(*) AS ban_count, arg_max(kind, (at_ms, seq)) AS ban_kind, max(at_ms) AS last_ban_at FROM w JOIN l ON l.host = w.host AND l.top = w.wins WHERE kind IS NOT NULL GROUP BY w.host)
 SELECT host, ban_kind, ban_count, last_ban_at, last_ban_at + CAST(least(43200000, 1800000 * pow(2, ban_count - 1)) AS BIGINT) AS next_retry_at FROM f""")
def host_ban_backoff(spark, d):
    """The events as answers of 40 hosts: errors are bans of three kinds, of which rate limits aren't terminal."""
    kind = F.when(F.col("event_type") == "error", F.element_at(F.array(F.lit("rate-limited"), F.lit("blocked"), F.lit("challenge")), (F.col("event_id") % 3 + 1).cast("int")))
    e = A.table(spark, d, "events").select(F.concat(F.lit("h"), F.col("user_id") % 40, F.lit(".example")).alias("host"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), F.col("event_id").alias("seq"), kind.alias("kind"))
    return state.host_bans(e.withColumn("terminal", F.coalesce(F.col("kind") != "rate-limited", F.lit(False))))


@query(f"WITH {EVENTS}, l AS (SELECT key, arg_max(ok, (at_ms, seq)) AS ok, max(at_ms) AS seen FROM ev GROUP BY key) SELECT count(*) AS feeds, round(avg(ok::INT), 6) AS success, round((1767225600000 - max(seen)) / 3600000.0, 6) AS freshness_hours, (SELECT round(count(*) FILTER (NOT ok) / nullif(count(*), 0), 6) FROM ev) AS error_rate FROM l")
def feed_health(spark, d):
    return M.feed_health(fetch_log(spark, d), NOW)


WATCHES = [(1, "the", None), (2, "license apache", NOW - 10 * A.DAY_MS), (3, "qqqq", None)]


@query(f"""WITH {ENTRIES}, w AS (SELECT * FROM {values(WATCHES, 'watch_id, query, last_run')}), h AS (SELECT watch_id, id FROM w JOIN entries ON pub_date > coalesce(last_run, 1767225600000 - 30 * 86400000::BIGINT) AND len(list_filter(string_split(query, ' '), lambda x: NOT contains(lower(title || ' ' || content), x))) = 0)
 SELECT w.watch_id, count(h.id) AS hits, 1767225600000 AS last_run, min(h.id) AS first_hit FROM w LEFT JOIN h ON h.watch_id = w.watch_id GROUP BY w.watch_id""")
def watch_eval(spark, d):
    return state.watch_hits(A.entries(spark, d), rows(spark, WATCHES, "watch_id int, query string, last_run long"), NOW)


@query(f"""WITH {ENTRIES}, c AS (SELECT doc_id FROM documents WHERE doc_id % 11 <> 0) SELECT count(*) AS entries, count(DISTINCT feed_url) AS feeds, count(*) FILTER (source_type = 'web') AS web_entries, count(*) FILTER (starred) AS starred, count(*) FILTER (NOT is_read) AS unread, round(count(DISTINCT feed_url) / count(*), 3) AS diversity, round(avg((length(content) > 0)::INT), 6) AS full_text_share, max(cached_at) AS last_refresh,
 (SELECT count(*) FROM c) AS chunks, (SELECT count(*) FROM c WHERE doc_id % 7 = 0) AS missing, (SELECT round(count(*) FILTER (doc_id % 7 = 0) / count(*), 6) FROM c) AS backlog, (SELECT count(*) FROM documents WHERE doc_id % 11 = 0) AS chunkless FROM entries""")
def cache_stats(spark, d):
    return A.cache_stats(A.entries(spark, d), doc_chunks(spark, d))


@query(f"WITH {ENTRIES} SELECT collection, count(*) AS n, count(DISTINCT feed_url) AS feeds, round(count(DISTINCT feed_url) / count(*), 3) AS diversity FROM entries GROUP BY collection")
def source_diversity(spark, d):
    return A.entries(spark, d).groupBy("collection").agg(F.count("*").alias("n"), F.count_distinct("feed_url").alias("feeds"), F.round(F.count_distinct("feed_url") / F.count("*"), 3).alias("diversity"))


@query("SELECT lang AS collection, count(*) AS chunks, count(*) FILTER (doc_id % 7 = 0) AS missing, round(count(*) FILTER (doc_id % 7 = 0) / count(*), 6) AS backlog FROM documents WHERE doc_id % 11 <> 0 GROUP BY lang")
def coverage_backlog(spark, d):
    c = doc_chunks(spark, d).join(A.entries(spark, d).select(F.col("id").alias("entry_id"), "collection"), "entry_id")
    return c.groupBy("collection").agg(F.count("*").alias("chunks"), F.count_if(F.col("embedding").isNull()).alias("missing"), F.round(F.count_if(F.col("embedding").isNull()) / F.count("*"), 6).alias("backlog"))


@query(f"WITH {ENTRIES}, a AS (SELECT (1767225600000 - pub_date) / 86400000.0 AS age FROM entries WHERE pub_date > 0) SELECT round(avg(age), 6) AS mean_days, round(quantile_cont(age, 0.5), 6) AS median_days, round(max(age), 6) AS oldest_days FROM a")
def age_distribution(spark, d):
    return A.age_report(A.entries(spark, d))


@query("SELECT event_type, round(quantile_disc(value, 0.5), 6) AS p50, round(quantile_disc(value, 0.95), 6) AS p95, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY event_type")
def latency_percentiles(spark, d):
    return M.nearest_rank(A.table(spark, d, "events").filter("value is not null"), "event_type", "value")


PAYLOAD = [("solar", '{"results": [{"title": "One", "url": "https://a.example/1", "content": "x  y"}, {"title": "Again", "url": "https://a.example/1", "content": "z"}, {"title": "None", "content": "q"}, {"title": "Two", "url": "https://b.example/2", "content": "long text"}]}')]


@query("""SELECT 'solar' AS query, CAST(r AS INTEGER) AS rank, t AS title, u AS url, s AS snippet FROM (VALUES (1, 'One', 'https://a.example/1', 'x y'), (2, 'Two', 'https://b.example/2', 'long text')) AS x(r, t, u, s)""")
def web_digest(spark, d):
    return fetch.digest(fetch.search_results(rows(spark, PAYLOAD, "query string, payload string")))


@query("""WITH r AS (SELECT page_id AS position, url, regexp_extract(lower(url), '://([^/?#]*)', 1) AS host FROM pages QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1), n AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY position) AS nth FROM r)
 SELECT position, url, host FROM n WHERE nth <= 3 AND url NOT IN (SELECT url FROM pages WHERE page_id % 4 = 0) ORDER BY position, url LIMIT 25""")
def web_backfill_select(spark, d):
    p = A.table(spark, d, "pages")
    cached = p.filter("page_id % 4 = 0").select(F.col("url").alias("link"), F.concat(F.lit("web:"), "url").alias("guid"))
    return fetch.backfill_choice(p.select(F.col("page_id").alias("position"), "url"), cached, 25)


QRELS = "qr AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), rel AS (SELECT query_id, count(*) AS n FROM qr GROUP BY query_id)"


@query(f"""WITH {QRELS}, {DOCS}, {BM25_WORDS}, hit AS (SELECT bm.query_id, rank FROM bm JOIN qr ON qr.query_id = bm.query_id AND qr.doc_id = bm.chunk_id WHERE rank <= 10),
 m AS (SELECT rel.query_id, count(rank) FILTER (rank <= 1) / n AS r1, count(rank) FILTER (rank <= 3) / n AS r3, count(rank) FILTER (rank <= 5) / n AS r5, count(rank) / n AS r10, coalesce(1 / min(rank), 0) AS rr, coalesce(sum(1 / log2(rank + 1)), 0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, least(10, any_value(n)) + 1) t(i)) AS ndcg FROM rel LEFT JOIN hit ON hit.query_id = rel.query_id GROUP BY rel.query_id, n)
 SELECT count(*) AS queries, round(avg(r1), 6) AS recall_1, round(avg(r3), 6) AS recall_3, round(avg(r5), 6) AS recall_5, round(avg(r10), 6) AS recall_10, round(avg(rr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg_10 FROM m""")
def eval_metrics(spark, d):
    q = bench_queries(spark, d)
    return M.retrieval_metrics(S.bm25_words(chunk_texts(spark, d), q), M.passages_in(chunk_texts(spark, d), q))


GATE = [("recall_5", 0.79, 0.80), ("recall_10", 0.92, 0.86), ("mrr", 0.78, 0.73), ("ndcg_10", 0.82, 0.7699)]


@query(f"SELECT metric, current::DOUBLE - baseline::DOUBLE < -0.05::DOUBLE AS regressed FROM {values(GATE, 'metric, baseline, current')}")
def eval_regressions(spark, d):
    return M.regressions(rows(spark, GATE, "metric string, baseline double, current double"))


@query()
def stream_dedupe(spark, d):
    return jobs.dedupe(spark, d)


@query()
def stream_feed_state(spark, d):
    return jobs.feed_state(spark, d)


@query()
def stream_watches(spark, d):
    return jobs.watches(spark, d)


@query(f"WITH {EVENTS}, x AS (SELECT key, at_ms, seq, ok FROM ev QUALIFY row_number() OVER (PARTITION BY key ORDER BY at_ms DESC, seq DESC) = 1) SELECT key, at_ms, ok FROM x")
def state_upsert(spark, d):
    log = fetch_log(spark, d).withColumn("stamp", F.struct("at_ms", "seq"))
    return log.groupBy("key").agg(F.max_by(F.struct("at_ms", "ok"), "stamp").alias("x")).select("key", "x.*")


@query(f"""WITH {ENTRIES}, p AS (SELECT CAST('0x' || substr(sha256(id || '|' || coalesce(title, '')), 1, 15) AS BIGINT) AS x FROM entries)
 SELECT substr(sha256(count(*) || '|' || sum(x::HUGEINT) || '|' || bit_xor(x)), 1, 8) AS fingerprint FROM p""")
def index_fingerprint(spark, d):
    return M.fingerprint(A.entries(spark, d).select(F.concat(F.col("id").cast("string"), F.lit("|"), F.coalesce("title", F.lit(""))).alias("line")))


# A refresh pass over recorded answers

FRESH = """<rss><channel><item><title>Newest of the feed</title><link>https://f.example/1</link><guid>gf1</guid><pubDate>Thu, 01 Jan 2026 00:00:00 GMT</pubDate></item><item><title>Older of the feed</title><link>https://f.example/2</link><guid>gf2</guid><pubDate>Mon, 01 Dec 2025 00:00:00 GMT</pubDate></item></channel></rss>"""
_HOUR = 3_600_000
PASS_FEEDS = [(f"https://{x}", 6 if x[0] == "a" else None, None, "c", 1 if x[0] == "f" else None) for x in ("a.example/feed", "b.example/feed", "c.example/feed", "d.example/page", "e.example/news", "f.example/feed", "g.example/feed", "h.example/feed", "i.example/feed", "j.example/feed", "k.example/feed")]
PASS_STATE = [
    ("https://a.example/feed", None, None, NOW - _HOUR, 200, 0, None, None), ("https://b.example/feed", '"e1"', "Mon", NOW - 24 * _HOUR, 200, 2, NOW - 5, "x"),
    ("https://i.example/feed", None, None, NOW - 24 * _HOUR, 500, 3, NOW + 600_000, "HTTP 500"), ("https://j.example/feed", None, None, NOW - 24 * _HOUR, 503, 1, NOW - 1, "HTTP 503"),
]
PASS_HOSTS = [("h.example", "blocked", 2, NOW - _HOUR, NOW + _HOUR), ("b.example", "challenge", 1, NOW - 24 * _HOUR, NOW - _HOUR)]
PASS_ANSWERS = [
    ("https://a.example/feed", 0, 200, "", RSS, None), ("https://b.example/feed", 0, 304, "Date: x", None, None), ("https://c.example/feed", 0, 200, 'ETag: "c2"\nDate: x', RSS, None), ("https://e.example/news", 0, 200, "", "<html><title>Just a moment...</title>" + "x" * 50, None),
    ("https://f.example/feed", 0, 429, "", "", "7"), ("https://f.example/feed", 1, 200, "", FRESH, None), ("https://g.example/feed", 0, 403, "", "", None), ("https://g.example/feed", 1, 200, "", RSS, None), *(("https://j.example/feed", i, 503, "Server: nginx", "down", None) for i in range(3)),
]
PASS_CACHED = [("g1", "Old title of the story", None, "old text", "old title of the story", "0")]


def _pass(spark) -> dict[str, DataFrame]:
    return R.run(
        rows(spark, PASS_FEEDS, "url string, refresh_hours int, tags string, collection string, max_items int"), rows(spark, PASS_STATE, "url string, etag string, last_modified string, last_fetched long, last_status int, fail_count long, next_retry_at long, last_error string"),
        rows(spark, PASS_HOSTS, "host string, ban_kind string, ban_count long, last_ban_at long, next_retry_at long"), rows(spark, [("https://d.example/page", False)], "url string, allowed boolean"), rows(spark, PASS_ANSWERS, "url string, attempt int, status int, headers string, body string, retry_after string"),
        rows(spark, PASS_CACHED, "guid string, title string, summary string, content string, title_key string, content_hash string"), lambda df: fetch.parse_answers(df, NOW), NOW,
    )


@query("""SELECT 'https://' || u AS url, mode, skip, w::BIGINT AS wait_minutes, e AS if_none_match, m AS if_modified_since FROM (VALUES ('a.example/feed', 'fast', 'not-due', 300, NULL, NULL), ('b.example/feed', 'fast', NULL, NULL, '"e1"', 'Mon'), ('c.example/feed', 'fast', NULL, NULL, NULL, NULL), ('d.example/page', 'slow', 'robots', NULL, NULL, NULL), ('e.example/news', 'slow', NULL, NULL, NULL, NULL),
 ('f.example/feed', 'fast', NULL, NULL, NULL, NULL), ('g.example/feed', 'fast', NULL, NULL, NULL, NULL), ('h.example/feed', 'fast', 'host-paused', 60, NULL, NULL), ('i.example/feed', 'fast', 'backoff', 10, NULL, NULL), ('j.example/feed', 'fast', NULL, NULL, NULL, NULL), ('k.example/feed', 'fast', NULL, NULL, NULL, NULL)) AS t(u, mode, skip, w, e, m)""")
def conditional_fetch(spark, d):
    return _pass(spark)["plan"].select("url", "mode", "skip", "wait_minutes", "if_none_match", "if_modified_since")


@query("""SELECT substr(u, 1, 1) AS feed, result, status, error, tries::BIGINT AS tries, waited::BIGINT AS waited_ms, kind AS ban_kind, vendor AS ban_vendor, terminal AS ban_terminal FROM (VALUES ('a', 'skipped', NULL, 'not-due', 0, 0, NULL, NULL, false), ('b', 'not-modified', 304, NULL, 1, 0, NULL, NULL, false), ('c', 'ok', 200, NULL, 1, 0, NULL, NULL, false), ('d', 'skipped', NULL, 'robots', 0, 0, NULL, NULL, false),
 ('e', 'failed', 200, 'bot wall', 1, 0, 'challenge', 'cloudflare', true), ('f', 'ok', 200, NULL, 2, 7000, 'rate-limited', NULL, false), ('g', 'failed', 403, 'HTTP 403', 1, 0, 'blocked', NULL, true), ('h', 'skipped', NULL, 'host-paused', 0, 0, NULL, NULL, false), ('i', 'skipped', NULL, 'backoff', 0, 0, NULL, NULL, false),
 ('j', 'failed', 503, 'HTTP 503', 3, 2400, NULL, NULL, false), ('k', 'failed', NULL, 'network', 0, 0, NULL, NULL, false)) AS t(u, result, status, error, tries, waited, kind, vendor, terminal)""")
def fetch_outcomes(spark, d):
    return _pass(spark)["outcomes"].select(F.substring("host", 1, 1).alias("feed"), "result", "status", "error", "tries", "waited_ms", "ban_kind", "ban_vendor", "ban_terminal")


@query(f"""SELECT 'https://' || u || '.example/' || CASE u WHEN 'e' THEN 'news' ELSE 'feed' END AS url, e AS etag, m AS last_modified, {NOW} - ago AS last_fetched, status AS last_status, fails::BIGINT AS fail_count, {NOW} + wait AS next_retry_at, error AS last_error FROM (VALUES ('a', NULL, NULL, 3600000, 200, 0, NULL, NULL), ('b', '"e1"', 'Mon', 0, 304, 0, NULL, NULL), ('c', '"c2"', NULL, 0, 200, 0, NULL, NULL), ('e', NULL, NULL, 0, 200, 1, 900000, 'bot wall'),
 ('f', NULL, NULL, 0, 200, 0, NULL, NULL), ('g', NULL, NULL, 0, 403, 1, 900000, 'HTTP 403'), ('i', NULL, NULL, 86400000, 500, 3, 600000, 'HTTP 500'), ('j', NULL, NULL, 0, 503, 2, 1800000, 'HTTP 503'), ('k', NULL, NULL, 0, NULL, 1, 900000, 'network')) AS t(u, e, m, ago, status, fails, wait, error)""")
def feed_state_after(spark, d):
    return _pass(spark)["feeds"]


@query(f"SELECT host || '.example' AS host, kind AS ban_kind, n::BIGINT AS ban_count, {NOW} - ago AS last_ban_at, {NOW} + wait AS next_retry_at FROM (VALUES ('h', 'blocked', 2, 3600000, 3600000), ('e', 'challenge', 1, 0, 1800000), ('g', 'blocked', 1, 0, 1800000)) AS t(host, kind, n, ago, wait)")
def host_state_after(spark, d):
    return _pass(spark)["hosts"]


@query("SELECT 2 AS added, 1 AS updated, 1 AS not_modified, 1 AS not_due, 3 AS skipped, 3 AS fast_ok, 3 AS fast_failed, 0 AS slow_ok, 1 AS slow_failed, 3 AS bans, 3 AS paused_hosts")
def refresh_report(spark, d):
    return _pass(spark)["report"]


@query("""WITH p AS (SELECT url, regexp_extract(lower(url), '://([^/?#]*)', 1) AS host FROM (SELECT DISTINCT url FROM pages)), s AS (SELECT url, host, 1500 * (row_number() OVER (PARTITION BY host ORDER BY url) - 1) AS start_ms FROM p) SELECT host, url, CAST(start_ms AS BIGINT) AS start_ms FROM s""")
def fetch_schedule(spark, d):
    p = A.table(spark, d, "pages").select("url").distinct()
    return R.schedule(p.select("url", T.url_host(F.col("url")).alias("host"), F.lit("slow").alias("mode"), F.lit(None).cast("string").alias("skip")), 1500, 0)


@query("""SELECT * FROM (VALUES ('https://a.example/f', 'rss', 2, 'First & best story|Second story', NULL), ('https://p.example/a/', 'html', 4, 'Rain floods the old town|A second link of the heading|Fifteen letters|A long enough anchor text of another site', NULL), ('https://w.example/', 'unknown', 0, NULL, 'challenge')) AS t(url, kind, items, sample, ban)""")
def feed_probe(spark, d):
    return fetch.probe(rows(spark, [("https://a.example/f", RSS), ("https://p.example/a/", LINKS), ("https://w.example/", "Just a moment...")], "url string, body string"), NOW)


@query(r"""WITH r AS (SELECT page_id // 50 AS query, page_id AS position, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS site FROM pages), s AS (SELECT query, site, min(position) AS first FROM r GROUP BY ALL) SELECT query, site, site || '/' AS seed, row_number() OVER (PARTITION BY query ORDER BY first, site) AS position FROM s QUALIFY position <= 8""")
def feed_candidates(spark, d):
    p = A.table(spark, d, "pages").select(F.floor(F.col("page_id") / 50).alias("query"), F.col("page_id").alias("position"), "url")
    return fetch.feed_candidates(p)


@query()
def web_backfill_articles(spark, d):
    p = A.table(spark, d, "pages").select("url", F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"), F.lit(200).alias("status"), F.col("html").alias("body"))
    return fetch.backfilled(p, NOW).select("guid", "feed_url", "title", F.length("content").alias("n_chars"), "source_type")


CHANGES = [(True, "https://n.example/f/"), (True, "ftp://bad.example/f"), (True, "https://a.example/f"), (False, "https://b.example/f/"), (False, "https://a.example")]


@query(f"""WITH l AS (SELECT regexp_replace(trim(line), '/+$', '') AS url FROM {values(LINES, 'line')} WHERE trim(line) <> '' AND trim(line) NOT LIKE '#%'), c AS (SELECT add_it, regexp_replace(trim(url), '/+$', '') AS url FROM {values(CHANGES, 'add_it, url')})
 SELECT DISTINCT url FROM (SELECT url FROM l UNION ALL SELECT url FROM c WHERE add_it AND regexp_matches(lower(url), '^https?://[^/]')) WHERE url NOT IN (SELECT url FROM c WHERE NOT add_it)""")
def feed_edits(spark, d):
    return U.edits(rows(spark, LINES, "line string"), rows(spark, CHANGES, "add boolean, url string"))


# Diagnostics, embedding, index upkeep


@query("SELECT round(count(*) FILTER (value IS NULL) / nullif(count(*), 0), 3) AS empty_rate, NULL::DOUBLE AS degraded_rate, round(count(*) FILTER (event_type = 'error') / nullif(count(*), 0), 3) AS error_rate FROM events")
def search_rates(spark, d):
    one = lambda x: F.when(x, 1).otherwise(0)
    e = A.table(spark, d, "events")
    return U.search_rates(e.select(F.lit(1).alias("searches"), one(F.col("value").isNull()).alias("empty"), F.lit(0).alias("degraded_of"), F.lit(0).alias("degraded"), F.lit(1).alias("fetches"), one(F.col("event_type") == "error").alias("errors")))


RUNS = [(i, f"w{i}", "q", None if i == 3 else NOW - (i * 7 % 5) * 1000, i) for i in range(8)]


@query(f"SELECT (SELECT count(*) FROM {values(RUNS, 'watch_id, name, query, last_run, last_hits')}) AS total, CAST(row_number() OVER (ORDER BY last_run DESC NULLS LAST, watch_id) AS INTEGER) AS position, name, last_run, last_hits FROM {values(RUNS, 'watch_id, name, query, last_run, last_hits')} ORDER BY last_run DESC NULLS LAST, watch_id LIMIT 5")
def watch_status(spark, d):
    return U.watch_status(rows(spark, RUNS, "watch_id int, name string, query string, last_run long, last_hits long"))


@query(f"""WITH {ENTRIES}, {EVENTS}, c AS (SELECT count(*) AS n, count(*) FILTER (doc_id % 7 <> 0) AS embedded FROM documents WHERE doc_id % 11 <> 0), r AS (SELECT round(count(*) FILTER (NOT ok) / count(*), 3) AS e FROM ev)
 SELECT (SELECT count(*) FROM entries) AS entries, n AS chunks_all, embedded, e AS fetch_error_rate, CASE WHEN embedded < n THEN 'limited' WHEN e > 0.2 THEN 'degraded' ELSE 'healthy' END AS verdict, concat_ws('; ', CASE WHEN embedded < n THEN 'chunks without vectors' END, CASE WHEN e > 0.2 THEN 'many fetches fail' END) AS notes FROM c, r""")
def diagnostics(spark, d):
    log, e, c = fetch_log(spark, d), A.entries(spark, d), doc_chunks(spark, d)
    rates = U.search_rates(log.select(F.lit(0).alias("searches"), F.lit(0).alias("empty"), F.lit(0).alias("degraded_of"), F.lit(0).alias("degraded"), F.lit(1).alias("fetches"), F.when(F.col("ok"), 0).otherwise(1).alias("errors")))
    row = U.diagnostics(A.cache_stats(e, c), E.coverage(c), rates, M.feed_health(log, NOW), A.age_report(e), True)
    return row.select("entries", "chunks_all", "embedded", "fetch_error_rate", "verdict", "notes")


@query("SELECT item_id AS chunk_id, item_id % 3 = 0 OR item_id < 3 * (SELECT count(*) FROM benchmark) / 4 AS filled FROM benchmark")
def embedding_backfill(spark, d):
    """A third of the passages have vectors; a bounded run fills those of the lowest ids among the rest."""
    b = A.table(spark, d, "benchmark").withColumn("has", F.col("item_id") % 3 == 0)
    c = b.select(F.col("item_id").alias("chunk_id"), F.col("item_id").alias("entry_id"), "text", F.lit(None).cast("string").alias("heading"), F.when(F.col("has"), F.array(F.lit(1.0))).alias("embedding"), F.when(F.col("has"), E.STYLE).alias("embed_style"))
    articles = b.select(F.col("item_id").alias("id"), F.lit(None).cast("string").alias("title"))
    n = b.count()
    room = sum(1 for i in range(n) if i % 3 and i < 3 * n / 4)
    return E.fill(spark, c, articles, E.char_hash(), room).select("chunk_id", F.col("embedding").isNotNull().alias("filled"))


@query("SELECT * FROM (VALUES (1, true, NULL), (2, false, 'dimension'), (3, false, 'model'), (4, true, NULL)) AS t(id, ok, reason)")
def embedding_guard(spark, d):
    meta, none = rows(spark, [("m", 8)], "model string, dim int"), rows(spark, [], "model string, dim int")
    parts = [E.guard(x, m, n).select(F.lit(i).alias("id"), "ok", "reason") for i, (x, m, n) in enumerate([(meta, "m", 8), (meta, "m", 16), (meta, "o", 8), (none, "m", 8)], 1)]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query(f"WITH {ENTRIES} SELECT 1 AS id, 7::BIGINT AS at_ms UNION ALL SELECT 2, 9 UNION ALL SELECT 3, max(cached_at) FROM entries")
def last_refresh(spark, d):
    e = A.entries(spark, d)
    parts = [E.last_refresh(rows(spark, m, "key string, value string"), e).select(F.lit(i).alias("id"), "at_ms") for i, m in enumerate([[("last_refresh", '{"timestamp": 7}')], [("last_refresh", "9")], [("other", "5")]], 1)]
    return parts[0].union(parts[1]).union(parts[2])


@query(r"""WITH c AS (SELECT doc_id, CASE WHEN doc_id % 10 = 1 THEN text || ' tidings' ELSE text END AS text FROM documents WHERE doc_id % 10 <> 2 AND text IS NOT NULL), w AS (SELECT doc_id AS chunk_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM c) SELECT term, count(*) AS tf, count(DISTINCT chunk_id) AS df FROM w GROUP BY term""")
def index_delta(spark, d):
    """An index of all documents after a tenth of them changed and another tenth went: the same as one made anew."""
    t = A.table(spark, d, "documents").filter("text is not null").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("entry_id"), F.lit(0).alias("chunk_index"), "text", F.lit("").alias("heading"))
    index = P.Index.build(spark, t)
    fresh = t.filter("chunk_id % 10 = 1").withColumn("text", F.concat("text", F.lit(" tidings")))
    now = index.changed(spark, fresh, t.filter("chunk_id % 10 = 2").select("chunk_id"))
    return now.postings.groupBy("term").agg(F.sum("tf").alias("tf")).join(now.vocabulary.select("term", "df"), "term")


@query(f"WITH {ENTRIES}, {FUSED} SELECT query_id, id AS entry_id, round(0.8 * score + 0.2 * exp(-greatest((1767225600000 - pub_date) / 86400000.0, 0) / 30), 6) AS combined FROM fused JOIN entries ON id = chunk_id")
def blended_scores(spark, d):
    r = _fused_articles(spark, d)
    return r.select("query_id", F.col("id").alias("entry_id"), F.round("combined", 6).alias("combined"))


@query()
def hybrid_with_vectors(spark, d):
    """Hybrid search of all benchmark queries in English articles, chunk vectors and query vectors among its lists."""
    return hybrid(spark, A.entries(spark, d), bench_queries(spark, d), embedder=E.char_hash(), collection="en")


WATCH_LIST = [(1, "common", "the", None, None), (2, "old", "license apache", NOW - 10 * A.DAY_MS, 4), (3, "quiet", "qqqq", None, None)]


@query(f"""WITH {ENTRIES}, w AS (SELECT * FROM {values(WATCH_LIST, 'watch_id, name, query, last_run, last_hits')}), h AS (SELECT watch_id FROM w JOIN entries ON pub_date > coalesce(last_run, 1767225600000 - 30 * 86400000::BIGINT) AND len(list_filter(string_split(query, ' '), lambda x: NOT contains(lower(title || ' ' || content), x))) = 0)
 SELECT w.watch_id, name, query, 1767225600000 AS last_run, count(h.watch_id) AS last_hits FROM w LEFT JOIN h ON h.watch_id = w.watch_id GROUP BY ALL""")
def watch_advance(spark, d):
    w = rows(spark, WATCH_LIST, "watch_id int, name string, query string, last_run long, last_hits long")
    return state.advanced(w, state.watch_hits(A.entries(spark, d), w, NOW))
