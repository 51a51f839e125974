from pyspark.sql import functions as F

from tidepress.functions import bans
from tidepress.functions import text as T
from tidepress.functions.stemming import stem
from tidepress.sources import parsers


def test_stems():
    want = {"caresses": "caress", "ponies": "poni", "relational": "relat", "hopping": "hop", "adoption": "adopt", "sky": "sky"}
    assert {w: stem(w) for w in want} == want


def test_chunks_overlap_and_keep_every_word():
    got = parsers.chunk_text("a" * 500, 200, 120)
    assert len(got) >= 3 and len(got[0]["text"]) == 200 and all(len(c["text"]) <= 321 for c in got)
    text = "One day it rained. Then it stopped! Was it over? It was not so."
    plain = parsers.chunk_text(text, 60, 0)
    assert " ".join(c["text"] for c in plain).split() == text.split() and all(len(c["text"]) <= 60 for c in plain)
    assert parsers.chunk_text("# Intro\nHello there.\n## Details\nBeta rules.")[-1]["heading"] == "Intro > Details"


def test_body_simhash_is_signed_and_null_without_words():
    assert parsers.body_simhash(None) is None and parsers.body_simhash("the a") is None
    a = "Storm brings heavy rain across coastal towns today. Crews restore power before night falls. Schools remain closed while roads flood. Officials urge people stay home. Forecasters expect calm weather tomorrow morning."
    near = (parsers.body_simhash(a) ^ parsers.body_simhash(a + " Follow us")) & (1 << 64) - 1
    assert near.bit_count() < 20 and -(1 << 63) <= parsers.body_simhash(a) < 1 << 63


def test_feeds_in_three_forms():
    rss = "<rss><channel><item><title>A &amp; B</title><link>https://x/1</link></item></channel></rss>"
    for xml in (rss, rss.replace("</channel></rss>", "<broken")):
        (item,) = parsers.parse_feed(xml, "https://x", 7)
        assert (item["title"], item["guid"], item["pub_date"]) == ("A & B", "https://x/1", 7)


def test_opml_and_robots():
    assert parsers.parse_opml("<bad") == []
    rules = parsers.robots_rules("User-agent: a\nUser-agent: b\nDisallow: /x\nDisallow:\n")
    assert [(r["agent"], r["path"]) for r in rules] == [("a", "/x"), ("b", "/x")]
    assert parsers.robots_pattern("/a*.pdf$") == r"^/a.*\.pdf$"


def test_links_and_reading(spark):
    page = "<html><body><nav>Menu</nav><article><h2><a href='/news/rain-floods-town'>Rain floods the old town</a></h2><p>" + "Word " * 60 + "</p></article></body></html>"
    assert [x["link"] for x in parsers.page_links(page, "https://p.example/")] == ["https://p.example/news/rain-floods-town"]
    assert "Menu" not in parsers.readable(page) and parsers.readable(None) == ""
    row = spark.createDataFrame([("  é  b ", "A-B  c!", "foo OR \"bar\" -baz (qux)")], "t string, k string, q string").select(
        T.title_key(F.col("k")).alias("k"), T.query_terms(F.col("q")).alias("q"), bans.backoff_ms(F.lit(3), 900_000, 86_400_000).alias("b")
    ).first()
    assert (row["k"], row["q"], row["b"]) == ("a b c", ["foo", "or", "bar", "baz", "qux"], 3_600_000)
