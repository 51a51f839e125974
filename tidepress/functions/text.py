"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORDS = r"[\p{L}\p{N}]+"
SPACES = "[\\s ]+"
#: Named entities that the cleaner knows; numeric ones are decoded by text_udfs.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&amp;": "&"}


def title_key(title: Column, size: int = 200) -> Column:
    """Lower-case letters and digits with single blanks between; null where nothing is left."""
    key = F.substring(F.trim(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}]+", " ")), 1, size)
    return F.when(F.length(key) > 0, key)


def content_hash(title: Column, summary: Column, content: Column) -> Column:
    return F.sha1(F.concat_ws("\n", *(F.coalesce(c, F.lit("")) for c in (title, summary, content))))


def tag_list(csv: Column) -> Column:
    """Trimmed lower-case tags of a comma list; null where there are none."""
    tags = F.filter(F.transform(F.split(csv, ","), lambda t: F.lower(F.trim(t))), lambda t: F.length(t) > 0)
    return F.when(F.size(tags) > 0, tags)


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def url_key(url: Column) -> Column:
    return F.regexp_replace(F.trim(url), "/+$", "")


def url_host(url: Column) -> Column:
    """Lower-case host and port without user and default port; empty where it can't be read."""
    authority = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)
    scheme = F.regexp_extract(F.lower(url), r"^([a-z][a-z0-9+.-]*)://", 1)
    plain = F.when(scheme == "http", F.regexp_replace(authority, ":80$", "")).when(scheme == "https", F.regexp_replace(authority, ":443$", "")).otherwise(authority)
    return F.coalesce(plain, F.lit(""))


def iso_date(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORDS), F.lit(0))


def query_terms(query: Column, most: int = 8) -> Column:
    """What a search asks for: the first runs of letters and digits, cut at 24 characters, lower case; [a] for none."""
    found = F.slice(F.regexp_extract_all(F.lower(F.coalesce(query, F.lit(""))), F.lit(r"[\p{L}\p{N}]{1,24}"), F.lit(0)), 1, most)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("a")))


def title_tokens(title: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(title, F.lit(""))), F.lit(r"[\p{L}\p{N}]{3,}"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def html_to_text(html: Column) -> Column:
    """Headings as # lines, block ends as line ends, other tags as blanks, the common entities, space collapsed."""
    x = F.regexp_replace(html, r"(?is)<!\[CDATA\[(.*?)\]\]>", "$1")
    x = F.regexp_replace(x, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    for level in (1, 2, 3):
        x = F.regexp_replace(x, rf"(?i)<h{level}[^>]*>", "\n" + "#" * level + " ")
    x = F.regexp_replace(x, r"(?i)</(h[1-6]|p|div|li|ul|ol|tr|table|article|section|blockquote)>|<br[^>]*>", "\n")
    x = F.regexp_replace(x, r"<[^>]*>", " ")
    for name, value in ENTITIES.items():
        x = F.replace(x, F.lit(name), F.lit(value))
    x = F.regexp_replace(x, "[ \\t\\r\\f ]+", " ")
    x = F.regexp_replace(F.regexp_replace(x, " ?\n ?", "\n"), "\n{3,}", "\n\n")
    return F.regexp_replace(x, "^[ \n]+|[ \n]+$", "")


def contextual(title: Column, heading: Column, chunk: Column) -> Column:
    head = F.concat_ws(" | ", blank_to_null(title), blank_to_null(heading))
    return F.when(F.length(head) > 0, F.concat(head, F.lit("\n"), chunk)).otherwise(chunk)


def embed_prefix(model: Column, is_query: Column) -> Column:
    m = F.lower(F.coalesce(model, F.lit("")))
    ask = F.when(m.contains("bge") | m.contains("mxbai") | m.contains("snowflake"), F.lit("Represent this sentence for searching relevant passages: ")).otherwise(F.lit(""))
    return F.when(m.contains("nomic"), F.when(is_query, F.lit("search_query: ")).otherwise(F.lit("search_document: "))).otherwise(F.when(is_query, ask).otherwise(F.lit("")))


def snippet(text: Column, terms: Column, size: int = 600, before: int = 200) -> Column:
    """Up to size characters, from `before` in front of the first query term (in the order of the query) that occurs."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " "))
    low = F.lower(flat)
    asked = F.filter(F.slice(terms, 1, 12), lambda t: F.length(t) >= 3)
    spots = F.filter(F.transform(asked, lambda t: F.call_function("instr", low, t)), lambda p: p > 0)
    start = F.greatest(F.lit(1), F.coalesce(F.get(spots, F.lit(0)), F.lit(1)) - before)
    piece = F.trim(F.substring(flat, start, F.lit(size)))
    return F.when(F.length(flat) <= size, flat).otherwise(
        F.concat(F.when(start > 1, F.lit("…")).otherwise(F.lit("")), piece, F.when(start + size - 1 < F.length(flat), F.lit("…")).otherwise(F.lit("")))
    )


def char_hash_vector(text: Column, dim: int = 16) -> Column:
    """Deterministic embedding: code point plus one added up at the position modulo dim, of unit length."""
    points = F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: F.length(c) > 0), lambda c: F.ascii(c) + 1)
    slots = F.sequence(F.lit(0), F.lit(dim - 1))
    sums = F.transform(slots, lambda d: F.aggregate(F.filter(points, lambda x, i: i % dim == d), F.lit(0).cast("long"), lambda a, x: a + x))
    norm = F.sqrt(F.aggregate(sums, F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return F.transform(sums, lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0)))
