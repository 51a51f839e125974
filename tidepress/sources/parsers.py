"""Parsers of feeds, pages, outlines and robots files, and the chunker: plain functions and their Arrow-batched forms."""

from __future__ import annotations

import html
import math
import re
import xml.etree.ElementTree as ET
from collections import Counter
from collections.abc import Callable, Iterator
from email.utils import parsedate_to_datetime
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepress.storage import bound_batches

ITEM = "guid string, feed_url string, title string, link string, author string, pub_date long, summary string, content string"


def explode_with(df: DataFrame, keys: list[str], make: Callable[..., Iterator[dict]], schema: str) -> DataFrame:
    """A row for each dictionary that make(*row values) yields, by batches; schema names the columns."""
    names = [x.split()[0] for x in schema.split(", ")]
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for values in pdf[keys].itertuples(index=False, name=None) for r in make(*values)]
            yield pd.DataFrame(rows, columns=names)

    return df.select(*keys).mapInPandas(run, schema)


def decode_entities(text: str | None) -> str:
    """Character references resolved until nothing changes, five times at most."""
    text = text or ""
    for _ in range(5):
        new = html.unescape(text)
        if new == text:
            break
        text = new
    return text


def _ms(value: str | None, now_ms: int) -> int:
    value = (value or "").strip()
    for read in (parsedate_to_datetime, lambda v: pd.Timestamp(v).to_pydatetime()):
        try:
            d = read(value)
            return int((d if d.tzinfo else d.replace(tzinfo=pd.Timestamp(0, tz="UTC").tzinfo)).timestamp() * 1000)
        except (ValueError, TypeError, IndexError):
            continue
    return now_ms


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1].lower() if isinstance(tag, str) else ""


def _clean(text: str | None) -> str:
    return re.sub(r"\s+", " ", re.sub(r"<[^>]*>", " ", decode_entities(text))).strip()


def parse_feed(xml: str, feed_url: str, now_ms: int) -> list[dict]:
    """Items of RSS 2.0 or Atom; malformed XML goes to the expression-based reader."""
    try:
        root = ET.fromstring(xml.strip())
    except ET.ParseError:
        return parse_feed_loose(xml, feed_url, now_ms)
    out = []
    for node in root.iter():
        kind = _local(node.tag)
        if kind not in ("item", "entry"):
            continue
        text: dict[str, str] = {}
        links = []
        for c in node:
            name = _local(c.tag)
            if "purl.org/rss/1.0/modules/content" in str(c.tag) and name == "encoded":
                name = "content:encoded"
            if name == "link" and c.get("href"):
                links.append((c.get("rel"), c.get("href")))
            value = " ".join(c.itertext()).strip()
            if name == "author":
                value = next((" ".join(x.itertext()).strip() for x in c if _local(x.tag) == "name"), value)
            if value:
                text.setdefault(name, value)
        link = text.get("link") or next((h for r, h in links if r in (None, "alternate")), "")
        title = _clean(text.get("title"))
        if kind == "item":
            body, brief, author, when = text.get("content:encoded") or text.get("description"), text.get("description"), text.get("creator") or text.get("author"), text.get("pubdate") or text.get("date")
        else:
            body, brief, author, when = text.get("content") or text.get("summary"), text.get("summary"), text.get("author"), text.get("updated") or text.get("published")
        guid = text.get("guid") or text.get("id") or link or f"{feed_url}#{title}"
        out.append({"guid": guid, "feed_url": feed_url, "title": title, "link": link, "author": author, "pub_date": _ms(when, now_ms), "summary": _clean(brief), "content": _clean(body)})
    return out


def parse_feed_loose(xml: str, feed_url: str, now_ms: int) -> list[dict]:
    """Items and entries of XML that doesn't parse, by expressions."""

    def field(block: str, *names: str) -> str | None:
        for n in names:
            if m := re.search(rf"<{n}\b[^>]*>(?:\s*<!\[CDATA\[)?(.*?)(?:\]\]>\s*)?</{n}>", block, re.S | re.I):
                return m[1].strip()
        return None

    out = []
    for m in re.finditer(r"<(item|entry)\b[^>]*>(.*?)</\1>", xml, re.S | re.I):
        b = m[2]
        href = re.search(r"<link\b[^>]*href=[\"']([^\"']+)", b, re.I)
        link = field(b, "link") or (href[1] if href else "")
        title = _clean(field(b, "title"))
        author = _clean(field(b, "name", "dc:creator", "author")) or None
        body = field(b, "content:encoded", "content", "description", "summary")
        out.append({"guid": field(b, "guid", "id") or link or f"{feed_url}#{title}", "feed_url": feed_url, "title": title, "link": link, "author": author, "pub_date": _ms(field(b, "pubDate", "dc:date", "updated", "published"), now_ms), "summary": _clean(field(b, "description", "summary")), "content": _clean(body)})
    return out


def feed_items(df: DataFrame, now_ms: int) -> DataFrame:
    """df: feed_url, body."""
    return explode_with(df, ["body", "feed_url"], lambda body, url: parse_feed(body or "", url, now_ms), ITEM)


class _Links(HTMLParser):
    """Every link with its text, whether a heading is around or inside it, whether it is its heading's first, and whether
    an article is around it."""

    HEADS = ("h1", "h2", "h3", "h4")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[dict] = []
        self.open: list[str] = []
        self.used = False
        self.at: dict | None = None

    def handle_starttag(self, tag, attrs):
        if tag in self.HEADS or tag == "article":
            self.open.append(tag)
            self.used = self.used and tag == "article"
            if self.at and tag != "article":
                self.at["inner"] = True
        if tag == "a" and dict(attrs).get("href"):
            self.close()
            head = any(t in self.HEADS for t in self.open)
            self.at = {"href": dict(attrs)["href"], "words": [], "lead": head and not self.used, "inner": False, "article": "article" in self.open}
            self.used = self.used or head

    def close(self):
        if self.at:
            self.found.append({**self.at, "title": re.sub(r"\s+", " ", "".join(self.at.pop("words"))).strip()})
            self.at = None

    def handle_endtag(self, tag):
        if tag in self.open:
            self.open = self.open[: len(self.open) - 1 - self.open[::-1].index(tag)]
        if tag == "a":
            self.close()

    def handle_data(self, data):
        if self.at:
            self.at["words"].append(data)


SOCIAL = ("facebook.com", "instagram.com", "linkedin.com", "twitter.com", "x.com", "youtube.com")
PATTERNS = ("article", "blog", "news", "post", "press", "releases", "stories", "story")
_BOILER = re.compile(r"\b(advertisement|cookie|follow us|log ?in|newsletter|page \d+|pagination|privacy policy|read more|sign up|subscribe|terms of service)\b", re.I)


def page_links(page: str, base: str, patterns: tuple[str, ...] = (), most: int = 30) -> list[dict]:
    """Article links of a page: the first of each heading, then anchors of 25 characters (15 inside an article) without a
    heading in them. Distinct, `most` at most; a part of the URL must hold one of the patterns; no social sites,
    boilerplate titles or URLs that end in a slash."""
    p = _Links()
    p.feed(page or "")
    p.close()
    ordered = [x for x in p.found if x["lead"]] + [x for x in p.found if not x["inner"] and len(x["title"]) >= (15 if x["article"] else 25)]
    wanted = [w.lower() for w in patterns or PATTERNS]
    out: dict[str, dict] = {}
    for x in ordered:
        try:
            link = urljoin(base, x["href"])
            scheme = urlsplit(link).scheme
        except ValueError:
            continue
        low, title = link.lower(), x["title"]
        if scheme not in ("http", "https") or len(title) < 15 or _BOILER.search(title) or low.endswith("/") or any(s in low for s in SOCIAL):
            continue
        if any(w in part for w in wanted for part in low.split("/")):
            out.setdefault(link, {"page": base, "link": link, "title": title})
    return [{**v, "position": i + 1} for i, v in enumerate(list(out.values())[:most])]


class _Body(HTMLParser):
    DROP = {"script", "style", "nav", "header", "footer", "aside", "form", "noscript", "iframe", "svg"}
    VOID = {"br", "img", "meta", "link", "input", "hr", "source", "area", "base", "col", "embed", "wbr"}
    JUNK = re.compile(r"\b(ad|ads|advert|banner|sidebar|share|social|comment|related|promo|newsletter|cookie|menu)\b", re.I)
    GOOD = re.compile(r"article|content|post|entry|story", re.I)

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, str | None, bool]] = []
        self.text = {k: [] for k in ("article", "content", "main", "body")}
        self.meta = ""

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "meta" and (a.get("property") == "og:description" or a.get("name") == "description"):
            self.meta = max(self.meta, a.get("content") or "", key=len)
        if tag in self.VOID:
            return
        mark = f"{a.get('class') or ''} {a.get('id') or ''}".replace("-", " ").replace("_", " ")
        drop = tag in self.DROP or bool(self.JUNK.search(mark))
        kind = tag if tag in ("article", "main", "body") else "content" if self.GOOD.search(mark) else None
        self.stack.append((tag, kind, drop))

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                break
        if tag in ("p", "div", "li", "h1", "h2", "h3", "h4"):
            self.handle_data(" ")

    def handle_data(self, data):
        if any(d for _, _, d in self.stack):
            return
        for k in {k for _, k, _ in self.stack if k}:
            self.text[k].append(data)


def readable(page: str | None, most: int = 20_000) -> str:
    """Main text of a page without boilerplate: article, content block, main or body; a longer description for short ones."""
    p = _Body()
    p.feed(page or "")
    for kind in ("article", "content", "main", "body"):
        text = re.sub(r"\s+", " ", "".join(p.text[kind])).strip()
        if text:
            break
    return (p.meta if len(text) < 200 and len(p.meta) > len(text) else text)[:most]


def discover_feeds(page: str, base: str) -> list[dict]:
    out: dict[str, None] = {}
    for tag in re.findall(r"<link\b[^>]*>", page or "", re.I):
        a = dict((k.lower(), v) for k, v in re.findall(r"([a-zA-Z:-]+)\s*=\s*[\"']([^\"']*)", tag))
        if "alternate" in a.get("rel", "").lower() and re.search(r"(rss|atom|xml)", a.get("type", ""), re.I) and a.get("href"):
            out.setdefault(urljoin(base, a["href"]))
    return [{"page": base, "feed": f, "position": i + 1} for i, f in enumerate(out)]


def parse_opml(xml: str) -> list[dict]:
    """Feeds of an outline, first of each URL; folders and categories become tags. Malformed: none."""
    try:
        root = ET.fromstring((xml or "").strip())
    except ET.ParseError:
        return []
    out: dict[str, dict] = {}

    def walk(node, folders):
        for o in node:
            if _local(o.tag) != "outline":
                walk(o, folders)
                continue
            name = o.get("title") or o.get("text") or ""
            if url := o.get("xmlUrl"):
                own = [t.strip().lower() for t in (o.get("category") or "").split(",") if t.strip()]
                out.setdefault(url, {"url": url, "title": name, "tags": ",".join(dict.fromkeys([*folders, *own]))})
            walk(o, folders if o.get("xmlUrl") else [*folders, name.strip().lower()] if name.strip() else folders)

    walk(root, [])
    return list(out.values())


def robots_rules(text: str | None) -> list[dict]:
    """agent, allow, path, delay of each rule; consecutive agent lines share a group."""
    out, agents, ruled = [], [], False
    for raw in (text or "").splitlines():
        line = raw.split("#", 1)[0].strip()
        key, _, value = line.partition(":")
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent":
            if ruled:
                agents, ruled = [], False
            agents.append(value.lower())
        elif key in ("allow", "disallow"):
            ruled = True
            out += [{"agent": a, "allow": key == "allow", "path": value} for a in agents if value]
    return out


def robots_pattern(path: str) -> str:
    """The rule as an anchored expression: * for anything, $ at the end for the end."""
    end = path.endswith("$")
    body = ".*".join(re.escape(p) for p in path.removesuffix("$").split("*"))
    return f"^{body}{'$' if end else ''}"


def robots_allowed(rules: DataFrame, asked: DataFrame, agent: str) -> DataFrame:
    """url, allowed. rules: host, agent, allow, path, pattern; asked: url, host, path. The group is the longest agent that
    starts ours, else *; the longest matching path decides, allow on ties; without any it is allowed."""
    low = agent.lower()
    own = rules.filter((F.col("agent") == "*") | F.lit(low).startswith(F.col("agent")))
    weight = F.when(F.col("agent") == "*", 0).otherwise(F.length("agent"))
    best = own.groupBy("host").agg(F.max(weight).alias("w"))
    group = own.join(best, "host").filter(weight == F.col("w"))
    hit = asked.join(group.select("host", "allow", F.col("path").alias("rule"), "pattern"), "host").filter(F.expr("path rlike pattern"))
    decided = hit.groupBy("url").agg(F.max_by("allow", F.struct(F.length("rule"), "allow")).alias("allow"))
    return asked.select("url").distinct().join(decided, "url", "left").select("url", F.coalesce("allow", F.lit(True)).alias("allowed"))


_SENTENCE = re.compile(r"[^.!?…]+[.!?…]+[\"')\]]*\s*|[^.!?…]+$")
_HEADING = re.compile(r"^\s*(#{1,3})\s+(.*\S)\s*$")


def chunk_text(text: str | None, size: int = 800, overlap: int = 120) -> list[dict]:
    """Sentences packed into chunks of up to size code points, each with its heading trail; from the second on, the last
    `overlap` code points of the raw chunk before it come first, so a chunk has at most size + overlap + 1."""
    x = re.sub(r"[ \t\f\v ]+", " ", (text or "").replace("\r", ""))
    x = re.sub(r"\n{3,}", "\n\n", re.sub(r" *\n *", "\n", x)).strip()
    trail: list[str] = []
    raw: list[list] = []
    for part in re.split(r"\n+", x):
        if not part:
            continue
        if m := _HEADING.match(part):
            level = len(m[1])
            trail = (trail + [""] * 3)[: level - 1] + [m[2]]
        head = " > ".join(t for t in trail if t)
        for unit in _SENTENCE.findall(part) or [part]:
            unit = unit.strip()
            for i in range(0, len(unit), size):
                piece = unit[i : i + size]
                if raw and len(raw[-1][0]) + 1 + len(piece) <= size:
                    raw[-1] = [f"{raw[-1][0]} {piece}", head]
                else:
                    raw.append([piece, head])
    return [{"chunk_index": i, "text": c if not i or not overlap else f"{raw[i - 1][0][-overlap:]} {c}".strip(), "heading": h} for i, (c, h) in enumerate(raw)]


def chunks(df: DataFrame, size: int = 800, overlap: int = 120, titled: bool = False) -> DataFrame:
    """entry_id, chunk_index, text, heading (, title). df: id, title, summary, content."""
    body = df.select("id", "title", F.concat_ws("\n\n", "title", "summary", "content").alias("body"))
    schema = "entry_id long, chunk_index int, text string, heading string" + ", title string" * titled
    return explode_with(body, ["id", "body", "title"] if titled else ["id", "body"], lambda i, b, *t: ({"entry_id": i, **c, **({"title": t[0]} if t else {})} for c in chunk_text(b, size, overlap)), schema)


STOP = frozenset(
    """about after also and are before but can could for from had has have her him his how into its more most new not one
    only other our out over said says she should some such than that the their them then they this two was were what when
    where which who why will with would you your""".split()
)
_FNV, _PRIME = np.uint64(0xCBF29CE484222325), np.uint64(0x100000001B3)


def fnv1a(texts: list[str]) -> np.ndarray:
    """Unsigned 64-bit hashes over UTF-16 code units; all texts advance together, unit by unit."""
    raw = [t.encode("utf-16-le", "surrogatepass") for t in texts]
    size = np.array([len(r) // 2 for r in raw], np.int64)
    units = np.frombuffer(b"".join(raw), "<u2").astype(np.uint64)
    order = np.argsort(-size, kind="stable")
    start, length = (np.cumsum(size) - size)[order], size[order]
    h = np.full(len(texts), _FNV, np.uint64)
    for k in range(int(length[0]) if len(length) else 0):
        alive = int(np.searchsorted(-length, -k, "left"))
        h[:alive] = (h[:alive] ^ units[start[:alive] + k]) * _PRIME
    out = np.empty_like(h)
    out[order] = h
    return out


def body_simhashes(bodies: list[str | None]) -> list[int | None]:
    """Signed 64-bit SimHash of each text's word trigrams weighted 1 + ln(count); pairs and single words where texts are
    short; None without words."""
    counts = []
    for body in bodies:
        words = [w for w in re.findall(r"[^\W_]{2,}", (body or "").lower()) if w not in STOP]
        grams = [f"{a} {b} {c}" for a, b, c in zip(words, words[1:], words[2:], strict=False)]
        if len(grams) < 2 and len(words) >= 2:
            grams += [" ".join(words[i : i + 2]) for i in range(len(words) - 1)]
        counts.append(Counter(grams or words))
    each = list(dict.fromkeys(g for c in counts for g in c))
    bits = dict(zip(each, fnv1a(each), strict=True))
    out: list[int | None] = []
    for c in counts:
        if not c:
            out.append(None)
            continue
        h = np.array([bits[g] for g in c], np.uint64)
        weight = np.array([1 + math.log(n) for n in c.values()])
        ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
        out.append(int(np.packbits((2 * ones - 1).T @ weight > 0, bitorder="little").view("<i8")[0]))
    return out


def body_simhash(body: str | None) -> int | None:
    return body_simhashes([body])[0]


def simhash_udf(column):
    """The texts' SimHashes, in slices of a batch."""

    def run(s: pd.Series) -> pd.Series:
        texts = s.tolist()
        found = [x for i in range(0, len(texts), 256) for x in body_simhashes(texts[i : i + 256])]
        return pd.Series(found, index=s.index, dtype="Int64")

    bound_batches(SparkSession.active())
    return F.pandas_udf(run, "long")(column)


def _mapped(function, kind: str):
    """A column function that applies `function` to a column in Arrow batches; made when called, not in the workers."""

    def apply(column):
        bound_batches(SparkSession.active())
        dtype = "Int64" if kind == "long" else "object"
        return F.pandas_udf(lambda s: pd.Series([function(x) for x in s], dtype=dtype), kind)(column)

    return apply


readable_udf = _mapped(readable, "string")
decode_udf = _mapped(decode_entities, "string")
pattern_udf = _mapped(robots_pattern, "string")
