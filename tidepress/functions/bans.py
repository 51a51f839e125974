"""How an HTTP answer is read: bans, challenge pages, retries and waits, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Vendor, kind and expression of what only a challenge or block page says; the first that matches names the answer.
SURE = [
    ("cloudflare", "challenge", "just a moment"),
    ("cloudflare", "challenge", "checking (your browser before accessing|if the site connection is secure)"),
    ("cloudflare", "challenge", "enable javascript and cookies to continue"),
    ("cloudflare", "blocked", r"attention required!?\s*[-–|]?\s*cloudflare"),
    ("cloudflare", "challenge", "(__cf_chl|cf-mitigated|cf-chl-|cf_chl_opt)"),
    ("cloudflare", "blocked", r"(access denied.*cloudflare|error\s*1020)"),
    ("imperva", "blocked", r"request unsuccessful\.?\s*incapsula"),
    ("imperva", "blocked", r"(incapsula incident id|_incap_ses|incident id:\s*[0-9])"),
    ("imperva", "blocked", "pardon our interruption"),
    ("akamai", "blocked", r"reference\s*#\s*[0-9]+\.[0-9a-f]{6,}"),
    ("akamai", "challenge", r"(_abck\b|akamai bot manager)"),
    ("sucuri", "blocked", "(cloudproxy|sucuri website firewall|access denied - sucuri)"),
    ("datadome", "challenge", "datadome"),
    ("perimeterx", "challenge", "(perimeterx|px-captcha)"),
    ("distil", "challenge", "(distil captcha|distil_r_captcha)"),
]
#: What an article may say too: counts in short pages only.
HINTS = [
    ("captcha", "challenge", "(hcaptcha|recaptcha)"),
    ("captcha", "challenge", "(verify you are human|are you a (robot|human))"),
    ("captcha", "blocked", "(automated queries|unusual traffic from your computer network)"),
    ("cloudflare", "challenge", "(protected by cloudflare|ddos protection by)"),
]
#: Lines of "name: value" headers that name the vendor.
HEADERS = [
    ("cloudflare", r"(server:\s*cloudflare\b|cf-ray:|cf-mitigated:)"),
    ("akamai", r"(server:\s*akamaighost\b|x-akamai-)"),
    ("sucuri", "x-sucuri-(block|cache|id):"),
    ("datadome", "x-datadome"),
    ("imperva", r"(x-iinfo:|x-cdn:\s*incapsula|server:.*incapsula)"),
    ("waf", r"server:\s*(zonealarm|wts/waf)"),
]


def _first(text: Column, rules: list[tuple[str, str, str]], also: Column | None = None) -> list[Column]:
    hold = lambda p: text.rlike(f"(?i){p}") if also is None else also & text.rlike(f"(?i){p}")
    return [F.when(hold(p), F.struct(F.lit(kind).alias("kind"), F.lit(by).alias("vendor"))) for by, kind, p in rules]


def interstitial(body: Column, weak_below: int = 15_000) -> Column:
    """kind, vendor of a challenge or block page: a sure sign anywhere, or a hint in a short page; null for other pages."""
    text = F.coalesce(body, F.lit(""))
    return F.coalesce(*_first(text, SURE), *_first(text, HINTS, F.length(text) <= weak_below))


def vendor(body: Column, headers: Column) -> Column:
    """Who answers, by sure signs in headers and the first 8,000 characters of the body, then by header lines."""
    seen = F.concat(F.coalesce(headers, F.lit("")), F.lit("\n"), F.substring(F.coalesce(body, F.lit("")), 1, 8000))
    return F.coalesce(*(x["vendor"] for x in _first(seen, SURE)), *(F.when(seen.rlike(f"(?im)^{p}"), F.lit(by)) for by, p in HEADERS))


def ban(status: Column, body: Column, headers: Column) -> Column:
    """kind (rate-limited, blocked, challenge) and vendor of an answer that is a ban; null for any other.

    Missing sign-ins and plain server errors are none; a 503 is one where it carries a challenge or names a vendor.
    """
    by, page = vendor(body, headers), interstitial(body)
    own = lambda kind: F.struct(F.lit(kind).alias("kind"), by.alias("vendor"))
    return (
        F.when(status.isin(401, 407), F.lit(None))
        .when(status == 429, own("rate-limited"))
        .when(status == 403, own("blocked"))
        .when(status == 503, F.coalesce(page, F.when(by.isNotNull(), own("challenge"))))
        .when(status >= 500, F.lit(None))
        .otherwise(page)
    )


def describe(found: Column, status: Column) -> Column:
    """The ban in words: what happened, who did it, the status; empty where there is none."""
    by, code = found["vendor"], F.concat(F.lit(" (HTTP "), status.cast("string"), F.lit(")"))
    named = lambda start, plain: F.concat(F.coalesce(F.concat(F.lit(start), by), F.lit(plain)), code)
    why = (
        F.when(status == 429, named("rate limited by ", "rate limited"))
        .when(status == 403, named("blocked by ", "request blocked"))
        .otherwise(F.concat(by, F.lit(" "), found["kind"]))
    )
    return F.coalesce(F.concat(why, F.coalesce(F.concat(F.lit(" ["), by, F.lit("]")), F.lit("")), F.lit(" HTTP "), status.cast("string")), F.lit(""))


def retry_after_ms(value: Column, now_ms: Column) -> Column:
    """Milliseconds to wait from whole seconds, or from an HTTP date (60 s at most, not negative)."""
    v = F.trim(value)
    at = F.unix_millis(F.try_to_timestamp(F.regexp_replace(v, "^[A-Za-z]{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss")))
    return F.when(v.rlike("^[0-9]+$"), v.try_cast("bigint") * 1000).when(at.isNotNull(), F.least(F.greatest(at - now_ms, F.lit(0)), F.lit(60_000)))


def retry_wait_ms(status: Column, attempt: Column, after_ms: Column, most: int = 2) -> Column:
    """Wait before the next attempt (0-based attempts so far), null for no retry. Status 0: the network failed."""
    again = (attempt < most) & ((status == 0) | (status == 429) | (status >= 500) | ((status == 403) & after_ms.isNotNull()))
    wait = F.when(status == 0, 600 * (attempt + 1)).otherwise(F.least(F.coalesce(after_ms, 800 * (attempt + 1)), F.lit(15_000)))
    return F.when(again, wait)


def backoff_ms(failures: Column, first_ms: int, most_ms: int) -> Column:
    return F.when(failures <= 0, F.lit(0)).otherwise(F.least(F.lit(float(most_ms)), first_ms * F.pow(F.lit(2.0), failures - 1))).cast("long")


def looks_like_feed(url: Column) -> Column:
    u = F.lower(F.coalesce(url, F.lit("")))
    return u.rlike(r"\.(xml|rss|atom)([?#]|$)|/rss([/?#]|$)|/feed([/?#]|$)|feedburner|/feeds/") | (u.contains("search") & u.contains("format=rss"))


def feed_type(body: Column) -> Column:
    head = F.lower(F.substring(F.coalesce(body, F.lit("")), 1, 4000))
    return F.when(head.contains("<rss") | head.contains("<rdf:rdf"), "rss").when(head.contains("<feed"), "atom").when(head.contains("<html") | head.contains("<!doctype html"), "html").otherwise("unknown")
