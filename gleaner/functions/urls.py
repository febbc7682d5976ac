"""URL expressions: parts, canonical keys, features and rules."""

import re
import unicodedata
from urllib import parse

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gleaner.functions.text import words

# Query parameters that only track.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "ref")
#: Each escape as it is kept: unreserved characters as themselves, others in upper case.
_ESCAPES = {b: chr(b) if chr(b).isalnum() and b < 128 or chr(b) in "-._~" else f"%{b:02X}" for b in range(256)}
_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)(?::(\d+))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def part(url: Column, group: int) -> Column:
    """1 scheme, 2 host, 3 port, 4 path, 5 query, 6 fragment; empty when absent, also without scheme."""
    return F.regexp_extract(url, _PARTS, group)


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(part(url, 2)), r"^www\.", "")


def fetchable(url: Column) -> Column:
    """The URL without fragment, or null if it is no http(s) URL with a host."""
    return F.when(F.lower(part(url, 1)).isin("http", "https") & (part(url, 2) != ""), F.split_part(url, F.lit("#"), F.lit(1)))


def _canonical(url: str, tracking: frozenset[str]) -> str | None:
    u = parse.urlsplit(unicodedata.normalize("NFC", url.strip()))
    try:
        port = u.port
    except ValueError:  # no number
        return None
    site = (u.hostname or "").lower().rstrip(".")
    if port and (u.scheme.lower(), port) not in (("http", 80), ("https", 443)):
        site += f":{port}"
    path = re.sub("%([0-9A-Fa-f]{2})", lambda m: _ESCAPES[int(m[1], 16)], u.path).rstrip("/") or "/"
    kept = [(k, v) for k, v in parse.parse_qsl(u.query, keep_blank_values=True) if k.lower() not in tracking]
    query = "&".join(f"{parse.quote(k, safe='/:@-._~')}={parse.quote(v, safe='/:@-._~')}" for k, v in kept)
    return parse.urlunsplit((u.scheme.lower(), site, path, query, ""))


@F.pandas_udf(StringType())
def normalized(url: pd.Series) -> pd.Series:
    """NFC; lower-case scheme and host, the host's last dot gone; no default port, fragment, tracking parameters or trailing slash.

    Escapes of unreserved characters are undone, others are in upper case; the
    query is written anew, with blank values.  Null where the port is no number.
    """
    tracking = frozenset(TRACKING)
    return url.map(lambda u: _canonical(u, tracking), na_action="ignore")


def canonical_key(url: Column) -> Column:
    """The normalized URL without its scheme."""
    return F.regexp_replace(normalized(url), "^[a-z][a-z0-9+.-]*:", "")


def path_segments(url: Column) -> Column:
    return F.filter(F.split(part(url, 4), "/"), lambda s: s != "")


def extension(url: Column) -> Column:
    return F.lower(F.regexp_extract(part(url, 4), r"\.([A-Za-z0-9]{1,8})$", 1))


def has_tracking(url: Column) -> Column:
    return F.exists(F.split(part(url, 5), "&"), lambda p: F.lower(F.split_part(p, F.lit("="), F.lit(1))).isin(*TRACKING))


def url_text(url: Column) -> Column:
    """Host, path and query as words, percent-decoded where that is possible."""
    raw = F.concat_ws(" ", host(url), part(url, 4), part(url, 5))
    return F.coalesce(F.try_url_decode(raw), raw)


def url_tokens(url: Column) -> Column:
    return words(F.regexp_replace(url_text(url), "[_-]", " "))


def numeric_ratio(tokens: Column) -> Column:
    n = F.size(tokens)
    return F.when(n > 0, F.size(F.filter(tokens, lambda t: t.rlike(r"^\d+$"))) / n).otherwise(0.0)


def opaque(tokens: Column) -> Column:
    """Mostly numbers, no word, or a single token: nothing to match a query with."""
    no_word = ~F.exists(tokens, lambda t: t.rlike(r"\p{L}{2,}"))
    return (numeric_ratio(tokens) >= 0.5) | no_word | (F.size(tokens) <= 1)


def likely_language(h: Column) -> Column:
    return (
        F.when(h.endswith(".vn"), "vi").when(h.endswith(".cn") | h.endswith(".tw") | h.endswith(".hk"), "zh")
        .when(h.endswith(".org") | h.endswith(".com") | h.endswith(".net"), "en").otherwise("unknown"))


def record_id(url: Column, wanted_host: str) -> Column:
    """The number of a record page: right host, no query or fragment, a path of one number."""
    ok = (host(url) == wanted_host) & (part(url, 5) == "") & (part(url, 6) == "") & part(url, 4).rlike(r"^/\d+/?$")
    return F.when(ok, F.regexp_extract(part(url, 4), r"(\d+)", 1).cast("long"))


def discovery_class(url: Column) -> Column:
    """What kind of listing page a URL looks like."""
    path = F.lower(part(url, 4))
    return (
        F.when(path.rlike(r"sitemap.*\.xml"), "sitemap").when(path.contains("robots.txt"), "robots").when(path.rlike("(search|tim-kiem)"), "search")
        .when(path.rlike("(tag|category|topic)"), "listing").when(F.size(path_segments(url)) <= 1, "shallow").otherwise("article"))


def matches_rule(url: Column, rule: dict) -> Column:
    """A sampling rule: any of domain, suffix, scheme, with_query, without_extension."""
    out = F.lit(True)
    if "domain" in rule:
        out = out & (host(url) == rule["domain"])
    if "suffix" in rule:
        out = out & host(url).endswith(rule["suffix"])
    if "scheme" in rule:
        out = out & (F.lower(part(url, 1)) == rule["scheme"])
    if "with_query" in rule:
        out = out & ((part(url, 5) != "") == rule["with_query"])
    if rule.get("without_extension"):
        out = out & (extension(url) == "")
    return out
