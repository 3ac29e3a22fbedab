"""Scalar functions as column expressions; none is a Python UDF but decode_entities."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parameters that only track where a visitor came from. Names are compared in lower case, so the last never matches.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "mc_cid", "mc_eid", "ref", "referrer", "_hsenc", "_hsmi", "hsCtaTracking")
#: How a question starts.
QUESTION_STARTS = ("what", "why", "how", "will", "would", "could", "should", "do ", "does", "did", "is ", "are ", "can ", "which", "who ", "when", "where", "might", "shall")
#: Hosts whose links hide another address.
SHORTENERS = ("tinyurl.com", "bit.ly", "ow.ly", "goo.gl", "buff.ly", "dlvr.it", "ift.tt", "rebrand.ly", "short.io", "tiny.cc", "t.co", "lnkd.in", "fb.me", "is.gd", "v.gd")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def item_id(source: Column | str, url: Column | str) -> Column:
    """The first 16 hexadecimal digits of SHA-256 of source:url."""
    return F.substring(F.sha2(F.concat(F.coalesce(col(source), F.lit("")), F.lit(":"), F.coalesce(col(url), F.lit(""))), 256), 1, 16)


def _form(x: Column) -> Column:
    """A form field's text decoded and encoded again, so that equal values look equal; what cannot be decoded stays."""
    plain = F.coalesce(F.try_url_decode(x), F.replace(x, F.lit("+"), F.lit(" ")))
    return F.replace(F.replace(F.url_encode(plain), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def normalize_url(url: Column | str) -> Column:
    """Without fragment, tracking or blank parameters and slashes at its end; repeated parameters stand together; lower case."""
    bare = F.regexp_replace(col(url), "(?s)#.*$", "")
    path, query = F.regexp_extract(bare, r"^([^?]*)", 1), F.regexp_extract(bare, r"(?s)^[^?]*\?(.*)$", 1)
    given = F.filter(F.split(query, "&"), lambda p: (F.instr(p, "=") > 0) & ~p.endswith("=") | p.rlike("^[^=]*=.*=$"))
    name = lambda p: _form(F.substring_index(p, "=", 1))
    pairs = F.filter(F.transform(given, lambda p: F.struct(name(p).alias("k"), _form(F.substr(p, F.instr(p, "=") + 1)).alias("v"))), lambda p: ~F.lower(p["k"]).isin(*TRACKING))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    grouped = F.flatten(F.transform(keys, lambda k: F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: F.concat(k, F.lit("="), p["v"]))))
    rest = F.array_join(grouped, "&")
    return F.lower(F.regexp_replace(F.when(rest == "", path).otherwise(F.concat(path, F.lit("?"), rest)), "/+$", ""))


def title_key(title: Column | str) -> Column:
    """Without a trailing publisher, a word character and up to 40 more without a hyphen; a-z and digits only; 80 characters."""
    bare = F.regexp_replace(F.regexp_replace(col(title), r"(?U)^\s+|\s+\z", ""), r"(?U)\s+-\s+\w[^-]{0,40}\z", "")
    return F.substring(F.regexp_replace(F.lower(bare), "[^a-z0-9]", ""), 1, 80)


def search_title_key(title: Column | str) -> Column:
    return F.substring(F.trim(F.lower(col(title))), 1, 80)


def detail_score(content: Column | str, summary: Column | str, raw: Column | str) -> Column:
    has = F.when(F.coalesce(col(summary), F.lit("")) != "", 2.0).otherwise(0.0)
    return F.length(F.coalesce(col(content), F.lit(""))) * F.lit(0.001) + has + col(raw) * 0.5


def decode_entities(text: Column | str) -> Column:
    """The six entities that cover most feeds, & last."""
    out = col(text)
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def strip_html(page: Column | str) -> Column:
    """Entities first, so that encoded tags go too; a tag becomes a space; white space collapses."""
    return F.trim(F.regexp_replace(F.regexp_replace(decode_entities(page), "<[^>]+>", " "), r"\s+", " "))


def unescape_all(text: Column | str) -> Column:
    """Every named entity, by Arrow batches."""
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(html.unescape, na_action="ignore")

    return run(col(text))


def search_terms(query: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(col(query)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def fts_escape(query: Column | str) -> Column:
    """Words quoted one by one, an empty phrase if there is none."""
    found = F.regexp_extract_all(col(query), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.when(F.size(found) == 0, F.lit('""')).otherwise(F.array_join(F.transform(found, lambda w: F.concat(F.lit('"'), w, F.lit('"'))), " "))


def word_count(text: Column | str) -> Column:
    return F.regexp_count(col(text), F.lit(r"\S+"))


def is_question(text: Column | str) -> Column:
    low = F.lower(F.trim(col(text)))
    starts = low.startswith(QUESTION_STARTS[0])
    for s in QUESTION_STARTS[1:]:
        starts = starts | low.startswith(s)
    return low.endswith("?") | starts | (word_count(low) >= 7)


def wants_expansion(text: Column | str) -> Column:
    return is_question(text) | (word_count(text) >= 3)


def minmax(x: Column | str, low: Column, high: Column, flat: float = 0.0) -> Column:
    """(x - low) / (high - low), clamped to [0, 1]; `flat` where high is not above low."""
    return F.when(high <= low, F.lit(flat)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (col(x) - low) / (high - low))))


def freshness(published: Column | str, at: Column, hours: float = 48.0) -> Column:
    age = F.timestamp_diff("SECOND", col(published), at) / 3600.0
    return F.exp(-F.greatest(F.lit(0.0), age) / hours)


def sigmoid_boost(x: Column | str, scale: float) -> Column:
    return F.lit(2.0) / (F.lit(1.0) + F.exp(-F.lit(scale) * col(x))) - 1.0


def interaction_weight(action: Column | str, seconds: Column | str) -> Column:
    a, s = col(action), col(seconds)
    read = F.when(s >= 180, 3.0).when(s >= 60, 1.5).when(s >= 15, 0.5).otherwise(0.0)
    return F.when(a == "upvote", 5.0).when(a == "unupvote", -5.0).when(a == "downvote", -8.0).when(a == "undownvote", 8.0).when(a == "click", 1.5).when(a == "read", read).otherwise(0.0)


def instant(text: Column | str, at: Column) -> Column:
    """A time in ISO 8601, in UTC; `at` where there is none or it cannot be read."""
    return F.coalesce(F.try_to_timestamp(col(text)).cast("timestamp_ntz"), at)


def slug(topic: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(col(topic)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def escaped(text: Column | str) -> Column:
    """Text for HTML, quotes included."""
    out = col(text)
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(char), F.lit(name))
    return out


def bold(markdown: Column | str) -> Column:
    return F.regexp_replace(escaped(markdown), r"\*\*(.+?)\*\*", "<strong>$1</strong>")


def parse_digest(text: Column | str) -> Column:
    """headline and bullets: what stands between ||| as it is, without blank bullets, else the lines that are not blank, trimmed.
    Null where there is nothing."""
    t = col(text)
    blank = lambda p: F.regexp_replace(p, r"^\s+|\s+$", "") == ""
    parts, lines = F.split(t, r"\|\|\|"), F.filter(F.transform(F.split(t, r"\r\n|\r|\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    cut = F.instr(t, "|||") > 0
    rest = lambda x: F.slice(x, 2, F.greatest(F.lit(1), F.size(x)))
    held = F.struct(F.when(cut, F.get(parts, F.lit(0))).otherwise(F.get(lines, F.lit(0))).alias("headline"), F.when(cut, F.filter(rest(parts), lambda p: ~blank(p))).otherwise(rest(lines)).alias("bullets"))
    return F.when(cut | (F.size(lines) > 0), held)


def csv_list(text: Column | str) -> Column:
    """Trimmed, non-empty, first seen of each in any case; `all` or nothing gives an empty list."""
    parts = F.filter(F.transform(F.split(F.coalesce(col(text), F.lit("")), ","), lambda p: F.trim(p)), lambda p: p != "")
    first = F.filter(parts, lambda p, i: F.array_position(F.transform(parts, lambda q: F.lower(q)), F.lower(p)) == i + 1)
    return F.when(F.lower(F.trim(col(text))) == "all", F.array().cast("array<string>")).otherwise(first)


def embed_text(title: Column | str, content: Column | str, n: int = 200) -> Column:
    return F.concat(col(title), F.lit(" "), F.substring(F.coalesce(col(content), F.lit("")), 1, n))


def cashtags(text: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.upper(col(text)), F.lit(r"\$[A-Z]{1,5}\b"), F.lit(0)))


#: Fixed value: the host whose article links hold their target.
NEWS_HOST = "news.google.com"


def news_target(url: Column | str) -> Column:
    """The address inside a news search's article link: url-safe base64 of its path segment, up to a zero byte. Other links, and
    those that hold no address, stay as they are."""
    segment = F.regexp_extract(col(url), r"/articles/([A-Za-z0-9_-]+)", 1)
    raw = F.decode(F.try_to_binary(F.translate(segment, "-_", "+/"), F.lit("base64")), "ISO-8859-1")
    plain, safe = (F.regexp_extract(raw, rf"(?s)({x}://[^\x00]*)", 1) for x in ("http", "https"))
    held = F.when(safe != "", safe).otherwise(plain)
    held = F.decode(F.encode(held, "ISO-8859-1"), "UTF-8")
    found = F.contains(col(url), F.lit(NEWS_HOST)) & (segment != "") & (F.instr(F.substring(held, 1, 60), ".") > 0)
    return F.when(F.coalesce(found, F.lit(False)), held).otherwise(col(url))


def fenced_json(text: Column | str) -> Column:
    """What stands inside a code fence, or all of it; null unless that is an array."""
    body = F.trim(F.regexp_replace(F.trim(col(text)), r"^```[a-z]*\s*|\s*```$", ""))
    return F.when(body.startswith("[") & body.endswith("]"), body)


def json_object(text: Column | str) -> Column:
    """From the first { to the last }; null if there is none."""
    found = F.regexp_extract(col(text), r"(?s)(\{.*\})", 1)
    return F.when(found != "", found)


def shown_url(expanded: Column | str, own: Column | str) -> Column:
    """The linked address unless it is a shortener's or the network's own."""
    host = F.lower(F.regexp_replace(F.regexp_extract(col(expanded), r"^[a-zA-Z]+://([^/?#]+)", 1), r"^www\.", ""))
    bad = host.isin(*SHORTENERS, "twitter.com", "x.com") | (host == "")
    return F.when(F.coalesce(bad, F.lit(True)), col(own)).otherwise(col(expanded))


def show_content(title: Column | str, content: Column | str) -> Column:
    t, c = col(title), col(content)
    return (F.length(c) > F.length(t) + 60) & ~F.lower(c).startswith("http") & (F.substring(F.lower(c), 1, 80) != F.substring(F.lower(t), 1, 80))


def usage(response: Column | str) -> list[Column]:
    """prompt_tokens, completion_tokens, total_tokens of a model's answer in JSON; 0 for what is missing or no number."""
    read = lambda k: F.get_json_object(col(response), f"$.usage.{k}")
    names = ("prompt_tokens", "completion_tokens", "total_tokens")
    return [F.coalesce(read(k).try_cast("double").cast("long"), F.lit(0).cast("long")).alias(k) for k in names]
