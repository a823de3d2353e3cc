"""Regex-level HTML expressions (the pure-SQL relatives of the node table).

These work on the raw ``html`` column with built-in regex functions, so they
stay JVM-side and are checkable by the DuckDB oracle with identical patterns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagesift.functions.text import col_, collapse_ws, decode_entities, strip_tags

COMMENT_RE = "(?is)<!--.*?-->"
SCRIPT_RE = "(?is)<script[^>]*>.*?</script>"
STYLE_RE = "(?is)<style[^>]*>.*?</style>"
LINK_TAG_RE = "(?is)<link[^>]*>"
TITLE_RE = "(?is)<title[^>]*>(.*?)</title>"
# Token stream: comments, script and style blocks whole, then tags, then text runs.
TOKEN_STREAM_RE = "(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<[^>]+>|[^<]+"
ANCHOR_RE = "(?is)<a\\s[^>]*>.*?</a>"
HREF_RE = "(?is)^<a\\s[^>]*?href\\s*=\\s*[\"']?([^\"'\\s>]*)"
ANCHOR_TEXT_RE = "(?is)^<a\\s[^>]*>(.*?)</a>$"
IMG_RE = "(?is)<img\\s[^>]*>"
SRC_RE = "(?is)^<img\\s[^>]*?src\\s*=\\s*[\"']?([^\"'\\s>]*)"
NAV_RE = "(?is)<nav[^>]*>.*?</nav>"


def clean_html(c) -> Column:
    """Drop comments, scripts, styles and ``<link>`` tags; keep everything else."""
    out = col_(c)
    for pat in (COMMENT_RE, SCRIPT_RE, STYLE_RE, LINK_TAG_RE):
        out = F.regexp_replace(out, pat, "")
    return out


def page_text(c) -> Column:
    """Cleaned, tag-stripped, entity-decoded text with whitespace collapsed."""
    return collapse_ws(decode_entities(strip_tags(clean_html(c))))


def page_title(c) -> Column:
    """Text of the first ``<title>``; ``Untitled`` when missing or blank."""
    t = decode_entities(F.regexp_extract(col_(c), TITLE_RE, 1))
    has_title = col_(c).rlike(TITLE_RE) & (F.trim(t) != "")
    return F.when(F.coalesce(has_title, F.lit(False)), t).otherwise(F.lit("Untitled"))


def anchors(c) -> Column:
    """Whole ``<a …>…</a>`` elements in document order."""
    return F.regexp_extract_all(col_(c), F.lit(ANCHOR_RE), 0)


def anchor_href(a) -> Column:
    return decode_entities(F.regexp_extract(col_(a), HREF_RE, 1))


def anchor_text(a) -> Column:
    return collapse_ws(decode_entities(strip_tags(F.regexp_extract(col_(a), ANCHOR_TEXT_RE, 1))))


def image_srcs(c) -> Column:
    """``src`` of every ``<img>`` in document order (blank when absent)."""
    return F.transform(
        F.regexp_extract_all(col_(c), F.lit(IMG_RE), 0),
        lambda t: decode_entities(F.regexp_extract(t, SRC_RE, 1)),
    )


def html_tokens(c) -> Column:
    return F.regexp_extract_all(col_(c), F.lit(TOKEN_STREAM_RE), 0)
