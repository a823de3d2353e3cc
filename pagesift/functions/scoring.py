"""Paragraph-scoring rules: label patterns, tag weights and thresholds.

Fixed values — these must equal the reference's for the same article choice.
The four label patterns are matched case-insensitively anywhere in a class
or id string; ``(?i)`` is written into each so Java and RE2 agree.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label patterns.
EXCLUDE_RE = (
    "(?i)combx|comment|community|disqus|extra|foot|header|menu|remark|rss|shoutbox|navbar|sidebar|sponsor|"
    "ad-break|agegate|pagination|pager|popup"
)
ALLOW_RE = "(?i)and|article|body|column|main|shadow"
POSITIVE_RE = (
    "(?i)article|body|content|entry|hentry|main|page|pagination|post|text|blog|story|document|section|chapter"
)
NEGATIVE_RE = (
    "(?i)combx|comment|com-|contact|foot|footer|footnote|masthead|media|meta|outbrain|promo|related|scroll|"
    "shoutbox|sidebar|sponsor|shopping|tags|tool|widget"
)
# Fixed value: a div whose inner markup has none of these tag openings becomes a paragraph.
PARAGRAPH_FIX_TAGS = ("a", "blockquote", "dl", "div", "img", "ol", "p", "pre", "table", "ul")

# Tag weights.
TAG_SCORES = [
    (("div", "article"), 5),
    (("pre", "td"), 3),
    (("address", "ol", "ul", "dl", "dd", "dt", "li", "form", "aside"), -3),
    (("h1", "h2", "h3", "h4", "h5", "h6", "th", "header", "footer", "nav"), -5),
]

# Paragraph thresholds.
MIN_TEXT_LENGTH = 25
MIN_CJK_LENGTH = 12  # int(25 / 2)
CJK_BYTE_RATIO = 1.4
PRE_SCORE_CAP = 35
EXPAND_RATIO = 0.2
EXPAND_FLOOR = 10
SHORT_PARAGRAPH = 80
LONG_P_MAX_DENSITY = 0.25
CANDIDATE_TAGS = ("p", "pre", "td")
BOILERPLATE_KEEP_TAGS = ("html", "body")


def tag_score(tag) -> Column:
    tag = F.lower(F.col(tag) if isinstance(tag, str) else tag)
    out = None
    for tags, score in TAG_SCORES:
        cond = tag.isin(list(tags))
        out = F.when(cond, F.lit(score)) if out is None else out.when(cond, F.lit(score))
    return out.otherwise(F.lit(0))


def label_score(label: Column) -> Column:
    """+25 for a positive label, else −25 for a negative one, else 0."""
    return (
        F.when(label.rlike(POSITIVE_RE), F.lit(25)).when(label.rlike(NEGATIVE_RE), F.lit(-25)).otherwise(F.lit(0))
    )


def css_score(cls: Column, ident: Column) -> Column:
    """Sum of ``label_score`` over the non-empty class and id strings."""
    def one(x):
        return F.when(F.coalesce(x, F.lit("")) != "", label_score(x)).otherwise(F.lit(0))

    return one(cls) + one(ident)


def is_boilerplate(cls: Column, ident: Column, tag: Column) -> Column:
    """A label matches the exclude pattern and not the allow pattern (html/body exempt)."""
    def one(x):
        x = F.coalesce(x, F.lit(""))
        return (x != "") & x.rlike(EXCLUDE_RE) & ~x.rlike(ALLOW_RE)

    return (one(cls) | one(ident)) & ~F.lower(tag).isin(list(BOILERPLATE_KEEP_TAGS))
