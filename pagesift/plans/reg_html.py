"""Registered queries: token-level HTML tables, links, images, URLs, charsets (M2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagesift.functions import html as H
from pagesift.functions.urls import url_join
from pagesift.operators import charset as CS
from pagesift.operators.frontier import scope_source
from pagesift.operators import tokens as TK
from pagesift.plans import sqlparts as S
from pagesift.plans.catalog import register
from pagesift.sources.tables import table

CANDIDATES = ["p", "pre", "td"]


def _pages(spark, sf, *cols):
    return table(spark, sf, "pages", *(cols or ("page_id", "url", "html")))


@register("html_tokens", lambda: f"SELECT page_id, pos, kind, tag, token FROM {S.tokens_sql()}")
def q_html_tokens(spark, sf):
    return TK.html_tokens(_pages(spark, sf, "page_id", "html"))


@register(
    "nodes_by_tag",
    lambda: f"""SELECT page_id, tag, pos, row_number() OVER (PARTITION BY page_id ORDER BY
                       list_position({['p', 'pre', 'td']}, tag), pos) AS ord
                FROM {S.start_tags_sql()} WHERE tag IN ('p', 'pre', 'td')""",
)
def q_nodes_by_tag(spark, sf):
    return TK.nodes_by_tag(TK.start_tags(TK.html_tokens(_pages(spark, sf, "page_id", "html"))), CANDIDATES)


@register(
    "node_labels",
    lambda: f"""SELECT page_id, pos, 'class' AS kind, class AS label FROM {S.start_tags_sql()} WHERE class <> ''
                UNION ALL
                SELECT page_id, pos, 'id' AS kind, id AS label FROM {S.start_tags_sql()} WHERE id <> ''""",
)
def q_node_labels(spark, sf):
    return TK.node_labels(TK.start_tags(TK.html_tokens(_pages(spark, sf, "page_id", "html"))))


@register("tag_score", lambda: f"SELECT page_id, pos, tag, {S.tag_score_sql('tag')} AS tag_score FROM {S.start_tags_sql()}")
def q_tag_score(spark, sf):
    return TK.tag_scores(TK.start_tags(TK.html_tokens(_pages(spark, sf, "page_id", "html"))))


@register(
    "css_score",
    lambda: f"""SELECT page_id, pos, tag, {S.css_score_sql('class', 'id')} AS css_score,
                       {S.boilerplate_sql('class', 'id', 'tag')} AS boilerplate FROM {S.start_tags_sql()}""",
)
def q_css_score(spark, sf):
    return TK.css_scores(TK.start_tags(TK.html_tokens(_pages(spark, sf, "page_id", "html"))))


def links_sql() -> str:
    a = S.posexplode_sql("pages", "page_id, url", f"regexp_extract_all(html, {S.q(H.ANCHOR_RE)}, 0)", "pos", "a")
    href = S.decode_entities(f"regexp_extract(a, {S.q(H.HREF_RE)}, 1)")
    text = S.collapse_ws(S.decode_entities(S.strip_tags(f"regexp_extract(a, {S.q(H.ANCHOR_TEXT_RE)}, 1)")))
    return f"(SELECT page_id, url, pos, {href} AS href, {text} AS text FROM {a})"


@register("page_links", lambda: f"SELECT page_id, pos, href, text FROM {links_sql()}")
def q_page_links(spark, sf):
    return TK.page_links(_pages(spark, sf, "page_id", "html"))


@register(
    "page_images",
    lambda: f"""SELECT page_id, pos, {S.decode_entities(f"regexp_extract(val, {S.q(H.SRC_RE)}, 1)")} AS src
                FROM {S.posexplode_sql('pages', 'page_id', f"regexp_extract_all(html, {S.q(H.IMG_RE)}, 0)")}""",
)
def q_page_images(spark, sf):
    return TK.page_images(_pages(spark, sf, "page_id", "html"))


def _nav_hrefs_sql():
    nav = f"array_to_string(regexp_extract_all(html, {S.q(H.NAV_RE)}, 0), '')"
    return (
        f"list_transform(regexp_extract_all({nav}, {S.q(H.ANCHOR_RE)}, 0), "
        f"lambda a: {S.decode_entities(f'regexp_extract(a, {S.q(H.HREF_RE)}, 1)')})"
    )


@register(
    "first_five",
    lambda: f"""SELECT page_id, {', '.join(f'h[{i}] AS v{i}' for i in range(1, 6))}
                FROM (SELECT page_id, {_nav_hrefs_sql()} AS h FROM pages)""",
)
def q_first_five(spark, sf):
    """First five navigation links of each page in five columns (the photo-column shape)."""
    p = _pages(spark, sf, "page_id", "html")
    hrefs = F.transform(F.regexp_extract_all(scope_source("html", H.NAV_RE), F.lit(H.ANCHOR_RE), 0), H.anchor_href)
    return p.select("page_id", *TK.first_five(hrefs))


@register(
    "url_join",
    lambda: f"SELECT page_id, pos, href, {S.url_join_sql('url', 'href')} AS abs_url FROM {links_sql()}",
)
def q_url_join(spark, sf):
    p = _pages(spark, sf, "page_id", "url", "html")
    links = p.select("page_id", "url", F.posexplode(H.anchors("html")).alias("pos", "a"))
    links = links.select("page_id", "url", "pos", H.anchor_href("a").alias("href"))
    return links.select("page_id", "pos", "href", url_join("url", "href").alias("abs_url"))


@register(
    "charset_detect",
    lambda: f"""SELECT page_id, {S.q('')} || regexp_extract(html, {S.q(CS.META_CHARSET_RE)}, 1) AS declared,
                       {CS.charset_sql('html')} AS charset FROM pages""",
)
def q_charset_detect(spark, sf):
    p = _pages(spark, sf, "page_id", "html")
    return p.select("page_id", F.regexp_extract("html", CS.META_CHARSET_RE, 1).alias("declared"),
                    CS.detect_charset("html").alias("charset"))


@register(
    "html_decode",
    """SELECT page_id, CASE page_id % 3 WHEN 2 THEN 'iso-8859-1' ELSE 'utf-8' END AS charset,
              md5(CASE page_id % 3 WHEN 0 THEN html WHEN 1 THEN html || chr(65533) || 'x'
                  ELSE replace(regexp_replace(html, '[^\\x{0000}-\\x{00FF}]', '?', 'g'), 'charset="utf-8"', 'charset="iso-8859-1"') END) AS html_md5
       FROM pages""",
)
def q_html_decode(spark, sf):
    """Bytes → charset detection → text: whole UTF-8, UTF-8 with a bad byte, and a second declared charset."""
    html, third = F.col("html"), F.col("page_id") % 3
    latin = F.replace(F.regexp_replace(html, "[^\\x{0000}-\\x{00FF}]", "?"), F.lit('charset="utf-8"'), F.lit('charset="iso-8859-1"'))
    content = (
        F.when(third == 0, F.encode(html, "UTF-8"))
        .when(third == 1, F.concat(F.encode(html, "UTF-8"), F.lit(b"\xffx")))
        .otherwise(F.encode(latin, "ISO-8859-1"))
    )
    d = CS.html_decode(_pages(spark, sf, "page_id", "html").select("page_id", content.alias("content")), "content")
    return d.select("page_id", "charset", F.md5(F.encode("html", "UTF-8")).alias("html_md5"))
