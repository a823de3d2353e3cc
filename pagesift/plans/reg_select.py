"""Registered queries: selectors, field rules, link following, body selection (M5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagesift.functions.stopwords import load_default_stopwords
from pagesift.operators import article as A
from pagesift.operators import dom as D
from pagesift.operators import select as SL
from pagesift.operators.relevance import profile_words, row_similarity
from pagesift.functions import html as H
from pagesift.functions import text as T
from pagesift.operators.relevance import REFERENCE_ANCHORS
from pagesift.plans import sqlparts as SQ
from pagesift.plans.catalog import register
from pagesift.plans.reg_text import PROFILE, TITLE_THRESHOLD
from pagesift.sources.tables import table


def _nodes(spark, sf):
    pages = table(spark, sf, "pages", "page_id", "html")
    return pages, A.cut(D.html_nodes(pages))


@register(
    "select_nodes",
    lambda: f"""SELECT page_id, 'xpath' AS selector, label AS text FROM {_nav_items_sql()} WHERE pos = 1
                UNION ALL
                SELECT page_id, 'css', {SQ.collapse_ws(SQ.decode_entities('val'))} FROM {SQ.posexplode_sql(
                    "pages", "page_id",
                    "regexp_extract_all(regexp_extract(html, '(?is)<article[^>]*>.*?</article>', 0), '(?is)<b(?:\\s[^>]*)?>([^<]*)', 1)")}""",
)
def q_select_nodes(spark, sf):
    """Nodes hit by an XPath and a CSS selector of the supported subset, reported by their text."""
    pages, n = _nodes(spark, sf)
    ctx = SL.document_ctx(pages)
    a = SL.select_nodes(n, ctx, SL.compile_xpath("//nav//li[2]/a")).withColumn("selector", F.lit("xpath"))
    b = SL.select_nodes(n, ctx, SL.compile_css("article > p b")).withColumn("selector", F.lit("css"))
    hits = a.unionByName(b)
    txt = D.node_text(n, hits.select("page_id", "node_id"))
    return hits.join(txt, ["page_id", "node_id"]).select("page_id", "selector", "text")


@register(
    "field_scalar",
    lambda: f"""SELECT page_id, 'title' AS field, {SQ.decode_entities(f"regexp_extract(html, {SQ.q(H.TITLE_RE)}, 1)")} AS value
                FROM pages WHERE regexp_matches(html, {SQ.q(H.TITLE_RE)})
                UNION ALL
                SELECT page_id, 'first_link', href FROM {_nav_items_sql()} WHERE pos = 0
                UNION ALL
                SELECT page_id, 'heading', regexp_extract(regexp_extract(html, '(?is)<article[^>]*>.*?</article>', 0),
                                                          '(?is)<h1[^>]*>.*?</h1>', 0)
                FROM pages WHERE regexp_matches(html, '(?is)<article[^>]*>.*?<h1')""",
)
def q_field_scalar(spark, sf):
    """First hit per page: a text node, an attribute and a serialised element."""
    pages, n = _nodes(spark, sf)
    ctx = SL.document_ctx(pages)
    parts = [
        SL.field_values(n, ctx, "xpath", "//title/text()", True).withColumn("field", F.lit("title")),
        SL.field_values(n, ctx, "xpath", "//nav//a/@href", True).withColumn("field", F.lit("first_link")),
        SL.field_values(n, ctx, "css", "article h1", True).withColumn("field", F.lit("heading")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("page_id", "field", "value")


@register(
    "field_list",
    lambda: f"""SELECT page_id, 'links' AS field, pos AS ord, href AS value FROM {_nav_items_sql()}
                UNION ALL
                SELECT page_id, 'paragraphs', pos, {SQ.decode_entities('val')} FROM {SQ.posexplode_sql(
                    "pages", "page_id",
                    "regexp_extract_all(regexp_extract(html, '(?is)<article[^>]*>.*?</article>', 0), '(?is)<p[^>]*>([^<]+)', 1)")}""",
)
def q_field_list(spark, sf):
    """All hits per page in document order."""
    pages, n = _nodes(spark, sf)
    ctx = SL.document_ctx(pages)
    a = SL.field_values(n, ctx, "xpath-list", "//nav//a/@href", False).withColumn("field", F.lit("links"))
    b = SL.field_values(n, ctx, "css-list", "article p::text", False).withColumn("field", F.lit("paragraphs"))
    return a.unionByName(b).select("page_id", "field", "ord", "value")


def _nav_items_sql() -> str:
    nav = f"regexp_extract(html, {SQ.q(H.NAV_RE)}, 0)"
    a = SQ.posexplode_sql("pages", "page_id", f"regexp_extract_all({nav}, {SQ.q(H.ANCHOR_RE)}, 0)", "pos", "raw")
    href = SQ.decode_entities(f"regexp_extract(raw, {SQ.q(H.HREF_RE)}, 1)")
    label = SQ.decode_entities(f"regexp_extract(raw, {SQ.q(H.ANCHOR_TEXT_RE)}, 1)")
    return f"(SELECT page_id, pos, {href} AS href, {label} AS label FROM {a})"


@register(
    "field_scope_loop",
    lambda: f"""SELECT page_id, pos AS item_ord, 'href' AS field, href AS value FROM {_nav_items_sql()}
                UNION ALL
                SELECT page_id, pos, 'label', label FROM {_nav_items_sql()}""",
)
def q_field_scope_loop(spark, sf):
    """``xpath-loop`` over list items; children evaluated inside each item.
    Each scope is reported by its document-order rank within the page."""
    pages, n = _nodes(spark, sf)
    scopes = SL.scope_loop(n, SL.document_ctx(pages), "xpath-loop", "//nav//li")
    a = SL.field_values(n, scopes, "xpath", "a/@href", True).withColumn("field", F.lit("href"))
    b = SL.field_values(n, scopes, "css", "a::text", True).withColumn("field", F.lit("label"))
    from pyspark.sql.window import Window

    rank = scopes.select("page_id", "scope", "ctx_id").withColumn(
        "item_ord", F.row_number().over(Window.partitionBy("page_id").orderBy("ctx_id")) - 1)
    vals = a.unionByName(b).join(rank, ["page_id", "scope"])
    return vals.select("page_id", "item_ord", "field", "value")


@register(
    "field_value_loop",
    lambda: f"""WITH p AS (
                  SELECT page_id, list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1), '/'),
                                              lambda x: x <> '') AS items,
                         {SQ.decode_entities("regexp_extract(html, '(?is)<h1[^>]*>([^<]*)', 1)")} AS h1
                  FROM pages)
                SELECT page_id, '/#' || (i - 1) AS scope, items[i] AS item, h1 AS value
                FROM (SELECT page_id, items, h1, generate_subscripts(items, 1) AS i FROM p)
                UNION ALL
                SELECT page_id, '/#0', NULL, h1 FROM p WHERE len(items) = 0""",
)
def q_field_value_loop(spark, sf):
    """``loop`` over a rendered list (the page's path segments): one pass per item."""
    pages, n = _nodes(spark, sf)
    url = table(spark, sf, "pages", "page_id", "url")
    ctx = SL.document_ctx(pages).join(url, "page_id")
    items = F.filter(F.split(F.regexp_extract("url", "^[a-z]+://[^/]+/([^?#]*)", 1), "/"), lambda x: x != "")
    scopes = SL.value_loop(ctx, items)
    vals = SL.field_values(n, scopes.drop("item"), "xpath", "//h1/text()", True)
    return scopes.select("page_id", "scope", "item").join(vals.select("page_id", "scope", "value"), ["page_id", "scope"], "left")


def _title_test(spark, threshold: float = TITLE_THRESHOLD):
    words = profile_words(spark, PROFILE)
    return row_similarity(F.col("text"), words, stopwords=load_default_stopwords(spark)) >= F.lit(threshold)


def _nav_links_sql(threshold: float = TITLE_THRESHOLD) -> str:
    """Anchors inside <nav> with href, text, raw markup and the title test."""
    nav = f"regexp_extract(html, {SQ.q(H.NAV_RE)}, 0)"
    a = SQ.posexplode_sql("pages", "page_id", f"regexp_extract_all({nav}, {SQ.q(H.ANCHOR_RE)}, 0)", "pos", "raw")
    href = SQ.decode_entities(f"regexp_extract(raw, {SQ.q(H.HREF_RE)}, 1)")
    text = SQ.collapse_ws(SQ.decode_entities(SQ.strip_tags(f"regexp_extract(raw, {SQ.q(H.ANCHOR_TEXT_RE)}, 1)")))
    base = f"(SELECT page_id, pos, raw, {href} AS href, {text} AS text FROM {a})"
    sims = SQ.similarity_sql(base, "page_id * 100000 + pos", "text", PROFILE, REFERENCE_ANCHORS)
    return f"""(SELECT b.*, s.sim >= {threshold} AS ok FROM {base} b JOIN {sims} s ON s.id = b.page_id * 100000 + b.pos)"""


@register(
    "link_follow_scalar",
    lambda: f"SELECT page_id, 0 AS ord, href AS value FROM {_nav_links_sql(0.0)} WHERE pos = 0 AND ok",
)
def q_link_follow_scalar(spark, sf):
    pages, n = _nodes(spark, sf)
    # The reference's default title threshold (0): every first link passes the test.
    out = SL.link_follow(n, SL.document_ctx(pages), "css", "nav a", _title_test(spark, 0.0), first_only=True)
    return out.select("page_id", "ord", "value")


@register(
    "link_follow_list",
    lambda: f"""WITH j AS {_nav_links_sql()},
                np AS (SELECT page_id, count(*) FILTER (WHERE ok) AS n_ok FROM j GROUP BY page_id)
                SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS ord, href AS value FROM j WHERE ok
                UNION ALL
                SELECT j.page_id, j.pos AS ord, j.raw AS value FROM j JOIN np USING (page_id) WHERE np.n_ok = 0""",
)
def q_link_follow_list(spark, sf):
    pages, n = _nodes(spark, sf)
    out = SL.link_follow(n, SL.document_ctx(pages), "css-list", "nav a", _title_test(spark), first_only=False,
                         fallback_all=True)
    return out.select("page_id", "ord", "value")


@register(
    "body_select",
    lambda: f"""SELECT page_id, coalesce(array_to_string(list_filter(list_transform(
                    regexp_extract_all(regexp_replace(regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1),
                                                      '(?is)<h1[^>]*>.*?</h1>', '', 'g'), '(?:^|>)([^<]+)', 1),
                    lambda t: regexp_replace({SQ.decode_entities('t')}, '^{T.WS_CLASS}+|{T.WS_CLASS}+$', '', 'g')),
                    lambda t: t <> ''), chr(10)), '') AS body
                FROM pages""",
)
def q_body_select(spark, sf):
    """Body from an XPath: stripped non-blank hits of the article paragraphs, newline-joined."""
    pages, n = _nodes(spark, sf)
    return SL.body_select(n, pages, False, "//article//p//text()")
