"""Registered queries: links by stage, routing, fetch join, frontier, history (M6)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pagesift.functions import html as H
from pagesift.functions.joins import param_frame, spread
from pagesift.functions.urls import url_join
from pagesift.operators import frontier as FR
from pagesift.operators import requests as RQ
from pagesift.plans import sqlparts as S
from pagesift.plans.catalog import register
from pagesift.plans.reg_html import links_sql
from pagesift.sources.tables import fetch_join, table

FOOTER_RE = "(?is)<footer[^>]*>.*?</footer>"
ARTICLE_RE = "(?is)<article[^>]*>.*?</article>"
FIELDS = [
    ("sections", H.NAV_RE, "section"),
    ("footer_links", FOOTER_RE, "detail"),
    ("body_links", ARTICLE_RE, ""),  # no next stage: not followed
]
STAGES = [("list", 0), ("section", 1), ("detail", 2)]
DEPTH_LIMIT = 5


def _hrefs_sql(scope_re: str) -> str:
    src = f"array_to_string(regexp_extract_all(html, {S.q(scope_re)}, 0), '')"
    return (
        f"list_transform(regexp_extract_all({src}, {S.q(H.ANCHOR_RE)}, 0), "
        f"lambda a: {S.decode_entities(f'regexp_extract(a, {S.q(H.HREF_RE)}, 1)')})"
    )


def _links_long_sql() -> str:
    parts = []
    for name, scope, nxt in FIELDS:
        if not nxt:
            continue
        ex = S.posexplode_sql("pages", "page_id, url", _hrefs_sql(scope), "pos", "href")
        parts.append(f"SELECT page_id, url, '{name}' AS field, '{nxt}' AS next_stage, pos, href FROM {ex}")
    return "(" + " UNION ALL ".join(parts) + ")"


@register(
    "links_by_stage",
    lambda: " UNION ALL ".join(
        f"""SELECT page_id, '{nxt}' AS next_stage, len(h) AS n_links, array_to_string(h, ' ') AS hrefs
            FROM (SELECT page_id, {_hrefs_sql(scope)} AS h FROM pages)"""
        for _, scope, nxt in FIELDS if nxt
    ),
)
def q_links_by_stage(spark, sf):
    p = table(spark, sf, "pages", "page_id", "url", "html")
    g = FR.links_by_stage_grouped(p, FIELDS)
    return g.select("page_id", "next_stage", F.size("hrefs").alias("n_links"), F.array_join("hrefs", " ").alias("hrefs"))


def _stage_df(spark):
    return param_frame(spark, STAGES, "name STRING, stage_ord INT")


def _routes(spark, sf):
    p = table(spark, sf, "pages", "page_id", "url", "html")
    return FR.stage_route(FR.links_by_stage(p, FIELDS), _stage_df(spark))


def _routes_sql() -> str:
    st = S.values(STAGES, "name, stage_ord")
    return f"""(SELECT l.page_id, l.pos, l.next_stage, s.stage_ord, {S.url_join_sql('l.url', 'l.href')} AS request_url,
                       1 AS depth,
                       CASE WHEN s.stage_ord IS NULL THEN 'unknown stage: ' || l.next_stage END AS route_error
                FROM {_links_long_sql()} l LEFT JOIN {st} s ON s.name = l.next_stage)"""


@register("stage_route", lambda: f"SELECT * FROM {_routes_sql()}")
def q_stage_route(spark, sf):
    return _routes(spark, sf)


@register(
    "fetch_join",
    lambda: f"""SELECT r.page_id, r.pos, r.request_url, p.page_id AS fetched_page_id, p.page_id IS NOT NULL AS fetched
                FROM {_routes_sql()} r LEFT JOIN pages p ON p.url = r.request_url""",
)
def q_fetch_join(spark, sf):
    """Requests resolved to snapshots; the fixture's nav links resolve to none."""
    r = _routes(spark, sf).select("page_id", "pos", "request_url")
    pages = table(spark, sf, "pages", "page_id", "url", "html").withColumnRenamed("page_id", "fetched_page_id")
    pages = pages.withColumnRenamed("fetched_page_id", "page_id")
    j = fetch_join(r.withColumnRenamed("page_id", "src_page_id"), pages, "request_url")
    return j.select(
        F.col("src_page_id").alias("page_id"), "pos", "request_url", F.col("page_id").alias("fetched_page_id"), "fetched"
    )


def page_edges(pages):
    """``src_url, dst_url``: the resolved targets of all links of all pages."""
    links = pages.select("url", F.explode(H.anchors("html")).alias("a"))
    return links.select(F.col("url").alias("src_url"), url_join(F.col("url"), H.anchor_href("a")).alias("dst_url"))


def _edges_sql() -> str:
    return f"(SELECT DISTINCT url AS src_url, {S.url_join_sql('url', 'href')} AS dst_url FROM {links_sql()})"


@register(
    "frontier_expand",
    lambda: f"""WITH RECURSIVE e AS (SELECT * FROM {_edges_sql()}),
        r(url, depth) AS (
          SELECT url, 1 FROM pages
          UNION
          SELECT e.dst_url, r.depth + 1 FROM r JOIN e ON e.src_url = r.url WHERE r.depth <= {DEPTH_LIMIT} AND e.dst_url IS NOT NULL)
        SELECT url, min(depth) AS depth FROM r GROUP BY url""",
)
def q_frontier_expand(spark, sf):
    """Start from every page; expand over the pages' own links to the depth limit."""
    pages = table(spark, sf, "pages", "url", "html")
    return FR.frontier_expand(spark, pages.select("url"), page_edges(spread(pages)), FR.depth_limit(DEPTH_LIMIT))


def derived_edges(pages):
    """A deeper link table than the fixture's own (whose links resolve to no
    snapshot): page i links to pages 2i+1 and 2i+2.  Two equi-joins on page_id —
    no skew, no pairs."""
    p = pages.select("page_id", "url")
    q = pages.select(F.col("page_id").alias("dst_id"), F.col("url").alias("dst_url"))
    left = p.join(q, q["dst_id"] == p["page_id"] * 2 + 1)
    right = p.join(q, q["dst_id"] == p["page_id"] * 2 + 2)
    return left.unionByName(right).select(F.col("url").alias("src_url"), "dst_url")


@register(
    "frontier_levels",
    f"""WITH RECURSIVE e AS (
          SELECT p.url AS src_url, q.url AS dst_url FROM pages p JOIN pages q ON q.page_id = 2 * p.page_id + 1
          UNION ALL
          SELECT p.url, q.url FROM pages p JOIN pages q ON q.page_id = 2 * p.page_id + 2),
        r(url, depth) AS (
          SELECT url, 1 FROM pages WHERE NOT contains(url, '?')
          UNION
          SELECT e.dst_url, r.depth + 1 FROM r JOIN e ON e.src_url = r.url WHERE r.depth <= {DEPTH_LIMIT})
        SELECT url, min(depth) AS depth FROM r GROUP BY url""",
)
def q_frontier_levels(spark, sf):
    """The same over derived links that go several levels deep, from the pages whose URL has no query string."""
    pages = table(spark, sf, "pages", "page_id", "url")
    start = pages.where(~F.col("url").contains("?")).select("url")
    return FR.frontier_expand(spark, start, derived_edges(pages), FR.depth_limit(DEPTH_LIMIT))


HISTORY_BUCKET = 64


def previous_turns(c):
    """``conv_id, turn, prev_turn``: the latest earlier turn, whatever lies between.

    A conversation is ordered in buckets of turns; the first turn of a bucket
    follows the last one of the bucket before, so no task orders more than a
    bucket's turns or a conversation's buckets.
    """
    turns = c.select("conv_id", "turn", F.floor(F.col("turn") / HISTORY_BUCKET).alias("bucket"))
    inside = Window.partitionBy("conv_id", "bucket").orderBy("turn")
    last = turns.groupBy("conv_id", "bucket").agg(F.max("turn").alias("last"))
    before = last.select("conv_id", "bucket", F.lag("last").over(Window.partitionBy("conv_id").orderBy("bucket")).alias("last"))
    own = turns.withColumn("prev", F.lag("turn").over(inside))
    return own.join(before, ["conv_id", "bucket"]).select("conv_id", "turn", F.coalesce("prev", "last").alias("prev_turn"))


@register(
    "stage_history",
    """WITH RECURSIVE t AS (SELECT conv_id, turn, role, text, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS up
                            FROM conversations),
       anc AS (SELECT conv_id, turn, up, 1 AS step FROM t WHERE up IS NOT NULL
               UNION ALL SELECT anc.conv_id, anc.turn, t.up, step + 1 FROM anc JOIN t ON t.conv_id = anc.conv_id AND t.turn = anc.up WHERE t.up IS NOT NULL),
       latest AS (SELECT anc.conv_id, anc.turn, t.role, arg_min(t.text, step) AS text
                  FROM anc JOIN t ON t.conv_id = anc.conv_id AND t.turn = anc.up GROUP BY ALL)
       SELECT t.conv_id, t.turn, t.up AS prev_turn, max(l.text) FILTER (WHERE l.role = 'system') AS system_text,
              max(l.text) FILTER (WHERE l.role = 'user') AS user_text, max(l.text) FILTER (WHERE l.role = 'assistant') AS assistant_text
       FROM t LEFT JOIN latest l ON l.conv_id = t.conv_id AND l.turn = t.turn GROUP BY ALL""",
)
def q_stage_history(spark, sf):
    """The latest earlier value of every stage visible to each step, by lineage.

    Turns are requests, roles their stages, the latest turn before is the
    parent.  Values travel as row references; the texts join at the end.
    """
    c = table(spark, sf, "conversations", "conv_id", "turn", "role", "text")
    up = previous_turns(c).checkpoint(eager=True)
    key = lambda t: F.concat_ws(":", "conv_id", t)
    steps = c.select("conv_id", "turn", "role").join(up, ["conv_id", "turn"])
    requests = steps.select(key("turn").alias("id"), F.when(F.col("prev_turn").isNotNull(), key("prev_turn")).alias("parent"), "role", F.col("turn").alias("value"))
    latest = RQ.lineage_latest(requests, "id", "parent", "role", "value")
    roles = ("system", "user", "assistant")
    out = up.join(latest.withColumnRenamed("id", "_id"), key("turn") == F.col("_id")).select(
        "conv_id", "turn", "prev_turn", *[F.col("latest")[r].alias(f"_{r}") for r in roles])
    for r in roles:
        said = c.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), F.col("text").alias(f"{r}_text"))
        out = out.join(said, (F.col("conv_id") == F.col("_c")) & (F.col(f"_{r}") == F.col("_t")), "left").drop("_c", "_t", f"_{r}")
    return out


CRAWL_RULE = {
    "tag": "web",
    "common": {"depth_limit": 2, "is_static": True, "external_def": ""},
    "filter": {"title_threshold": 0.05, "content_threshold": 0.1, "weight_dict": {"re": 0.5, "th": 0.3, "ble": 0.2}},
    "stages": [
        {"name": "list", "auto_parse_body": True, "remove_repeats": True,
         "parser": {"sections": {"type": "css-list", "css": "nav a", "next": "section"},
                    "items": {"type": "xpath-loop", "xpath": "//nav//li",
                              "child": {"first": {"type": "xpath", "xpath": "a", "next": "section"}}}}},
        {"name": "section", "body_parser": "//article//p//text()", "parser": {}},
    ],
}


LINEAGE_RULE = {
    "tag": "web",
    "common": {"depth_limit": 2, "external_def": '{"agent": "pagesift"}'},
    "filter": {"title_threshold": 0, "content_threshold": 0, "weight_dict": {}},
    "stages": [
        {"name": "list", "header": {}, "request": {}, "parser": {
            "title": {"type": "xpath", "xpath": "//title/text()"}, "sections": {"type": "css-list", "css": "nav a", "next": "section"}}},
        {"name": "section", "header": {"loop": {"view": ["full", "short"]}},
         "request": {"headers": {"Agent": "{{e.agent}}", "From": "{{list.parser.title}}"}, "cookies": {"view": "{{s.header.loop.view_item}}"}}},
    ],
}


@register(
    "crawl_requests",
    lambda: f"""WITH asked AS (SELECT DISTINCT page_id, {S.url_join_sql('l.url', 'l.href')} AS url FROM {_links_long_sql()} l WHERE next_stage = 'section'),
                told AS (SELECT DISTINCT asked.url, {S.decode_entities(f"regexp_extract(html, {S.q(H.TITLE_RE)}, 1)")} AS title
                         FROM asked JOIN pages USING (page_id))
                SELECT 0 AS depth, 'list' AS stage, url, 'GET' AS method, NULL AS agent, NULL AS source, NULL AS view, NULL AS error
                FROM (SELECT DISTINCT url FROM pages)
                UNION ALL
                SELECT 1, 'section', url, 'GET', 'pagesift', title, unnest(['full', 'short']), NULL FROM told""",
)
def q_crawl_requests(spark, sf):
    """Requests of a rule run from every page: loops, headers and cookies from the values of the page that led there."""
    from pagesift.plans.crawl import run_requests

    pages = table(spark, sf, "pages", "page_id", "url", "html")
    r = run_requests(spark, LINEAGE_RULE, pages, pages.select("url"))
    return r.select("depth", "stage", "url", "method", F.col("headers")["Agent"].alias("agent"), F.col("headers")["From"].alias("source"),
                    F.col("cookies")["view"].alias("view"), "error")


@register("crawl_run")
def q_crawl_run(spark, sf):
    """A stored rule run end to end from every page."""
    from pagesift.functions.stopwords import load_default_stopwords
    from pagesift.plans.crawl import run_rule
    from pagesift.plans.reg_text import RUN_TS

    pages = table(spark, sf, "pages", "page_id", "url", "html")
    return run_rule(spark, CRAWL_RULE, pages, pages.select("url"), RUN_TS, stopwords=load_default_stopwords(spark))
