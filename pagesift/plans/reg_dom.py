"""Registered queries: node table, main-text scoring, scored article flow (M4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagesift.functions.stopwords import load_default_stopwords
from pagesift.operators import article as A
from pagesift.operators import dom as D
from pagesift.plans.articles import article_sink, url_dedup
from pagesift.plans.catalog import register
from pagesift.plans.reg_text import PROFILE, RUN_TS, TAG, THRESHOLD
from pagesift.operators.relevance import profile_words, row_similarity
from pagesift.sources.tables import table

KEY = ["page_id", "node_id"]


def _nodes(spark, sf):
    return A.cut(D.html_nodes(table(spark, sf, "pages", "page_id", "html")))


def _prepared(spark, sf):
    return A.div_to_paragraph(A.cut(A.clean_and_filter(_pages(spark, sf))))


def _flat(nodes):
    return nodes.select(
        "page_id", "node_id", "parent_id", "tag", "class", "id", F.to_json("attrs").alias("attrs"),
        "start", "end", "depth", "sib_ord", "kind", "text", F.array_join(F.transform("path", lambda x: x.cast("string")), ".").alias("path"),
    )


@register("html_nodes")
def q_html_nodes(spark, sf):
    return _flat(_nodes(spark, sf))


def _pages(spark, sf):
    return D.html_nodes(table(spark, sf, "pages", "page_id", "html"))


@register("node_text")
def q_node_text(spark, sf):
    """Collapsed subtree text of every element."""
    return A.node_texts(A.page_trees(_pages(spark, sf), A.cleaning_root(), paragraphs=False))


@register("link_density")
def q_link_density(spark, sf):
    """Link density of every element (in [0, 1] when anchors do not nest)."""
    return A.link_density(A.page_trees(_pages(spark, sf), A.cleaning_root(), paragraphs=False))


@register("boilerplate_filter")
def q_boilerplate_filter(spark, sf):
    return _flat(A.boilerplate_filter(D.html_clean_nodes(_pages(spark, sf))))


@register("div_to_paragraph")
def q_div_to_paragraph(spark, sf):
    return _flat(_prepared(spark, sf))


@register("paragraph_score")
def q_paragraph_score(spark, sf):
    return A.paragraph_score(A.main_trees(_pages(spark, sf))).select(*KEY, F.round("score", 6).alias("score"))


@register("top_paragraph")
def q_top_paragraph(spark, sf):
    return A.top_paragraph(A.main_trees(_pages(spark, sf))).select(*KEY, F.round("score", 6).alias("score"))


@register("article_expand")
def q_article_expand(spark, sf):
    return A.article_expand(A.main_trees(_pages(spark, sf)))


@register("article_text")
def q_article_text(spark, sf):
    return A.article_text(_pages(spark, sf))


def scored_articles(spark, pages, profile, threshold, tag, run_ts, stopwords=()):
    """Dedup by URL, main text by paragraph scoring, similarity, threshold, sink rows."""
    fresh = A.cut(url_dedup(pages.select("page_id", "url", "html")))
    bodies = A.article_text(D.html_nodes(fresh.select("page_id", "html")))
    words = profile_words(spark, profile)
    scored = bodies.withColumn("sim", row_similarity(F.col("body"), words, stopwords=stopwords))
    passed = scored.where(F.col("sim") >= F.lit(float(threshold)))
    from pagesift.functions.html import image_srcs, page_title

    meta = fresh.select("page_id", "url", page_title("html").alias("title"), image_srcs("html").alias("photos"))
    return article_sink(passed.join(meta, "page_id"), tag, run_ts)


@register("scored_articles")
def q_scored_articles(spark, sf):
    pages = table(spark, sf, "pages", "page_id", "url", "html")
    return scored_articles(spark, pages, PROFILE, THRESHOLD, TAG, RUN_TS, load_default_stopwords(spark))
