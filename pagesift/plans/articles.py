"""Relevant, distinct articles from page snapshots (the flagship plan).

pages → url_dedup → text form (clean, strip, decode, collapse) → similarity
against a keyword profile → threshold → article rows.

Plan shape: one shuffle (the dedup, keyed by URL, partially aggregated
map-side so a hot URL collapses before it moves); text extraction, scoring
and sink shaping are narrow projections after it, in one codegen stage
apart from the higher-order fold of the scorer.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.functions.html import image_srcs, page_text, page_title
from pagesift.operators.relevance import REFERENCE_ANCHORS, profile_words, row_similarity

# Fixed value: the status written with every stored article ("unedited").
ARTICLE_STATUS = "未编辑"
TIME_FORMAT = "yy/MM/dd/HH/mm/ss"


def url_dedup(pages: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """One row per URL never seen before: the first snapshot (lowest ``page_id``).

    ``seen`` (a ``url`` column) is the persistent seen-set; the caller appends
    the returned URLs to it *before* any threshold, as the spider marks a URL
    seen even when it is then rejected.
    """
    if seen is not None:
        pages = pages.join(seen.select("url").distinct(), "url", "left_anti")
    # The winner per URL is found on the narrow (url, page_id) columns by a
    # hash aggregate (partial, map-side: a URL repeated in a third of all rows
    # collapses before it moves); the page rows are then kept by a semi-join,
    # so the html moves once (``min_by(html, …)`` would force a sort-based
    # aggregate over it).  Rows without a URL are one page.
    winners = pages.select("url", "page_id").groupBy("url").agg(F.min("page_id").alias("_page"))
    winners = winners.withColumnRenamed("url", "_url")
    same = pages["url"].eqNullSafe(winners["_url"]) & (pages["page_id"] == winners["_page"])
    return pages.join(winners, same, "left_semi").select("url", "page_id", "html")


def keep_where(df: DataFrame, cond) -> DataFrame:
    """``df.where(cond)`` evaluated *after* the projection that feeds it.

    A plain filter on a computed column is pushed below its projection, so
    the expensive columns (the page text) would be computed twice: once for
    the condition, once for the output.  A generator over the condition is
    not pushed down, so each row's text is built once.
    """
    keep = F.explode(F.when(cond, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>")))
    return df.select("*", keep.alias("_keep")).drop("_keep")


def text_form(pages: DataFrame) -> DataFrame:
    """``page_id, url, body, title, photos`` by regex extraction (no parser)."""
    return pages.select(
        "page_id",
        "url",
        page_text("html").alias("body"),
        page_title("html").alias("title"),
        image_srcs("html").alias("photos"),
    )


def article_sink(articles: DataFrame, tag: str, run_ts: dt.datetime) -> DataFrame:
    """Shape rows for the article table: five photo columns padded with nulls,
    a formatted run time and the fixed status; id and reserved left null."""
    photos = F.col("photos")
    return articles.select(
        F.lit(None).cast("bigint").alias("id"),
        "body",
        F.date_format(F.lit(run_ts), TIME_FORMAT).alias("created"),
        *[F.try_element_at(photos, F.lit(i)).alias(f"photo{i}") for i in range(1, 6)],
        "url",
        F.lit(ARTICLE_STATUS).alias("status"),
        F.lit(tag).alias("tag"),
        "title",
        F.lit(None).cast("string").alias("reserved"),
    )


def relevant_articles(
    spark: SparkSession,
    pages: DataFrame,
    profile: dict,
    threshold: float,
    tag: str,
    run_ts: dt.datetime,
    stopwords=(),
    seen: DataFrame | None = None,
    anchors=REFERENCE_ANCHORS,
) -> DataFrame:
    words = profile_words(spark, profile)
    fresh = url_dedup(pages.select("page_id", "url", "html"), seen)
    scored = text_form(fresh).withColumn("sim", row_similarity(F.col("body"), words, anchors, stopwords))
    passed = keep_where(scored, F.col("sim") >= F.lit(float(threshold)))
    return article_sink(passed, tag, run_ts)
