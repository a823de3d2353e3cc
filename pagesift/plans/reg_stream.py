"""Registered queries: streaming forms, drained with ``availableNow`` (M7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagesift.functions.stopwords import load_default_stopwords
from pagesift.operators.relevance import profile_words
from pagesift.plans.catalog import register
from pagesift.plans.reg_text import PROFILE, RUN_TS, TAG, THRESHOLD, _flagship_sql
from pagesift.streaming import crawl as ST
from pagesift.streaming.crawl import EVENT_SCHEMA, PAGE_SCHEMA


@register("stream_url_dedup", "SELECT url, min(page_id) AS page_id FROM pages GROUP BY url")
def q_stream_url_dedup(spark, sf):
    """The snapshots that a stream over the page files stores: the first of every URL."""
    base = ST.new_run_dir(spark, "dedup")
    pages = ST.read_table_stream(spark, sf, "pages", PAGE_SCHEMA)
    ST.store_first_snapshots(spark, pages, lambda rows: rows.select("url", "page_id"), f"{base}/out", f"{base}/ckpt")
    return spark.read.parquet(f"{base}/out").drop("epoch")


@register("stream_articles", _flagship_sql)
def q_stream_articles(spark, sf):
    base = ST.new_run_dir(spark, "articles")
    pages = ST.read_table_stream(spark, sf, "pages", PAGE_SCHEMA)
    words = profile_words(spark, PROFILE)
    ST.stream_articles(spark, pages, words, THRESHOLD, TAG, RUN_TS, f"{base}/out", f"{base}/ckpt",
                       stopwords=load_default_stopwords(spark))
    return spark.read.parquet(f"{base}/out").drop("epoch")


@register(
    "stream_run_status",
    """SELECT user_id AS task_id, max(ts) FILTER (WHERE event_type = 'signup') AS last_start,
              arg_max(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END, ts) AS is_running
       FROM events WHERE event_type IN ('signup', 'purchase') GROUP BY user_id""",
)
def q_stream_run_status(spark, sf):
    base = ST.new_run_dir(spark, "status")
    events = ST.read_table_stream(spark, sf, "events", EVENT_SCHEMA)
    ST.run_status_to_table(spark, events, f"{base}/out", f"{base}/ckpt")
    return spark.read.parquet(f"{base}/out").select("task_id", "last_start", F.col("is_running"))
