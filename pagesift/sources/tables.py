"""Table sources: page snapshots and the other driver tables.

Reads are plain Parquet scans; callers select columns so Catalyst prunes the
``ReadSchema`` and pushes filters into the scan.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return df.select(*columns) if columns else df


def page_scan(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Page snapshots ``(page_id, url, html)``; the stand-in for fetching."""
    if streaming:
        schema = "page_id BIGINT, url STRING, html STRING"
        return spark.readStream.schema(schema).parquet(path)
    return spark.read.parquet(path).select("page_id", "url", "html")


def fetch_join(frontier: DataFrame, pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Resolve frontier URLs to snapshots.

    Left join so that unfetched URLs stay visible (``page_id`` null); callers
    take ``fetched`` or ``~fetched`` for the inner / anti halves.  Both sides
    are shuffled on the URL: the frontier can be as big as the page table.
    """
    snap = pages.select(F.col("url").alias("_snap_url"), "page_id", "html")
    out = frontier.join(snap, frontier[url_col] == snap["_snap_url"], "left")
    return out.drop("_snap_url").withColumn("fetched", F.col("page_id").isNotNull())


def rule_lookup(rules: DataFrame, task_id, scheduled: bool) -> DataFrame:
    """The rule JSON of one task from the one-off or scheduled set (0 or 1 row)."""
    return rules.where((F.col("id") == F.lit(task_id)) & (F.col("scheduled") == F.lit(scheduled))).select(
        "id", "scheduled", "rule"
    )


def stopword_load(spark: SparkSession, path: str) -> DataFrame:
    """A text file, one word per line, as a distinct ``term`` column."""
    return spark.read.text(path).select(F.trim("value").alias("term")).where(F.col("term") != "").distinct()


def json_doc_load(spark: SparkSession, path: str, schema=None, multi_line: bool = True) -> DataFrame:
    """Load JSON documents: one per file spread over lines (``multi_line``) or one per line."""
    reader = spark.read.option("multiLine", "true" if multi_line else "false")
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(path)


def log_scan(spark: SparkSession, log_dir: str, entrance: str) -> DataFrame:
    """Lines of an entrance's latest log: files named ``<entrance>…_latest.log``."""
    return spark.read.text(f"{log_dir.rstrip('/')}/{entrance}*_latest.log").select(
        F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("line")
    )
