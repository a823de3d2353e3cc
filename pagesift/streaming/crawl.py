"""Structured Streaming forms: pages arriving as files, scored and stored
incrementally; run events folded into the current task state.

The caller names the checkpoint location; a stream restarted with the same one
goes on where it stopped.  The registered queries drain a table anew at every
call, so they take a new folder each (``new_run_dir``).
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.functions.joins import spread
from pagesift.operators.relevance import REFERENCE_ANCHORS, row_similarity
from pagesift.plans.articles import article_sink, keep_where, text_form
from pagesift.session import ensure_checkpoint_dir

PAGE_SCHEMA = "page_id BIGINT, url STRING, html STRING"
EVENT_SCHEMA = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def _run_dir(spark: SparkSession, name: str) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), f"stream-{name}-{uuid.uuid4().hex[:12]}")


def read_stream(spark: SparkSession, folder: str, schema: str, glob: str | None = None,
                max_files: int | None = None) -> DataFrame:
    """Files arriving in ``folder`` (optionally only names matching ``glob``)."""
    r = spark.readStream.schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", str(max_files))
    return r.parquet(folder)


def read_pages_stream(spark: SparkSession, folder: str, glob: str | None = None, max_files: int | None = None) -> DataFrame:
    return read_stream(spark, folder, PAGE_SCHEMA, glob, max_files)


def read_table_stream(spark: SparkSession, sf_dir: str, name: str, schema: str) -> DataFrame:
    """A table of ``sf_dir`` as a stream, whether it is one file or a folder of files.

    A name filter sees the names of files only, never that of a folder, and a plain
    path must be a folder; a pattern, here one that only this name fits, may be both.
    """
    return read_stream(spark, os.path.join(sf_dir, f"{name}.parque[t]"), schema)


def stream_url_dedup(pages: DataFrame, watermark_col: str | None = None, delay: str | None = None) -> DataFrame:
    """Dedup by URL with all columns, for sinks in append mode; of equal URLs in one micro-batch any row may win.

    ``first_snapshots`` picks the row that the batch form picks.  Without a watermark
    the state keeps every URL ever seen; with ``watermark_col`` the state is bounded by
    ``dropDuplicatesWithinWatermark``.
    """
    if watermark_col:
        return pages.withWatermark(watermark_col, delay or "1 day").dropDuplicatesWithinWatermark(["url"])
    return pages.dropDuplicates(["url"])


def run_to_parquet(df: DataFrame, out: str, checkpoint: str, output_mode: str = "append") -> None:
    """Drain all available input once (``availableNow``) into a Parquet folder."""
    q = (
        df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .outputMode(output_mode).trigger(availableNow=True).start()
    )
    q.awaitTermination()


def first_snapshots(pages: DataFrame) -> DataFrame:
    """``url, page_id, file``: the first snapshot of every URL never seen before, as the batch form picks it.

    A streaming aggregate (run it in update mode) that keeps per URL the earliest
    arrival: micro-batch first, ``page_id`` next.  Only narrow columns move, folded
    in the map tasks before the shuffle, so a URL of a third of all rows sends a row
    per task.  A URL is new when all its rows came in the running micro-batch; the
    time of a micro-batch is kept in the stream's log, so a replay decides alike,
    and a clock that was set back makes no URL new again.  Rows without a URL are
    one page.  ``pages`` is a file stream; the state holds a row per URL for good.
    """
    rows = pages.select("url", F.current_timestamp().alias("at"), "page_id", F.col("_metadata.file_path").alias("file"))
    state = rows.groupBy("url").agg(F.min(F.struct("at", "page_id", "file")).alias("first"), F.max("at").alias("last"))
    now = F.current_timestamp()
    return state.where((F.col("first.at") == now) & (F.col("last") == now)).select("url", "first.page_id", "first.file")


def store_first_snapshots(spark: SparkSession, pages: DataFrame, form, out: str, checkpoint: str) -> None:
    """Drain ``pages`` and store ``form(rows)`` of the first snapshot of every URL under ``out``.

    A micro-batch writes one folder, overwritten when the batch is replayed after a
    lost executor or a killed driver; a later run with the same ``out`` and
    ``checkpoint`` goes on where the last one stopped.  So every URL is stored once.
    The pages are read again from the files that hold the batch's winners, by a
    semi-join; the list of files is no longer than the one the stream keeps itself.
    """

    def sink(batch: DataFrame, epoch_id: int) -> None:
        s = batch.sparkSession
        won = f"{checkpoint}-won/epoch={epoch_id}"
        batch.write.mode("overwrite").parquet(won)
        winners = s.read.schema("url STRING, page_id BIGINT, file STRING").parquet(won)
        files = [r["file"] for r in winners.select("file").distinct().collect()]
        rows = s.read.schema(PAGE_SCHEMA).parquet(*files) if files else s.createDataFrame([], PAGE_SCHEMA)
        w = winners.select(F.col("url").alias("_url"), F.col("page_id").alias("_page"))
        kept = rows.join(w, rows["url"].eqNullSafe(w["_url"]) & (rows["page_id"] == w["_page"]), "left_semi")
        form(kept).write.mode("overwrite").parquet(f"{out}/epoch={epoch_id}")

    q = (first_snapshots(pages).writeStream.outputMode("update").foreachBatch(sink)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def stream_articles(spark: SparkSession, pages: DataFrame, words: dict, threshold: float, tag: str, run_ts,
                    out: str, checkpoint: str, stopwords=(), anchors=REFERENCE_ANCHORS) -> None:
    """Score the first snapshot of every arriving URL and store the article rows that pass.

    Dedup is the only state; text and scores are projections of the stored rows.
    A URL counts as seen before the threshold, as in the batch form.
    """

    def form(rows: DataFrame) -> DataFrame:
        scored = text_form(spread(rows)).withColumn("sim", row_similarity(F.col("body"), words, anchors, stopwords))
        return article_sink(keep_where(scored, F.col("sim") >= F.lit(float(threshold))), tag, run_ts)

    store_first_snapshots(spark, pages, form, out, checkpoint)


def stream_run_status(events: DataFrame) -> DataFrame:
    """Current state per task from start ('signup') / end ('purchase') events (complete mode)."""
    e = events.where(F.col("event_type").isin("signup", "purchase"))
    start = F.col("event_type") == "signup"
    return e.groupBy(F.col("user_id").alias("task_id")).agg(
        F.max(F.when(start, F.col("ts"))).alias("last_start"),
        F.max_by(F.when(start, 1).otherwise(0), F.struct("ts", "event_id")).alias("is_running"),
    )


def run_status_to_table(spark: SparkSession, events: DataFrame, out: str, checkpoint: str) -> None:
    """Complete-mode aggregate; each batch overwrites the status table."""
    agg = stream_run_status(events)

    def sink(batch: DataFrame, epoch_id: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    q = agg.writeStream.outputMode("complete").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


new_run_dir = _run_dir
