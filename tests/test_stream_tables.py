"""Streams over tables that are folders of files."""

from pagesift.plans import catalog


def test_streams_read_tables_of_several_files(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i % 4}", f"<p>text {i}</p>") for i in range(9)], "page_id long, url string, html string")
    pages.repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    events = spark.sql("SELECT id AS event_id, timestamp_seconds(id) AS ts, id % 2 AS user_id, if(id < 2, 'signup', 'view') AS event_type,"
                       " 1D AS value, '{}' AS props FROM range(6)")
    events.repartition(2).write.parquet(f"{tmp_path}/events.parquet")
    q = catalog.queries()
    assert sorted(map(tuple, q["stream_url_dedup"](spark, str(tmp_path)).collect())) == [(f"http://h/{i}", i) for i in range(4)]
    assert q["stream_articles"](spark, str(tmp_path)).count() <= 4
    assert sorted((r["task_id"], r["is_running"]) for r in q["stream_run_status"](spark, str(tmp_path)).collect()) == [(0, 1), (1, 1)]
