import os
import sys

from pagesift.plans import catalog
from pagesift.streaming import crawl as ST

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as E  # noqa: E402


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["id", "body", "created", "photo1", "photo2", "photo3", "photo4", "photo5", "url", "status", "tag", "title", "reserved"]


def test_oracle_keys_subset():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 80


def test_batch_equals_stream_dedup(spark):
    sf = "/root/testdata/sf0.001"
    batch = {r["url"] for r in catalog.queries()["url_dedup"](spark, sf).collect()}
    base = ST.new_run_dir(spark, "t")
    pages = ST.read_pages_stream(spark, sf, glob="pages.parquet")
    ST.run_to_parquet(ST.stream_url_dedup(pages).select("url"), f"{base}/o", f"{base}/c")
    assert {r["url"] for r in spark.read.parquet(f"{base}/o").collect()} == batch


def test_crawl_run_level0_equals_scored_articles(spark):
    sf = "/root/testdata/sf0.001"
    qs = catalog.queries()
    crawl = {r["url"]: (r["body"], r["title"]) for r in qs["crawl_run"](spark, sf).collect()}
    scored = {r["url"]: (r["body"], r["title"]) for r in qs["scored_articles"](spark, sf).collect()}
    assert crawl == scored
    assert len(crawl) > 0


def test_crawl_run_levels_and_depth_limit(spark):
    import datetime as dt

    from pagesift.plans.crawl import run_rule

    body = "<article><p>" + "re th ble words here and there " * 3 + "</p></article>"

    def page(i, links):
        nav = "".join(f"<li><a href='/p{j}'>re th</a></li>" for j in links)
        return (i, f"http://h.example/p{i}", f"<html><body><nav><ul>{nav}</ul></nav>{body}</body></html>")

    pages = spark.createDataFrame([page(1, [2, 3]), page(2, [4, 1]), page(3, []), page(4, [])], "page_id long, url string, html string")
    rule = {"tag": "t", "common": {"depth_limit": 1},
            "filter": {"title_threshold": 0.0, "content_threshold": 0.0, "weight_dict": {"re": 1.0}},
            "stages": [{"name": "a", "auto_parse_body": True, "parser": {"l": {"type": "css-list", "css": "nav a", "next": "a"}}}]}
    start = spark.createDataFrame([("http://h.example/p1",)], "url string")
    got = sorted(r["url"] for r in run_rule(spark, rule, pages, start, dt.datetime(2024, 1, 1)).collect())
    # depth limit 1: the start page (depth 0) emits links, its children (depth 1) do not
    assert got == ["http://h.example/p1", "http://h.example/p2", "http://h.example/p3"]
    rule["common"]["depth_limit"] = 2
    got = sorted(r["url"] for r in run_rule(spark, rule, pages, start, dt.datetime(2024, 1, 1)).collect())
    assert got == ["http://h.example/p1", "http://h.example/p2", "http://h.example/p3", "http://h.example/p4"]


PAGE = "page_id long, url string, html string"


def _arrive(spark, folder, name, rows):
    spark.createDataFrame(rows, PAGE).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def _stored(spark, out):
    return sorted(((r["url"] or "", r["page_id"]) for r in spark.read.parquet(out).collect()))


def test_stream_keeps_the_first_snapshot_and_resumes(spark):
    base = ST.new_run_dir(spark, "t")
    src, out, ckpt = f"{base}/in", f"{base}/out", f"{base}/ckpt"

    def drain():
        pages = spark.readStream.schema(ST.PAGE_SCHEMA).parquet(f"{src}/*")
        ST.store_first_snapshots(spark, pages, lambda rows: rows.select("url", "page_id", "html"), out, ckpt)

    # repeats inside a batch (the lowest page_id wins wherever it stands), a null and an empty url
    _arrive(spark, src, "a", [(7, "u", "7"), (3, "u", "3"), (9, "v", "9"), (4, None, "4"), (2, None, "2"), (5, "", None)])
    _arrive(spark, src, "b", [(1, "w", "1"), (8, "v", "8"), (6, "u", "6")])
    drain()
    first = [("", 2), ("", 5), ("u", 3), ("v", 8), ("w", 1)]
    assert _stored(spark, out) == first
    drain()  # nothing new
    assert _stored(spark, out) == first
    _arrive(spark, src, "c", [(0, "u", "0"), (11, "x", "11"), (10, "x", "10")])
    drain()  # a url that was stored stays as it is, whatever page_id comes later
    assert _stored(spark, out) == sorted([*first, ("x", 10)])
    assert {r["html"] for r in spark.read.parquet(out).where("url = 'x'").collect()} == {"10"}


def test_killed_stream_stores_each_url_once(spark):
    import pytest

    base = ST.new_run_dir(spark, "t")
    src, out, ckpt = f"{base}/in", f"{base}/out", f"{base}/ckpt"
    _arrive(spark, src, "a", [(1, "u", "1"), (2, "v", "2")])
    calls = []

    def drain(form):
        pages = spark.readStream.schema(ST.PAGE_SCHEMA).parquet(f"{src}/*")
        ST.store_first_snapshots(spark, pages, form, out, ckpt)

    def form(rows):
        return rows.select("url", "page_id")

    def dies_after_writing(rows):
        calls.append(1)
        form(rows).write.mode("overwrite").parquet(f"{out}/epoch=0")  # the rows land, the batch is never committed
        raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        drain(dies_after_writing)
    _arrive(spark, src, "b", [(0, "u", "0"), (3, "w", "3")])
    drain(form)  # the batch is replayed, then the new file is read
    assert calls == [1] and _stored(spark, out) == [("u", 1), ("v", 2), ("w", 3)]
    drain(form)
    assert _stored(spark, out) == [("u", 1), ("v", 2), ("w", 3)]


def test_stream_over_an_empty_table(spark):
    base = ST.new_run_dir(spark, "t")
    _arrive(spark, f"{base}/in", "a", [])
    pages = spark.readStream.schema(ST.PAGE_SCHEMA).parquet(f"{base}/in/*")
    ST.store_first_snapshots(spark, pages, lambda rows: rows.select("url", "page_id"), f"{base}/out", f"{base}/ckpt")
    assert spark.read.parquet(f"{base}/out").count() == 0
