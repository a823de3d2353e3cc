"""Rules at the edges: decoding, predicate order, ties, missing URLs, repeat runs."""

import datetime as dt
import html

from pyspark.sql import functions as F

from pagesift.functions.text import decode_entities
from pagesift.operators import article as A
from pagesift.operators import charset as CS
from pagesift.operators import config as C
from pagesift.operators import dom as D
from pagesift.operators import frontier as FR
from pagesift.operators import select as SL
from pagesift.plans.articles import url_dedup
from pagesift.plans.crawl import run_rule
from pagesift.plans import catalog


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x"))).first()[0]


def test_references(spark):
    text = "a &amp;lt; &#65;&#x1F600; &eacute;&nbsp;&copy;2024 &unknown; &amp x &#0; &#xD800; & &Omega;&apos;"
    want = "a &lt; A\U0001F600 é\xa0©2024 &unknown; &amp x \ufffd \ufffd & Ω'"
    assert one(spark, text, decode_entities) == want
    for t in ("", "no reference", "&", "&;", "&&amp;&", "x&#9;y"):
        assert one(spark, t, decode_entities) == html.unescape(t)


def test_bad_bytes_are_replaced(spark):
    rows = [(1, b"<p>\xc3\xa9\xff</p>"), (2, '<meta charset="gb2312"><p>研究'.encode("gb2312")), (3, b'<meta charset="no-such"><p>a\xfe'), (4, None)]
    df = CS.html_decode(spark.createDataFrame(rows, "page_id long, content binary"), "content")
    got = {r.page_id: (r.charset, r.html) for r in df.collect()}
    assert got[1] == ("utf-8", "<p>é\ufffd</p>")
    assert got[2] == ("gb2312", '<meta charset="gb2312"><p>研究')
    assert got[3] == ("utf-8", '<meta charset="no-such"><p>a\ufffd')
    assert got[4][1] is None


def test_predicates_hold_in_order(spark):
    page = "<ul><li class='y'>1</li><li class='x'>2</li><li class='x'>3</li></ul><script>var s</script><link href='/f'>"
    pages = spark.createDataFrame([(1, page)], "page_id long, html string")
    nodes, ctx = A.cut(D.html_nodes(pages)), SL.document_ctx(pages)
    vals = lambda e: [r["value"] for r in SL.field_values(nodes, ctx, "xpath", e, False).orderBy("ord").collect()]
    assert vals("//li[2][@class='x']/text()") == ["2"]
    assert vals("//li[@class='x'][2]/text()") == ["3"]
    assert vals("//li[1][@class='x']/text()") == []
    assert vals("//link/@href") == ["/f"] and vals("//script/text()") == ["var s"]


def test_every_match_of_a_scope_is_read(spark):
    page = "<nav><a href='/1'>a</a></nav><p><a href='/no'>b</a></p><nav><a href='/2'>c</a></nav>"
    pages = spark.createDataFrame([(1, "http://h/", page)], "page_id long, url string, html string")
    rows = FR.links_by_stage(pages, [("f", "(?is)<nav[^>]*>.*?</nav>", "s")]).orderBy("pos").collect()
    assert [(r.pos, r.href) for r in rows] == [(0, "/1"), (1, "/2")]


def test_rows_without_a_url_are_one_page(spark):
    pages = spark.createDataFrame([(3, None, "c"), (1, "u", "a"), (2, None, "b"), (4, "u", "d")], "page_id long, url string, html string")
    assert {(r.url, r.page_id) for r in url_dedup(pages).collect()} == {("u", 1), (None, 2)}


def test_repeated_parser_rows_keep_their_groups_apart(spark):
    rows = [(g, i, "s.parser", "a", "xpath-loop", "//x", None) for g in (1, 2) for i in range(3)]
    rows += [(1, 9, "s.parser.a", "b", "css", "p", "n"), (2, 9, "s.parser.b", "c", "css", "p", "n")]
    df = spark.createDataFrame(rows, "rule long, ord int, loc string, name string, type string, value string, next string")
    got = {(r.rule, r.path) for r in C.parser_tree(df.repartition(5), ["rule"]).collect()}
    assert got == {(1, "s.parser.a"), (2, "s.parser.a"), (1, "s.parser.a.b")}


def test_equal_times_take_the_last_event(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(i, t, 7, kind, 1.0, "{}") for i, kind in enumerate(["signup", "view", "purchase"])]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    qs = catalog.queries()
    assert [r.value for r in qs["config_latest"](spark, str(tmp_path)).collect()] == ["purchase"]
    assert [r.is_running for r in qs["run_log_latest"](spark, str(tmp_path)).collect()] == [0]


PAGE = "<article><p>re th words that are here and there in this page.</p></article>"


def crawl_pages(spark):
    rows = [(1, "http://h.example/1", f"<html><body><nav><a href='/2'>re</a></nav><aside><a href='/2'>re</a></aside>{PAGE}</body></html>"),
            (2, "http://h.example/2", f"<html><body><nav><a href='/3'>re</a></nav>{PAGE}</body></html>"),
            (3, "http://h.example/3", f"<html><body>{PAGE}</body></html>")]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def rule(**stages):
    return {"tag": "t", "common": {"depth_limit": 3}, "filter": {"title_threshold": 0.0, "content_threshold": 0.0, "weight_dict": {"re": 1.0}},
            "stages": [{"name": k, **v} for k, v in stages.items()]}


def urls(df):
    return sorted(r["url"][-1] for r in df.collect())


def test_a_seen_page_is_not_stored_but_followed(spark):
    r = rule(a={"auto_parse_body": True, "parser": {"l": {"type": "css-list", "css": "nav a", "next": "a"}}})
    start = spark.createDataFrame([("http://h.example/1",)], "url string")
    seen = spark.createDataFrame([("http://h.example/1",)], "url string")
    assert urls(run_rule(spark, r, crawl_pages(spark), start, dt.datetime(2024, 1, 1), seen=seen)) == ["2", "3"]


def test_one_url_under_two_stages_is_followed_under_both(spark):
    r = rule(a={"auto_parse_body": True, "parser": {"l": {"type": "css-list", "css": "nav a", "next": "b"}, "m": {"type": "css-list", "css": "aside a", "next": "c"}}},
             b={"auto_parse_body": True, "parser": {}},
             c={"auto_parse_body": True, "parser": {"l": {"type": "css-list", "css": "nav a", "next": "b"}}})
    start = spark.createDataFrame([("http://h.example/1",)], "url string")
    assert urls(run_rule(spark, r, crawl_pages(spark), start, dt.datetime(2024, 1, 1))) == ["1", "2", "3"]


def test_a_body_parser_without_hits_falls_back_to_the_main_text(spark):
    r = rule(a={"body_parser": "//no-such//text()", "parser": {}})
    start = spark.createDataFrame([("http://h.example/3",)], "url string")
    got = run_rule(spark, r, crawl_pages(spark), start, dt.datetime(2024, 1, 1)).collect()
    assert [x["body"] for x in got] == ["re th words that are here and there in this page."]


def test_no_stop_word_file_is_needed():
    from pagesift.functions.stopwords import default_stopwords

    words = default_stopwords()
    assert {"the", "und", "les", "los"} <= set(words) and words == sorted(set(words))


def test_queries_run_from_another_folder(tmp_path):
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        f"import sys; sys.path.insert(0, {root!r})\n"
        "import __spark_entry__ as e\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '4').getOrCreate()\n"
        "print('ROWS', e.queries()['html_nodes'](s, '/root/testdata/sf0.001').count())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in out.stdout, out.stderr[-800:]
