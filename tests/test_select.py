import pytest
from pyspark.sql import functions as F

from pagesift.operators import article as A
from pagesift.operators import dom as D
from pagesift.operators import select as SL

HTML = ("<html><head><title>T &amp; U</title></head><body>"
        "<nav><ul><li><a href='/a' class='x y'>Alpha</a></li><li><a href='/b'>Beta</a></li></ul></nav>"
        "<article><h1 id='h'>Head</h1><p>one <b>two</b></p><p>three</p></article></body></html>")


@pytest.fixture(scope="module")
def ctx(spark):
    pages = spark.createDataFrame([(1, HTML)], "page_id long, html string")
    nodes = A.cut(D.html_nodes(pages))
    return nodes, SL.document_ctx(pages)


def vals(df):
    return [r["value"] for r in df.orderBy("ord").collect()]


def test_compile_rejects_unsupported():
    with pytest.raises(SL.SelectorError):
        SL.compile_xpath("//a[position()>1]")
    with pytest.raises(SL.SelectorError):
        SL.compile_css("a:hover")


def test_xpath_text_attr_position(spark, ctx):
    nodes, c = ctx
    assert vals(SL.field_values(nodes, c, "xpath", "//title/text()", True)) == ["T & U"]
    assert vals(SL.field_values(nodes, c, "xpath-list", "//nav//a/@href", False)) == ["/a", "/b"]
    assert vals(SL.field_values(nodes, c, "xpath", "//li[2]/a/text()", True)) == ["Beta"]
    assert vals(SL.field_values(nodes, c, "xpath-list", "//a[contains(@class,'y')]/@href", False)) == ["/a"]


def test_css_and_serialisation(spark, ctx):
    nodes, c = ctx
    assert vals(SL.field_values(nodes, c, "css", "article > p", True)) == ["<p>one <b>two</b></p>"]
    assert vals(SL.field_values(nodes, c, "css-list", "a.x::attr(href)", False)) == ["/a"]
    assert vals(SL.field_values(nodes, c, "css", "#h::text", True)) == ["Head"]


def test_scope_loop_relative(spark, ctx):
    nodes, c = ctx
    scopes = SL.scope_loop(nodes, c, "xpath-loop", "//li")
    got = sorted(r["value"] for r in SL.field_values(nodes, scopes, "xpath", "a/@href", True).collect())
    assert got == ["/a", "/b"]


def test_value_loop_empty_list_runs_once(spark, ctx):
    _, c = ctx
    out = SL.value_loop(c, F.array().cast("array<string>")).collect()
    assert len(out) == 1 and out[0]["item"] is None


def test_link_follow_and_body(spark, ctx):
    nodes, c = ctx
    passes = F.col("text") == "Beta"
    assert vals(SL.link_follow(nodes, c, "css-list", "nav a", passes, first_only=False)) == ["/b"]
    assert vals(SL.link_follow(nodes, c, "css", "nav a", passes, first_only=True)) == []
    fb = vals(SL.link_follow(nodes, c, "css-list", "nav a", F.lit(False), first_only=False, fallback_all=True))
    assert fb == ['<a href="/a" class="x y">Alpha</a>', '<a href="/b">Beta</a>']
    pages = c.select("page_id")
    body = SL.body_select(nodes, pages, False, "//article//p//text()").first()["body"]
    assert body == "one\ntwo\nthree"
    assert SL.body_select(nodes, pages, True, None).first()["body"] == ""
    assert SL.body_select(nodes, pages, False, "").count() == 0


def test_charset_decode(spark):
    from pagesift.operators import charset as CS

    gbk = '<meta charset="gb2312"><p>招生简章</p>'.encode("gb2312")
    df = spark.createDataFrame([(1, gbk), (2, "<p>plain</p>".encode())], "page_id long, content binary")
    got = {r["page_id"]: (r["charset"], r["html"]) for r in CS.html_decode(df, "content").collect()}
    assert got[1] == ("gb2312", '<meta charset="gb2312"><p>招生简章</p>')
    assert got[2] == ("utf-8", "<p>plain</p>")


def test_css_in_scope_matches_self(spark, ctx):
    nodes, c = ctx
    scopes = SL.scope_loop(nodes, c, "css-loop", "li")
    got = SL.field_values(nodes, scopes, "css", "li a::attr(href)", True).count()
    assert got == 2
