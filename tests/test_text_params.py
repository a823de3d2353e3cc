from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from pagesift.functions import html as H
from pagesift.functions import text as T
from pagesift.functions.urls import url_join
from pagesift.operators import template as TP


def test_title_and_entities(spark):
    df = spark.createDataFrame(
        [("<html><title> A &amp; B </title></html>",), ("<title>   </title>",), ("<p>none</p>",)], "html string"
    )
    got = [r[0] for r in df.select(H.page_title("html")).collect()]
    assert got == [" A & B ", "Untitled", "Untitled"]


def test_collapse_and_severity(spark):
    df = spark.createDataFrame([("a \t\n b 　c",)], "s string")
    assert df.select(T.collapse_ws("s")).first()[0] == "a b c"
    lines = spark.createDataFrame([("error at column 0",), (" an error",), (" warning then error",), ("x Traceback",)], "l string")
    assert [r[0] for r in lines.select(T.log_severity("l")).collect()] == ["plain", "error", "error", "traceback"]


HREFS = ["", "/a/b", "c", "../d", "./e/../f", "?q=1", "#frag", "//other.org/x", "https://abs.example/y", "g/h/../..", "..", "/x/./y/"]
BASES = ["http://h.example.org/p/q?z=1#t", "https://h.example.org", "http://h.example.org/dir/"]


def test_url_join_matches_stdlib(spark):
    rows = [(b, h) for b in BASES for h in HREFS]
    df = spark.createDataFrame(rows, "base string, href string")
    got = [r[0] for r in df.select(url_join("base", "href")).collect()]
    assert got == [urljoin(b, h) for b, h in rows]


def test_legal_url(spark):
    df = spark.createDataFrame([("http://a.b/c",), ("ftp://x",), ("https://",)], "u string")
    assert [r[0] for r in df.select(T.legal_url("u")).collect()] == [True, False, False]


def test_loop_product_order_and_edges(spark):
    df = spark.createDataFrame([(1, ["a1", "a2"], ["b1", "b2", "b3"], [])], "id int, a array<string>, b array<string>, e array<string>")
    out = TP.loop_product(df, [("a", F.col("a")), ("b", F.col("b"))]).orderBy("loop_ord").collect()
    assert [(r["a_item"], r["b_item"]) for r in out] == [
        ("a1", "b1"), ("a2", "b1"), ("a1", "b2"), ("a2", "b2"), ("a1", "b3"), ("a2", "b3")]
    assert TP.loop_product(df, []).count() == 1
    assert TP.loop_product(df, [("a", F.col("a")), ("e", F.col("e"))]).count() == 0


def test_render_struct_and_errors(spark):
    df = spark.createDataFrame([(("x", [1, 2], "h"),)], "env struct<name:string, nums:array<int>, host:string>")
    et = df.schema["env"].dataType
    assert df.select(TP.render_struct("https://{{host}}/{{ name }}", F.col("env"), et)).first()[0] == "https://h/x"
    assert df.select(TP.render_struct("{{nums}}", F.col("env"), et)).first()[0] == [1, 2]
    with pytest.raises(TP.PieceTypeError):
        TP.render_struct("n={{nums}}", F.col("env"), et)
    with pytest.raises(TP.TemplateError):
        TP.render_struct("{{missing}}", F.col("env"), et)
    with pytest.raises(TP.TemplateError):
        TP.parse_template("{{__import__('os')}}")


def test_render_variant_demo(spark):
    js = '{"test": {"key3": {"key5": {"key6": ["a", "b", "v"]}}, "n": 2}}'
    df = spark.createDataFrame([(js,)], "j string").select(F.parse_json("j").alias("v"))
    v, e = TP.render_variant("{{test.key3.key5.key6[0]}}", F.col("v"))
    assert df.select(v, e).first() == ("a", None)
    v, e = TP.render_variant("n={{test.n}}", F.col("v"))
    assert df.select(v, e).first() == (None, "ConcatenateError: test.n")
    v, e = TP.render_variant("{{test.nope}}", F.col("v"))
    assert df.select(e).first()[0] == "ExpressionError: test.nope"
