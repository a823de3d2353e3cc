import itertools
import json
import random

from pyspark.sql import functions as F

from pagesift.operators import requests as R


def rendered(spark, template, env):
    df = spark.createDataFrame([(template, json.dumps(env))], "t string, e string").withColumn("v", F.parse_json("e"))
    return tuple(df.select(R.render_rows(F.col("t"), F.col("v")).alias("r")).select("r.*").first())


def test_templates_differ_per_row(spark):
    env = {"a": {"b": ["x", 2, {"c": "ü"}]}, "n": 3, "nothing": None, "host": "h"}
    cases = [
        ("plain", ("plain", True, None)), ("", ("", True, None)), (None, (None, True, None)),
        ("https://{{host}}/{{ a.b[2].c }}?", ("https://h/ü?", True, None)), ("{{host}}{{a.b[0]}}", ("hx", True, None)),
        ("{{a.b}}", ('["x",2,{"c":"ü"}]', False, None)), ("{{n}}", ("3", False, None)), ("{{nothing}}", ("null", False, None)),
        ("n={{n}}", (None, True, "ConcatenateError: n")), ("{{a.b[9]}}", (None, True, "ExpressionError: a.b[9]")),
        ("{{host}}{{no.where}}", (None, True, "ExpressionError: no.where")), ("{{1+1}}", (None, True, "ExpressionError: 1+1")),
    ]
    df = spark.createDataFrame([(i, t, json.dumps(env)) for i, (t, _) in enumerate(cases)], "i int, t string, e string")
    got = df.select("i", R.render_rows(F.col("t"), F.parse_json("e")).alias("r")).select("i", "r.*").orderBy("i").collect()
    for row, (t, want) in zip(got, cases):
        assert (row.value, row.error) == (want[0], want[2]), t
        if want[2] is None:
            assert row.is_text == want[1], t


STAGES = [
    {"name": "list", "header": {"external": ["sites"], "loop": {"word": "{{e.words}}", "n": ["1", "2", "3"]}},
     "request": {"url": "https://{{sites.main}}/{{s.header.loop.word_item}}/{{s.header.loop.n_item}}", "method": "POST",
                 "headers": {"Agent": "{{s.agent}}"}, "cookies": {"c": "{{e.token}}"}}, "agent": "bot"},
    {"name": "page", "header": {}, "request": {"headers": {"From": "{{list.parser.title}}", "By": "{{list.header.loop.word_item}}"}}},
    {"name": "none", "header": {"loop": {"x": "{{e.empty}}"}}, "request": {"url": "u"}},
    {"name": "letters", "header": {"loop": {"x": "{{e.token}}"}}, "request": {"url": "{{s.header.loop.x_item}}"}},
    {"name": "list", "request": {"url": "never"}},
]
EXTERNAL = json.dumps({"sites": {"main": "m.example"}, "words": ["a", "b"], "token": 't"1', "empty": []})


def test_requests_of_a_stage(spark):
    stages = R.stage_rows(spark, STAGES, EXTERNAL)
    start = spark.createDataFrame([(s, None, None, 7) for s in ("list", "none", "letters", "else", "page")], "stage string, default_url string, history map<string,string>, other int")
    got = R.build_requests(start, stages).orderBy("stage", "loop_ord").collect()
    own = [r for r in got if r.stage == "list"]
    assert [r.url for r in own] == [f"https://m.example/{w}/{n}" for n in "123" for w in "ab"]
    assert {(r.method, r.headers["Agent"], r.cookies["c"], r.error, r.other) for r in own} == {("POST", "bot", 't"1', None, 7)}
    assert [r.url for r in got if r.stage == "letters"] == ["t", '"', "1"]
    assert not [r for r in got if r.stage == "none"]
    assert [(r.url, r.error) for r in got if r.stage == "else"] == [(None, "unknown stage: else")]
    assert [r.error for r in got if r.stage == "page"] == ["ExpressionError: list.header.loop.word_item"]
    env = json.loads(own[0].env)
    assert env["s"]["header"]["loop"] == {"word": "{{e.words}}", "n": ["1", "2", "3"], "word_item": "a", "n_item": "1"}
    assert env["e"]["token"] == 't"1' and env["sites"] == {"main": "m.example"}


def test_history_travels_with_the_rows(spark):
    stages = R.stage_rows(spark, STAGES, EXTERNAL)
    start = spark.createDataFrame([("list", None, None)], "stage string, default_url string, history map<string,string>")
    first = R.build_requests(start, stages).withColumn("parser", F.to_json(F.struct(F.concat(F.lit("T"), "loop_ord").alias("title"))))
    onward = R.with_history(first, "parser").select(F.lit("page").alias("stage"), F.lit("http://d/{{s.name}}").alias("default_url"), "history")
    got = R.build_requests(onward, stages)
    rows = sorted((r.headers["From"], r.headers["By"], r.url, r.error) for r in got.collect())
    assert rows == [(f"T{i}", "ab"[i % 2], "http://d/page", None) for i in range(6)]
    again = R.with_history(got.withColumn("parser", F.lit('{"x":1}')), "parser").first()
    assert set(again.history) == {"list", "page"} and json.loads(again.history["page"])["parser"] == {"x": 1}


def test_lineage_by_pointer_jumping(spark):
    rnd = random.Random(5)
    rows = [(0, None, "list", "v0"), (1, 99999, "detail", "orphan")]
    for i in range(2, 400):
        parent = rnd.choice([0, 1, i - 1, i - 1, i - 1, rnd.randrange(i), None])
        rows.append((i, parent if parent != i else None, rnd.choice(["list", "section", "detail"]), rnd.choice([f"v{i}", None])))
    by_id = {r[0]: r for r in rows}
    want = {}
    for i, up, _, _ in rows:
        latest = {}
        while up in by_id:
            _, nxt, stage, value = by_id[up]
            latest.setdefault(stage, value)
            up = nxt
        want[i] = latest
    df = spark.createDataFrame(rows, "id long, parent long, stage string, value string")
    got = {r.id: r.latest for r in R.lineage_latest(df, "id", "parent", "stage", "value").collect()}
    assert got == want
    assert max(map(len, want.values())) == 3
    empty = R.lineage_latest(df.limit(0), "id", "parent", "stage", "value")
    assert empty.count() == 0 and list(itertools.chain(empty.columns)) == ["id", "latest"]


def site(spark):
    def page(i, links, title):
        nav = "".join(f"<li><a href='/p{j}'>go</a></li>" for j in links)
        return (i, f"http://h.example/p{i}", f"<html><head><title>{title}</title></head><body><nav>{nav}</nav><h1>H{i}</h1></body></html>")

    rows = [page(1, [2, 3], "one &amp; \"1\""), page(2, [4, 2], "two"), page(3, [4], "three"), page(4, [], "four")]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


LINKS = {"type": "css-list", "css": "nav a"}
RULE = {
    "tag": "t", "common": {"depth_limit": 3, "external_def": json.dumps({"host": "h.example", "start": ["p1", "p9"]})},
    "filter": {"title_threshold": 0, "content_threshold": 0, "weight_dict": {"re": 1.0}},
    "stages": [
        {"name": "list", "header": {"loop": {"p": "{{e.start}}"}}, "request": {"url": "http://{{e.host}}/{{s.header.loop.p_item}}", "method": "PUT"},
         "parser": {"title": {"type": "xpath", "xpath": "//title/text()"}, "heads": {"type": "css-list", "css": "h1"}, "l": {**LINKS, "next": "section"}}},
        {"name": "section", "request": {"headers": {"From": "{{list.parser.title}}"}, "cookies": {"h": "{{list.header.loop.p_item}}"}},
         "parser": {"l": {**LINKS, "next": "detail"}}},
        {"name": "detail", "request": {"headers": {"From": "{{list.parser.title}}", "Host": "{{e.host}}"}}, "body_parser": "//h1/text()"},
    ],
}


def test_a_run_carries_environments_through_three_stages(spark):
    from pagesift.plans.crawl import run_requests, run_rule

    got = run_requests(spark, RULE, site(spark)).collect()
    seen = sorted((r.depth, r.stage, r.url[-2:], r.method, tuple(sorted(r.headers.items())), tuple(r.cookies.items()), r.error) for r in got)
    one = 'one & "1"'
    assert seen == [
        (0, "list", "p1", "PUT", (), (), None), (0, "list", "p9", "PUT", (), (), None),
        (1, "section", "p2", "GET", (("From", one),), (("h", "p1"),), None), (1, "section", "p3", "GET", (("From", one),), (("h", "p1"),), None),
        (2, "detail", "p2", "GET", (("From", one), ("Host", "h.example")), (), None),
        (2, "detail", "p4", "GET", (("From", one), ("Host", "h.example")), (), None),
    ]
    deep = next(r for r in got if r.url.endswith("p4"))
    assert json.loads(deep.history["list"])["parser"] == {"title": one, "heads": ["<h1>H1</h1>"], "l": ['<a href="/p2">go</a>', '<a href="/p3">go</a>']}
    assert set(deep.history) == {"list", "section"}
    import datetime as dt

    articles = run_rule(spark, RULE, site(spark), None, dt.datetime(2024, 1, 1)).collect()
    assert sorted((r["url"][-2:], r["body"]) for r in articles) == [("p2", "H2"), ("p4", "H4")]


def test_a_request_that_fails_to_render_leads_nowhere(spark):
    from pagesift.plans.crawl import run_requests

    broken = json.loads(json.dumps(RULE))
    broken["stages"][1]["request"]["headers"]["From"] = "{{list.parser.subtitle}}"
    got = run_requests(spark, broken, site(spark)).collect()
    assert sorted((r.depth, r.url, r.error) for r in got if r.depth)[0] == (1, None, "ExpressionError: list.parser.subtitle")
    assert max(r.depth for r in got) == 1


def test_previous_turns_over_gaps_and_buckets(spark):
    from pagesift.plans.reg_frontier import previous_turns

    rnd = random.Random(3)
    turns = {c: sorted(rnd.sample(range(-50, 500), n)) for c, n in ((1, 200), (2, 1), (3, 2), (4, 30))}
    df = spark.createDataFrame([(c, t) for c, ts in turns.items() for t in ts], "conv_id long, turn long")
    got = {(r.conv_id, r.turn): r.prev_turn for r in previous_turns(df).collect()}
    assert got == {(c, t): p for c, ts in turns.items() for t, p in zip(ts, [None, *ts])}
