import datetime as dt
import json

from pyspark.sql import functions as F

from pagesift.operators import config as C
from pagesift.operators import frontier as FR
from pagesift.plans.articles import url_dedup


def _rows(spark, rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "rule int, ord int, loc string, name string, type string, value string, next string")


def test_parser_tree_first_wins_and_reach(spark):
    rows = [
        ("s.parser", "a", "xpath-loop", "//li", None),
        ("s.parser", "a", "xpath", "//dup", "x"),  # duplicate name: first wins
        ("s.parser.a", "b", "xpath", "./b", "detail"),
        ("s.parser", "c", "css", "p", None),
        ("s.parser.c", "d", "css", "q", None),  # under a leaf: never reached
        ("other", "e", "css", "r", None),  # outside the root
    ]
    t = {r["path"]: r for r in C.parser_tree(_rows(spark, rows), ["rule"]).collect()}
    assert set(t) == {"s.parser.a", "s.parser.a.b", "s.parser.c"}
    assert t["s.parser.a"]["type"] == "xpath-loop" and t["s.parser.a"]["xpath"] == "//li"
    assert t["s.parser.a"]["next"] is None and t["s.parser.a.b"]["next"] == "detail"
    assert t["s.parser.c"]["css"] == "p"


def test_tree_in_the_row_equals_the_join_form(spark):
    import random

    draw = random.Random(5)
    rows = []
    for rule in range(200):
        for ord_ in range(draw.randrange(0, 14)):
            loc = draw.choice(["s.parser", "s.parser.a", "s.parser.a.b", "s.parser.a.b.a", "s.parser.b", "s.parserx", "other", None])
            rows.append((rule, ord_, loc, draw.choice(["a", "b", "c", None]), draw.choice(["loop", "xpath-loop", "css", "xpath-list", "odd"]),
                         draw.choice(["v", "", None]), draw.choice(["n", None])))
    df = spark.createDataFrame(rows, "rule int, ord int, loc string, name string, type string, value string, next string")
    packed = df.groupBy("rule").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.struct("loc", "name", "type", "value", "next").alias("r")))),
                                                lambda x: x["r"]).alias("rows"))
    inline = packed.select("rule", F.inline(C.tree_in_row(F.col("rows"))))
    joined = C.parser_tree(df, ["rule"])
    assert inline.columns == joined.columns
    key = lambda r: tuple((x is None, str(x)) for x in r)
    got, want = sorted(map(tuple, inline.collect()), key=key), sorted(map(tuple, joined.collect()), key=key)
    assert got == want and len(got) > 60
    edge = spark.createDataFrame([([],), (None,)], f"rows {C.PARSER_ROWS}")
    assert [r[0] for r in edge.select(C.tree_in_row(F.col("rows"))).collect()] == [[], None]


def test_fields_of_a_compiled_tree(spark):
    leaf = {"type": "css", "css": "p"}
    deep = leaf
    for i in range(40):
        deep = {"type": "loop", "loop": "x", "child": {f"d{i}": deep, "twin": leaf}}
    parsers = {
        0: {"a": leaf},
        1: {"a": {"type": "css-loop", "css": "li"}},  # a loop without child
        2: {"a": {"type": "xpath-loop", "child": []}},  # no expression, child of a wrong type
        3: {"a": {"type": "odd", "css": 1}, "b": None, "c": "text", "d": {"css": "p"}, "e": {"type": 3}},
        4: {"top": deep},  # forty levels, all clean
        5: {"a": {"type": "loop", "loop": "x", "child": {"b": {"type": "xpath", "css": "p"}, "c": {"type": "css", "css": ""}}}},
        6: [{"loc": "s.parser", "name": "a", "type": "loop", "value": "x", "next": None},
            {"loc": "s.parser.a", "name": "b", "type": "css", "value": None, "next": None}],
        7: {}, 8: [], 9: "text", 10: None,
    }
    df = spark.createDataFrame([(i, json.dumps(p)) for i, p in parsers.items()], "id int, p string").withColumn("p", F.parse_json("p"))
    got = {}
    for r in df.select("id", F.inline(C.parser_issue_array(F.col("p")))).collect():
        got.setdefault(r["id"], set()).add((r["path"], r["severity"], r["message"], r["counted"]))
    assert got == {
        1: {("s.parser.a", "warning", "parser-a.child lose", True)},
        2: {("s.parser.a", "error", "Necessary part parser-a.xpath lose", True), ("s.parser.a", "error", "parser-a.child type error", True)},
        3: {("s.parser.a", "warning", "Unknown parser type 'odd'", False), ("s.parser.b", "error", "Necessary part parser-b lose", True),
            ("s.parser.c", "error", "parser-c type error", True), ("s.parser.d", "error", "Necessary part parser-d.type lose", True),
            ("s.parser.e", "error", "parser-e.type type error", True)},
        5: {("s.parser.a.b", "error", "Necessary part parser-b.xpath lose", True)},
        6: {("s.parser.a.b", "error", "Necessary part parser-b.css lose", True)},
    }
    assert df.where("id = 4").select(F.size(C.tree_fields(F.col("p")))).first()[0] == 81


def test_verdict_of_a_rule_in_its_row(spark):
    clean = {"name": "s", "header": {"external": [], "loop": {}}, "request": {"url": "u", "method": "GET", "headers": {}, "cookies": {}},
             "parser": {"a": {"type": "css", "css": "p"}}, "remove_repeats": True, "need_refresh": False}
    rules = {0: [clean, clean], 1: [clean, dict(clean, parser={"a": {"type": "loop", "loop": "x"}})], 2: [dict(clean, parser={"a": {"type": "css"}})],
             3: [], 4: [dict(clean, request=None), dict(clean, need_refresh="yes", header=None)]}
    df = spark.createDataFrame([(i, [json.dumps(s) for s in r]) for i, r in rules.items()] + [(5, None)], "id int, s array<string>")
    v = {r["id"]: r["v"] and tuple(r["v"]) for r in df.select("id", C.stages_verdict(F.transform("s", F.parse_json)).alias("v")).collect()}
    # a child that is missing in the second loop of rule 1, an expression in rule 2
    assert v == {0: (0, 0, True, True), 1: (0, 1, False, True), 2: (1, 0, False, False), 3: (0, 0, True, True), 4: (2, 1, False, False), 5: None}


def test_rows_the_editor_rejects(spark):
    rows = [("s.parser", "", "css", "p", None), ("s.parser", None, "css", "", None), ("s.parser", "a", "css", None, None), ("s.parser", "b", "css", "p", None)]
    got = {(r["ord"], r["message"]) for r in C.editor_issues(_rows(spark, rows), ["rule"]).collect()}
    assert got == {(0, "Empty field name"), (1, "Empty field name"), (1, "Empty expression")}


def test_path_rename(spark):
    rows = [("s.parser", "a", "loop", "x", None), ("s.parser.a", "b", "css", "y", None),
            ("s.parser.a.b", "c", "css", "z", None), ("s.parser.ab", "d", "css", "w", None)]
    out = C.path_rename(_rows(spark, rows), "s.parser", "a", "z").orderBy("ord").collect()
    assert [(r["loc"], r["name"]) for r in out] == [
        ("s.parser", "z"), ("s.parser.z", "b"), ("s.parser.z.b", "c"), ("s.parser.ab", "d")]


def test_json_check_and_kv(spark):
    df = spark.createDataFrame([("",), ('{"a":1}',), ("{bad",), (None,)], "s string")
    assert [r[0] for r in df.select(C.json_check("s")).collect()] == ["{}", '{"a":1}', None, "{}"]
    kv = spark.createDataFrame([([("k", "1"), ("j", "2"), ("k", "3")],)], "e array<struct<key:string,value:string>>")
    assert kv.select(C.kv_to_map("e")).first()[0] == {"j": "2", "k": "3"}
    m = spark.createDataFrame([({},)], "m map<string,string>")
    assert [tuple(x) for x in m.select(C.map_to_kv("m")).first()[0]] == [("", "")]
    arr = spark.createDataFrame([(["a", "", None, "b"],)], "a array<string>")
    assert arr.select(C.drop_blank_items("a")).first()[0] == ["a", "b"]


def test_stage_verdict_modes(spark):
    full = {"name": "s", "header": {"external": [], "loop": {}}, "request": {"url": "u", "method": "GET", "headers": {}, "cookies": {}},
            "parser": [], "remove_repeats": True, "need_refresh": False}
    missing_opt = dict(full)
    del missing_opt["need_refresh"]
    missing_url = json.loads(json.dumps(full))
    del missing_url["request"]["url"]
    wrong_type = dict(full, remove_repeats="yes")
    stages = spark.createDataFrame([(i, json.dumps(s)) for i, s in enumerate([full, missing_opt, missing_url, wrong_type])], "sid int, s string")
    st = stages.select("sid", F.parse_json("s").alias("stage"))
    issues = C.stage_issues(st, "stage").withColumn("counted", F.lit(True))
    v = {r["sid"]: r for r in C.verdict(issues, ["sid"]).collect()}
    assert 0 not in v  # no issues at all
    assert (v[1]["check_pass"], v[1]["correct_pass"]) == (False, True)
    assert (v[2]["check_pass"], v[2]["correct_pass"]) == (False, False)
    assert v[3]["errors"] == 1


def test_config_defaults(spark):
    df = spark.createDataFrame([((None, 0, "", 0.0, -1),), ((True, 3, '{"a":1}', 2.0, 2),)],
                               "c struct<is_static:boolean, depth_limit:int, external_def:string, request_interval:double, retry_times:int>")
    d = C.config_defaults(F.col("c"))
    rows = df.select(*[v.alias(k) for k, v in d.items()]).collect()
    assert tuple(rows[0]) == (False, 5, None, None, "{}")
    assert tuple(rows[1]) == (True, 3, 2.0, 2, '{"a":1}')


def test_frontier_chain(spark):
    edges = spark.createDataFrame([("1", "2"), ("2", "3"), ("3", "4")], "src_url string, dst_url string")
    start = spark.createDataFrame([("1",)], "url string")
    got = {r["url"]: r["depth"] for r in FR.frontier_expand(spark, start, edges, 2).collect()}
    assert got == {"1": 1, "2": 2, "3": 3}


def test_frontier_equals_a_plain_search(spark):
    import random

    draw = random.Random(3)
    links = {(f"u{draw.randrange(300)}", f"u{draw.randrange(300)}") for _ in range(330)}
    links |= {("u1", "u1"), ("u2", None), (None, "u3")}  # to itself, to nowhere, from nowhere
    start, seen = [*(f"u{i}" for i in range(0, 300, 15)), "u1", "u2", "u2", "u50", None], ["u50", "u60", "u7"]
    depth = {u: 1 for u in start if u not in seen}
    for level in range(1, 7):
        for src, dst in sorted((p for p in links if None not in p)):
            if depth.get(src) == level and dst not in seen:
                depth.setdefault(dst, level + 1)
    edges = spark.createDataFrame([*links, *links], "src_url string, dst_url string")
    got = FR.frontier_expand(spark, spark.createDataFrame([(u,) for u in start], "url string"), edges, 6,
                             spark.createDataFrame([(u,) for u in seen], "url string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(depth.items(), key=str)
    assert max(depth.values()) > 4
    empty = spark.createDataFrame([], "src_url string, dst_url string")
    assert FR.frontier_expand(spark, empty.selectExpr("src_url AS url"), empty, 3).collect() == []
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("pagesift_frontier")]


def test_url_dedup_marks_seen_before_threshold(spark):
    pages = spark.createDataFrame([(1, "u1", "<p>x</p>"), (2, "u1", "<p>y</p>"), (3, "u2", "<p>z</p>")], "page_id long, url string, html string")
    first = url_dedup(pages)
    assert sorted((r["url"], r["page_id"]) for r in first.collect()) == [("u1", 1), ("u2", 3)]
    # u1 was seen (even if it then failed the threshold): a later snapshot is not stored
    later = spark.createDataFrame([(9, "u1", "<p>again</p>")], "page_id long, url string, html string")
    assert url_dedup(later, seen=first.select("url")).count() == 0


def test_stage_route_unknown_stage(spark):
    links = spark.createDataFrame([(1, "http://h/p", "a", "nx", 0, "/x")], "page_id long, url string, field string, next_stage string, pos int, href string")
    stages = spark.createDataFrame([("list", 0)], "name string, stage_ord int")
    r = FR.stage_route(links, stages).first()
    assert r["request_url"] == "http://h/x" and r["route_error"] == "unknown stage: nx"


def test_stage_route_remove_repeats(spark):
    links = spark.createDataFrame(
        [(1, "http://h/p", "a", "list", 0, "/x"), (1, "http://h/p", "a", "list", 1, "http://h/x"), (1, "http://h/p", "a", "list", 2, "/y")],
        "page_id long, url string, field string, next_stage string, pos int, href string")
    stages = spark.createDataFrame([("list", 0)], "name string, stage_ord int")
    assert FR.stage_route(links, stages).count() == 3
    got = sorted((r["pos"], r["request_url"]) for r in FR.stage_route(links, stages, remove_repeats=True).collect())
    assert got == [(0, "http://h/x"), (2, "http://h/y")]


def test_correct_mode_fills_defaults(spark):
    ok = {"name": "s", "request": {"url": "u"}, "parser": []}
    bad = {"name": "b", "parser": []}  # request missing: an error, returned unchanged
    df = spark.createDataFrame([(0, json.dumps(ok)), (1, json.dumps(bad))], "sid int, s string")
    v = C.stage_verdicts(df.select("sid", "s", F.parse_json("s").alias("stage")), "stage")
    out = {r["sid"]: r["c"] for r in v.select("sid", C.corrected_stage(F.col("s"), F.col("errors")).alias("c")).collect()}
    fixed = json.loads(out[0])
    assert fixed["request"]["method"] == "GET" and fixed["header"] == {"external": [], "loop": {}}
    assert fixed["remove_repeats"] is True and fixed["need_refresh"] is False
    assert json.loads(out[1]) == bad


def test_correct_mode_keeps_the_whole_stage(spark):
    tree = {"list": {"type": "xpath-loop", "xpath": "//li", "next_stage": "x", "my_own": [1, {"a": None}]},
            "deep": {"type": "loop", "loop": "{{e.a}}", "child": {"in": {"type": "css-loop", "css": "p", "child": {"t": {"type": "css", "css": "b"}}}, "un": {"type": "loop", "loop": "x"}}}}
    stage = {"my_key": {"x": 1.5}, "name": "s \"1\" ü", "request": {"url": "u", "extra": {"retry": 2}, "headers": None}, "parser": tree, "header": {"loop": {"a": "b"}}, "need_refresh": None}
    df = spark.createDataFrame([(json.dumps(stage), 0), (json.dumps({"request": None}), 1), (None, 0)], "s string, e long")
    got = [r[0] for r in df.select(C.corrected_stage(F.col("s"), F.col("e"))).collect()]
    fixed = json.loads(got[0])
    want = json.loads(json.dumps(stage))
    want["request"] |= {"method": "GET", "cookies": {}}
    want["header"]["external"] = []
    want["remove_repeats"] = True
    want["parser"]["list"]["child"] = {}
    want["parser"]["deep"]["child"]["un"]["child"] = {}
    assert fixed == want  # a key that is null stays null
    assert json.loads(got[1]) == {"request": None} and got[2] is None
