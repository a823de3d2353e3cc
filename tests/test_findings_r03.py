"""Findings of round 3: narrow rows of much work, expressions computed once."""

import json
import re

from pyspark.sql import functions as F

from pagesift.functions.joins import DEAL_ROWS
from pagesift.operators import config as C
from pagesift.plans import catalog
from pagesift.plans import reg_config, reg_params


def _calls(column, name: str) -> int:
    return len(re.findall(rf"\b{name}\(", str(column)))


def _parts(spark, folder, n: int) -> str:
    """A part table of ``n`` rows in one file."""
    part = spark.range(n).select(
        F.col("id").alias("p_partkey"), F.lit("large ring").alias("p_name"), F.concat(F.lit("Brand#"), F.col("id") % 25).alias("p_brand"),
        F.lit("SMALL HOT").alias("p_type"), (F.col("id") % 50).cast("int").alias("p_size"))
    part.coalesce(1).write.parquet(f"{folder}/part.parquet")
    return str(folder)


def test_narrow_rows_of_much_work_are_dealt_out(spark, tmp_path):
    sf = _parts(spark, tmp_path, 4 * DEAL_ROWS)
    q = catalog.queries()
    for rows in (reg_config.rules(spark, sf), reg_params._part_env(spark, sf), q["request_rows"](spark, sf), q["config_verdict"](spark, sf)):
        assert rows.rdd.getNumPartitions() == 4
    assert q["config_verdict"](spark, sf).select("id").distinct().count() == 4 * DEAL_ROWS


def test_a_kind_looks_its_value_up_once(spark):
    assert _calls(C._vtype(F.col("v"), "$.a"), "try_variant_get") == 1
    values = {"d": {}, "l": [1, "a"], "s": "", "b": False, "i": 1, "f": 1.5, "big": 10**30, "n": None}
    v = spark.createDataFrame([(json.dumps(values),)], "s string").select(F.parse_json("s").alias("v"))
    got = v.select(*[C._vtype(F.col("v"), f"$.{k}").alias(k) for k in (*values, "none")]).first().asDict()
    assert got == {"d": "dict", "l": "list", "s": "str", "b": "bool", "i": "number", "f": "number", "big": "number", "n": None, "none": None}


def test_a_stage_is_taken_apart_once(spark):
    stage = C.corrected_stage(F.col("s"), F.col("e"))
    # the stage, its parser for the function of Python, its header and its request
    assert _calls(stage, "from_json") <= 4


def test_issue_log_meets_in_one_shuffle(spark):
    """Both modes from one group per rule; counts go over repeated rules, a null id has none."""
    issue = [(1, "header", "warning", "header lose"), (5, "request.url", "error", "Necessary part request.url lose")]
    stages = spark.createDataFrame(
        [(1, 0, "list", issue), (1, 1, None, []), (2, 0, "a", issue[:1]), (2, 0, "a", issue[:1]), (None, 0, "n", issue[1:]), (3, None, "x", issue[1:])],
        "id long, stage_idx int, name string, issues array<struct<ord:int,field:string,severity:string,message:string>>").repartition(3)
    fields = spark.createDataFrame(
        [(1, 1, "s.parser.b", "error", "b", True), (1, 1, "s.parser.a", "warning", "a", False), (9, 0, "s.parser.c", "error", "c", True)],
        "id long, stage_idx int, path string, severity string, message string, counted boolean")
    log = C.issue_log(stages, fields, ("CHECK", "CORRECT"))
    assert len(re.findall(r"\bExchange hashpartitioning", log._jdf.queryExecution().executedPlan().toString())) == 1
    got = {(r.id, r.mode): r.log.split("\n") for r in log.collect()}
    opening = "INFO - Validation initiate with mode CHECK."
    lost, url = "WARNING - header lose", "ERROR - Necessary part request.url lose"
    assert len(got) == 10
    assert got[1, "CHECK"] == [
        opening, "INFO - Stage list validation start.", lost, url, "INFO - Stage list validation end. Result:  Error: 1  Warning: 1",
        "INFO - Stage Untitled Stage validation start.", "WARNING - a", "ERROR - b", "INFO - Stage Untitled Stage validation end. Result:  Error: 1  Warning: 0"]
    assert got[1, "CORRECT"] == ["INFO - Validation initiate with mode CORRECT.", *got[1, "CHECK"][1:3], "INFO - Autofill header with default", *got[1, "CHECK"][3:]]
    assert got[2, "CHECK"] == [opening, *["INFO - Stage a validation start."] * 2, lost, lost, *["INFO - Stage a validation end. Result:  Error: 0  Warning: 2"] * 2]
    assert got[None, "CHECK"] == [opening, "INFO - Stage n validation start.", url, "INFO - Stage n validation pass."]
    assert sorted(got[3, "CHECK"]) == sorted([opening, "INFO - Stage x validation start.", url, "INFO - Stage x validation pass."])
    assert got[9, "CHECK"] == got[9, "CORRECT"] == ["ERROR - c"]


def test_issue_log_derives_stages_once(spark, tmp_path):
    plan = catalog.queries()["config_issue_log"](spark, _parts(spark, tmp_path, 40))._jdf.queryExecution().executedPlan().toString()
    assert "part.parquet" not in plan and plan.count("/stages-") > 0


def test_a_rule_is_taken_apart_once(spark, tmp_path):
    """A stage's keys are read in one pass per object, a row's path is put together once, texts are derived outside of the lambdas."""
    lookups = [_calls(C.parser_issue_array(F.col("p")), "try_variant_get"), _calls(C.stages_verdict(F.col("s")), "try_variant_get")]
    assert lookups[1] - lookups[0] == 3  # the stage, its header and its request
    assert _calls(C.tree_in_row(F.col("rows")), "concat_ws") == 1
    plan = catalog.queries()["config_verdict"](spark, _parts(spark, tmp_path, 40))._jdf.queryExecution().executedPlan().toString()
    derived = [line for line in plan.splitlines() if "from_json" in line]
    assert derived and not any("lambda" in line for line in derived)


def test_verdict_of_odd_stages(spark):
    own = {"name": "a", "request": {"url": "u", "method": "GET", "headers": {}, "cookies": {}}, "parser": [],
           "header": {"external": [], "loop": {}}, "remove_repeats": True, "need_refresh": False}
    row = {"loc": "s.parser", "name": "a", "type": "xpath-loop", "value": "v"}
    under = {"loc": "s.parser.a", "name": "b", "type": "css"}
    odd = {
        "right": (own, 0, 0), "list": ([own], 2, 3), "null": (None, 2, 3),
        "letter case": ({**own, "Header": own["header"], "header": None}, 0, 1),
        "dotted key": ({**own, "header": {"loop": {}}, "header.external": []}, 0, 1),
        "kinds": ({**own, "header": [], "request": {**own["request"], "url": 7, "method": None}, "remove_repeats": "true", "need_refresh": 10**30}, 4, 1),
        "request is text": ({**own, "request": "{}"}, 1, 0),
        "row without value": ({**own, "parser": [row, under]}, 1, 0),
        "path twice, first wins": ({**own, "parser": [row, {**under, "value": "v"}, under]}, 0, 0),
        "first is no loop": ({**own, "parser": [{**row, "type": "xpath"}, row, under]}, 0, 0),
        "number as type": ({**own, "parser": [{**row, "type": 7}]}, 0, 0),
        "no type": ({**own, "parser": [{"loc": "s.parser", "name": "a", "value": "v"}]}, 1, 0),
        "tree": ({**own, "parser": {"a": {"type": "css-loop", "css": "v", "child": {"b": {"type": "xpath"}, "c": 1}}, "d": {"type": "loop", "loop": "v"}}}, 2, 1),
    }
    rows = [(k, [json.dumps(stage)]) for k, (stage, *_) in odd.items()] + [("none", []), ("no stages", None)]
    df = spark.createDataFrame(rows, "id string, s array<string>")
    got = {r.id: r.v and tuple(r.v) for r in df.select("id", C.stages_verdict(F.transform("s", F.parse_json)).alias("v")).collect()}
    want = {k: (e, w, e == 0 and w == 0, e == 0) for k, (_, e, w) in odd.items()}
    assert got == want | {"none": (0, 0, True, True), "no stages": None}
