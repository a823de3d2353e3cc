"""Templates are taken apart once per row."""

import re

from pyspark.sql import functions as F

from pagesift.operators import requests as RQ


def _calls(column, name: str) -> int:
    return len(re.findall(rf"\b{name}\(", str(column)))


def test_a_template_is_taken_apart_once(spark):
    made = RQ.render_rows(F.col("t"), F.col("env"))
    assert _calls(made, "regexp_extract_all") == 1 and _calls(made, "split") == 1
    env = RQ.environment(F.col("own"), F.col("external"), F.col("names"), F.col("history"))
    assert _calls(env, "parse_json") == 1
