"""Requests of a rule as rows: templates, loops and environments are data.

A frontier row asks for a stage, maybe at a URL, and carries the values of the
stages it came through (``history``: stage name → JSON).  The stage table holds
the templates.  Everything a request is made of is rendered in its row: loop
lists, url, headers, cookies; a template that fails leaves its error there
instead of ending the run.

An environment is a JSON object: ``s`` (the own stage, with the current loop
items), ``e`` (external definitions), each external name of the stage, and each
stage of the history.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.functions.joins import param_frame
from pagesift.functions.text import bound
from pagesift.operators.template import EXPRESSION_RE, PATH_EXPR_RE

_EXPRESSION = EXPRESSION_RE.pattern.replace("{", r"\{").replace("}", r"\}")


def render_rows(template: Column, env: Column) -> Column:
    """``struct(value, is_text, error)`` of a template column over a VARIANT column.

    Differing templates per row: the expressions are taken out, looked up and
    put back within the row.  A template that is one whole expression keeps a
    value that is no string as JSON text (``is_text`` false); inside a longer
    one that is an error, and so are a path that leads nowhere and an
    expression that is no path.  A null template gives a null value.
    """
    # ``bound`` names what is used more than once: within a lambda a repeated expression is computed again
    def lookup(x: Column, whole: Column) -> Column:
        v = F.when(x.rlike(PATH_EXPR_RE.pattern), F.call_function("try_variant_get", env, F.concat(F.lit("$."), F.trim(x)), F.lit("variant")))
        return bound(v, lambda v: bound(F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False)), lambda is_text: found_value(x, whole, v, is_text)))

    def found_value(x: Column, whole: Column, v: Column, is_text: Column) -> Column:
        text = F.when(is_text, F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v))
        # fixed values: the names of the two errors
        error = F.when(v.isNull(), F.concat(F.lit("ExpressionError: "), F.trim(x))).when(
            ~is_text & ~whole, F.concat(F.lit("ConcatenateError: "), F.trim(x)))
        return F.struct(text.alias("text"), is_text.alias("is_text"), error.alias("error"))

    def result(literals: Column, whole: Column, found: Column) -> Column:
        def of(error: Column) -> Column:
            joined = F.array_join(F.zip_with(literals, found, lambda a, f: F.concat(a, F.coalesce(f["text"], F.lit("")))), "")
            is_text = ~whole | F.try_element_at(found, F.lit(1))["is_text"]
            return F.struct(F.when(error.isNull(), joined).alias("value"), F.coalesce(is_text, F.lit(True)).alias("is_text"), error.alias("error"))

        return bound(F.try_element_at(F.filter(F.transform(found, lambda f: f["error"]), lambda e: e.isNotNull()), F.lit(1)), of)

    def rendered(parts: Column) -> Column:
        expressions, literals = parts["expressions"], parts["literals"]
        return bound((F.size(expressions) == 1) & (F.array_join(literals, "") == ""), lambda whole: bound(
            F.transform(expressions, lambda x: lookup(x, whole)), lambda found: result(literals, whole, found)))

    return bound(F.struct(F.regexp_extract_all(template, F.lit(_EXPRESSION), 1).alias("expressions"),
                          F.split(template, _EXPRESSION, -1).alias("literals")), rendered)


def quoted(text: Column) -> Column:
    """A text as a JSON string."""
    listed = F.to_json(F.array(text))
    return listed.substr(F.lit(2), F.length(listed) - 2)


def members(pairs: Column) -> Column:
    """``"key":json`` members of a map of JSON texts, joined by commas."""
    return F.array_join(F.transform(F.map_entries(pairs), lambda p: F.concat(quoted(p["key"]), F.lit(":"), p["value"])), ",")


def environment(own: Column, external: Column, names: Column, history: Column) -> Column:
    """The JSON object of a request's environment.

    ``own`` and ``external`` are JSON objects, ``names`` the external names of the stage, ``history`` a map from
    stage to JSON.  An external name hides a stage of that name, and a stage named ``s`` hides the own one.
    """
    taken = F.concat(F.array(F.lit("e")), names)
    past = F.map_filter(F.coalesce(history, F.create_map().cast("map<string,string>")), lambda k, _: ~F.array_contains(taken, k))

    def value(e: Column, n: Column) -> Column:
        return F.coalesce(F.to_json(F.call_function("try_variant_get", e, F.concat(F.lit("$."), n), F.lit("variant"))), F.lit("null"))

    named = bound(F.parse_json(external), lambda e: F.map_from_entries(F.transform(
        F.filter(F.array_distinct(names), lambda n: n != "e"), lambda n: F.struct(n.alias("key"), value(e, n).alias("value")))))

    def whole(past: Column) -> Column:
        own_map = F.map_filter(F.create_map(F.lit("s"), own), lambda k, _: ~F.map_contains_key(past, k))
        return F.concat(F.lit("{"), members(F.map_concat(own_map, past, F.create_map(F.lit("e"), external), named)), F.lit("}"))

    return bound(past, whole)


def stage_rows(spark: SparkSession, stages: list[dict], external: str = "{}") -> DataFrame:
    """The stages of a rule as rows: templates as columns, what templates can read as JSON.

    The first stage of a name wins; the list is as large as the rule.
    """
    rows, seen = [], set()
    for i, s in enumerate(stages):
        if s["name"] in seen:
            continue
        seen.add(s["name"])
        header, request = s.get("header") or {}, s.get("request") or {}
        loop = header.get("loop") or {}
        shown = {k: v for k, v in s.items() if k not in ("header", "parser")}
        rest = {k: v for k, v in header.items() if k != "loop"}
        given = {k: v for k, v in loop.items() if k.removesuffix("_item") not in loop or not k.endswith("_item")}
        text = lambda m: {str(k): str(v) for k, v in (m or {}).items()}
        rows.append((
            s["name"], i, json.dumps(shown)[:-1], json.dumps(rest)[1:-1], json.dumps(given)[1:-1],
            request.get("url"), request.get("method") or "GET", text(request.get("headers")), text(request.get("cookies")),
            list(loop), [v if isinstance(v, str) else json.dumps(v) for v in loop.values()], [not isinstance(v, str) for v in loop.values()],
            [str(n) for n in header.get("external") or []], external or "{}",
        ))
    return param_frame(
        spark, rows,
        "stage string, stage_ord int, own_members string, header_members string, loop_members string, url_template string, method string,"
        " header_templates map<string,string>, cookie_templates map<string,string>, loop_keys array<string>, loop_templates array<string>,"
        " loop_literal array<boolean>, names array<string>, external string")


def _own(items: Column, parser: Column) -> Column:
    """JSON of the own stage: its members, its field values, and its header with the current loop items."""
    joined = lambda *parts: F.array_join(F.filter(F.array(*parts), lambda p: p != ""), ",")
    loop = F.concat(F.lit('"loop":{'), joined(F.col("loop_members"), items), F.lit("}"))
    return F.concat("own_members", F.lit(',"parser":'), parser, F.lit(',"header":{'), joined(F.col("header_members"), loop), F.lit("}}"))


def _map_rendered(templates: Column, env: Column) -> Column:
    return F.map_from_entries(F.transform(F.map_entries(templates), lambda p: F.struct(p["key"].alias("key"), render_rows(p["value"], env).alias("value"))))


def build_requests(frontier: DataFrame, stages: DataFrame) -> DataFrame:
    """The requests of ``frontier`` (``stage, default_url, history`` and any others) by the templates of ``stage_rows``.

    Adds ``loop_ord, url, method, headers, cookies, env, error``: one row per
    combination of the stage's loop lists, the first list varying fastest; no
    lists give one row, an empty list none.  ``default_url`` (a template, too)
    replaces the stage's own.  A stage that is not in the table gives one row
    with an error.  A list is a JSON list or a template that renders to one; a
    template that renders to text loops over its characters.  ``env`` is the
    JSON object that the templates were rendered over.
    """
    keep = frontier.columns
    f = frontier.join(stages, "stage", "left")
    known = F.col("stage_ord").isNotNull()
    empty = F.array().cast("array<string>")
    own = F.when(known, _own(F.lit(""), F.lit("{}"))).otherwise(F.lit("{}"))
    names, external = F.coalesce("names", empty), F.coalesce("external", F.lit("{}"))
    f = f.withColumn("_env", F.parse_json(environment(own, external, names, F.col("history"))))
    # each list as JSON texts of its items
    rendered = F.transform(F.coalesce("loop_templates", empty), lambda t: render_rows(t, F.col("_env")))

    def items(r: Column, literal: Column) -> Column:
        listed = F.from_json(r["value"], "array<variant>")
        return F.when(literal | ~r["is_text"], F.transform(listed, lambda v: F.to_json(v))).otherwise(
            F.transform(F.filter(F.split(r["value"], ""), lambda c: c != ""), quoted))

    f = f.withColumn("_rendered", rendered)
    f = f.withColumn("_error", F.when(~known, F.concat(F.lit("unknown stage: "), "stage")).otherwise(
        F.try_element_at(F.filter(F.transform("_rendered", lambda r: r["error"]), lambda e: e.isNotNull()), F.lit(1))))
    f = f.withColumn("_lists", F.zip_with("_rendered", F.coalesce("loop_literal", F.array().cast("array<boolean>")), items))
    runs = F.aggregate("_lists", F.lit(1).cast("long"), lambda n, x: n * F.coalesce(F.size(x), F.lit(0)))
    runs = F.when(F.col("_error").isNotNull(), F.lit(1).cast("long")).otherwise(runs)
    f = f.withColumn("loop_ord", F.explode(F.when(runs > 0, F.sequence(F.lit(0).cast("long"), runs - 1))))
    radix = lambda i: F.aggregate(F.slice("_lists", F.lit(1), i), F.lit(1).cast("long"), lambda n, x: n * F.size(x))
    picked = F.when(F.col("_error").isNotNull(), empty).otherwise(F.transform(
        "_lists", lambda x, i: F.element_at(x, ((F.col("loop_ord") / radix(i)).cast("long") % F.size(x)).cast("int") + 1)))
    pairs = F.zip_with(F.coalesce("loop_keys", empty), picked, lambda k, v: F.concat(quoted(F.concat(k, F.lit("_item"))), F.lit(":"), v))
    f = f.withColumn("_items", F.array_join(pairs, ","))
    own = F.when(known, _own(F.col("_items"), F.lit("{}"))).otherwise(F.lit("{}"))
    f = f.withColumn("env", environment(own, external, names, F.col("history"))).withColumn("_env", F.parse_json("env"))
    f = f.withColumn("_url", render_rows(F.coalesce("default_url", "url_template"), F.col("_env")))
    for name, templates in (("_headers", "header_templates"), ("_cookies", "cookie_templates")):
        f = f.withColumn(name, _map_rendered(F.coalesce(templates, F.create_map().cast("map<string,string>")), F.col("_env")))
    failed = F.concat(*[F.transform(F.map_values(c), lambda r: r["error"]) for c in ("_headers", "_cookies")])
    # maps have no order: of several errors the first in text order
    error = F.coalesce("_error", F.col("_url")["error"], F.array_min(F.filter(failed, lambda e: e.isNotNull())),
                       F.when(F.col("_url")["value"].isNull(), F.lit("no url")))
    values = lambda c: F.transform_values(c, lambda _, r: r["value"])
    return f.select(
        *keep, "loop_ord", F.when(error.isNull(), F.col("_url")["value"]).alias("url"), F.coalesce("method", F.lit("GET")).alias("method"),
        values("_headers").alias("headers"), values("_cookies").alias("cookies"), "env", error.alias("error"))


def with_history(requests: DataFrame, parser: str) -> DataFrame:
    """``requests`` (``stage, history, env``) with ``history`` extended by their own stage's values.

    ``parser`` names a column with the JSON object of the fields parsed from the
    page.  The nearest value of a stage replaces an older one, so a row carries
    at most one value per stage of the rule, however deep it lies.
    """
    own = F.to_json(F.try_variant_get(F.parse_json("env"), "$.s", "variant"))
    # the parsed fields take the place of the empty object that the templates saw
    shown = F.from_json(own, "map<string,variant>")
    kept = F.transform_values(F.map_filter(shown, lambda k, _: k != "parser"), lambda _, v: F.to_json(v))
    value = F.concat(F.lit("{"), members(F.map_concat(kept, F.create_map(F.lit("parser"), F.coalesce(parser, F.lit("{}"))))), F.lit("}"))
    past = F.map_filter(F.coalesce("history", F.create_map().cast("map<string,string>")), lambda k, _: k != F.col("stage"))
    return requests.withColumn("history", F.map_concat(past, F.create_map("stage", value)))


def lineage_latest(requests: DataFrame, id_col: str, parent_col: str, stage_col: str, value_col: str, checkpoint=lambda df: df.checkpoint(eager=True)) -> DataFrame:
    """``(id, latest)``: for every request the newest value of each stage among its ancestors, a map of stage to value.

    Pointer jumping: a row knows the newest values up to an ancestor, and that
    ancestor knows those beyond; every round doubles the reach, so a chain of n
    requests takes log n joins of narrow rows.  The nearer value wins.  A parent
    that is no request, or null, is the beginning.
    """
    rows = requests.select(F.col(id_col).alias("id"), F.col(parent_col).alias("up"), F.col(stage_col).alias("stage"), F.col(value_col).alias("value"))
    own = rows.select(F.col("id").alias("up"), F.create_map("stage", "value").alias("more"))
    none = F.create_map().cast(own.schema["more"].dataType)
    # ``up`` is the farthest ancestor whose value is known
    known = rows.join(own, "up", "left").select("id", F.when(F.col("more").isNotNull(), F.col("up")).alias("up"), F.coalesce("more", none).alias("latest"))
    while True:
        known = checkpoint(known)
        if known.where("up IS NOT NULL").isEmpty():
            return known.select("id", "latest")
        ahead = known.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("latest").alias("more"))
        far = F.map_filter(F.coalesce("more", none), lambda k, _: ~F.map_contains_key(F.col("latest"), k))
        known = known.join(ahead, "up", "left").select("id", F.col("next").alias("up"), F.map_concat("latest", far).alias("latest"))
