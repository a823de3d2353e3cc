"""Registered queries: templates, parameter environments, loops, requests (M2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagesift.functions.joins import deal
from pagesift.operators import requests as RQ
from pagesift.operators import template as TP
from pagesift.plans.catalog import register
from pagesift.sources.tables import table

HOST = "shop.example.com"
URL_TEMPLATE = "https://{{e.host}}/{{s.brand}}/{{s.words[0]}}"
SIZE_TEMPLATE = "{{s.size}}"
STAGE = "catalog"
REQUEST_URL = "https://{{e.host}}/{{s.brand}}/{{s.header.loop.kind_item}}?q={{s.header.loop.word_item}}"
REFERER = "https://{{e.host}}/{{s.brand}}"


def _part_env(spark, sf):
    """One environment per part row: ``s`` (its stage-like fields) and ``e`` (external)."""
    p = deal(table(spark, sf, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size"))
    s = F.struct(
        F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_size").alias("size"),
        F.split("p_name", " ").alias("words"),
    )
    return p.select("p_partkey", "p_name", "p_type", F.struct(s.alias("s"), F.struct(F.lit(HOST).alias("host")).alias("e")).alias("env"))


def _loops_sql():
    return """SELECT p_partkey, p_brand, (kp - 1) * len(w) + (wp - 1) AS loop_ord, w[wp] AS word_item, k[kp] AS kind_item FROM (
                SELECT p_partkey, p_brand, w, k, kp, generate_subscripts(w, 1) AS wp FROM (
                  SELECT p_partkey, p_brand, w, k, generate_subscripts(k, 1) AS kp FROM (
                    SELECT p_partkey, p_brand, string_split(p_name, ' ') AS w, string_split(p_type, ' ') AS k FROM part)))"""


@register("loop_product", lambda: f"SELECT p_partkey, loop_ord, word_item, kind_item FROM ({_loops_sql()})")
def q_loop_product(spark, sf):
    """Per part: every (name word × type word) pair, the first list varying fastest."""
    p = table(spark, sf, "part", "p_partkey", "p_name", "p_type")
    out = TP.loop_product(p, [("word", F.split("p_name", " ")), ("kind", F.split("p_type", " "))])
    return out.select("p_partkey", "loop_ord", "word_item", "kind_item")


@register(
    "template_render",
    f"""SELECT p_partkey, 'https://' || '{HOST}' || '/' || p_brand || '/' || string_split(p_name, ' ')[1] AS url,
               p_size AS size FROM part""",
)
def q_template_render(spark, sf):
    env = _part_env(spark, sf)
    et = env.schema["env"].dataType
    return env.select(
        "p_partkey",
        TP.render_struct(URL_TEMPLATE, F.col("env"), et).alias("url"),
        TP.render_struct(SIZE_TEMPLATE, F.col("env"), et).alias("size"),
    )


ALL_TEMPLATES = [URL_TEMPLATE, "{{s.type}}", "{{s.brand}}-{{s.type}}"]


@register(
    "template_render_all",
    f"""SELECT p_partkey, 0 AS pos, 'https://' || '{HOST}' || '/' || p_brand || '/' || string_split(p_name, ' ')[1] AS value FROM part
        UNION ALL SELECT p_partkey, 1, p_type FROM part
        UNION ALL SELECT p_partkey, 2, p_brand || '-' || p_type FROM part""",
)
def q_template_render_all(spark, sf):
    env = _part_env(spark, sf)
    et = env.schema["env"].dataType
    rendered = F.array(*[TP.render_struct(t, F.col("env"), et) for t in ALL_TEMPLATES])
    return env.select("p_partkey", F.posexplode(rendered).alias("pos", "value"))


@register(
    "path_lookup",
    """SELECT event_id,
              CASE WHEN json_type(props, '$.k') = 'VARCHAR' THEN json_extract_string(props, '$.k')
                   ELSE json_extract(props, '$.k')::VARCHAR END AS k,
              CASE WHEN json_type(props, '$.k') IS NULL THEN 'ExpressionError: k'
                   WHEN json_type(props, '$.k') <> 'VARCHAR' THEN 'ConcatenateError: k' END AS embed_error,
              'ExpressionError: missing.path[0]' AS missing_error
       FROM events""",
)
def q_path_lookup(spark, sf):
    """Free-form JSON parameters: whole-value lookup, an embedded use and a missing path."""
    e = table(spark, sf, "events", "event_id", "props").select("event_id", F.parse_json("props").alias("v"))
    k, _ = TP.render_variant("{{k}}", F.col("v"))
    _, embed_err = TP.render_variant("k={{k}}", F.col("v"))
    _, missing_err = TP.render_variant("{{missing.path[0]}}", F.col("v"))
    return e.select("event_id", k.alias("k"), embed_err.alias("embed_error"), missing_err.alias("missing_error"))


def _requests(spark, sf):
    p = table(spark, sf, "part", "p_partkey", "p_name", "p_brand", "p_type")
    loops = TP.loop_product(p, [("word", F.split("p_name", " ")), ("kind", F.split("p_type", " "))])
    env = F.struct(
        F.struct(
            F.lit(STAGE).alias("name"),
            F.col("p_brand").alias("brand"),
            F.struct(F.struct("word_item", "kind_item").alias("loop")).alias("header"),
        ).alias("s"),
        F.struct(F.lit(HOST).alias("host")).alias("e"),
    )
    return loops.select("p_partkey", "loop_ord", env.alias("env"))


@register(
    "request_build",
    lambda: f"""SELECT p_partkey, loop_ord, '{STAGE}' AS stage,
                       'https://{HOST}/' || p_brand || '/' || kind_item || '?q=' || word_item AS url,
                       'https://{HOST}/' || p_brand AS referer, 0 AS depth
                FROM ({_loops_sql()})""",
)
def q_request_build(spark, sf):
    """One request per loop combination: rendered url and headers, depth 0."""
    r = _requests(spark, sf)
    et = r.schema["env"].dataType
    return r.select(
        "p_partkey", "loop_ord", F.lit(STAGE).alias("stage"),
        TP.render_struct(REQUEST_URL, F.col("env"), et).alias("url"),
        TP.render_struct(REFERER, F.col("env"), et).alias("referer"),
        F.lit(0).alias("depth"),
    )


@register(
    "param_env",
    lambda: f"""SELECT p_partkey, loop_ord,
                       to_json({{'s': {{'name': '{STAGE}', 'brand': p_brand,
                                       'header': {{'loop': {{'word_item': word_item, 'kind_item': kind_item}}}}}},
                                 'e': {{'host': '{HOST}'}}}})::VARCHAR AS env
                FROM ({_loops_sql()})""",
)
def q_param_env(spark, sf):
    """The template environment of each request, as JSON (``s``, ``e``)."""
    r = _requests(spark, sf)
    return r.select("p_partkey", "loop_ord", F.to_json("env").alias("env"))


ROW_TEMPLATES = ("https://{{e.host}}/{{s.brand}}/{{s.words[0]}}", "{{s.words}}", "{{ s.type }}", "n={{s.size}}", "{{s.words[9]}}", "{{s.size}}")


@register(
    "template_rows",
    f"""SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'https://{HOST}/' || p_brand || '/' || string_split(p_name, ' ')[1]
                               WHEN 1 THEN to_json(string_split(p_name, ' '))::VARCHAR WHEN 2 THEN p_type
                               WHEN 5 THEN p_size::VARCHAR END AS value,
               p_size % 6 NOT IN (1, 5, 4) AS is_text,
               CASE p_size % 6 WHEN 3 THEN 'ConcatenateError: s.size' WHEN 4 THEN 'ExpressionError: s.words[9]' END AS error
        FROM part""",
)
def q_template_rows(spark, sf):
    """A template column that differs per row, rendered over a JSON environment; errors stay in their rows."""
    p = _part_env(spark, sf).select("p_partkey", F.col("env.s.size").alias("size"), F.parse_json(F.to_json("env")).alias("env"))
    template = F.element_at(F.array(*[F.lit(t) for t in ROW_TEMPLATES]), (F.col("size") % 6 + 1).cast("int"))
    return p.select("p_partkey", RQ.render_rows(template, F.col("env")).alias("r")).select("p_partkey", "r.*")


REQUEST_STAGES = [
    {"name": "catalog", "header": {"external": ["shop"], "loop": {"word": "{{origin.words}}", "n": ["1", "2"]}},
     "request": {"url": "https://{{shop.host}}/{{s.header.loop.word_item}}?n={{s.header.loop.n_item}}", "method": "POST",
                 "headers": {"Referer": "https://{{e.host}}/{{origin.brand}}"}, "cookies": {"kind": "{{origin.type}}"}}},
    {"name": "detail", "request": {"url": "https://{{e.host}}/{{origin.parser.missing}}"}},
]
REQUEST_EXTERNAL = f'{{"host": "{HOST}", "shop": {{"host": "{HOST}"}}}}'


@register(
    "request_rows",
    f"""SELECT p_partkey, 'catalog' AS stage, (np - 1) * len(w) + (wp - 1) AS loop_ord, 'POST' AS method,
               'https://{HOST}/' || w[wp] || '?n=' || np AS url, 'https://{HOST}/' || p_brand AS referer, p_type AS kind, NULL::VARCHAR AS error
        FROM (SELECT p_partkey, p_brand, p_type, w, np, generate_subscripts(w, 1) AS wp
              FROM (SELECT p_partkey, p_brand, p_type, string_split(p_name, ' ') AS w, unnest([1, 2]) AS np FROM part WHERE p_size % 3 <> 0))
        UNION ALL SELECT p_partkey, 'detail', 0, 'GET', NULL, NULL, NULL, 'ExpressionError: origin.parser.missing' FROM part WHERE p_size % 3 = 0""",
)
def q_request_rows(spark, sf):
    """Requests of two stages from rows that carry the values of the stage they came from."""
    p = deal(table(spark, sf, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size"))
    value = F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.split("p_name", " ").alias("words")))
    frontier = p.select(
        "p_partkey", F.when(F.col("p_size") % 3 == 0, "detail").otherwise("catalog").alias("stage"),
        F.lit(None).cast("string").alias("default_url"), F.create_map(F.lit("origin"), value).alias("history"))
    r = RQ.build_requests(frontier, RQ.stage_rows(spark, REQUEST_STAGES, REQUEST_EXTERNAL))
    return r.select("p_partkey", "stage", "loop_ord", "method", "url", F.col("headers")["Referer"].alias("referer"), F.col("cookies")["kind"].alias("kind"), "error")
