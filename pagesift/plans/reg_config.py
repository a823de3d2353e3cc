"""Registered queries: config tables — parser trees, validation, defaults,
entrances, key/value forms, run logs (M3).

The fixture has no rule store, so rule rows are derived from ``part``: the
three words of a part type give a three-level parser path (repeated paths
across parts exercise first-row-wins), and sizes pick field types, missing
keys and wrong types.  The derivation is written twice (Spark columns here,
SQL in the oracle) from the same rule.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pagesift.functions.joins import deal
from pagesift.operators import config as C
from pagesift.plans import sqlparts as S
from pagesift.plans.catalog import register
from pagesift.session import new_scratch_path
from pagesift.sources.tables import json_doc_load, log_scan, table

LEAF_TYPES = ["xpath", "css", "xpath-list", "css-list", "loop", "mystery"]
MID_TYPES = ["css-loop", "xpath", "loop"]


def _words(spark, sf):
    p = table(spark, sf, "part", "p_partkey", "p_brand", "p_type", "p_size")
    w = F.split(F.lower("p_type"), " ")
    return p.select(
        "p_partkey", F.col("p_brand").alias("rule"), "p_size",
        *[F.coalesce(F.try_element_at(w, F.lit(i)), F.lit("x")).alias(f"w{i}") for i in (1, 2, 3)],
    )


def parser_rows(spark, sf):
    """``(rule, ord, loc, name, type, value, next)``: three rows per part."""
    p = _words(spark, sf)
    mid = F.element_at(F.array(*[F.lit(t) for t in MID_TYPES]), (F.col("p_size") % 3 + 1).cast("int"))
    leaf = F.element_at(F.array(*[F.lit(t) for t in LEAF_TYPES]), (F.col("p_size") % 6 + 1).cast("int"))
    r1 = p.select("rule", (F.col("p_partkey") * 3).alias("ord"), F.lit("s.parser").alias("loc"), F.col("w1").alias("name"),
                  F.lit("xpath-loop").alias("type"), F.concat(F.lit("//section[@class='"), "w1", F.lit("']")).alias("value"),
                  F.lit(None).cast("string").alias("next"))
    r2 = p.select("rule", (F.col("p_partkey") * 3 + 1).alias("ord"), F.concat(F.lit("s.parser."), "w1").alias("loc"),
                  F.col("w2").alias("name"), mid.alias("type"), F.concat(F.lit("."), "w2").alias("value"),
                  F.lit(None).cast("string").alias("next"))
    r3 = p.select("rule", (F.col("p_partkey") * 3 + 2).alias("ord"), F.concat(F.lit("s.parser."), "w1", F.lit("."), "w2").alias("loc"),
                  F.col("w3").alias("name"), leaf.alias("type"),
                  F.when(F.col("p_size") % 25 == 7, F.lit("")).when(
                      F.col("p_size") % 5 != 0, F.concat(F.lit("a."), "w3", F.lit("::attr(href)"))).alias("value"),
                  F.when(F.col("p_size") % 4 == 0, F.lit("detail")).alias("next"))
    return r1.unionByName(r2).unionByName(r3)


def parser_rows_sql() -> str:
    mid = "[" + ", ".join(S.q(t) for t in MID_TYPES) + "]"
    leaf = "[" + ", ".join(S.q(t) for t in LEAF_TYPES) + "]"
    w = ("(SELECT p_partkey, p_brand AS rule, p_size, [coalesce(s[1], 'x'), coalesce(s[2], 'x'), coalesce(s[3], 'x')] AS w "
         "FROM (SELECT *, string_split(lower(p_type), ' ') AS s FROM part))")
    return f"""(
      SELECT rule, p_partkey * 3 AS ord, 's.parser' AS loc, w[1] AS name, 'xpath-loop' AS type,
             '//section[@class=''' || w[1] || ''']' AS value, CAST(NULL AS VARCHAR) AS next FROM {w}
      UNION ALL
      SELECT rule, p_partkey * 3 + 1, 's.parser.' || w[1], w[2], {mid}[p_size % 3 + 1], '.' || w[2], NULL FROM {w}
      UNION ALL
      SELECT rule, p_partkey * 3 + 2, 's.parser.' || w[1] || '.' || w[2], w[3], {leaf}[p_size % 6 + 1],
             CASE WHEN p_size % 25 = 7 THEN '' WHEN p_size % 5 <> 0 THEN 'a.' || w[3] || '::attr(href)' END,
             CASE WHEN p_size % 4 = 0 THEN 'detail' END FROM {w})"""


def parser_tree_sql(rows_sql: str | None = None, group: str = "rule") -> str:
    rows_sql = rows_sql or parser_rows_sql()
    g = ", ".join(x.strip() for x in group.split(","))
    corr = " AND ".join(f"l.{x.strip()} = c.{x.strip()}" for x in group.split(","))
    return f"""(
      WITH w AS (
        SELECT {g}, path, r.loc, r.name, r.type, r.value, r.next FROM (
          SELECT {g}, path, arg_min({{'loc': loc, 'name': name, 'type': type, 'value': value, 'next': next}}, ord) AS r
          FROM (SELECT *, loc || '.' || name AS path FROM {rows_sql}) GROUP BY {g}, path)),
      loops AS (SELECT {g}, path FROM w WHERE type IN ('loop', 'xpath-loop', 'css-loop')),
      c AS (SELECT *, len(string_split(loc, '.')) - 2 AS k FROM w WHERE loc = 's.parser' OR starts_with(loc, 's.parser.'))
      SELECT {g}, path, loc, name, k + 1 AS depth, type,
             CASE WHEN starts_with(type, 'xpath') THEN value END AS xpath,
             CASE WHEN starts_with(type, 'css') THEN value END AS css,
             CASE WHEN NOT starts_with(type, 'xpath') AND NOT starts_with(type, 'css') THEN value END AS loop,
             CASE WHEN type NOT IN ('loop', 'xpath-loop', 'css-loop') THEN next END AS next
      FROM c
      WHERE k = 0 OR k = (SELECT count(*) FROM loops l WHERE {corr} AND starts_with(c.loc || '.', l.path || '.')))"""


def compile_rows_sql() -> str:
    w = "string_split(lower(p_type) || ' x x', ' ')"
    return f"""(
      SELECT p_partkey AS id, 0 AS stage_idx, 0 AS ord, 's.parser' AS loc, {w}[1] AS name, 'xpath-loop' AS type,
             '//section' AS value, CAST(NULL AS VARCHAR) AS next FROM part
      UNION ALL
      SELECT p_partkey, 0, 1, 's.parser.' || {w}[1], {w}[2], 'xpath',
             CASE WHEN p_size % 5 <> 0 THEN './a/@href' END, 'detail' FROM part)"""


@register("parser_tree", lambda: f"SELECT * FROM {parser_tree_sql()}")
def q_parser_tree(spark, sf):
    return C.parser_tree(parser_rows(spark, sf), ["rule"])


@register("rows_at_loc", lambda: f"SELECT rule, ord, name, type FROM {parser_rows_sql()} WHERE loc = 's.parser'")
def q_rows_at_loc(spark, sf):
    return C.rows_at_loc(parser_rows(spark, sf), "s.parser").select("rule", "ord", "name", "type")


@register(
    "path_rename",
    lambda: f"""SELECT rule, ord,
                  CASE WHEN loc = 's.parser.standard' OR starts_with(loc, 's.parser.standard.')
                       THEN 's.parser.std' || substring(loc, {len('s.parser.standard') + 1}) ELSE loc END AS loc,
                  CASE WHEN loc = 's.parser' AND name = 'standard' THEN 'std' ELSE name END AS name
                FROM {parser_rows_sql()}""",
)
def q_path_rename(spark, sf):
    """Rename the top-level field ``standard`` to ``std`` in every rule."""
    r = C.path_rename(parser_rows(spark, sf), "s.parser", "standard", "std")
    return r.select("rule", "ord", "loc", "name")


def parser_issues_sql(tree: str, keys: str) -> str:
    known = "('loop','xpath-loop','css-loop','xpath','css','xpath-list','css-list')"
    return f"""SELECT {keys}, path,
                  CASE WHEN type IS NULL THEN 'error' WHEN type NOT IN {known} THEN 'warning' ELSE 'error' END AS severity,
                  CASE WHEN type IS NULL THEN 'Necessary part parser-' || name || '.type lose'
                       WHEN type NOT IN {known} THEN 'Unknown parser type ''' || type || ''''
                       ELSE 'Necessary part parser-' || name || '.' ||
                            CASE WHEN type = 'loop' THEN 'loop' WHEN starts_with(type, 'xpath') THEN 'xpath' ELSE 'css' END || ' lose' END AS message,
                  type IS NULL OR type IN {known} AS counted
                FROM {tree}
                WHERE type IS NULL OR type NOT IN {known}
                   OR coalesce(CASE WHEN type = 'loop' THEN loop WHEN starts_with(type, 'xpath') THEN xpath
                                    WHEN starts_with(type, 'css') THEN css END, NULL) IS NULL"""


@register("parser_field_validate", lambda: parser_issues_sql(parser_tree_sql(), "rule"))
def q_parser_field_validate(spark, sf):
    return C.parser_field_issues(C.parser_tree(parser_rows(spark, sf), ["rule"]), ["rule"])


@register("editor_validate", lambda: f"SELECT rule, ord, 'Empty expression' AS message FROM {parser_rows_sql()} WHERE value = ''")
def q_editor_validate(spark, sf):
    """Authoring rows that the rule editor rejects."""
    return C.editor_issues(parser_rows(spark, sf), ["rule"])


#: Expression key of the inner field of a derived tree, by ``p_size``, beside its type in LEAF_TYPES.
TREE_KEYS = ["xpath", "css", "xpath", "css", "loop", "xpath"]


@register(
    "tree_field_validate",
    lambda: f"""
      WITH t AS (SELECT p_partkey AS id, p_size, list_transform([1, 2], lambda i: coalesce(string_split(lower(p_type), ' ')[i], 'x')) AS w, {[*LEAF_TYPES]}[p_size % 6 + 1] AS t,
                        {[*TREE_KEYS]}[p_size % 6 + 1] AS k FROM part)
      SELECT id, 's.parser.' || w[1] AS path, CASE WHEN p_size % 9 = 0 THEN 'warning' ELSE 'error' END AS severity,
             'parser-' || w[1] || '.child ' || CASE WHEN p_size % 9 = 0 THEN 'lose' ELSE 'type error' END AS message, true AS counted
      FROM t WHERE p_size % 9 < 2
      UNION ALL
      SELECT id, 's.parser.' || w[1] || '.' || w[2], 'error', 'Necessary part parser-' || w[2] || ' lose', true FROM t WHERE p_size % 9 = 2
      UNION ALL
      SELECT id, 's.parser.' || w[1] || '.' || w[2], 'warning', 'Unknown parser type ''mystery''', false FROM t WHERE p_size % 9 > 2 AND t = 'mystery'
      UNION ALL
      SELECT id, 's.parser.' || w[1] || '.' || w[2], 'error',
             CASE WHEN p_size % 5 = 0 THEN 'Necessary part parser-' || w[2] || '.' || k || ' lose' ELSE 'parser-' || w[2] || '.' || k || ' type error' END, true
      FROM t WHERE p_size % 9 > 2 AND p_size % 5 < 2 AND t <> 'mystery'
      UNION ALL
      SELECT id, 's.parser.' || w[1] || '.' || w[2], 'warning', 'parser-' || w[2] || '.child lose', true FROM t WHERE p_size % 9 > 2 AND t = 'loop'""",
)
def q_tree_field_validate(spark, sf):
    """Compiled parsers, one per part: every field judged down the ``child`` objects, missing and mistyped ones among them."""
    p = deal(_words(spark, sf))
    size = F.col("p_size")
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (size % 6 + 1).cast("int"))
    expr = F.when(size % 5 == 0, "null").when(size % 5 == 1, "7").otherwise('"./a"')
    inner = F.when(size % 9 == 2, "null").otherwise(F.format_string('{"type":"%s","%s":%s}', pick(LEAF_TYPES), pick(TREE_KEYS), expr))
    child = F.when(size % 9 == 0, "null").when(size % 9 == 1, "[]").otherwise(F.format_string('{"%s":%s}', F.col("w2"), inner))
    tree = F.format_string('{"%s":{"type":"xpath-loop","xpath":"//section","child":%s}}', F.col("w1"), child)
    return p.select(F.col("p_partkey").alias("id"), F.inline(C.parser_issue_array(F.parse_json(tree))))


# -- whole rules as JSON ---------------------------------------------------------

def rules(spark, sf):
    """One rule JSON per part (id = p_partkey), with two stages."""
    p = deal(table(spark, sf, "part", "p_partkey", "p_brand", "p_type", "p_size", "p_name"))
    w = F.split(F.concat(F.lower("p_type"), F.lit(" x x")), " ")
    rows = F.array(
        F.struct(F.lit("s.parser").alias("loc"), F.try_element_at(w, F.lit(1)).alias("name"), F.lit("xpath-loop").alias("type"),
                 F.lit("//section").alias("value"), F.lit(None).cast("string").alias("next")),
        F.struct(F.concat(F.lit("s.parser."), F.try_element_at(w, F.lit(1))).alias("loc"), F.try_element_at(w, F.lit(2)).alias("name"),
                 F.lit("xpath").alias("type"), F.when(F.col("p_size") % 5 != 0, F.lit("./a/@href")).alias("value"),
                 F.lit("detail").alias("next")),
    )
    size = F.col("p_size")
    header = F.when(size % 3 == 0, F.struct(F.array().cast("array<string>").alias("external"), F.create_map().cast("map<string,string>").alias("loop")))
    request = F.struct(
        F.when(size % 7 != 0, F.concat(F.lit("https://shop.example.com/"), F.lower("p_brand"))).alias("url"),
        F.when(size % 2 == 0, F.lit("GET")).alias("method"),
    )
    list_stage = F.struct(
        F.lit("list").alias("name"), header.alias("header"), request.alias("request"), rows.alias("parser"),
        F.when(size % 4 != 0, F.lit(True)).alias("remove_repeats"),
    )
    detail_stage = F.struct(
        F.lit("detail").alias("name"),
        F.struct(F.lit("{{s.detail_url}}").alias("url")).alias("request"),
        F.when(size % 11 != 0, F.array().cast("array<struct<loc:string>>")).alias("parser"),
        F.lit(True).alias("auto_parse_body"), F.lit(False).alias("need_refresh"),
        F.when(size % 6 == 0, F.lit("yes")).alias("remove_repeats"),  # a wrong type on purpose
    )
    common = F.struct(
        (size % 2 == 0).alias("is_static"), (size % 7 - 2).alias("depth_limit"),
        F.when(size % 3 == 0, F.lit("")).otherwise(F.concat(F.lit('{"q":"'), F.try_element_at(F.split("p_name", " "), F.lit(1)), F.lit('"}'))).alias("external_def"),
        (size % 4 - 1).cast("double").alias("request_interval"), (size % 3 - 1).alias("retry_times"),
    )
    flt = F.struct(F.when(size % 5 != 0, F.lit(0.05)).alias("title_threshold"), F.when(size % 4 != 0, F.lit(0.1)).alias("content_threshold"),
                   F.create_map(F.try_element_at(w, F.lit(1)), F.lit(0.6), F.try_element_at(w, F.lit(3)), F.lit(0.4)).alias("weight_dict"))
    rule = F.to_json(F.struct(F.col("p_brand").alias("tag"), common.alias("common"), flt.alias("filter"),
                              F.array(F.to_json(list_stage), F.to_json(detail_stage)).alias("_stages")))
    return p.select(F.col("p_partkey").alias("id"), (size % 2 == 0).alias("scheduled"), rule.alias("rule_raw"), "p_size")


def stages_sql() -> str:
    """``(id, stage_idx, stage JSON)``: the two stages of each part's rule (JSON
    nulls where the Spark side omits a key; both mean "missing" to the checks)."""
    return """(
      SELECT p_partkey AS id, 0 AS stage_idx, json_object(
          'name', 'list',
          'header', CASE WHEN p_size % 3 = 0 THEN json_object('external', json('[]'), 'loop', json('{}')) END,
          'request', json_object('url', CASE WHEN p_size % 7 <> 0 THEN 'https://shop.example.com/' || lower(p_brand) END,
                                 'method', CASE WHEN p_size % 2 = 0 THEN 'GET' END),
          'parser', json('[{"loc":"s.parser"},{"loc":"x"}]'),
          'remove_repeats', CASE WHEN p_size % 4 <> 0 THEN true END) AS stage FROM part
      UNION ALL
      SELECT p_partkey, 1, json_object(
          'name', 'detail',
          'request', json_object('url', '{{s.detail_url}}'),
          'parser', CASE WHEN p_size % 11 <> 0 THEN json('[]') END,
          'auto_parse_body', true, 'need_refresh', false,
          'remove_repeats', CASE WHEN p_size % 6 = 0 THEN 'yes' END) FROM part)"""


def _jtype(path: str) -> str:
    t = f"json_type(stage, '{path}')"
    return (f"(CASE WHEN {t} IS NULL OR {t} = 'NULL' THEN NULL WHEN {t} = 'OBJECT' THEN 'dict' "
            f"WHEN {t} = 'ARRAY' THEN 'list' WHEN {t} = 'VARCHAR' THEN 'str' WHEN {t} = 'BOOLEAN' THEN 'bool' "
            f"ELSE 'number' END)")


def issues_sql() -> str:
    """The stage checks restated in SQL over the JSON text."""
    ok = {}
    parts = []
    for ord_, path, name, typ, necessary, parent in C.STAGE_CHECKS:
        t = _jtype(path)
        gate = ok[parent] if parent is not None else "true"
        fits = f"{t} IN ({', '.join(S.q(x) for x in typ.split('|'))})"
        ok[ord_] = f"({gate} AND {t} IS NOT NULL AND {fits})"
        sev = "error" if necessary else "warning"
        msg = f"Necessary part {name} lose" if necessary else f"{name} lose"
        parts.append(
            f"SELECT id, stage_idx, {ord_} AS ord, '{name}' AS field, "
            f"CASE WHEN {t} IS NULL THEN '{sev}' ELSE 'error' END AS severity, "
            f"CASE WHEN {t} IS NULL THEN '{msg}' ELSE '{name} type error' END AS message "
            f"FROM {stages_sql()} WHERE {gate} AND ({t} IS NULL OR NOT {fits})"
        )
    return "(" + " UNION ALL ".join(parts) + ")"


def _stage_texts():
    """The stage texts of a rule, read off its JSON in one pass."""
    return F.from_json("rule_raw", "_stages array<string>")["_stages"]


def _stages(spark, sf):
    r = rules(spark, sf)
    return r.select("id", F.posexplode(_stage_texts()).alias("stage_idx", "stage_json")).select(
        "id", "stage_idx", F.parse_json("stage_json").alias("stage")
    )


@register(
    "config_defaults",
    """SELECT p_partkey AS id, p_size % 2 = 0 AS is_static,
              CASE WHEN p_size % 7 - 2 > 0 THEN p_size % 7 - 2 ELSE 5 END AS depth_limit,
              CASE WHEN p_size % 4 - 1 > 0 THEN (p_size % 4 - 1)::DOUBLE END AS request_interval,
              CASE WHEN p_size % 3 - 1 > 0 THEN p_size % 3 - 1 END AS retry_times,
              CASE WHEN p_size % 3 = 0 THEN '{}' ELSE '{"q":"' || string_split(p_name, ' ')[1] || '"}' END AS external_def,
              CASE WHEN p_size % 5 <> 0 THEN 0.05::DOUBLE ELSE 0::DOUBLE END AS title_threshold,
              CASE WHEN p_size % 4 <> 0 THEN 0.1::DOUBLE ELSE 0::DOUBLE END AS content_threshold
       FROM part""",
)
def q_config_defaults(spark, sf):
    r = rules(spark, sf)
    common = F.from_json(
        F.get_json_object("rule_raw", "$.common"),
        "is_static boolean, depth_limit int, external_def string, request_interval double, retry_times int",
    )
    flt = F.from_json(F.get_json_object("rule_raw", "$.filter"), "title_threshold double, content_threshold double")
    d = C.config_defaults(common, flt)
    return r.select("id", *[d[k].alias(k) for k in (
        "is_static", "depth_limit", "request_interval", "retry_times", "external_def", "title_threshold", "content_threshold")])


def _sorted_sql(*cases: str) -> str:
    """The keys that are there, sorted and joined; a case is a key or ``condition: key``."""
    items = [f"CASE WHEN {c.split(': ')[0]} THEN '{c.split(': ')[1]}' END" if ": " in c else f"'{c}'" for c in cases]
    return f"array_to_string(list_sort(list_filter([{', '.join(items)}], lambda k: k IS NOT NULL)), ',')"


@register(
    "corrected_stage",
    lambda: f"""SELECT p_partkey AS id, 0 AS stage_idx,
                       {_sorted_sql('name', 'parser', 'request', 'ok OR p_size % 3 = 0: header', 'ok OR p_size % 4 <> 0: remove_repeats', 'ok: need_refresh')} AS keys,
                       {_sorted_sql('ok: url', 'ok OR p_size % 2 = 0: method', 'ok: headers', 'ok: cookies')} AS request_keys,
                       CASE WHEN ok OR p_size % 3 = 0 THEN '{{"external":[],"loop":{{}}}}' END AS header,
                       CASE WHEN ok OR p_size % 4 <> 0 THEN 'true' END AS remove_repeats, CASE WHEN ok THEN 'false' END AS need_refresh,
                       2 AS n_fields, lower(split_part(p_type, ' ', 1)) AS first_field
                FROM (SELECT *, p_size % 7 <> 0 AS ok FROM part)
                UNION ALL
                SELECT p_partkey, 1,
                       {_sorted_sql('auto_parse_body', 'name', 'need_refresh', 'request', 'p_size % 11 <> 0: parser', 'ok: header', 'ok OR p_size % 6 = 0: remove_repeats')},
                       {_sorted_sql('url', 'ok: method', 'ok: headers', 'ok: cookies')},
                       CASE WHEN ok THEN '{{"external":[],"loop":{{}}}}' END,
                       CASE WHEN p_size % 6 = 0 THEN 'yes' WHEN ok THEN 'true' END, 'false',
                       CASE WHEN p_size % 11 <> 0 THEN 0 END, NULL
                FROM (SELECT *, p_size % 11 <> 0 AND p_size % 6 <> 0 AS ok FROM part)""",
)
def q_corrected_stage(spark, sf):
    """Every stage as correct mode returns it: which keys it has, and what the filled ones hold."""
    st = _stages(spark, sf)
    errors = C.stage_verdicts(st.withColumn("text", F.to_json("stage")), "stage")
    c = errors.select("id", "stage_idx", C.corrected_stage(F.col("text"), F.col("errors")).alias("c"))
    keys = lambda j: F.array_join(F.array_sort(F.json_object_keys(j)), ",")
    get = lambda p: F.get_json_object("c", p)
    return c.select(
        "id", "stage_idx", keys(F.col("c")).alias("keys"), keys(get("$.request")).alias("request_keys"), get("$.header").alias("header"),
        get("$.remove_repeats").alias("remove_repeats"), get("$.need_refresh").alias("need_refresh"),
        F.json_array_length(get("$.parser")).alias("n_fields"), get("$.parser[0].name").alias("first_field"))


@register("config_compile", lambda: f"SELECT * FROM {parser_tree_sql(compile_rows_sql(), 'id, stage_idx')}")
def q_config_compile(spark, sf):
    """All stages of every rule: stage parser rows → resolved tree per (rule, stage)."""
    return _compiled(_stages(spark, sf).select("id", "stage_idx", _authored("stage").alias("rows")))


def _authored(stage: str):
    """The parser rows of a stage."""
    return F.from_json(F.to_json(F.try_variant_get(stage, "$.parser", "variant")), C.PARSER_ROWS)


def _compiled(stages):
    rows = stages.select("id", "stage_idx", F.posexplode("rows").alias("ord", "r")).select("id", "stage_idx", "ord", "r.*")
    return C.parser_tree(rows, ["id", "stage_idx"])


def _issues(spark, sf):
    return C.stage_issues(_stages(spark, sf), "stage")


@register("config_validate", lambda: f"SELECT * FROM {issues_sql()}")
def q_config_validate(spark, sf):
    return _issues(spark, sf)


def _parser_counts_sql() -> str:
    issues = parser_issues_sql(parser_tree_sql(compile_rows_sql(), "id, stage_idx"), "id, stage_idx")
    return f"""(SELECT id, count(*) FILTER (WHERE counted AND severity = 'error') AS errors,
                       count(*) FILTER (WHERE counted AND severity = 'warning') AS warnings FROM ({issues}) GROUP BY id)"""


@register(
    "config_verdict",
    lambda: f"""SELECT v.id, v.errors + coalesce(p.errors, 0) AS errors, v.warnings + coalesce(p.warnings, 0) AS warnings,
                       v.errors + coalesce(p.errors, 0) = 0 AND v.warnings + coalesce(p.warnings, 0) = 0 AS check_pass,
                       v.errors + coalesce(p.errors, 0) = 0 AS correct_pass
                FROM (SELECT s.id, count(i.severity) FILTER (WHERE i.severity = 'error') AS errors,
                             count(i.severity) FILTER (WHERE i.severity = 'warning') AS warnings
                      FROM {stages_sql()} s LEFT JOIN {issues_sql()} i ON i.id = s.id AND i.stage_idx = s.stage_idx
                      GROUP BY s.id) v LEFT JOIN {_parser_counts_sql()} p ON p.id = v.id""",
)
def q_config_verdict(spark, sf):
    """Per rule: counts of stage and parser-field issues, and pass flags over both, in the rule's own row."""
    r = rules(spark, sf)
    # named twice, the texts keep a projection of their own: below a lambda their expressions would not be compiled
    r, texts = r.select("id", _stage_texts().alias("texts")), F.col("texts")
    verdict = F.when(texts.isNotNull(), C.stages_verdict(F.transform(texts, F.parse_json)))
    return r.select("id", verdict.alias("v")).select("id", "v.*")


def _log_sql(mode: str) -> str:
    fields = parser_issues_sql(parser_tree_sql(compile_rows_sql(), "id, stage_idx"), "id, stage_idx")
    fill = "" if mode == "CHECK" else """
        UNION ALL SELECT id, stage_idx, ord, '', 1, 'INFO - Autofill ' || field || ' with default' FROM issues WHERE severity = 'warning'"""
    return f"""
      WITH stages AS (SELECT id, stage_idx, coalesce(json_extract_string(stage, '$.name'), 'Untitled Stage') AS name FROM {stages_sql()}),
      issues AS (SELECT * FROM {issues_sql()}), fields AS ({fields}),
      counts AS (SELECT id, stage_idx, count(*) FILTER (WHERE severity = 'error') AS e, count(*) FILTER (WHERE severity = 'warning') AS w
                 FROM (SELECT id, stage_idx, severity FROM issues UNION ALL SELECT id, stage_idx, severity FROM fields WHERE counted) GROUP BY id, stage_idx),
      lines(id, stage_idx, ord, path, sub, line) AS (
        SELECT DISTINCT id, -1, 0, '', 0, 'INFO - Validation initiate with mode {mode}.' FROM stages
        UNION ALL SELECT id, stage_idx, 0, '', 0, 'INFO - Stage ' || name || ' validation start.' FROM stages
        UNION ALL SELECT id, stage_idx, ord, '', 0, upper(severity) || ' - ' || message FROM issues
        UNION ALL SELECT id, stage_idx, {C.PARSER_ORD}, path, 0, upper(severity) || ' - ' || message FROM fields
        UNION ALL SELECT s.id, s.stage_idx, {C.END_ORD}, '', 0,
               CASE WHEN coalesce(e, 0) = 0 AND coalesce(w, 0) = 0 THEN 'INFO - Stage ' || name || ' validation pass.'
                    ELSE 'INFO - Stage ' || name || ' validation end. Result:  Error: ' || coalesce(e, 0) || '  Warning: ' || coalesce(w, 0) END
               FROM stages s LEFT JOIN counts c ON c.id = s.id AND c.stage_idx = s.stage_idx{fill})
      SELECT id, '{mode}' AS mode, string_agg(line, chr(10) ORDER BY stage_idx, ord, path, sub, line) AS log FROM lines GROUP BY id"""


@register("config_issue_log", lambda: f"SELECT * FROM ({_log_sql('CHECK')}) UNION ALL SELECT * FROM ({_log_sql('CORRECT')})")
def q_config_issue_log(spark, sf):
    """One log text per rule and mode: opening, stage, issue, autofill and closing lines."""
    stages = _stages(spark, sf).select(
        "id", "stage_idx", "stage", F.try_variant_get("stage", "$.name", "string").alias("name"), _authored("stage").alias("rows"))
    # every stage is derived once; what is kept of it are few distinct texts, which columns store small
    path = new_scratch_path(spark, "stages")
    C.stages_with_issues(stages).write.parquet(path)
    stages = spark.read.parquet(path)
    fields = C.parser_field_issues(_compiled(stages), ["id", "stage_idx"])
    return C.issue_log(stages.drop("rows"), fields, ("CHECK", "CORRECT"))


# -- entrances, JSON checks, key/value forms -------------------------------------

def _entrances_sql() -> str:
    return """(SELECT event_id,
                 CASE WHEN value >= 10 THEN event_type || '-' || event_id END AS entrance_name,
                 CASE event_type WHEN 'view' THEN 'list' WHEN 'click' THEN 'detail' WHEN 'purchase' THEN 'checkout' END AS stage_name,
                 CASE WHEN event_type = 'error' THEN '{' || props WHEN event_type = 'signup' THEN '' ELSE props END AS external
               FROM events)"""


def _entrances(spark, sf):
    e = table(spark, sf, "events", "event_id", "event_type", "value", "props")
    return e.select(
        "event_id",
        F.when(F.col("value") >= 10, F.concat("event_type", F.lit("-"), F.col("event_id").cast("string"))).alias("entrance_name"),
        F.when(F.col("event_type") == "view", "list").when(F.col("event_type") == "click", "detail")
        .when(F.col("event_type") == "purchase", "checkout").alias("stage_name"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("{"), "props"))
        .when(F.col("event_type") == "signup", F.lit("")).otherwise(F.col("props")).alias("external"),
    )


@register(
    "json_check",
    lambda: f"""SELECT event_id, CASE WHEN coalesce(external, '') = '' THEN '{{}}'
                                      WHEN json_valid(external) THEN external END AS checked
                FROM {_entrances_sql()}""",
)
def q_json_check(spark, sf):
    return _entrances(spark, sf).select("event_id", C.json_check("external").alias("checked"))


STAGE_NAMES = [("list",), ("detail",)]


@register(
    "entrance_check",
    lambda: f"""SELECT event_id, entrance_name,
                  CASE WHEN entrance_name IS NULL THEN 'entrance_name not found'
                       WHEN stage_name IS NULL THEN 'stage_name not found'
                       WHEN stage_name NOT IN ('list', 'detail') THEN 'config not found'
                       WHEN NOT (coalesce(external, '') = '' OR json_valid(external)) THEN 'External json decode fail'
                  END AS rejection,
                  CASE WHEN coalesce(external, '') = '' THEN '{{}}' WHEN json_valid(external) THEN external END AS external
                FROM {_entrances_sql()}""",
)
def q_entrance_check(spark, sf):
    """Accepted entrances (``rejection`` null) and typed rejections."""
    from pagesift.functions.joins import param_frame

    e = _entrances(spark, sf)
    stages = param_frame(spark, STAGE_NAMES, "stage_name STRING").withColumn("_known", F.lit(True))
    j = e.join(stages, "stage_name", "left")
    checked = C.json_check(F.col("external"))
    rejection = (
        F.when(F.col("entrance_name").isNull(), "entrance_name not found")
        .when(F.col("stage_name").isNull(), "stage_name not found")
        .when(F.col("_known").isNull(), "config not found")
        .when(checked.isNull(), "External json decode fail")
    )
    return j.select("event_id", "entrance_name", rejection.alias("rejection"), checked.alias("external"))


@register(
    "drop_blank_items",
    "SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: x IS NOT NULL AND x <> '')) AS n_items FROM documents",
)
def q_drop_blank_items(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "text")
    return d.select("doc_id", F.size(C.drop_blank_items(F.split("text", "\n"))).alias("n_items"))


@register(
    "kv_to_map",
    """SELECT conv_id, turn, '{"text":' || to_json(text) || ',"turn":"' || turn || '","' || role || '":"last"}' AS obj FROM conversations""",
)
def q_kv_to_map(spark, sf):
    """Key/value lists with a repeated key (last wins) → JSON objects."""
    c = table(spark, sf, "conversations", "conv_id", "turn", "role", "text")
    entries = F.array(
        F.struct(F.col("role").alias("key"), F.lit("first").alias("value")),
        F.struct(F.lit("text").alias("key"), F.col("text").alias("value")),
        F.struct(F.lit("turn").alias("key"), F.col("turn").cast("string").alias("value")),
        F.struct(F.col("role").alias("key"), F.lit("last").alias("value")),
    )
    return c.select("conv_id", "turn", F.to_json(C.kv_to_map(entries)).alias("obj"))


@register(
    "map_to_kv",
    """SELECT event_id, '' AS key, '' AS value FROM events WHERE event_type = 'signup'
       UNION ALL
       SELECT event_id, k AS key, json_extract_string(props, '$.' || k) AS value
       FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events WHERE event_type <> 'signup')""",
)
def q_map_to_kv(spark, sf):
    """JSON objects → key/value rows; an empty object gives one blank pair."""
    e = table(spark, sf, "events", "event_id", "event_type", "props")
    m = F.when(F.col("event_type") == "signup", F.create_map().cast("map<string,string>")).otherwise(
        F.from_json("props", "map<string,string>")
    )
    return e.select("event_id", F.inline(C.map_to_kv(m)))


# -- latest-by-key state ----------------------------------------------------------

@register(
    "config_latest",
    """SELECT user_id AS key, last(event_type ORDER BY ts, event_id) AS value, max(ts) AS updated FROM events
       GROUP BY user_id HAVING last(event_type ORDER BY ts, event_id) <> 'error'""",
)
def q_config_latest(spark, sf):
    """A keyed store from its change log: latest value per key (of equal times the last event), tombstones ('error') dropped."""
    e = table(spark, sf, "events", "event_id", "user_id", "ts", "event_type")
    latest = e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("value"), F.max("ts").alias("updated"))
    return latest.where(F.col("value") != "error").select(F.col("user_id").alias("key"), "value", "updated")


@register(
    "config_keys",
    "SELECT user_id AS key FROM events GROUP BY user_id HAVING last(event_type ORDER BY ts, event_id) <> 'error'",
)
def q_config_keys(spark, sf):
    return C.config_keys(q_config_latest(spark, sf))


@register(
    "config_get",
    lambda: f"""SELECT c_custkey AS key, coalesce(value, {S.q(C.NOT_FOUND["config"])}) AS value
                FROM customer LEFT JOIN (SELECT user_id, last(event_type ORDER BY ts, event_id) AS value FROM events
                                         GROUP BY user_id HAVING last(event_type ORDER BY ts, event_id) <> 'error') s
                  ON s.user_id = c_custkey""",
)
def q_config_get(spark, sf):
    """Every customer asks the store for the value of its own key."""
    asked = table(spark, sf, "customer", "c_custkey").select(F.col("c_custkey").alias("key"))
    return C.config_get(asked, q_config_latest(spark, sf), C.NOT_FOUND["config"])


@register(
    "run_log_latest",
    """SELECT user_id AS task_id,
              strftime(max(ts) FILTER (WHERE event_type = 'signup'), '%y/%m/%d/%H/%M/%S') AS lastruntime,
              last(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END ORDER BY ts, event_id) AS is_running
       FROM events WHERE event_type IN ('signup', 'purchase') GROUP BY user_id""",
)
def q_run_log_latest(spark, sf):
    """Task state from start ('signup') and end ('purchase') events."""
    e = table(spark, sf, "events", "event_id", "user_id", "ts", "event_type").where(F.col("event_type").isin("signup", "purchase"))
    start = F.col("event_type") == "signup"
    return e.groupBy(F.col("user_id").alias("task_id")).agg(
        F.date_format(F.max(F.when(start, F.col("ts"))), "yy/MM/dd/HH/mm/ss").alias("lastruntime"),
        F.max_by(F.when(start, 1).otherwise(0), F.struct("ts", "event_id")).alias("is_running"),
    )


@register(
    "rule_lookup",
    """SELECT l.l_orderkey, l.l_linenumber, p.p_partkey AS rule_id, p.p_brand AS tag
       FROM lineitem l LEFT JOIN part p ON p.p_partkey = l.l_partkey AND (p.p_size % 2 = 0) = (l.l_linenumber % 2 = 0)""",
)
def q_rule_lookup(spark, sf):
    """Every line item looks up the rule of its part in the one-off or scheduled set."""
    r = rules(spark, sf).select("id", "scheduled", F.get_json_object("rule_raw", "$.tag").alias("tag"))
    li = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey")
    req = li.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("id"), (F.col("l_linenumber") % 2 == 0).alias("scheduled"))
    j = req.join(r, ["id", "scheduled"], "left")
    return j.select("l_orderkey", "l_linenumber", F.when(F.col("tag").isNotNull(), F.col("id")).alias("rule_id"), "tag")


@register(
    "json_doc_load",
    """SELECT event_id, event_type, props, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') AS ts, user_id, value FROM events""",
)
def q_json_doc_load(spark, sf):
    """Events written as JSON documents, loaded back into a collection."""
    path = new_scratch_path(spark, "events-json")
    table(spark, sf, "events").write.mode("overwrite").json(path)
    return json_doc_load(spark, path, multi_line=False)


@register(
    "log_scan",
    "SELECT unnest(string_split(text, chr(10))) AS line FROM documents WHERE lang = 'en'",
)
def q_log_scan(spark, sf):
    """Latest-log lines of one entrance among several written logs."""
    base = new_scratch_path(spark, "logs")
    d = table(spark, sf, "documents", "lang", "text")
    lines = d.select("lang", F.explode(F.split("text", "\n")).alias("value"))
    for lang in ("en", "de"):
        sel = lines.where(F.col("lang") == lang).select("value")
        sel.write.mode("overwrite").text(f"{base}/task_{lang}_latest.log")
        sel.write.mode("overwrite").text(f"{base}/task_{lang}_old.log")
    return log_scan(spark, base, "task_en").select("line")
