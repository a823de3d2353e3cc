"""Config tables: parser rows → tree, validation issues, verdicts, defaults.

Rules are JSON text (``VARIANT`` once parsed); parser fields are kept in the
flat authoring form ``(loc, name, type, value, next)`` and the tree is
resolved set-wise: a field's path is ``loc.name``, the first row per path
wins, and a row is *reached* when every proper prefix of its ``loc`` is the
path of a winning loop-type field.  That is one explode + equi-join +
aggregate — no recursion, no driver loop.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagesift.functions.text import bound

ROOT_LOC = "s.parser"
LOOP_TYPES = ("loop", "xpath-loop", "css-loop")
FIELD_TYPES = LOOP_TYPES + ("xpath", "css", "xpath-list", "css-list")

PARSER_ROW = T.StructType([T.StructField(n, T.StringType()) for n in ("loc", "name", "type", "value", "next")])


def parser_tree(rows: DataFrame, group_cols: list[str], ord_col: str = "ord") -> DataFrame:
    """Resolve flat parser rows into the reached fields of the tree.

    Output per group: ``path, loc, name, depth, type, xpath, css, loop, next``.
    Value goes to ``xpath``/``css``/``loop`` by type prefix; loops carry no
    ``next`` (they have children), leaves carry no children.
    """
    g = list(group_cols)
    r = rows.withColumn("path", F.concat_ws(".", "loc", "name"))
    # First row per path: min_by aggregates partially before the shuffle, so a
    # path repeated in a third of all rows still spreads over the map tasks.
    cols = [c for c in r.columns if c not in (*g, "path")]
    win = r.groupBy(*g, "path").agg(F.min_by(F.struct(*cols), F.col(ord_col)).alias("_w")).select(*g, "path", "_w.*")
    # Proper prefixes of loc below the root: s.parser.a, s.parser.a.b, …
    parts = F.split(F.col("loc"), "\\.")
    n_root = len(ROOT_LOC.split("."))
    k = F.size(parts) - n_root  # number of prefixes to check
    prefixes = F.transform(
        F.sequence(F.lit(n_root + 1), F.greatest(F.size(parts), F.lit(n_root + 1))),
        lambda i: F.array_join(F.slice(parts, 1, i), "."),
    )
    rooted = (F.col("loc") == ROOT_LOC) | F.col("loc").startswith(ROOT_LOC + ".")
    # ``(group, path)`` is unique after the aggregate, so it names the row.
    cand = win.where(rooted).withColumn("_k", k)
    need = cand.where(F.col("_k") > 0).select(
        *g, F.col("path").alias("_of"), F.explode(F.slice(prefixes, 1, F.col("_k"))).alias("path")
    )
    loops = win.where(F.col("type").isin(*LOOP_TYPES)).select(*g, "path").withColumn("_ok", F.lit(1))
    have = need.join(loops, [*g, "path"], "left").groupBy(*g, "_of").agg(F.count("*").alias("_n"), F.sum("_ok").alias("_m"))
    have = have.withColumnRenamed("_of", "path")
    reached = cand.join(have, [*g, "path"], "left").where((F.col("_k") == 0) | (F.col("_n") == F.col("_m")))
    t = F.col("type")
    return reached.select(
        *g, "path", "loc", "name", (F.col("_k") + 1).alias("depth"), "type",
        F.when(t.startswith("xpath"), F.col("value")).alias("xpath"),
        F.when(t.startswith("css"), F.col("value")).alias("css"),
        F.when(~t.startswith("xpath") & ~t.startswith("css"), F.col("value")).alias("loop"),
        F.when(~t.isin(*LOOP_TYPES), F.col("next")).alias("next"),
    )


def rows_at_loc(rows: DataFrame, target: str, key: str = "loc") -> DataFrame:
    return rows.where(F.col(key) == F.lit(target))


def path_rename(rows: DataFrame, loc: str, old: str, new: str) -> DataFrame:
    """Rename field ``old`` at ``loc`` to ``new`` and move its descendants' ``loc``."""
    target = f"{loc}.{old}"
    moved = (F.col("loc") == target) | F.col("loc").startswith(target + ".")
    new_loc = F.concat(F.lit(f"{loc}.{new}"), F.expr(f"substring(loc, {len(target) + 1})"))
    renamed = (F.col("loc") == loc) & (F.col("name") == old)
    return rows.withColumn("name", F.when(renamed, F.lit(new)).otherwise(F.col("name"))).withColumn(
        "loc", F.when(moved, new_loc).otherwise(F.col("loc"))
    )


def kv_to_map(entries) -> Column:
    """``array<struct<key,value>>`` → map; the last duplicate key wins."""
    e = F.col(entries) if isinstance(entries, str) else entries
    n = F.size(e)
    last = F.filter(e, lambda x, i: ~F.exists(F.slice(e, i + 2, n), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(last)


def map_to_kv(m) -> Column:
    """Map → ``array<struct<key,value>>``; an empty map gives one blank pair."""
    m = F.col(m) if isinstance(m, str) else m
    blank = F.array(F.struct(F.lit("").alias("key"), F.lit("").alias("value")))
    return F.when(F.size(m) > 0, F.map_entries(m)).otherwise(blank)


def drop_blank_items(arr) -> Column:
    a = F.col(arr) if isinstance(arr, str) else arr
    return F.filter(a, lambda x: x.isNotNull() & (x != ""))


def json_check(s) -> Column:
    """'' or null → '{}', valid JSON → itself, invalid → null (rejected)."""
    s = F.col(s) if isinstance(s, str) else s
    return F.when(F.coalesce(s, F.lit("")) == "", F.lit("{}")).when(F.try_parse_json(s).isNotNull(), s)


# -- the keyed store ------------------------------------------------------------

# What a get answers for a key that the store does not have.
NOT_FOUND = {
    "stage": '{"error": "Stage not found"}',
    "config": '{"error": "Config not found. Check stage settings again."}',
    "validation": "Validator not found. Please validate config first.",
}


def config_keys(store: DataFrame, key: str = "key") -> DataFrame:
    """The names in a store, each once."""
    return store.select(key).distinct()


def config_get(requests: DataFrame, store: DataFrame, default: str, key: str = "key", value: str = "value") -> DataFrame:
    """Every request with the stored value of its key, or ``default``; a null key is not found."""
    return requests.join(store.select(key, value), key, "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


# -- validation ----------------------------------------------------------------

# The kind of a JSON value by the two letters its schema begins with; JSON null (VOID) is not among them.
_KINDS = {"ST": "str", "OB": "dict", "AR": "list", "BO": "bool"} | dict.fromkeys(("BI", "DE", "DO", "DA", "TI", "FL", "IN", "SM", "UU", "YE"), "number")


def _kind(v: Column) -> Column:
    """'dict' | 'list' | 'str' | 'bool' | 'number' | None (missing or JSON null) of a VARIANT.

    It stands once in the expression: within a lambda a repeated expression is computed again.
    """
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in _KINDS.items() for x in kv]), F.substring(F.schema_of_variant(v), 1, 2))


def _vtype(v: Column, path: str) -> Column:
    """The kind of the value at ``path``, which is looked up once."""
    return _kind(F.try_variant_get(v, path, "variant"))


def _members(v: Column, names) -> Column:
    """The named members of a VARIANT object as a struct of VARIANTs, found in one pass over its keys (a path
    lookup reads all keys up to its own); null for anything else."""
    return F.try_variant_get(v, "$", f"struct<{', '.join(f'{n}:variant' for n in names)}>")


# (ord, json path, display name, accepted types, necessary, parent check ord or None);
# a parser is the compiled tree (dict) or its authoring rows (list).
STAGE_CHECKS = [
    (1, "$.header", "header", "dict", False, None),
    (2, "$.header.external", "header.external", "list", False, 1),
    (3, "$.header.loop", "header.loop", "dict", False, 1),
    (4, "$.request", "request", "dict", True, None),
    (5, "$.request.url", "request.url", "str", True, 4),
    (6, "$.request.method", "request.method", "str", False, 4),
    (7, "$.request.headers", "request.headers", "dict", False, 4),
    (8, "$.request.cookies", "request.cookies", "dict", False, 4),
    (9, "$.parser", "parser", "dict|list", True, None),
    (11, "$.remove_repeats", "remove_repeats", "bool", False, None),
    (12, "$.need_refresh", "need_refresh", "bool", False, None),
]


def _with_types(stages: DataFrame, stage_col: str) -> DataFrame:
    """One column per checked key with the JSON type found there (computed once)."""
    v = F.col(stage_col)
    return stages.select("*", *[_vtype(v, path).alias(f"_t{o}") for o, path, *_ in STAGE_CHECKS])


def stage_issue_array(kind=lambda ord_: F.col(f"_t{ord_}")) -> Column:
    """``array<struct<ord, field, severity, message>>`` from the JSON type ``kind(ord)`` of every
    checked key, by default the ``_t*`` columns.

    Missing necessary key or wrong type → error; missing optional key →
    warning.  Children are checked only when their parent passed.
    """
    ok: dict[int, Column] = {}
    items = []
    for ord_, path, name, typ, necessary, parent in STAGE_CHECKS:
        t = kind(ord_)
        ok[ord_] = fits = t.isin(*typ.split("|"))
        sev_missing = "error" if necessary else "warning"
        msg_missing = f"Necessary part {name} lose" if necessary else f"{name} lose"
        found = (
            F.when(t.isNull(), F.struct(F.lit(ord_).alias("ord"), F.lit(name).alias("field"), F.lit(sev_missing).alias("severity"), F.lit(msg_missing).alias("message")))
            .when(~fits, F.struct(F.lit(ord_).alias("ord"), F.lit(name).alias("field"), F.lit("error").alias("severity"), F.lit(f"{name} type error").alias("message")))
        )
        items.append(found if parent is None else F.when(ok[parent], found))
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def stage_issues(stages: DataFrame, stage_col: str = "stage") -> DataFrame:
    """Issues of each stage row (``stage`` is a VARIANT): ``ord, field, severity, message``."""
    found = stages_with_issues(stages, stage_col)
    return found.select(*[c for c in found.columns if c != "issues"], F.inline("issues"))


def stages_with_issues(stages: DataFrame, stage_col: str = "stage") -> DataFrame:
    """Every stage row with the array ``issues`` in place of its stage: the rows of ``stage_issues`` before the explode."""
    from pagesift.functions.joins import spread

    keep = [c for c in stages.columns if c != stage_col]
    return _with_types(spread(stages), stage_col).select(*keep, stage_issue_array().alias("issues"))


def stage_verdicts(stages: DataFrame, stage_col: str = "stage") -> DataFrame:
    """Per stage row, computed in the row (no explode, no shuffle): error and
    warning counts and the pass flags of check and correct mode."""
    from pagesift.functions.joins import spread

    keep = [c for c in stages.columns if c != stage_col]
    x = _with_types(spread(stages), stage_col).select(*keep, stage_issue_array().alias("_i"))
    errors = F.size(F.filter("_i", lambda i: i["severity"] == "error"))
    warnings = F.size(F.filter("_i", lambda i: i["severity"] == "warning"))
    return x.select(*keep, errors.alias("errors"), warnings.alias("warnings")).select(
        *keep, "errors", "warnings",
        ((F.col("errors") == 0) & (F.col("warnings") == 0)).alias("check_pass"),
        (F.col("errors") == 0).alias("correct_pass"),
    )


def parser_field_issues(tree: DataFrame, group_cols: list[str]) -> DataFrame:
    """Issues of resolved parser fields: type present, expression present,
    unknown type → an uncounted warning."""
    t = F.col("type")
    expr_val = (
        F.when(t.isin("loop"), F.col("loop"))
        .when(t.startswith("xpath"), F.col("xpath"))
        .when(t.startswith("css"), F.col("css"))
    )
    key = F.when(t == "loop", F.lit("loop")).when(t.startswith("xpath"), F.lit("xpath")).otherwise(F.lit("css"))
    field = F.concat(F.lit("parser-"), F.col("name"))
    issue = (
        F.when(t.isNull(), F.struct(F.lit("error").alias("severity"), F.concat(F.lit("Necessary part "), field, F.lit(".type lose")).alias("message"), F.lit(True).alias("counted")))
        .when(~t.isin(*FIELD_TYPES), F.struct(F.lit("warning").alias("severity"), F.concat(F.lit("Unknown parser type '"), t, F.lit("'")).alias("message"), F.lit(False).alias("counted")))
        .when(expr_val.isNull(), F.struct(F.lit("error").alias("severity"), F.concat(F.lit("Necessary part "), field, F.lit("."), key, F.lit(" lose")).alias("message"), F.lit(True).alias("counted")))
    )
    out = tree.select(*group_cols, "path", issue.alias("i")).where(F.col("i").isNotNull())
    return out.select(*group_cols, "path", "i.severity", "i.message", "i.counted")


PARSER_ROWS = "array<struct<loc:string,name:string,type:string,value:string,next:string>>"


def reached_rows(rows: Column) -> Column:
    """The reached rows of one array of parser rows, ``array<struct<path, loc, name, type, value, next>>`` in the
    order of the rows: the first row of a path wins, and all proper prefixes of its ``loc`` are paths of loops.

    A row's path is put together once; places are looked up only where a path comes
    twice.  A null array gives null.
    """
    n_root = len(ROOT_LOC.split("."))

    def reached(r: Column, loops: Column) -> Column:
        def prefixes(parts: Column) -> Column:
            return F.transform(F.sequence(F.lit(n_root + 1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))

        under = bound(F.split(r["loc"], "\\."), lambda parts: F.size(F.array_except(prefixes(parts), loops)) == 0)
        return F.when(r["loc"] == ROOT_LOC, True).when(r["loc"].startswith(ROOT_LOC + "."), under).otherwise(False)

    def tree(won: Column) -> Column:
        loops = F.filter(won, lambda r: r["type"].isin(*LOOP_TYPES))["path"]
        return bound(loops, lambda ls: F.filter(won, lambda r: reached(r, ls)))

    keyed = F.transform(rows, lambda r: F.struct(
        F.concat_ws(".", r["loc"], r["name"]).alias("path"), *[r[n].alias(n) for n in PARSER_ROW.names]))

    def first(ks: Column, paths: Column) -> Column:
        return F.when(F.size(F.array_distinct(paths)) == F.size(paths), ks).otherwise(
            F.filter(ks, lambda r, i: F.array_position(paths, r["path"]) == i + 1))

    return bound(keyed, lambda ks: bound(ks["path"], lambda paths: bound(first(ks, paths), tree)))


def tree_in_row(rows: Column) -> Column:
    """``parser_tree`` of one array of parser rows, within its row: no explode, no join.

    ``array<struct<path, loc, name, depth, type, xpath, css, loop, next>>`` of the
    ``reached_rows``.  Work per row of the table grows with the square of one
    parser's fields, not with the table.  A null array gives null.
    """
    n_root = len(ROOT_LOC.split("."))

    def field(r: Column) -> Column:
        t, value = r["type"], r["value"]
        is_xpath, is_css = t.startswith("xpath"), t.startswith("css")
        return F.struct(
            r["path"].alias("path"), r["loc"].alias("loc"), r["name"].alias("name"),
            (F.size(F.split(r["loc"], "\\.")) - n_root + 1).alias("depth"), t.alias("type"),
            F.when(is_xpath, value).alias("xpath"), F.when(is_css, value).alias("css"),
            F.when(~is_xpath & ~is_css, value).alias("loop"), F.when(~t.isin(*LOOP_TYPES), r["next"]).alias("next"))

    return F.transform(reached_rows(rows), field)


def tree_fields(parser: Column) -> Column:
    """All fields of a compiled parser (a VARIANT object) as ``array<struct<path, name, v>>``, outer ones first.

    The tree is walked level by level within the row, down the ``child`` objects of
    its loops, whatever its depth: no more levels than the text names ``child``.
    A parser that is no object has no fields.
    """
    none = F.array().cast("array<struct<path:string,name:string,v:variant>>")

    def members(prefix: Column, obj: Column) -> Column:
        entries = F.map_entries(F.try_variant_get(obj, "$", "map<string,variant>"))
        return F.coalesce(F.transform(entries, lambda e: F.struct(
            F.concat(prefix, F.lit("."), e["key"]).alias("path"), e["key"].alias("name"), e["value"].alias("v"))), none)

    def below(f: Column) -> Column:
        loop = F.try_variant_get(f["v"], "$.type", "string").isin(*LOOP_TYPES)
        return F.when(loop, members(f["path"], F.try_variant_get(f["v"], "$.child", "variant"))).otherwise(none)

    levels = F.sequence(F.lit(1), F.coalesce(F.size(F.split(F.to_json(parser), '"child"')), F.lit(1)))
    return F.aggregate(
        levels, F.struct(none.alias("done"), members(F.lit(ROOT_LOC), parser).alias("level")),
        lambda acc, _: F.struct(F.concat(acc["done"], acc["level"]).alias("done"), F.flatten(F.transform(acc["level"], below)).alias("level")),
        lambda acc: F.concat(acc["done"], acc["level"]))


def _field_kinds(path, name, field, type_kind, type_, expr, child) -> Column:
    return F.struct(path.alias("path"), name.alias("name"), field.alias("field"), type_kind.alias("type_kind"),
                    type_.alias("type"), expr.alias("expr"), child.alias("child"))


def _by_type(type_: Column, loop, xpath, css) -> Column:
    return F.when(type_ == "loop", loop).when(type_.startswith("xpath"), xpath).when(type_.startswith("css"), css)


def parser_issue_array(parser: Column) -> Column:
    """``array<struct<path, severity, message, counted>>``: issues of all fields of a parser, within its row.

    ``parser`` is a VARIANT, the compiled tree or its authoring rows.  A field is an
    object with a text ``type`` and the text expression of its type; a loop has a
    ``child`` object too, whose absence is a warning.  An unknown type is a warning
    that does not count.  Rows have no ``child``: compiling gives every loop one.
    """
    text = F.lit("str")

    def all_issues(parser: Column) -> Column:
        from_tree = F.transform(tree_fields(parser), lambda f: bound(F.try_variant_get(f["v"], "$.type", "string"), lambda t: bound(_field_kinds(
            f["path"], f["name"], _kind(f["v"]), _vtype(f["v"], "$.type"), t,
            _by_type(t, *[_vtype(f["v"], f"$.{k}") for k in ("loop", "xpath", "css")]), _vtype(f["v"], "$.child")), issues)))
        # a row's value is the expression of whatever type it has
        from_rows = F.transform(reached_rows(F.try_variant_get(parser, "$", PARSER_ROWS)), lambda r: issues({
            "path": r["path"], "name": r["name"], "field": F.lit("dict"), "type_kind": F.when(r["type"].isNotNull(), text),
            "type": r["type"], "expr": F.when(r["value"].isNotNull(), text), "child": F.lit("dict")}))
        return F.coalesce(F.flatten(from_rows), F.flatten(from_tree))

    def issues(f) -> Column:
        what, t = F.concat(F.lit("parser-"), f["name"]), f["type"]
        part = lambda key: F.concat(what, F.lit("."), key)
        known = t.isin(*FIELD_TYPES)

        def issue(severity: str, message: Column, counted: bool = True) -> Column:
            return F.struct(f["path"].alias("path"), F.lit(severity).alias("severity"), message.alias("message"), F.lit(counted).alias("counted"))

        def judged(kind: Column, wanted: str, what: Column, severity: str = "error") -> Column:
            lost = F.concat(F.lit("Necessary part " if severity == "error" else ""), what, F.lit(" lose"))
            return F.when(kind.isNull(), issue(severity, lost)).when(kind != wanted, issue("error", F.concat(what, F.lit(" type error"))))

        # a field is judged as far as it goes: an object, with a type, that is known, whose expression is there
        is_field, has_type = F.coalesce(f["field"] == "dict", F.lit(False)), F.coalesce(f["type_kind"] == "str", F.lit(False))
        own = (
            F.when(~is_field, judged(f["field"], "dict", what))
            .when(~has_type, judged(f["type_kind"], "str", part(F.lit("type"))))
            .when(known, judged(f["expr"], "str", part(_by_type(t, F.lit("loop"), F.lit("xpath"), F.lit("css")))))
            .when(~known, issue("warning", F.concat(F.lit("Unknown parser type '"), t, F.lit("'")), False)))
        child = F.when(is_field & has_type & t.isin(*LOOP_TYPES), judged(f["child"], "dict", part(F.lit("child")), "warning"))
        return F.filter(F.array(own, child), lambda i: i.isNotNull())

    return bound(parser, all_issues)


def _stage_parts(stage: Column) -> Column:
    """``struct<kinds, parser>``: the kind of every checked key as ``t<ord>``, and the parser, each object taken apart once."""
    top = [path[2:] for _, path, *_, parent in STAGE_CHECKS if parent is None]
    inner = {key: [path.split(".")[2] for _, path, *_ in STAGE_CHECKS if path.startswith(f"$.{key}.")] for key in top}

    def parts(own: Column, below: Column) -> Column:
        def member(path: str) -> Column:
            key, *rest = path.split(".")[1:]
            return below[key][rest[0]] if rest else own[key]

        kinds = F.struct(*[_kind(member(path)).alias(f"t{o}") for o, path, *_ in STAGE_CHECKS])
        return F.struct(kinds.alias("kinds"), own["parser"].alias("parser"))

    return bound(_members(stage, top), lambda own: bound(
        F.struct(*[_members(own[key], names).alias(key) for key, names in inner.items() if names]), lambda below: parts(own, below)))


def stages_verdict(stages: Column) -> Column:
    """``struct<errors, warnings, check_pass, correct_pass>`` of a rule from its stages (``array<variant>``), within its row:
    the issues of every stage and of all fields of its parser.  A null array gives null."""

    def severities(parts: Column) -> Column:
        own = stage_issue_array(lambda o: parts["kinds"][f"t{o}"])
        return F.concat(own["severity"], F.filter(parser_issue_array(parts["parser"]), lambda i: i["counted"])["severity"])

    def counts(found: Column) -> Column:
        n = {k: F.size(F.filter(found, lambda s: s == k)) for k in ("error", "warning")}
        return F.struct(n["error"].alias("errors"), n["warning"].alias("warnings"))

    def verdict_of(n: Column) -> Column:
        return F.struct(n["errors"].alias("errors"), n["warnings"].alias("warnings"),
                        ((n["errors"] == 0) & (n["warnings"] == 0)).alias("check_pass"), (n["errors"] == 0).alias("correct_pass"))

    found = F.flatten(F.transform(stages, lambda stage: bound(_stage_parts(stage), severities)))
    return bound(found, lambda f: F.when(f.isNotNull(), bound(counts(f), verdict_of)))


def editor_issues(rows: DataFrame, group_cols: list[str], ord_col: str = "ord") -> DataFrame:
    """Parser rows that the rule editor does not accept though the validator does: a blank or missing name, a blank
    expression.  One row per authoring row and reason, uncounted."""
    reasons = F.array(F.when(F.coalesce("name", F.lit("")) == "", F.lit("Empty field name")), F.when(F.col("value") == "", F.lit("Empty expression")))
    return rows.select(*group_cols, ord_col, F.explode(F.filter(reasons, lambda r: r.isNotNull())).alias("message"))


# Place of the parser's fields among the checks of a stage, and of its closing line.
PARSER_ORD, END_ORD = 10, 99


def issue_log(stages: DataFrame, field_issues: DataFrame, modes: tuple[str, ...] = ("CHECK",), key: str = "id") -> DataFrame:
    """``(id, mode, log)``: the validation log of every rule in every mode, clean ones too.

    ``stages`` has ``id, stage_idx, name, issues`` (see ``stages_with_issues``),
    ``field_issues`` the rows of ``parser_field_issues`` per ``id, stage_idx``.  Both
    are read once and meet in one shuffle; a rule's stages are one group, whose
    lines are made, counted and sorted within its row.  A null id has no counts.
    ``CORRECT`` mode adds a line for every default filled in.
    """
    # The texts of the lines.
    none = F.lit(None)
    field = F.struct("path", "severity", "message", "counted")
    stage = F.struct(F.coalesce("name", F.lit("Untitled Stage")).alias("name"), "issues")
    parts = stages.select(key, F.struct("stage_idx", stage.alias("stage"), none.cast(_FIELD).alias("field")).alias("p")).unionByName(
        field_issues.select(key, F.struct("stage_idx", none.cast(_STAGE).alias("stage"), field.cast(_FIELD).alias("field")).alias("p")))
    groups = parts.groupBy(key).agg(F.collect_list("p").alias("ps"))

    def line(idx, ord_, path, sub, text):
        return F.struct(idx.cast("int").alias("stage_idx"), ord_.cast("int").alias("ord"), path.alias("path"), F.lit(sub).alias("sub"), text.alias("line"))

    def leveled(i: Column) -> Column:
        return F.concat(F.upper(i["severity"]), F.lit(" - "), i["message"])

    def totals(ps: Column) -> Column:
        """Map from a stage's place to its counted errors and warnings, over all rows of that place."""

        def count(idx: Column, severity: str) -> Column:
            def own(p: Column) -> Column:
                counted = (p["field"]["severity"] == severity) & p["field"]["counted"]
                return F.when(p["stage_idx"] == idx, F.coalesce(F.size(F.filter(p["stage"]["issues"], lambda i: i["severity"] == severity)), counted.cast("int"), F.lit(0)))

            return F.aggregate(ps, F.lit(0), lambda n, p: n + F.coalesce(own(p), F.lit(0)))

        places = F.array_distinct(F.transform(F.filter(ps, lambda p: p["stage_idx"].isNotNull()), lambda p: p["stage_idx"]))
        return F.map_from_entries(F.transform(places, lambda idx: F.struct(idx, F.struct(count(idx, "error").alias("e"), count(idx, "warning").alias("w")))))

    def closing(p: Column, counts: Column) -> Column:
        def text(n: Column) -> Column:
            e, w, name = F.coalesce(n["e"], F.lit(0)), F.coalesce(n["w"], F.lit(0)), p["stage"]["name"]
            return F.when((e == 0) & (w == 0), F.concat(F.lit("INFO - Stage "), name, F.lit(" validation pass."))).otherwise(
                F.concat(F.lit("INFO - Stage "), name, F.lit(" validation end. Result:  Error: "), e.cast("string"), F.lit("  Warning: "), w.cast("string")))

        return bound(F.try_element_at(counts, p["stage_idx"]), text)

    def lines_of(p: Column, counts: Column) -> Column:
        """The lines that both modes share, of a stage or of a field's issue."""
        idx, no_path = p["stage_idx"], F.lit("")
        own = F.concat(
            F.array(line(idx, F.lit(0), no_path, 0, F.concat(F.lit("INFO - Stage "), p["stage"]["name"], F.lit(" validation start."))),
                    line(idx, F.lit(END_ORD), no_path, 0, closing(p, counts))),
            F.transform(p["stage"]["issues"], lambda i: line(idx, i["ord"], no_path, 0, leveled(i))))
        return F.when(p["stage"].isNotNull(), own).otherwise(F.array(line(idx, F.lit(PARSER_ORD), p["field"]["path"], 0, leveled(p["field"]))))

    def filled(p: Column) -> Column:
        return F.transform(F.filter(p["stage"]["issues"], lambda i: i["severity"] == "warning"), lambda i: line(
            p["stage_idx"], i["ord"], F.lit(""), 1, F.concat(F.lit("INFO - Autofill "), i["field"], F.lit(" with default"))))

    def text(lines: Column) -> Column:
        return F.array_join(F.transform(F.sort_array(lines), lambda x: x["line"]), "\n")

    def log(mode: str) -> Column:
        opening = F.when(F.exists("ps", lambda p: p["stage"].isNotNull()), F.array(line(F.lit(-1), F.lit(0), F.lit(""), 0, F.lit(f"INFO - Validation initiate with mode {mode}."))))
        some = [F.coalesce(opening, F.array().cast(_LINES)), F.col("lines")]
        if mode == "CORRECT":
            some.append(F.flatten(F.transform(F.filter("ps", lambda p: p["stage"].isNotNull()), filled)))
        return F.struct(F.lit(mode).alias("mode"), text(F.concat(*some)).alias("log"))

    counts = F.when(F.col(key).isNotNull(), totals(F.col("ps")))
    lines = bound(F.struct(counts.alias("n")), lambda c: F.flatten(F.transform("ps", lambda p: lines_of(p, c["n"]))))
    return groups.select(key, "ps", lines.alias("lines")).select(key, F.inline(F.array(*[log(m) for m in modes])))


_FIELD = "struct<path:string,severity:string,message:string,counted:boolean>"
_STAGE = "struct<name:string,issues:array<struct<ord:int,field:string,severity:string,message:string>>>"
_LINES = "array<struct<stage_idx:int,ord:int,path:string,sub:int,line:string>>"


def verdict(issue_counts: DataFrame, group_cols: list[str]) -> DataFrame:
    """Per stage: errors, warnings, and the pass flag in check and correct modes."""
    return issue_counts.groupBy(*group_cols).agg(
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if((F.col("severity") == "warning") & F.coalesce(F.col("counted"), F.lit(True))).alias("warnings"),
    ).select(
        *group_cols, "errors", "warnings",
        ((F.col("errors") == 0) & (F.col("warnings") == 0)).alias("check_pass"),
        (F.col("errors") == 0).alias("correct_pass"),
    )


def config_defaults(common: Column, flt: Column | None = None) -> dict[str, Column]:
    """Run settings with the spider's defaults applied; with the rule's filter, its thresholds too (0 if missing)."""
    d = common.getField("depth_limit")
    ri = common.getField("request_interval")
    rt = common.getField("retry_times")
    ext = common.getField("external_def")
    thresholds = {k: F.coalesce(flt.getField(k).cast("double"), F.lit(0.0)) for k in ("title_threshold", "content_threshold")} if flt is not None else {}
    return thresholds | {
        "is_static": F.coalesce(common.getField("is_static"), F.lit(False)),
        "depth_limit": F.when(F.coalesce(d, F.lit(0)) > 0, d).otherwise(F.lit(5)),
        "request_interval": F.when(ri > 0, ri),
        "retry_times": F.when(rt > 0, rt),
        "external_def": F.when(F.coalesce(ext, F.lit("")) == "", F.lit("{}")).otherwise(ext),
    }


# The defaults of the optional keys, as JSON.
STAGE_DEFAULTS = {"header": '{"external":[],"loop":{}}', "remove_repeats": "true", "need_refresh": "false"}
HEADER_DEFAULTS = {"external": "[]", "loop": "{}"}
REQUEST_DEFAULTS = {"method": '"GET"', "headers": "{}", "cookies": "{}"}
LOOPS = ("loop", "xpath-loop", "css-loop")


def _parts(json: Column) -> Column:
    """A JSON object as a map from its keys to JSON texts, whatever types they have."""
    return F.transform_values(F.from_json(json, "map<string,variant>"), lambda _, v: F.to_json(v))


def _object(parts: Column) -> Column:
    quoted = lambda k: F.regexp_extract(F.to_json(F.array(k)), r"(?s)^\[(.*)\]$", 1)
    return F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(parts), lambda p: F.concat(quoted(p["key"]), F.lit(":"), p["value"])), ","), F.lit("}"))


def _filled(parts: Column, defaults: dict[str, str]) -> Column:
    """``parts`` with the keys that it lacks; a key that is there keeps its value, a null too."""
    given = F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv])
    return bound(parts, lambda own: F.map_concat(own, F.map_filter(given, lambda k, _: ~F.map_contains_key(own, k))))


def _children(fields: dict) -> dict:
    """A parser tree whose loops all have children."""
    out = {}
    for name, field in fields.items():
        if isinstance(field, dict) and field.get("type") in LOOPS:
            field = {**field, "child": _children(field["child"]) if isinstance(field.get("child"), dict) else field.get("child", {})}
        out[name] = field
    return out


def _with_children(parser: Column) -> Column:
    """Parser trees with children; null for anything else.  Trees have any depth, which an expression cannot
    walk: a small function per parser does."""

    @F.pandas_udf("string")
    def walk(parsers: pd.Series) -> pd.Series:
        return parsers.map(lambda p: json.dumps(_children(json.loads(p)), ensure_ascii=False) if p is not None else None)

    return walk(bound(parser, lambda p: F.when(p.startswith("{") & p.contains("loop"), p)))


def corrected_stage(stage_json: Column, verdict_errors: Column) -> Column:
    """Correct mode: the whole stage, with every missing optional key set to its default.

    All other keys stay as they are, whatever they hold: the parser as a tree
    (whose loops get an empty ``child`` where they have none) or as rows, ``next``
    stages, keys of the caller's own.  A key that is null stays null.  A stage
    with errors comes back as it was.
    """
    # every part is computed once: ``bound`` names it, and the function of Python stands outside of all lambdas
    right = F.when(verdict_errors == 0, stage_json)
    trees = _with_children(F.to_json(F.try_element_at(F.from_json(right, "map<string,variant>"), F.lit("parser"))))

    def inner(stage: Column, key: str, defaults: dict[str, str]) -> Column:
        return bound(F.try_element_at(stage, F.lit(key)),
                     lambda value: F.when(value.startswith("{"), _object(_filled(_parts(value), defaults))).otherwise(value))

    def whole(stage: Column, tree: Column) -> Column:
        replaced = {"header": inner(stage, "header", HEADER_DEFAULTS), "request": inner(stage, "request", REQUEST_DEFAULTS),
                    "parser": F.coalesce(tree, F.try_element_at(stage, F.lit("parser")))}
        rest = F.map_filter(stage, lambda k, _: ~k.isin(*replaced))
        given = F.create_map(*[x for k, v in replaced.items() for x in (F.lit(k), v)])
        return _object(F.map_concat(rest, F.map_filter(given, lambda _, v: v.isNotNull())))

    found = F.struct(_filled(_parts(right), STAGE_DEFAULTS).alias("stage"), trees.alias("tree"))
    return F.when(verdict_errors == 0, bound(found, lambda x: whole(x["stage"], x["tree"]))).otherwise(stage_json)
