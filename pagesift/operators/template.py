"""Templates, parameter environments and loop products.

A template ``"https://{{e.host}}/{{s.header.loop.page_item}}"`` is compiled
once on the driver into a ``concat`` of literals and column lookups, so
rendering is a plain projection.  Expressions are paths with optional
``[i]`` indexes; nothing is evaluated as code.

Two environments are supported:

* a **struct** column: paths resolve against its schema at compile time, so a
  missing path or a non-string value inside a longer string is an error
  raised before any job runs; a template that is one whole expression keeps
  the value's own type (a list stays a list).
* a **JSON / VARIANT** column (free-form external parameters): paths are
  checked per row and failures land in an error column, as the per-request
  errors of the reference do.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The pattern of an expression, and the error names ExpressionError and ConcatenateError.
EXPRESSION_RE = re.compile(r"{{(.+?)}}")
PATH_EXPR_RE = re.compile(r"^\s*([A-Za-z_]\w*(?:\.[A-Za-z_]\w*|\[\d+\])*)\s*$")
STEP_RE = re.compile(r"\.?([A-Za-z_]\w*)|\[(\d+)\]")


class TemplateError(ValueError):
    """An expression that is not a path, or a path that does not resolve."""


class PieceTypeError(TemplateError):
    """A non-string value inside a longer string."""


def parse_template(template: str) -> list[tuple[str, str]]:
    """``[('lit', text) | ('path', 'a.b[0]')]`` in order."""
    parts, last = [], 0
    for m in EXPRESSION_RE.finditer(template):
        if m.start() > last:
            parts.append(("lit", template[last : m.start()]))
        pm = PATH_EXPR_RE.match(m.group(1))
        if not pm:
            raise TemplateError(f"{m.group(1)!r} is not a path expression")
        parts.append(("path", pm.group(1)))
        last = m.end()
    if last < len(template):
        parts.append(("lit", template[last:]))
    return parts


def _steps(path: str):
    for name, idx in STEP_RE.findall(path):
        yield (name, None) if name else (None, int(idx))


def _struct_lookup(env: Column, env_type: T.DataType, path: str) -> tuple[Column, T.DataType]:
    col, typ = env, env_type
    for name, idx in _steps(path):
        if name is not None:
            if isinstance(typ, T.StructType) and name in typ.fieldNames():
                col, typ = col.getField(name), typ[name].dataType
            elif isinstance(typ, T.MapType):
                col, typ = F.try_element_at(col, F.lit(name)), typ.valueType
            else:
                raise TemplateError(f"path {path!r} does not resolve at {name!r}")
        else:
            if not isinstance(typ, T.ArrayType):
                raise TemplateError(f"path {path!r} indexes a non-list")
            col, typ = F.try_element_at(col, F.lit(idx + 1)), typ.elementType
    return col, typ


def render_struct(template: str, env: Column, env_type: T.DataType) -> Column:
    """Compile ``template`` against a struct environment of type ``env_type``."""
    parts = parse_template(template)
    if len(parts) == 1 and parts[0][0] == "path":
        return _struct_lookup(env, env_type, parts[0][1])[0]
    cols = []
    for kind, text in parts:
        if kind == "lit":
            cols.append(F.lit(text))
        else:
            c, typ = _struct_lookup(env, env_type, text)
            if not isinstance(typ, T.StringType):
                raise PieceTypeError(f"{text!r} is {typ.simpleString()}, not a string")
            cols.append(c)
    return F.concat(*cols) if cols else F.lit("")


def json_path(path: str) -> str:
    return "$" + "".join(f".{n}" if n is not None else f"[{i}]" for n, i in _steps(path))


def render_variant(template: str, env: Column) -> tuple[Column, Column]:
    """Render against a VARIANT environment; returns ``(value, error)`` columns.

    A whole-template expression yields the value as a string (JSON text when
    it is not a string); an embedded non-string or a missing path yields a
    null value and an error message.
    """
    parts = parse_template(template)
    whole = len(parts) == 1 and parts[0][0] == "path"
    pieces, errors = [], []
    for kind, text in parts:
        if kind == "lit":
            pieces.append(F.lit(text))
            continue
        v = F.try_variant_get(env, json_path(text), "variant")
        is_str = F.schema_of_variant(v) == "STRING"
        as_str = F.when(is_str, F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v))
        missing = v.isNull()
        errors.append(F.when(missing, F.lit(f"ExpressionError: {text}")))
        if not whole:
            errors.append(F.when(~missing & ~is_str, F.lit(f"ConcatenateError: {text}")))
        pieces.append(as_str)
    error = F.coalesce(*errors) if errors else F.lit(None).cast("string")
    value = F.when(error.isNull(), F.concat(*pieces) if len(pieces) > 1 else pieces[0])
    return value, error


def loop_product(df: DataFrame, lists: list[tuple[str, Column]], ord_col: str = "loop_ord") -> DataFrame:
    """One row per combination of the named lists (``<key>_item`` columns).

    The first list varies fastest; no lists gives one run, an empty (or null)
    list gives none.  Lists live in the row, so the product is a chain of
    ``posexplode``s — no join.
    """
    if not lists:
        return df.withColumn(ord_col, F.lit(0).cast("long"))
    out = df
    radix = F.lit(1).cast("long")
    ord_expr = F.lit(0).cast("long")
    for i, (key, arr) in enumerate(lists):
        out = out.withColumn(f"_l{i}", arr)
    sizes = []
    for i, (key, _) in enumerate(lists):
        sizes.append(F.size(F.col(f"_l{i}")).cast("long"))
    for i in reversed(range(len(lists))):
        key = lists[i][0]
        out = out.select("*", F.posexplode(F.col(f"_l{i}")).alias(f"_p{i}", f"{key}_item"))
    for i in range(len(lists)):
        ord_expr = ord_expr + F.col(f"_p{i}").cast("long") * radix
        radix = radix * sizes[i]
    out = out.withColumn(ord_col, ord_expr)
    return out.drop(*[f"_l{i}" for i in range(len(lists))], *[f"_p{i}" for i in range(len(lists))])
