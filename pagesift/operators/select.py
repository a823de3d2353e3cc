"""Field selection on the node table: a small XPath/CSS subset compiled on the
driver into joins, plus the field rules (scalar, list, scoped loops, value
loops, link following, body selection).

Supported — XPath: ``//t``, ``/t``, ``./t``, ``.//t``, ``*``, ``@a``,
``text()``, ``[@a='v']``, ``[@a]``, ``[contains(@a,'v')]``, ``[n]``.
CSS: ``t``, ``.c``, ``#i``, ``[a]``, ``[a=v]``, descendant (space), child
(``>``), ``::text``, ``::attr(a)``.  Anything else raises when compiled.

A selector step is an equi-join of the current node set with candidate
elements: by ``(page_id, parent_id)`` for the child axis, by
``(page_id, explode(path))`` for the descendant axis.  Positions are
``row_number`` windows per parent.  All work stays keyed by ``page_id``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ROOT = -1  # the virtual document node above <html>


class SelectorError(ValueError):
    pass


@dataclass
class Step:
    axis: str  # 'child' | 'desc'
    tag: str | None = None
    preds: list = field(default_factory=list)


@dataclass
class Selector:
    steps: list[Step]
    extract: tuple = ("node",)  # ('node',) | ('attr', name) | ('text',)
    absolute: bool = False  # XPath from the document root even inside a scope


_XPRED = re.compile(
    r"^\[(?:@(?P<a1>[\w:-]+)\s*=\s*(?P<q1>['\"])(?P<v1>.*?)(?P=q1)|@(?P<a2>[\w:-]+)"
    r"|contains\(\s*@(?P<a3>[\w:-]+)\s*,\s*(?P<q3>['\"])(?P<v3>.*?)(?P=q3)\s*\)|(?P<n>\d+))\]"
)


def compile_xpath(expr: str) -> Selector:
    s = expr.strip()
    absolute = s.startswith("/")
    if s.startswith("./"):
        s = s[1:]
    elif not s.startswith("/"):
        s = "/" + s  # relative child step
    steps: list[Step] = []
    extract: tuple = ("node",)
    i = 0
    while i < len(s):
        if s.startswith("//", i):
            axis, i = "desc", i + 2
        elif s[i] == "/":
            axis, i = "child", i + 1
        else:
            raise SelectorError(f"unsupported XPath near {s[i:]!r} in {expr!r}")
        m = re.match(r"@([\w:-]+)$", s[i:])
        if m:
            if axis != "child":
                raise SelectorError(f"unsupported attribute axis in {expr!r}")
            extract = ("attr", m.group(1))
            break
        if s.startswith("text()", i) and i + 6 == len(s):
            extract = ("text",) if axis == "child" else ("desc_text",)
            break
        m = re.match(r"(\*|[A-Za-z][\w-]*)", s[i:])
        if not m:
            raise SelectorError(f"unsupported XPath step near {s[i:]!r} in {expr!r}")
        step = Step(axis, None if m.group(1) == "*" else m.group(1).lower())
        i += m.end()
        while i < len(s) and s[i] == "[":
            pm = _XPRED.match(s[i:])
            if not pm:
                raise SelectorError(f"unsupported predicate near {s[i:]!r} in {expr!r}")
            if pm.group("a1"):
                step.preds.append(("attr_eq", pm.group("a1"), pm.group("v1")))
            elif pm.group("a2"):
                step.preds.append(("attr_has", pm.group("a2")))
            elif pm.group("a3"):
                step.preds.append(("contains", pm.group("a3"), pm.group("v3")))
            else:
                step.preds.append(("pos", int(pm.group("n"))))
            i += pm.end()
        steps.append(step)
    return Selector(steps, extract, absolute)


_CSS_COMPOUND = re.compile(r"(?P<tag>\*|[A-Za-z][\w-]*)?(?P<rest>(?:[.#][\w-]+|\[[^\]]+\])*)$")


def compile_css(expr: str) -> Selector:
    s = expr.strip()
    extract: tuple = ("node",)
    m = re.search(r"::(text|attr\(([\w:-]+)\))$", s)
    if m:
        extract = ("text",) if m.group(1) == "text" else ("attr", m.group(2))
        s = s[: m.start()].strip()
    tokens = re.split(r"\s*(>)\s*|\s+", s)
    steps: list[Step] = []
    axis = "desc"
    for tok in tokens:
        if tok is None or tok == "":
            continue
        if tok == ">":
            axis = "child"
            continue
        cm = _CSS_COMPOUND.match(tok)
        if not cm or (not cm.group("tag") and not cm.group("rest")):
            raise SelectorError(f"unsupported CSS {tok!r} in {expr!r}")
        tag = cm.group("tag")
        step = Step(axis, None if tag in (None, "*") else tag.lower())
        for part in re.findall(r"[.#][\w-]+|\[[^\]]+\]", cm.group("rest")):
            if part[0] == ".":
                step.preds.append(("class", part[1:]))
            elif part[0] == "#":
                step.preds.append(("attr_eq", "id", part[1:]))
            else:
                am = re.match(r"\[\s*([\w:-]+)\s*(?:=\s*(['\"]?)(.*?)\2)?\s*\]$", part)
                if not am:
                    raise SelectorError(f"unsupported CSS attribute {part!r}")
                if am.group(3) is None and "=" not in part:
                    step.preds.append(("attr_has", am.group(1)))
                else:
                    step.preds.append(("attr_eq", am.group(1), am.group(3)))
        steps.append(step)
        axis = "desc"
    if not steps:
        raise SelectorError(f"empty CSS selector {expr!r}")
    if steps[0].axis == "desc":
        steps[0].axis = "self_desc"  # CSS on an element may match the element itself
    return Selector(steps, extract, False)


def _pred(p) -> Column:
    kind = p[0]
    if kind == "attr_eq":
        return F.try_element_at(F.col("attrs"), F.lit(p[1])) == F.lit(p[2])
    if kind == "attr_has":
        return F.try_element_at(F.col("attrs"), F.lit(p[1])).isNotNull()
    if kind == "contains":
        return F.instr(F.try_element_at(F.col("attrs"), F.lit(p[1])), p[2]) > 0
    if kind == "class":
        return F.array_contains(F.split(F.trim(F.coalesce(F.col("class"), F.lit(""))), "\\s+"), p[1])
    raise SelectorError(str(p))


def select_nodes(nodes: DataFrame, ctx: DataFrame, sel: Selector) -> DataFrame:
    """``(page_id, scope, node_id, start)`` of the selected elements (or text
    nodes for ``text()``) per context row ``(page_id, scope, ctx_id)``; a null
    ``ctx_id`` is the document.  Attribute extraction keeps ``value``."""
    elems = nodes.where(F.col("kind") == "elem").select("page_id", "node_id", "parent_id", "tag", "class", "attrs", "start", "path")
    cur = ctx.select("page_id", "scope", F.coalesce(F.col("ctx_id"), F.lit(ROOT)).alias("cur"))
    if sel.absolute:
        cur = cur.select("page_id", "scope", F.lit(ROOT).alias("cur")).distinct()
    last = None
    for st in sel.steps:
        cand = elems
        if st.tag is not None:
            cand = cand.where(F.col("tag") == st.tag)
        # Predicates hold in the order they are written: those before the
        # first position filter the candidates, later ones what it picks.
        first_pos = next((i for i, p in enumerate(st.preds) if p[0] == "pos"), len(st.preds))
        for p in st.preds[:first_pos]:
            cand = cand.where(F.coalesce(_pred(p), F.lit(False)))
        if st.axis == "child":
            c = cand.withColumn("cur", F.coalesce(F.col("parent_id"), F.lit(ROOT)))
        elif st.axis == "self_desc":
            c = cand.withColumn("cur", F.explode(F.concat(F.array(F.lit(ROOT)), F.col("path"), F.array("node_id"))))
        else:
            c = cand.withColumn("cur", F.explode(F.concat(F.array(F.lit(ROOT)), F.col("path"))))
        hit = c.join(cur, ["page_id", "cur"]).select("page_id", "scope", "node_id", "parent_id", "start").distinct()
        for p in st.preds[first_pos:]:
            if p[0] == "pos":
                w = Window.partitionBy("page_id", "scope", "parent_id").orderBy("start")
                hit = hit.withColumn("_pos", F.row_number().over(w)).where(F.col("_pos") == p[1]).drop("_pos")
            else:
                fits = elems.where(F.coalesce(_pred(p), F.lit(False))).select("page_id", "node_id")
                hit = hit.join(fits, ["page_id", "node_id"], "left_semi")
        cur = hit.select("page_id", "scope", F.col("node_id").alias("cur"))
        last = hit
    out = last.select("page_id", "scope", "node_id", "start")
    if sel.extract[0] == "attr":
        a = elems.select("page_id", "node_id", F.try_element_at(F.col("attrs"), F.lit(sel.extract[1])).alias("value"))
        return out.join(a, ["page_id", "node_id"]).where(F.col("value").isNotNull())
    if sel.extract[0] in ("text", "desc_text"):
        texts = nodes.where(F.col("kind") == "text")
        if sel.extract[0] == "text":
            t = texts.select("page_id", F.col("parent_id").alias("_p"), F.col("node_id").alias("_t"), F.col("start").alias("_s"), F.col("text").alias("value"))
        else:
            t = texts.select("page_id", F.explode("path").alias("_p"), F.col("node_id").alias("_t"), F.col("start").alias("_s"), F.col("text").alias("value"))
        j = out.withColumnRenamed("node_id", "_p").join(t, ["page_id", "_p"])
        return j.select("page_id", "scope", F.col("_t").alias("node_id"), F.col("_s").alias("start"), "value").distinct()
    return out


def _esc(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


VOID_TAGS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "keygen", "link", "meta", "param", "source", "track", "wbr")


def serialize(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """``(page_id, node_id, html)``: outer HTML of each target element rebuilt
    from its subtree rows (start tags, text, end tags in document order)."""
    attrs = F.array_join(
        F.transform(F.map_entries(F.coalesce(F.col("attrs"), F.create_map().cast("map<string,string>"))),
                    lambda e: F.concat(F.lit(" "), e["key"], F.lit('="'), F.replace(_esc(e["value"]), F.lit('"'), F.lit("&quot;")), F.lit('"'))),
        "",
    )
    is_elem = F.col("kind") == "elem"
    staged = nodes.select(
        "page_id", "node_id", "path", "start", "end", (-F.col("depth")).cast("int").alias("neg_depth"),
        F.when(is_elem, F.concat(F.lit("<"), F.col("tag"), attrs, F.lit(">"))).otherwise(_esc(F.col("text"))).alias("stok"),
        F.when(is_elem & ~F.col("tag").isin(*VOID_TAGS), F.concat(F.lit("</"), F.col("tag"), F.lit(">"))).alias("etok"),
    )
    toks = F.array(
        F.struct(F.col("start").alias("k1"), F.lit(0).alias("k2"), F.lit(0).alias("k3"), F.col("stok").alias("tok")),
        F.struct(F.col("end").alias("k1"), F.lit(1).alias("k2"), F.col("neg_depth").alias("k3"), F.col("etok").alias("tok")),
    )
    rows = staged.select("page_id", F.explode(F.concat(F.col("path"), F.array("node_id"))).alias("node_id"), F.inline(toks))
    rows = rows.where(F.col("tok").isNotNull()).join(targets.select("page_id", "node_id").distinct(), ["page_id", "node_id"], "left_semi")
    agg = rows.groupBy("page_id", "node_id").agg(F.array_sort(F.collect_list(F.struct("k1", "k2", "k3", "tok"))).alias("_t"))
    return agg.select("page_id", "node_id", F.array_join(F.transform("_t", lambda x: x["tok"]), "").alias("html"))


def compile_selector(kind: str, expr: str) -> Selector:
    return compile_xpath(expr) if kind.startswith("xpath") else compile_css(expr)


def extract_values(nodes: DataFrame, hits: DataFrame, sel: Selector) -> DataFrame:
    """Hits → ``(page_id, scope, start, value)``: attribute or text values as is,
    elements serialised."""
    if sel.extract[0] != "node":
        return hits.select("page_id", "scope", "start", "value")
    ser = serialize(nodes, hits)
    return hits.join(ser, ["page_id", "node_id"]).select("page_id", "scope", "start", F.col("html").alias("value"))


def field_values(nodes: DataFrame, ctx: DataFrame, kind: str, expr: str, first_only: bool) -> DataFrame:
    """Scalar (first hit or nothing) or list (all hits, document order) field."""
    sel = compile_selector(kind, expr)
    vals = extract_values(nodes, select_nodes(nodes, ctx, sel), sel)
    w = Window.partitionBy("page_id", "scope").orderBy("start")
    vals = vals.withColumn("ord", F.row_number().over(w) - 1)
    if first_only:
        vals = vals.where(F.col("ord") == 0)
    return vals.select("page_id", "scope", "ord", "value")


def document_ctx(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.lit("").alias("scope"), F.lit(None).cast("int").alias("ctx_id"))


def scope_loop(nodes: DataFrame, ctx: DataFrame, kind: str, expr: str) -> DataFrame:
    """``xpath-loop``/``css-loop``: each matched element becomes a child scope."""
    sel = compile_selector(kind, expr)
    hits = select_nodes(nodes, ctx, sel)
    return hits.select(
        "page_id", F.concat("scope", F.lit("/"), F.col("node_id").cast("string")).alias("scope"), F.col("node_id").alias("ctx_id")
    )


def value_loop(ctx: DataFrame, items: Column) -> DataFrame:
    """``loop``: one child scope per item of a list; an empty list gives one
    pass with no item (``item`` null)."""
    x = ctx.select("page_id", "scope", "ctx_id", F.posexplode_outer(items).alias("_i", "item"))
    return x.select(
        "page_id", F.concat("scope", F.lit("/#"), F.coalesce(F.col("_i"), F.lit(0)).cast("string")).alias("scope"), "ctx_id", "item"
    )


def body_select(nodes: DataFrame, pages: DataFrame, auto_parse_body: bool, body_parser: str | None) -> DataFrame:
    """``(page_id, body)``: '' when article extraction is asked for, the
    stripped non-blank XPath hits joined by newlines when a body parser is
    set; no row (page not stored) otherwise."""
    if auto_parse_body:
        return pages.select("page_id", F.lit("").alias("body"))
    if body_parser is None or body_parser.strip() == "":
        return pages.select("page_id", F.lit(None).cast("string").alias("body")).where(F.lit(False))
    vals = field_values(nodes, document_ctx(pages), "xpath", body_parser, first_only=False)
    from pagesift.functions.text import WS_CLASS

    stripped = F.regexp_replace(F.col("value"), f"^{WS_CLASS}+|{WS_CLASS}+$", "")
    v = vals.select("page_id", "ord", stripped.alias("v")).where(F.col("v") != "")
    agg = v.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("ord", "v"))).alias("_v"))
    got = agg.select("page_id", F.array_join(F.transform("_v", lambda x: x["v"]), "\n").alias("body"))
    return pages.select("page_id").join(got, "page_id", "left").select("page_id", F.coalesce("body", F.lit("")).alias("body"))


def _anchor_hits(nodes: DataFrame, ctx: DataFrame, kind: str, expr: str) -> DataFrame:
    """Element hits with their tag, anchor text and href (for link fields)."""
    from pagesift.operators.dom import node_text

    sel = compile_selector(kind, expr)
    if sel.extract[0] != "node":
        return None
    hits = select_nodes(nodes, ctx, sel)
    info = nodes.where(F.col("kind") == "elem").select(
        "page_id", "node_id", "tag", F.try_element_at(F.col("attrs"), F.lit("href")).alias("href")
    )
    txt = node_text(nodes, hits.select("page_id", "node_id"))
    return hits.join(info, ["page_id", "node_id"]).join(txt, ["page_id", "node_id"])


def link_follow(nodes: DataFrame, ctx: DataFrame, kind: str, expr: str, passes, first_only: bool,
                fallback_all: bool = False) -> DataFrame:
    """Links of a field with ``next``: ``(page_id, scope, ord, value)``.

    Scalar: the first hit; an ``<a>`` yields its href only if its text passes
    ``passes`` (a Column predicate over ``text``), otherwise the field is
    skipped; any other first hit yields its extracted value.  List: hrefs of
    passing ``<a>`` hits; when none pass and ``fallback_all`` is set, every
    hit serialised (the reference's behaviour, off by default).
    """
    sel = compile_selector(kind, expr)
    if sel.extract[0] != "node":
        return field_values(nodes, ctx, kind, expr, first_only)
    hits = _anchor_hits(nodes, ctx, kind, expr)
    w = Window.partitionBy("page_id", "scope").orderBy("start")
    hits = hits.withColumn("ord", F.row_number().over(w) - 1)
    is_a = F.col("tag") == "a"
    ok = is_a & F.coalesce(passes, F.lit(False))
    if first_only:
        first = hits.where(F.col("ord") == 0)
        links = first.where(ok).select("page_id", "scope", "ord", F.col("href").alias("value"))
        other = first.where(~is_a).select("page_id", "scope", "ord", "node_id", "start")
        ser = serialize(nodes, other)
        others = other.join(ser, ["page_id", "node_id"]).select("page_id", "scope", "ord", F.col("html").alias("value"))
        return links.unionByName(others)
    passed = hits.where(ok)
    w2 = Window.partitionBy("page_id", "scope").orderBy("start")
    out = passed.select("page_id", "scope", (F.row_number().over(w2) - 1).alias("ord"), F.col("href").alias("value"))
    if not fallback_all:
        return out
    none_passed = hits.groupBy("page_id", "scope").agg(F.count_if(ok).alias("_n")).where("_n = 0")
    fb = hits.join(none_passed, ["page_id", "scope"], "left_semi")
    ser = serialize(nodes, fb)
    fb = fb.join(ser, ["page_id", "node_id"]).select("page_id", "scope", "ord", F.col("html").alias("value"))
    return out.unionByName(fb)
