"""HTML → node table: the one Python boundary of the engine.

Each page becomes rows of a node table, one per element and one per text run::

    page_id, node_id, parent_id, tag, class, id, attrs, start, end, depth,
    sib_ord, kind ('elem' | 'text'), text, path

``start`` is the document-order position (even numbers, so a wrapper node can
be slotted in at ``start - 1`` later); an element's ``end`` is the position of
its last descendant, so *d is inside a* is ``a.start < d.start <= a.end``.
``path`` lists the ancestor ids, root first: descendant joins become
``explode(path)`` + an equi-join on ``(page_id, node_id)`` instead of a range
join.  Text runs are rows of their own (parent = enclosing element), so the
"tail" of an element is simply its following text sibling.

Parsing uses the standard library tokenizer plus the tree-building rules that
matter for real pages: void elements, implied ends of ``p``/``li``/``dt``/
``dd``/``tr``/``td``/``th``/``option``, unmatched end tags ignored.  It is not
libxml2, and the tests fix these rules rather than claim equality with it.
The UDF is batch-wise (``mapInPandas``): Arrow in, Arrow out, pages
processed in bounded chunks.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

NODE_SCHEMA = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("node_id", T.IntegerType()),
        T.StructField("parent_id", T.IntegerType()),
        T.StructField("tag", T.StringType()),
        T.StructField("class", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("sib_ord", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("path", T.ArrayType(T.IntegerType())),
    ]
)
COLUMNS = [f.name for f in NODE_SCHEMA.fields]

VOID = frozenset(
    "area base br col embed hr img input keygen link meta param source track wbr".split()
)
# Start tags that close an open <p> (HTML's "close a p element" list).
P_CLOSERS = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
SCOPE = frozenset("html table td th caption marquee object applet template button".split())
LIST_SCOPE = SCOPE | {"ol", "ul"}
HEAD_TAGS = frozenset("base link meta script style title noscript template".split())
MAX_DEPTH = 512
CLOSES_PEER = {
    "li": ({"li"}, LIST_SCOPE),
    "dt": ({"dt", "dd"}, SCOPE | {"dl"}),
    "dd": ({"dt", "dd"}, SCOPE | {"dl"}),
    "tr": ({"tr", "td", "th"}, frozenset({"table", "tbody", "thead", "tfoot", "html"})),
    "td": ({"td", "th"}, frozenset({"tr", "table", "html"})),
    "th": ({"td", "th"}, frozenset({"tr", "table", "html"})),
    "option": ({"option"}, frozenset({"select", "datalist", "optgroup", "html"})),
}


class _TreeBuilder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.stack: list[list] = []  # open element rows
        self.children: list[int] = []  # child counters parallel to stack
        self.root_children = 0
        self.pos = 0
        self.buf: list[str] = []
        self.outer: set[str] = set()  # of html and body, those that were opened; neither closes before the end

    # -- helpers -------------------------------------------------------
    def _next_pos(self) -> int:
        p = self.pos
        self.pos += 2
        return p

    def _sib(self) -> int:
        if self.children:
            n = self.children[-1]
            self.children[-1] += 1
            return n
        n = self.root_children
        self.root_children += 1
        return n

    def _parent_id(self):
        return self.stack[-1][0] if self.stack else None

    def _path(self):
        return [r[0] for r in self.stack]

    def _flush(self):
        if not self.buf:
            return
        text = "".join(self.buf)
        self.buf = []
        if text.isspace() and "body" not in self.outer and not (self.stack and self.stack[-1][2] in HEAD_TAGS):
            return  # between the outer tags
        self._imply(None)
        p = self._next_pos()
        # node_id, parent_id, tag, class, id, attrs, start, end, depth, sib_ord, kind, text, path
        self.rows.append([p, self._parent_id(), None, None, None, None, p, p, len(self.stack), self._sib(), "text", text, self._path()])

    def _close_top(self):
        row = self.stack.pop()
        self.children.pop()
        row[7] = self.pos - 2  # last assigned position inside it

    def _close_through(self, idx: int):
        while len(self.stack) > idx:
            self._close_top()

    def _find_in_scope(self, names, boundary) -> int:
        for i in range(len(self.stack) - 1, -1, -1):
            tag = self.stack[i][2]
            if tag in names:
                return i
            if tag in boundary:
                return -1
        return -1

    def _imply(self, tag: str | None):
        """Open the ``html``, ``head`` and ``body`` that a page leaves out before ``tag`` (None: text)."""
        if tag == "html" or "body" in self.outer:
            return
        if "html" not in self.outer:
            self._open("html", [], push=True)
        tags = {r[2] for r in self.stack}
        if tag in ("head", "body") or "head" in tags and tag in HEAD_TAGS:
            if tag == "body" and "head" in tags:
                self._close_through(1)
            return
        if tag in HEAD_TAGS:
            self._open("head", [], push=True)
            return
        if tag is None and "head" in tags and self.stack[-1][2] in HEAD_TAGS:
            return  # text of a title, script or style
        self._close_through(1)
        self._open("body", [], push=True)

    def _open(self, tag, attrs, push: bool):
        amap = {}
        for k, v in attrs:
            if k not in amap:
                amap[k] = "" if v is None else v
        if tag in ("html", "body"):
            self.outer.add(tag)
        p = self._next_pos()
        row = [p, self._parent_id(), tag, amap.get("class"), amap.get("id"), amap, p, p, len(self.stack), self._sib(), "elem", None, self._path()]
        self.rows.append(row)
        # Deeper elements become siblings, so that no path is longer than this.
        if push and len(self.stack) < MAX_DEPTH:
            self.stack.append(row)
            self.children.append(0)

    # -- parser events -------------------------------------------------
    def handle_starttag(self, tag, attrs):
        self._flush()
        if tag in self.outer:
            return  # the page is in it already
        self._imply(tag)
        if tag in P_CLOSERS:
            i = self._find_in_scope({"p"}, SCOPE)
            if i >= 0:
                self._close_through(i)
        if tag in CLOSES_PEER:
            names, boundary = CLOSES_PEER[tag]
            i = self._find_in_scope(names, boundary)
            if i >= 0:
                self._close_through(i)
        self._open(tag, attrs, push=tag not in VOID)

    def handle_startendtag(self, tag, attrs):
        self._flush()
        self._imply(tag)
        self._open(tag, attrs, push=False)

    def handle_endtag(self, tag):
        self._flush()
        if tag in VOID or tag in ("html", "body"):
            return  # what follows still belongs to the body
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][2] == tag:
                self._close_through(i)
                return
        # unmatched end tag: ignored

    def handle_data(self, data):
        self.buf.append(data)

    def handle_comment(self, data):
        self._flush()  # comments are not nodes (the cleaner drops them)

    def close(self):
        super().close()
        self._flush()
        self._close_through(0)


def parse_html(html: str | None) -> list[list]:
    """Node rows (without page_id) of one page, in document order."""
    b = _TreeBuilder()
    if html:
        b.feed(html)
    b.close()
    return b.rows


def _nodes_of_batches(batches, chunk_pages: int = 64):
    cols = COLUMNS[1:]
    for pdf in batches:
        for lo in range(0, len(pdf), chunk_pages):
            part = pdf.iloc[lo : lo + chunk_pages]
            out = []
            for pid, html in zip(part["page_id"], part["html"]):
                for r in parse_html(html):
                    out.append([int(pid)] + r)
            if out:
                frame = pd.DataFrame(out, columns=["page_id"] + cols)
                yield frame


def html_nodes(pages: DataFrame) -> DataFrame:
    """``pages(page_id, html)`` → node table (one Python pass per page)."""
    from pagesift.functions.joins import spread
    from pagesift.session import ship_package

    ship_package(pages.sparkSession)
    return spread(pages.select("page_id", "html")).mapInPandas(_nodes_of_batches, NODE_SCHEMA)


def held(df: DataFrame, *keep: str, **built) -> DataFrame:
    """Columns ``keep`` and ``built``, each built once a row.

    They come from a generator, which the optimizer does not merge into later
    expressions: an array that many lambdas read is not rebuilt in each of them.
    """
    columns = [F.col(c) for c in keep] + [c.alias(name) for name, c in built.items()]
    return df.select(F.inline(F.array(F.struct(*columns))))


def outside_subtrees(nodes: DataFrame, root: Column) -> DataFrame:
    """Nodes outside the subtrees of the elements that ``root`` marks: those that
    start after every such subtree before them has ended."""
    upto = Window.partitionBy("page_id").orderBy("start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.max(F.when(root, F.col("end"))).over(upto)
    return nodes.withColumn("_reach", reach).where(F.coalesce(F.col("_reach") < F.col("start"), F.lit(True))).drop("_reach")


CLEAN_TAGS = ("script", "style", "link")


def html_clean_nodes(nodes: DataFrame) -> DataFrame:
    """Drop script, style and ``<link>`` elements with their subtrees (comments are never nodes)."""
    return outside_subtrees(nodes, F.col("tag").isin(*CLEAN_TAGS))


def node_text(nodes: DataFrame, targets: DataFrame, collapse: bool = True) -> DataFrame:
    """``(page_id, node_id, text)``: text of each target's subtree in document
    order, whitespace runs collapsed (not trimmed).  Text rows are joined to
    their ancestors by ``explode(path)`` — an equi-join, no range join."""
    from pagesift.functions.text import collapse_ws

    t = nodes.where(F.col("kind") == "text").select("page_id", "start", "text", F.explode("path").alias("node_id"))
    tg = targets.select("page_id", "node_id").distinct()
    j = t.join(tg, ["page_id", "node_id"], "inner")
    agg = j.groupBy("page_id", "node_id").agg(F.array_sort(F.collect_list(F.struct("start", "text"))).alias("_parts"))
    txt = F.array_join(F.transform("_parts", lambda x: x["text"]), "")
    out = agg.select("page_id", "node_id", (collapse_ws(txt) if collapse else txt).alias("text"))
    # targets without any text get ''
    return tg.join(out, ["page_id", "node_id"], "left").select(
        "page_id", "node_id", F.coalesce("text", F.lit("")).alias("text")
    )
