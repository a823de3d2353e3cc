"""Main-text extraction by paragraph scoring, page by page.

clean → boilerplate filter → div-to-paragraph → candidate scores (first
writer per node, × (1 − link density)) → best node per page → sibling
expansion → text.

The node table is partitioned by ``page_id`` once.  Running sums in document
order (windows over that one partitioning) give every node the counts and text
lengths up to it; the nodes of a page then become one row, in which a node is
found by its position (``start / 2``), a subtree is the difference of the sums
at its two ends, and the scores are folded.  Nothing is joined, shuffled again
or checkpointed, and no row is repeated for its ancestors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagesift.functions import scoring as SC
from pagesift.functions.text import WS_CLASS, collapse_ws
from pagesift.operators.dom import CLEAN_TAGS, COLUMNS, held, outside_subtrees

KEY = ["page_id", "node_id"]
BLOCK_PREFIX_RE = "^(" + "|".join(SC.PARAGRAPH_FIX_TAGS) + ")"
BLANK_RE = "^" + WS_CLASS + "*$"


def _elems(nodes):
    return nodes.where(F.col("kind") == "elem")


def boilerplate_root() -> Column:
    """Whether a node-table row is an element that the label patterns call boilerplate."""
    return (F.col("kind") == "elem") & SC.is_boilerplate(F.col("class"), F.col("id"), F.col("tag"))


def cleaning_root() -> Column:
    """Whether a node-table row is a script, style or ``<link>`` element."""
    return F.coalesce(F.col("tag").isin(*CLEAN_TAGS), F.lit(False))


def boilerplate_filter(nodes: DataFrame) -> DataFrame:
    return outside_subtrees(nodes, boilerplate_root())


def clean_and_filter(nodes: DataFrame) -> DataFrame:
    """Cleaning and the boilerplate filter in one pass (a boilerplate root
    inside a removed script or style subtree is removed anyway)."""
    return outside_subtrees(nodes, cleaning_root() | boilerplate_root())


def _child_shape(nodes: DataFrame) -> DataFrame:
    """Per parent: ordinal of its first element child."""
    return (
        _elems(nodes)
        .where(F.col("parent_id").isNotNull())
        .groupBy("page_id", "parent_id")
        .agg(F.min("sib_ord").alias("first_elem_ord"))
        .withColumnRenamed("parent_id", "node_id")
    )


def div_to_paragraph(nodes: DataFrame) -> DataFrame:
    """(1) a div without block-ish descendants becomes a ``p``; (2) a div that
    has them *and* non-blank leading text gets that text and each non-blank
    tail wrapped in new ``p`` nodes, and loses its ``br`` children."""
    elems = _elems(nodes)
    after = Window.partitionBy("page_id").orderBy(F.desc("start")).rowsBetween(Window.unboundedPreceding, -1)
    next_block = F.last(F.when(F.col("tag").rlike(BLOCK_PREFIX_RE), F.col("start")), ignorenulls=True).over(after)
    holds = F.coalesce(next_block <= F.col("end"), F.lit(False))
    divs = elems.select(*KEY, "tag", holds.alias("_holds")).where(F.col("tag") == "div")
    plain = divs.where(~F.col("_holds")).select(*KEY, F.lit(True).alias("_to_p"))
    blocky = divs.where("_holds").select(*KEY)

    texts = nodes.where((F.col("kind") == "text") & F.col("parent_id").isNotNull())
    nonblank = texts.where(~F.col("text").rlike(BLANK_RE))
    lead = (
        nonblank.withColumnRenamed("parent_id", "_div")
        .join(_child_shape(nodes).withColumnRenamed("node_id", "_div"), ["page_id", "_div"], "left")
        .where(F.col("first_elem_ord").isNull() | (F.col("sib_ord") < F.col("first_elem_ord")))
        .select("page_id", F.col("_div").alias("node_id"))
    )
    wrap_divs = blocky.join(lead, KEY, "left_semi").select("page_id", F.col("node_id").alias("_wdiv"))

    by_parent = wrap_divs.withColumnRenamed("_wdiv", "parent_id")
    to_wrap = nonblank.join(by_parent, ["page_id", "parent_id"], "left_semi")
    brs = elems.where(F.col("tag") == "br").join(by_parent, ["page_id", "parent_id"], "left_semi")
    removed = to_wrap.select(*KEY).unionByName(brs.select(*KEY))
    kept = nodes.join(removed, KEY, "left_anti")
    kept = kept.join(plain, KEY, "left").select(
        *[F.when(F.col("_to_p"), F.lit("p")).otherwise(F.col("tag")).alias("tag") if c == "tag" else F.col(c) for c in COLUMNS]
    )
    wid = (F.col("start") - 1).cast("int")
    wrappers = to_wrap.select(
        "page_id", wid.alias("node_id"), "parent_id", F.lit("p").alias("tag"), F.lit(None).cast("string").alias("class"),
        F.lit(None).cast("string").alias("id"), F.lit(None).cast("map<string,string>").alias("attrs"),
        wid.alias("start"), F.col("start").alias("end"), "depth", "sib_ord", F.lit("elem").alias("kind"),
        F.lit(None).cast("string").alias("text"), "path",
    )
    wrapped = to_wrap.select(
        "page_id", "node_id", wid.alias("parent_id"), "tag", "class", "id", "attrs", "start", "end",
        (F.col("depth") + 1).alias("depth"), F.lit(0).alias("sib_ord"), "kind", "text",
        F.concat("path", F.array(wid)).alias("path"),
    )
    return kept.unionByName(wrappers).unionByName(wrapped)


def content_score(tag, chars, octets, words):
    """Content score of a candidate from the characters, UTF-8 octets and words
    of its collapsed text, or null when it is skipped."""
    n, b, w = chars.cast("double"), octets.cast("double"), words.cast("double")
    cjk = F.when(n > 0, b / n >= SC.CJK_BYTE_RATIO)
    score = F.when(cjk, F.lit(1.0) + n / 8 + b / 8).otherwise(F.lit(1.0) + w + F.least(n / 100, F.lit(3.0)))
    score = F.when(tag == "pre", F.least(score, F.lit(float(SC.PRE_SCORE_CAP)))).otherwise(score)
    keep = (n > 0) & F.when(cjk, n >= SC.MIN_CJK_LENGTH).otherwise(n >= SC.MIN_TEXT_LENGTH)
    return F.when(keep, score)


def _at(nodes: Column, start: Column) -> Column:
    """The node of a page that starts at ``start`` (positions are even and without gaps)."""
    return F.get(nodes, F.shiftright(start, 1))


def _between(items: Column, lo: Column, hi: Column) -> Column:
    """Items ``lo`` (from 0) to ``hi``, exclusive."""
    return F.slice(items, lo + 1, F.greatest(hi - lo, F.lit(0)))


def page_trees(nodes: DataFrame, root: Column, paragraphs: bool = True) -> DataFrame:
    """One row per page: ``page_id, nodes, texts, anchors``.

    ``nodes`` is the whole node table as ``html_nodes`` gives it; ``root`` marks
    the elements whose subtrees do not count.  They stay in the array, so that
    a node keeps its position, but are not ``live``.  Per node: ``chars``,
    ``octets`` and ``words`` of its collapsed text, ``holds`` (a block-ish
    descendant), ``wraps`` (a div whose own texts become paragraphs), ``lead``
    (a text before any element of its parent) and, as sums up to and with the
    node, ``n_texts``, ``n_leads`` and ``n_anchors``.  ``texts`` are the live
    texts and ``anchors`` the text lengths of the live ``a`` elements, in
    document order.  With ``paragraphs`` a div that holds no block-ish element is a ``p``.
    """
    order = Window.partitionBy("page_id").orderBy("start")
    upto, before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), order.rowsBetween(Window.unboundedPreceding, -1)
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int")).over(upto)

    t = nodes.select("page_id", "node_id", "parent_id", "tag", "class", "id", "start", "end", "kind", "text", root.alias("_root"))
    t = t.withColumn("_reach", F.max(F.when(F.col("_root"), F.col("end"))).over(upto))
    t = t.withColumn("live", F.coalesce(F.col("_reach") < F.col("start"), F.lit(True)))
    t = t.withColumn("_t", F.when(F.col("live") & (F.col("kind") == "text") & (F.col("text") != ""), collapse_ws("text")))
    is_text, is_elem = F.col("_t").isNotNull(), F.col("live") & (F.col("kind") == "elem")
    t = t.withColumns({
        "_ended": F.last(F.col("_t").endswith(" "), ignorenulls=True).over(before),
        "_opened": F.last(F.when(is_elem, F.col("node_id")), ignorenulls=True).over(before),
        "n_texts": count(is_text),
        "n_blocks": count(is_elem & F.col("tag").rlike(BLOCK_PREFIX_RE)),
        "n_anchors": count(is_elem & (F.col("tag") == "a")),
    })
    # A space that goes on from the text before counts once, and so does a word.
    spaced, begins = F.col("_ended"), F.col("_t").startswith(" ")
    t = t.withColumns({
        "m": F.coalesce(spaced & begins, F.lit(False)).cast("int"),
        "j": F.coalesce(~spaced & ~begins, F.lit(False)).cast("int"),
        "c": F.coalesce(F.length("_t"), F.lit(0)),
        "o": F.coalesce(F.octet_length("_t"), F.lit(0)),
        "w": F.coalesce(F.size(F.filter(F.split("_t", " "), lambda x: x != "")), F.lit(0)),
        "lead": F.coalesce(is_text & (F.col("_opened") == F.col("parent_id")), F.lit(False)),
        "blank": F.col("_t").rlike("^ *$"),
    })
    t = t.withColumn("w", F.when(is_text, F.col("w")).otherwise(0))
    t = t.withColumns({
        "s_c": F.sum(F.col("c") - F.col("m")).over(upto),
        "s_o": F.sum(F.col("o") - F.col("m")).over(upto),
        "s_w": F.sum(F.col("w") - F.col("j")).over(upto),
        "n_leads": count(F.col("lead")),
        "n_words": count(F.col("lead") & ~F.col("blank")),
    })
    live = lambda c: F.when(F.col("live"), F.col(c)).alias(c)
    node = F.struct(
        "start", "end", F.col("parent_id").alias("parent"), live("tag"), live("class"), live("id"), "kind", "live", live("text"), "lead", "blank",
        "m", "j", "c", "o", "w", "s_c", "s_o", "s_w", "n_texts", "n_blocks", "n_anchors", "n_leads", "n_words",
    )
    page = held(t.groupBy("page_id").agg(F.sort_array(F.collect_list(node)).alias("_n")), "page_id", raw=F.col("_n"))
    text = lambda x: x["live"] & (x["kind"] == "text") & (x["c"] > 0)
    page = held(page, "page_id", "raw", texts=F.filter("raw", text), opening=F.filter("raw", lambda x: text(x) & x["lead"] & ~x["blank"]))

    def shaped(x):
        last = _at(F.col("raw"), x["end"])
        first = F.get("texts", x["n_texts"])
        some = (x["kind"] == "elem") & (last["n_texts"] > x["n_texts"])
        holds = last["n_blocks"] > x["n_blocks"]
        size = lambda s, own, edge: F.when(x["kind"] == "text", x[own]).otherwise(
            F.when(some, last[s] - x[s] + first[edge]).otherwise(0)).cast("int")
        is_div = x["live"] & (x["tag"] == "div")
        tag = F.when(is_div & ~holds, F.lit("p")).otherwise(x["tag"]) if paragraphs else x["tag"]
        own = F.get("opening", x["n_words"])["parent"] == x["start"]
        return F.struct(
            x["start"].alias("start"), x["end"].alias("end"), x["parent"].alias("parent"), tag.alias("tag"), x["class"].alias("class"),
            x["id"].alias("id"), x["kind"].alias("kind"), x["live"].alias("live"), x["text"].alias("text"), x["lead"].alias("lead"),
            x["blank"].alias("blank"), x["n_texts"].alias("n_texts"), x["n_leads"].alias("n_leads"), x["n_anchors"].alias("n_anchors"),
            size("s_c", "c", "m").alias("chars"), size("s_o", "o", "m").alias("octets"), size("s_w", "w", "j").alias("words"),
            (F.coalesce(is_div & holds & own, F.lit(False)) & F.lit(paragraphs)).alias("wraps"),
        )

    page = held(page, "page_id", "texts", nodes=F.transform("raw", shaped))
    anchors = F.filter("nodes", lambda x: x["live"] & (x["kind"] == "elem") & (x["tag"] == "a"))
    return held(page, "page_id", "nodes", "texts", anchors=F.transform(anchors, lambda x: x["chars"]))


def main_trees(nodes: DataFrame) -> DataFrame:
    """``page_trees`` cleaned and without boilerplate, as the scoring reads them."""
    return page_trees(nodes, cleaning_root() | boilerplate_root())


def _last(x: Column) -> Column:
    return _at(F.col("nodes"), x["end"])


def _density(x: Column) -> Column:
    """Length of the text of descendant ``a`` elements over the node's text length (at least 1)."""
    inside = _between(F.col("anchors"), x["n_anchors"], _last(x)["n_anchors"])
    linked = F.aggregate(inside, F.lit(0).cast("long"), lambda a, n: a + n)
    return linked.cast("double") / F.greatest(x["chars"], F.lit(1))


def _live_elems() -> Column:
    return F.filter("nodes", lambda x: x["live"] & (x["kind"] == "elem"))


def node_texts(trees: DataFrame) -> DataFrame:
    """``(page_id, node_id, text)``: collapsed subtree text of every live element."""
    def text(x):
        inside = _between(F.col("texts"), x["n_texts"], _last(x)["n_texts"])
        return collapse_ws(F.array_join(F.transform(inside, lambda t: t["text"]), ""))

    return trees.select("page_id", F.inline(F.transform(_live_elems(), lambda x: F.struct(x["start"].alias("node_id"), text(x).alias("text")))))


def link_density(trees: DataFrame) -> DataFrame:
    """``(page_id, node_id, density)`` of every live element."""
    return trees.select("page_id", F.inline(F.transform(_live_elems(), lambda x: F.struct(x["start"].alias("node_id"), _density(x).alias("density")))))


def _wrapped(x: Column) -> Column:
    """A text that a div wraps in a paragraph of its own."""
    own = x["live"] & (x["kind"] == "text") & (x["chars"] > 0) & ~x["blank"]
    return F.coalesce(own & _at(F.col("nodes"), x["parent"])["wraps"], F.lit(False))


def with_scores(trees: DataFrame) -> DataFrame:
    """``trees`` with ``scores``, an array of ``(node_id, score, seq_rank, seq_start, seq_role)``.

    A candidate scores its parent and, by half, its grandparent; the first one
    in the order of tag, position and role writes a node's score.
    """
    ranks = F.array(*[F.lit(t) for t in SC.CANDIDATE_TAGS])
    wrapped = _wrapped
    candidate = lambda x: wrapped(x) | (x["live"] & (x["kind"] == "elem") & x["tag"].isin(*SC.CANDIDATE_TAGS) & x["parent"].isNotNull())

    def one(x):
        is_text = x["kind"] == "text"
        tag = F.when(is_text, F.lit("p")).otherwise(x["tag"])
        return F.struct(
            x["parent"].alias("parent"), _at(F.col("nodes"), x["parent"])["parent"].alias("grand"),
            F.array_position(ranks, tag).cast("int").alias("rank"), (x["start"] - is_text.cast("int")).alias("start"),
            content_score(tag, x["chars"], x["octets"], x["words"]).alias("score"),
        )

    def adds(c):
        return F.array(
            F.struct(c["parent"].alias("node"), c["rank"].alias("rank"), c["start"].alias("start"), F.lit(0).alias("role"), c["score"].alias("add")),
            F.struct(c["grand"].alias("node"), c["rank"].alias("rank"), c["start"].alias("start"), F.lit(1).alias("role"), (c["score"] / 2.0).alias("add")),
        )

    keep = ["page_id", "nodes", "texts", "anchors"]
    t = held(trees, *keep, found=F.transform(F.filter("nodes", candidate), one))
    t = held(t, *keep, adds=F.sort_array(F.flatten(F.transform(F.filter("found", lambda c: c["score"].isNotNull()), adds))))
    first = F.filter("adds", lambda a, i: a["node"].isNotNull() & ((i == 0) | ~a["node"].eqNullSafe(F.get("adds", i - 1)["node"])))
    t = held(t, *keep, first=F.transform(first, lambda a: F.struct(a.alias("by"), _at(F.col("nodes"), a["node"]).alias("at"))))

    def score(f):
        by, x = f["by"], f["at"]
        base = (SC.tag_score(x["tag"]) + SC.css_score(x["class"], x["id"])).cast("double") + by["add"]
        return F.struct(
            by["node"].alias("node_id"), (base * (F.lit(1.0) - _density(x))).alias("score"),
            by["rank"].alias("seq_rank"), by["start"].alias("seq_start"), by["role"].alias("seq_role"),
        )

    return held(t, *keep, scores=F.transform("first", score))


def paragraph_score(trees: DataFrame) -> DataFrame:
    """``(page_id, node_id, score, seq_rank, seq_start, seq_role)`` for scored nodes."""
    return with_scores(trees).select("page_id", F.inline("scores"))


def _best() -> Column:
    """Best score of a page; ties go to the node scored first."""
    ordered = F.transform("scores", lambda s: F.struct((-s["score"]).alias("k"), s["seq_rank"].alias("r"), s["seq_start"].alias("p"), s["seq_role"].alias("o"), s.alias("s")))
    return F.array_min(ordered)["s"]


def top_paragraph(trees: DataFrame) -> DataFrame:
    """``(page_id, node_id, score, …)`` of the best node of every page that has one."""
    t = held(with_scores(trees), "page_id", best=_best())
    return t.where(F.col("best").isNotNull()).select("page_id", "best.*")


def article_expand(trees: DataFrame) -> DataFrame:
    """``(page_id, body)``: text of the best node and its qualifying siblings (with their tails)."""
    keep = ["page_id", "nodes", "texts", "anchors", "scores"]
    t = held(with_scores(trees), *keep, best=_best()).where(F.col("best").isNotNull())
    top = _at(F.col("nodes"), F.col("best.node_id"))
    t = held(t, *keep, "best", top=top, above=_at(F.col("nodes"), top["parent"]),
             floor=F.greatest(F.col("best.score") * SC.EXPAND_RATIO, F.lit(float(SC.EXPAND_FLOOR))))
    beside = lambda x: x["live"] & (x["parent"] == F.col("top.parent"))
    # br elements of a div whose texts are wrapped are gone
    gone = lambda x: F.col("above.wraps") & (x["tag"] == "br")
    sibling = lambda x: beside(x) & (((x["kind"] == "elem") & ~gone(x)) | _wrapped(x))
    leads = F.filter("nodes", lambda x: x["lead"])
    scored = F.filter("scores", lambda s: (s["score"] >= F.col("floor")) & (_at(F.col("nodes"), s["node_id"])["parent"] == F.col("top.parent")))
    t = held(
        t, "page_id", "nodes", "texts", "anchors", "top", "above", leads=F.transform(leads, lambda x: F.struct(x["parent"].alias("parent"), F.length(x["text"]).alias("n"))),
        siblings=F.when(F.col("above").isNull(), F.array("top")).otherwise(F.filter("nodes", sibling)),
        high=F.array_union(F.transform(scored, lambda s: s["node_id"]), F.array("best.node_id")),
    )

    def lead_length(x):
        own = F.filter(_between(F.col("leads"), x["n_leads"], _last(x)["n_leads"]), lambda a: a["parent"] == x["start"])
        return F.aggregate(own, F.lit(0).cast("long"), lambda a, r: a + r["n"])

    def part(x, i):
        lead, density = lead_length(x), _density(x)
        short = lead <= SC.SHORT_PARAGRAPH
        plain = (x["tag"] == "p") & F.when(short, density == 0).otherwise(density < SC.LONG_P_MAX_DENSITY)
        end = F.get("siblings", i + 1)
        own = (x["kind"] == "text").cast("int")
        upto = F.when(F.col("above").isNull(), _last(x)["n_texts"]).otherwise(
            F.coalesce(end["n_texts"] - (end["kind"] == "text").cast("int"), _last(F.col("above"))["n_texts"]))
        return F.struct(
            F.coalesce((x["kind"] == "text") | plain, F.lit(False)).alias("plain"), x["start"].alias("start"),
            (x["n_texts"] - own).alias("lo"), upto.alias("hi"),
        )

    t = held(t, "page_id", "texts", "high", parts=F.transform("siblings", part))
    chosen = F.filter("parts", lambda p: p["plain"] | F.array_contains("high", p["start"]))
    text = F.transform(chosen, lambda p: F.array_join(F.transform(_between(F.col("texts"), p["lo"], p["hi"]), lambda x: x["text"]), ""))
    return t.select("page_id", collapse_ws(F.array_join(text, "")).alias("body"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise a node table that later steps read several times.

    Each step joins its input with itself a few times; without a cut the plan
    (and the work) would grow with every step.  ``checkpoint()`` writes to the
    shared ``spark.checkpoint.dir``, so the cut also survives lost executors.
    """
    return df.checkpoint(eager=True)


def article_text(nodes: DataFrame) -> DataFrame:
    """``(page_id, body)`` for every page with at least one scored candidate."""
    return article_expand(main_trees(nodes))
