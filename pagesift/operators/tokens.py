"""Token-level HTML tables (regex, no parser): tokens, tags, labels, scores, links.

A token is a comment, a script or style block, a tag, or a text run, with its
position in the page.  These tables are the SQL-checkable relatives of the
node table and serve scans that need tags or links but not the tree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagesift.functions import html as H
from pagesift.functions import scoring as SC

TAG_NAME_RE = "^<([a-zA-Z][a-zA-Z0-9]*)"
END_TAG_RE = "^</([a-zA-Z][a-zA-Z0-9]*)"


def attr_re(name: str) -> str:
    """Attribute value: double-quoted, single-quoted or bare (groups 1, 2, 3)."""
    return f"(?is)\\s{name}\\s*=\\s*(?:\"([^\"]*)\"|'([^']*)'|([^\\s\"'>]+))"


def attr_value(tok, name: str):
    pat = attr_re(name)
    return F.concat(*[F.regexp_extract(tok, pat, i) for i in (1, 2, 3)])


def token_kind(tok):
    return (
        F.when(tok.startswith("<!--"), "comment")
        .when(tok.rlike("(?is)^<script"), "script")
        .when(tok.rlike("(?is)^<style"), "style")
        .when(tok.rlike(END_TAG_RE), "end")
        .when(tok.rlike(TAG_NAME_RE), "start")
        .when(tok.startswith("<"), "other")
        .otherwise("text")
    )


def html_tokens(pages: DataFrame) -> DataFrame:
    """``(page_id, pos, kind, tag, token)`` in document order."""
    t = pages.select("page_id", F.posexplode(H.html_tokens("html")).alias("pos", "token"))
    tag = F.lower(F.coalesce(F.nullif(F.regexp_extract("token", TAG_NAME_RE, 1), F.lit("")),
                             F.nullif(F.regexp_extract("token", END_TAG_RE, 1), F.lit(""))))
    return t.select("page_id", "pos", token_kind(F.col("token")).alias("kind"), tag.alias("tag"), "token")


def start_tags(tokens: DataFrame) -> DataFrame:
    """Opening tags with their class and id strings."""
    s = tokens.where(F.col("kind").isin("start", "script", "style"))
    return s.select(
        "page_id", "pos", "tag",
        attr_value(F.col("token"), "class").alias("class"),
        attr_value(F.col("token"), "id").alias("id"),
    )


def nodes_by_tag(tags: DataFrame, names: list[str]) -> DataFrame:
    """Tags in ``names``, tag by tag (list order), then document order; ``ord`` is that rank per page."""
    rank = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("tag"))
    sel = tags.where(F.col("tag").isin(names)).withColumn("tag_rank", rank.cast("int"))
    w = Window.partitionBy("page_id").orderBy("tag_rank", "pos")
    return sel.select("page_id", "tag", "pos", F.row_number().over(w).alias("ord"))


def node_labels(tags: DataFrame) -> DataFrame:
    """Non-empty class and id strings, one row each."""
    labels = F.array(
        F.struct(F.lit("class").alias("kind"), F.col("class").alias("label")),
        F.struct(F.lit("id").alias("kind"), F.col("id").alias("label")),
    )
    x = tags.select("page_id", "pos", F.inline(labels))
    return x.where(F.col("label") != "")


def tag_scores(tags: DataFrame) -> DataFrame:
    return tags.select("page_id", "pos", "tag", SC.tag_score("tag").alias("tag_score"))


def css_scores(tags: DataFrame) -> DataFrame:
    return tags.select(
        "page_id", "pos", "tag", SC.css_score(F.col("class"), F.col("id")).alias("css_score"),
        SC.is_boilerplate(F.col("class"), F.col("id"), F.col("tag")).alias("boilerplate"),
    )


def page_links(pages: DataFrame) -> DataFrame:
    """``(page_id, pos, href, text)`` for every ``<a …>…</a>`` in order."""
    a = pages.select("page_id", F.posexplode(H.anchors("html")).alias("pos", "a"))
    return a.select("page_id", "pos", H.anchor_href("a").alias("href"), H.anchor_text("a").alias("text"))


def page_images(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.posexplode(H.image_srcs("html")).alias("pos", "src"))


def first_five(values) -> list:
    """Five columns from an array, null-padded."""
    return [F.try_element_at(values, F.lit(i)).alias(f"v{i}") for i in range(1, 6)]
