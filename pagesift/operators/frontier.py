"""Link graph and frontier: links by next stage, routing to stages, and the
depth-limited expansion of a crawl as a level-by-level loop of joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.functions import html as H
from pagesift.functions.urls import url_join
from pagesift.session import new_scratch_path

DEFAULT_DEPTH_LIMIT = 5


def depth_limit(configured) -> int:
    """A configured depth ≤ 0 means the default of 5."""
    d = int(configured or 0)
    return d if d > 0 else DEFAULT_DEPTH_LIMIT


def scope_source(html: str, scope: str | None):
    """Every match of ``scope`` in document order, one after the other (the whole page if None)."""
    return F.col(html) if scope is None else F.array_join(F.regexp_extract_all(html, F.lit(scope), 0), "")


def links_by_stage(pages: DataFrame, fields: list[tuple[str, str | None, str | None]]) -> DataFrame:
    """``(page_id, url, field, next_stage, pos, href)`` for link fields.

    ``fields`` are ``(name, scope_regex, next_stage)``: the anchors inside the
    matches of ``scope_regex`` (whole page if None).  Fields with a blank
    next stage are dropped.  All links of a page come from its own row, so
    this is an in-row ``posexplode`` — no grouping, no shuffle.
    """
    parts = []
    for name, scope, nxt in fields:
        if nxt is None or nxt.strip() == "":
            continue
        src = scope_source("html", scope)
        hrefs = F.transform(F.regexp_extract_all(src, F.lit(H.ANCHOR_RE), 0), H.anchor_href)
        parts.append(
            pages.select(
                "page_id", "url", F.lit(name).alias("field"), F.lit(nxt).alias("next_stage"),
                F.posexplode(hrefs).alias("pos", "href"),
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def stage_route(links: DataFrame, stages: DataFrame, depth_col: str | None = None,
                remove_repeats: bool = False) -> DataFrame:
    """Each link becomes a request of its next stage (first stage of that name wins).

    A link to an unknown stage keeps a ``route_error`` instead of silently
    running the start stage.  ``remove_repeats`` drops repeated request URLs
    of one page and stage (the first position is kept).
    """
    if remove_repeats:
        resolved = links.withColumn("_abs", url_join(F.col("url"), F.col("href")))
        firsts = resolved.groupBy("page_id", "next_stage", "_abs").agg(F.min("pos").alias("pos"))
        links = resolved.join(firsts, ["page_id", "next_stage", "_abs", "pos"], "left_semi").drop("_abs")
    first = stages.groupBy("name").agg(F.min_by("stage_ord", "stage_ord").alias("stage_ord"))
    j = links.join(first.withColumnRenamed("name", "next_stage"), "next_stage", "left")
    depth = (F.col(depth_col) + 1) if depth_col else F.lit(1)
    return j.select(
        "page_id", "pos", "next_stage", "stage_ord",
        url_join(F.col("url"), F.col("href")).alias("request_url"),
        depth.alias("depth"),
        F.when(F.col("stage_ord").isNull(), F.concat(F.lit("unknown stage: "), F.col("next_stage"))).alias("route_error"),
    )


def _bucketed(df: DataFrame, name: str, path: str, n: int) -> None:
    """Append ``df`` to the table ``name``, dealt to ``n`` files by url."""
    df.write.mode("append").bucketBy(n, "url").option("path", path).saveAsTable(name)


def next_level(visited: DataFrame, links: DataFrame, level: int) -> DataFrame:
    """``url, depth`` of the URLs that the links of ``level`` lead to and that were never visited."""
    frontier = visited.where(F.col("depth") == level).select("url")
    found = frontier.join(links.where("dst_url IS NOT NULL"), "url").select(F.col("dst_url").alias("url")).distinct()
    return found.join(visited.select("url"), "url", "left_anti").withColumn("depth", F.lit(level + 1))


def frontier_expand(spark: SparkSession, start: DataFrame, edges: DataFrame, limit: int, seen: DataFrame | None = None) -> DataFrame:
    """Breadth-first expansion: ``(url, depth)`` with the least depth per URL.

    Start URLs are depth 1; a page at depth L emits its links while L ≤ limit,
    so the deepest pages have depth ``limit + 1``.  A link without a target leads
    nowhere.  URLs of ``seen`` (a ``url`` column, from earlier runs) are neither
    returned nor expanded.

    The distinct links and the visited URLs are two tables bucketed by url in the
    shared checkpoint folder, so a level reads both where they lie: its one shuffle
    is that of the URLs just reached, and it appends its own rows to the visited
    table.  The driver loops over levels (not pages).  The tables leave the catalog
    at the end; their files stay, as the result reads them.
    """
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    paths = {t: new_scratch_path(spark, t) for t in ("frontier_links", "frontier_visited")}
    links, visited = (f"pagesift_{p.rpartition('/')[2].replace('-', '_')}" for p in paths.values())
    try:
        # Targets that are null go at the join: a filter here would resolve every link twice.
        e = edges.select(F.col("src_url").alias("url"), "dst_url").distinct()
        _bucketed(e.repartition(n, "url"), links, paths["frontier_links"], n)
        first = start.select("url", F.lit(1).alias("depth"))
        if seen is not None:
            first = first.unionByName(seen.select("url", F.lit(0).alias("depth")))
        _bucketed(first.groupBy("url").agg(F.min("depth").alias("depth")).repartition(n, "url"), visited, paths["frontier_visited"], n)
        for level in range(1, limit + 1):
            _bucketed(next_level(spark.table(visited), spark.table(links), level), visited, paths["frontier_visited"], n)
            if spark.table(visited).where(F.col("depth") == level + 1).isEmpty():
                break
    finally:
        for name in (links, visited):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
    return spark.read.schema("url STRING, depth INT").parquet(paths["frontier_visited"]).where("depth > 0")


def links_by_stage_grouped(pages: DataFrame, fields: list[tuple[str, str | None, str | None]]) -> DataFrame:
    """``(page_id, url, next_stage, hrefs)``: the link lists of all fields that
    feed one next stage, concatenated in field order, built inside each row."""
    by_stage: dict[str, list] = {}
    for name, scope, nxt in fields:
        if nxt is None or nxt.strip() == "":
            continue
        src = scope_source("html", scope)
        hrefs = F.transform(F.regexp_extract_all(src, F.lit(H.ANCHOR_RE), 0), H.anchor_href)
        by_stage.setdefault(nxt, []).append(hrefs)
    parts = [
        pages.select("page_id", "url", F.lit(nxt).alias("next_stage"),
                     (F.concat(*arrs) if len(arrs) > 1 else arrs[0]).alias("hrefs"))
        for nxt, arrs in by_stage.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
