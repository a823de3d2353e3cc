"""Run a stored rule end to end over page snapshots.

requests (rendered from the stage's templates, loops and the values of the
stages they came through) ⋈ pages → per stage: node table → body (article text, or body parser
and article text where that is empty) of URLs not in the seen-set → relevance →
article rows; link fields with ``next`` of every page → routed requests of the
next level.  The driver loops over
levels (at most the depth limit) and over the stage names of a level (a
config-sized set); every level's frontier and seen-set are checkpointed.

The rule is in its run form: ``stages[].parser`` is the nested field tree
(``name → {type, xpath|css|loop, child|next}``).
"""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.functions.html import image_srcs, page_title
from pagesift.functions.joins import param_frame
from pagesift.operators import article as A
from pagesift.operators import dom as D
from pagesift.operators import select as SL
from pagesift.operators.frontier import depth_limit, stage_route
from pagesift.operators import requests as RQ
from pagesift.operators.relevance import profile_words, row_similarity
from pagesift.plans.articles import article_sink, keep_where
from pagesift.sources.tables import fetch_join

def _field_links(spark, nodes: DataFrame, ctx: DataFrame, tree: dict, passes, path: str = "") -> list[DataFrame]:
    """Link rows of every field with ``next`` in a parser tree (recursing into loops)."""
    out = []
    for name, f in (tree or {}).items():
        t = f.get("type")
        if t in ("xpath-loop", "css-loop"):
            expr = f.get("xpath") if t == "xpath-loop" else f.get("css")
            scopes = SL.scope_loop(nodes, ctx, t, expr)
            out += _field_links(spark, nodes, scopes, f.get("child"), passes, f"{path}{name}.")
        elif t == "loop":
            items = f.get("loop") or []
            items = items if isinstance(items, list) else [items]
            scopes = SL.value_loop(ctx, F.array(*[F.lit(str(i)) for i in items]) if items else F.array().cast("array<string>"))
            out += _field_links(spark, nodes, scopes.drop("item"), f.get("child"), passes, f"{path}{name}.")
        elif t in ("xpath", "css", "xpath-list", "css-list") and f.get("next"):
            expr = f.get("xpath") if t.startswith("xpath") else f.get("css")
            vals = SL.link_follow(nodes, ctx, t, expr, passes, first_only=t in ("xpath", "css"))
            out.append(vals.select("page_id", F.lit(path + name).alias("field"), F.lit(f["next"]).alias("next_stage"),
                                   F.col("ord").cast("int").alias("pos"), F.col("value").alias("href")))
    return out


def _field_json(nodes: DataFrame, ctx: DataFrame, tree: dict) -> DataFrame | None:
    """``(page_id, parser)``: the scalar and list fields of a stage's parser as a JSON object."""
    parts = []
    for name, f in (tree or {}).items():
        t = f.get("type")
        if t in ("xpath", "css", "xpath-list", "css-list"):
            expr = f.get("xpath") if t.startswith("xpath") else f.get("css")
            vals = SL.field_values(nodes, ctx, t, expr, first_only=t in ("xpath", "css"))
            parts.append(vals.select("page_id", F.lit(name).alias("name"), F.lit(t.endswith("-list")).alias("many"), F.struct("ord", "value").alias("v")))
    if not parts:
        return None
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    listed = rows.groupBy("page_id", "name", "many").agg(F.transform(F.array_sort(F.collect_list("v")), lambda v: v["value"]).alias("v"))
    text = F.when(F.col("many"), F.to_json("v")).otherwise(RQ.quoted(F.col("v")[0]))
    whole = listed.groupBy("page_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("name"), text.alias("value"))))).alias("m"))
    return whole.select("page_id", F.concat(F.lit("{"), RQ.members(F.col("m")), F.lit("}")).alias("parser"))


ASKED = ("depth", "stage", "url", "method", "headers", "cookies", "env", "history", "error")


def _asked(frontier: DataFrame, stage_table: DataFrame, depth: int) -> DataFrame:
    """The requests of a level; those that are alike in all that a template can read are one."""
    built = RQ.build_requests(frontier, stage_table).withColumn("depth", F.lit(depth))
    rest = [F.first(c).alias(c) for c in ("method", "headers", "cookies", "history")]
    return built.groupBy("depth", "stage", "url", "env", "error").agg(*rest).select(*ASKED).checkpoint(eager=True)


def run_requests(spark: SparkSession, rule: dict, pages: DataFrame, start_urls: DataFrame | None = None) -> DataFrame:
    """Every request of a rule run: ``depth, stage, url, method, headers, cookies, env, history, error``.

    ``env`` is what its templates saw, ``history`` the values of the stages that
    led to it.  A request that fails to render has no url and an error.
    """
    asked: list[DataFrame] = []
    _run(spark, rule, pages, start_urls, asked, None)
    out = asked[0]
    for a in asked[1:]:
        out = out.unionByName(a)
    return out


def run_rule(spark: SparkSession, rule: dict, pages: DataFrame, start_urls: DataFrame | None, run_ts: dt.datetime,
             stopwords=(), seen: DataFrame | None = None) -> DataFrame:
    """Article rows produced by running ``rule``.

    The run begins at ``start_urls`` (a ``url`` column) or, without them, at the
    start stage's own request, once per combination of its loop lists.  A
    request that fails to render, and a URL without a snapshot, lead nowhere.
    """
    results = _run(spark, rule, pages, start_urls, [], run_ts, stopwords, seen)
    if not results:
        return article_sink(spark.createDataFrame([], "body string, photos array<string>, url string, title string"),
                            rule.get("tag", ""), run_ts)
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out


def _run(spark: SparkSession, rule: dict, pages: DataFrame, start_urls: DataFrame | None, asked_levels: list[DataFrame],
         run_ts: dt.datetime | None, stopwords=(), seen: DataFrame | None = None) -> list[DataFrame]:
    """The level loop: appends each level's requests to ``asked_levels`` and returns the articles (none without ``run_ts``)."""
    stages: dict[str, dict] = {}
    for s in rule["stages"]:
        stages.setdefault(s["name"], s)  # first stage of a name wins
    start = rule["stages"][0]["name"]
    limit = depth_limit(rule.get("common", {}).get("depth_limit"))
    flt = rule.get("filter", {})
    words = profile_words(spark, flt.get("weight_dict") or {})
    content_t = float(flt.get("content_threshold", 0) or 0)
    title_t = float(flt.get("title_threshold", 0) or 0)
    passes = row_similarity(F.col("text"), words, stopwords=stopwords) >= F.lit(title_t)
    stage_table = param_frame(spark, [(n, i) for i, n in enumerate(stages)], "name STRING, stage_ord INT")
    snap = pages.select("page_id", "url", "html")

    request_table = RQ.stage_rows(spark, rule["stages"], (rule.get("common") or {}).get("external_def") or "{}")
    # a stage without a body stores nothing and marks nothing as stored
    storing = [n for n, c in stages.items() if c.get("auto_parse_body") or (c.get("body_parser") or "").strip()]
    written_rule = json.dumps(rule["stages"])
    first = start_urls.select("url").distinct() if start_urls is not None else spark.range(1).select(F.lit(None).cast("string").alias("url"))
    first = first.select(F.lit(start).alias("stage"), F.col("url").alias("default_url"), F.create_map().cast("map<string,string>").alias("history"))
    asked_levels.append(_asked(first, request_table, 0))
    seen_urls = (seen.select("url") if seen is not None else spark.createDataFrame([], "url string")).checkpoint(eager=True)
    followed = asked_levels[0].select("url", "stage").limit(0)
    results: list[DataFrame] = []
    for level in range(limit + 1):
        # Repeated requests of one URL and stage fetch the same snapshot, and what
        # a pair led to at a lower level is known: collapse first (partial
        # aggregation), so a hot URL does not skew the join.
        # Of several requests of a pair the first environment is carried on.
        asked = asked_levels[-1].where("error IS NULL").groupBy("url", "stage").agg(F.min_by(F.struct("env", "history"), "env").alias("r"))
        asked = asked.select("url", "stage", "r.*").join(followed, ["url", "stage"], "left_anti")
        got = A.cut(fetch_join(asked, snap, "url").where("fetched").select("url", "page_id", "stage", "html", "env", "history"))
        followed = followed.unionByName(got.select("url", "stage").distinct()).checkpoint(eager=True)
        # The seen-set guards storing only: one snapshot and stage per URL that was
        # not stored before, marked before any threshold.  The winner is chosen on
        # narrow columns; links are followed from every page.
        order = F.struct("page_id", F.array_position(F.array(*[F.lit(n) for n in stages]), F.col("stage")), "stage")
        new = got.where(F.col("stage").isin(storing)).select("url", "page_id", "stage").join(seen_urls, "url", "left_anti")
        store = new.groupBy("url").agg(F.min_by(F.struct("page_id", "stage"), order).alias("w")).select("url", "w.*").checkpoint(eager=True)
        seen_urls = seen_urls.unionByName(store.select("url")).checkpoint(eager=True)
        names = [r["stage"] for r in got.select("stage").distinct().collect()]  # config-sized
        nxt = []
        for name in names:
            cfg = stages.get(name)
            if cfg is None:
                continue
            part = got.where(F.col("stage") == name)
            nodes = A.cut(D.html_nodes(part.select("page_id", "html").dropDuplicates(["page_id"])))
            kept = store.where(F.col("stage") == name).select("page_id")
            own = nodes.join(kept, "page_id", "left_semi")
            if run_ts is None:
                bodies = None
            elif cfg.get("auto_parse_body"):
                bodies = A.article_text(own)
            elif (cfg.get("body_parser") or "").strip():
                # A body parser that hits nothing falls back to the main text.
                parsed = A.cut(SL.body_select(own, kept, False, cfg["body_parser"]).where(F.trim(F.coalesce("body", F.lit(""))) != ""))
                rest = own.join(parsed.select("page_id"), "page_id", "left_anti")
                bodies = parsed.select("page_id", "body").unionByName(A.article_text(rest).select("page_id", "body"))
            else:
                bodies = None
            if bodies is not None:
                scored = bodies.withColumn("sim", row_similarity(F.col("body"), words, stopwords=stopwords))
                meta = part.join(kept, "page_id", "left_semi").select("page_id", "url", page_title("html").alias("title"), image_srcs("html").alias("photos"))
                passed = keep_where(scored, F.col("sim") >= F.lit(content_t)).join(meta, "page_id")
                results.append(article_sink(passed, rule.get("tag", ""), run_ts))
            if level < limit:
                ctx = SL.document_ctx(part.select("page_id").distinct())
                links = _field_links(spark, nodes, ctx, cfg.get("parser"), passes)
                if not links:
                    continue
                # fields are parsed for the templates of later stages only if one reads them
                fields = _field_json(nodes, ctx, cfg.get("parser")) if f"{name}.parser" in written_rule else None
                from_page = part.select("page_id", "stage", "env", "history")
                from_page = from_page.join(fields, "page_id", "left") if fields is not None else from_page.withColumn("parser", F.lit("{}"))
                past = A.cut(RQ.with_history(from_page, "parser").select("page_id", "history"))
                for lk in links:
                    routed = stage_route(lk.join(part.select("page_id", "url"), "page_id"), stage_table,
                                         remove_repeats=bool(cfg.get("remove_repeats")))
                    routed = routed.where(F.col("route_error").isNull()).join(past, "page_id")
                    nxt.append(routed.select(F.col("next_stage").alias("stage"), F.col("request_url").alias("default_url"), "history"))
        if not nxt:
            break
        frontier = nxt[0]
        for n in nxt[1:]:
            frontier = frontier.unionByName(n)
        frontier = _asked(frontier, request_table, level + 1)
        if frontier.isEmpty():
            break
        asked_levels.append(frontier)
    return results
