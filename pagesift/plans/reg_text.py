"""Registered queries: scans, text functions, relevance, sink, flagship (M1)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from pagesift.functions import html as H
from pagesift.functions import text as T
from pagesift.functions.joins import spread
from pagesift.functions.stopwords import load_default_stopwords
from pagesift.operators import relevance as R
from pagesift.plans import sqlparts as S
from pagesift.plans.articles import ARTICLE_STATUS, article_sink, relevant_articles, text_form, url_dedup
from pagesift.plans.catalog import register
from pagesift.session import new_scratch_path
from pagesift.sources.tables import stopword_load, table

# Parameters of the registered queries.  The fixture prose is invented
# syllables, so the keyword profile is chosen from it.
PROFILE = {"re": 0.5, "th": 0.3, "ble": 0.2}
THRESHOLD = 0.1
TITLE_THRESHOLD = 0.05
TAG = "web"
RUN_TS = dt.datetime(2024, 1, 1, 8, 30, 5)
# Anchor words that do occur in the prose, to exercise the df = 2 branch.
TEXT_ANCHORS = ("ble", "tion")


def _stop(spark):
    return R.stopword_frame(spark)


@register("page_scan", "SELECT page_id, url, html FROM pages")
def page_scan(spark, sf):
    return table(spark, sf, "pages", "page_id", "url", "html")


@register(
    "url_dedup",
    "SELECT url, min(page_id) AS page_id, length(arg_min(html, page_id)) AS html_len FROM pages GROUP BY url",
)
def q_url_dedup(spark, sf):
    d = url_dedup(table(spark, sf, "pages", "page_id", "url", "html"))
    return d.select("url", "page_id", F.length("html").alias("html_len"))


@register("page_title", lambda: f"SELECT page_id, {S.page_title('html')} AS title FROM pages")
def q_page_title(spark, sf):
    return table(spark, sf, "pages", "page_id", "html").select("page_id", H.page_title("html").alias("title"))


@register("html_clean", lambda: f"SELECT page_id, {S.clean_html('html')} AS clean FROM pages")
def q_html_clean(spark, sf):
    return table(spark, sf, "pages", "page_id", "html").select("page_id", H.clean_html("html").alias("clean"))


@register(
    "strip_tags",
    lambda: f"SELECT page_id, {S.strip_tags('html')} AS text, length({S.strip_tags('html')}) AS n_chars FROM pages",
)
def q_strip_tags(spark, sf):
    t = T.strip_tags("html")
    return table(spark, sf, "pages", "page_id", "html").select("page_id", t.alias("text"), F.length(t).alias("n_chars"))


@register("collapse_ws", lambda: f"SELECT doc_id, {S.collapse_ws('text')} AS text FROM documents")
def q_collapse_ws(spark, sf):
    return table(spark, sf, "documents", "doc_id", "text").select("doc_id", T.collapse_ws("text").alias("text"))


@register(
    "text_shape",
    """SELECT doc_id, length(text) AS n_chars, strlen(text) AS n_bytes,
              strlen(text)::DOUBLE / nullif(length(text), 0) AS byte_ratio,
              coalesce(strlen(text)::DOUBLE / nullif(length(text), 0) >= 1.4, false) AS is_cjk
       FROM documents""",
)
def q_text_shape(spark, sf):
    shape = T.text_shape("text")
    return table(spark, sf, "documents", "doc_id", "text").select(
        "doc_id", *[v.alias(k) for k, v in shape.items()]
    )


@register(
    "tokenize",
    lambda: f"""SELECT doc_id, pos - 1 AS pos, toks[pos] AS term FROM (
                  SELECT doc_id, toks, generate_subscripts(toks, 1) AS pos
                  FROM (SELECT doc_id, {S.tokens('text')} AS toks FROM documents))""",
)
def q_tokenize(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "text")
    return d.select("doc_id", F.posexplode(T.tokens("text")).alias("pos", "term"))


@register(
    "remove_stopwords",
    lambda: f"""SELECT doc_id, pos - 1 AS pos, toks[pos] AS term FROM (
                  SELECT doc_id, toks, generate_subscripts(toks, 1) AS pos
                  FROM (SELECT doc_id, {S.tokens('text')} AS toks FROM documents))
                WHERE toks[pos] NOT IN (SELECT term FROM {S.stopword_values()})""",
)
def q_remove_stopwords(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "text")
    toks = d.select("doc_id", F.posexplode(T.tokens("text")).alias("pos", "term"))
    return toks.join(_stop(spark), "term", "left_anti").select("doc_id", "pos", "term")


def _stop_sql_stats():
    # A corpus stop list: words in at least half of the documents of their language.
    return f"""
      WITH toks AS (SELECT DISTINCT doc_id, lang, unnest({S.tokens('text')}) AS term FROM documents),
      n AS (SELECT lang, count(*) AS n_docs FROM documents GROUP BY lang)
      SELECT DISTINCT term FROM (
        SELECT t.lang, t.term, count(*) AS df, any_value(n.n_docs) AS n_docs
        FROM toks t JOIN n USING (lang) GROUP BY t.lang, t.term
      ) WHERE df * 2 >= n_docs"""


@register("stopword_load", _stop_sql_stats)
def q_stopword_load(spark, sf):
    """Derive a corpus stop list with Spark, write it as a text file, load it back."""
    d = table(spark, sf, "documents", "doc_id", "lang", "text")
    toks = d.select("doc_id", "lang", F.explode(T.tokens("text")).alias("term")).distinct()
    n_docs = d.groupBy("lang").agg(F.count("*").alias("n_docs"))
    df = toks.groupBy("lang", "term").agg(F.count("*").alias("df"))
    words = df.join(n_docs, "lang").where(F.col("df") * 2 >= F.col("n_docs")).select("term").distinct()
    path = new_scratch_path(spark, "stopwords")
    words.write.mode("overwrite").text(path)
    return stopword_load(spark, path)


@register(
    "term_counts",
    lambda: f"""SELECT doc_id, term, count(*) AS tf FROM (
                  SELECT doc_id, unnest({S.tokens('trim(text)')}) AS term FROM documents)
                WHERE term NOT IN (SELECT term FROM {S.stopword_values()}) GROUP BY doc_id, term""",
)
def q_term_counts(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "text")
    return R.row_term_counts(d, "doc_id", "text", load_default_stopwords(spark))


def _df_sql(anchors):
    anch = S.values([(a,) for a in anchors], "term")
    return f"""SELECT doc_id, term, CASE WHEN term IN (SELECT term FROM {anch}) THEN 2 ELSE 1 END AS df,
                      round(log2(4.0 / CASE WHEN term IN (SELECT term FROM {anch}) THEN 2 ELSE 1 END), 6) AS idf
               FROM (SELECT DISTINCT doc_id, unnest({S.tokens('trim(text)')}) AS term FROM documents)
               WHERE term NOT IN (SELECT term FROM {S.stopword_values()})"""


@register("doc_frequency", lambda: _df_sql(TEXT_ANCHORS))
def q_doc_frequency(spark, sf):
    """df of each document term in the reference's four-text corpus {doc, ∅, ∅, anchors}."""
    d = table(spark, sf, "documents", "doc_id", "text")
    terms = R.row_term_counts(d, "doc_id", "text", load_default_stopwords(spark)).drop("tf")
    df = F.when(F.col("term").isin(list(TEXT_ANCHORS)), 2).otherwise(1)
    return terms.select("doc_id", "term", df.alias("df"), F.round(F.log2(4.0 / df), 6).alias("idf"))


@register(
    "profile_counts",
    lambda: f"""SELECT item_id, word, n FROM {S.profile_counts_sql(
        f"(SELECT item_id, term, count(*)::DOUBLE AS weight FROM (SELECT item_id, unnest({S.tokens('text')}) AS term FROM benchmark) GROUP BY item_id, term)",
        group='item_id')}""",
)
def q_profile_counts(spark, sf):
    """One keyword profile per benchmark passage: its words weighted by count."""
    b = table(spark, sf, "benchmark", "item_id", "text")
    prof = (
        b.select("item_id", F.explode(T.tokens("text")).alias("term"))
        .groupBy("item_id", "term")
        .agg(F.count("*").cast("double").alias("weight"))
    )
    return R.profile_counts(prof, ("item_id",))


def _tfidf_sql(anchors):
    anch = S.values([(a,) for a in anchors], "term")
    return f"""
      WITH tf AS (
        SELECT doc_id, term, count(*) AS tf FROM (
          SELECT doc_id, unnest({S.tokens('trim(text)')}) AS term FROM documents)
        WHERE term NOT IN (SELECT term FROM {S.stopword_values()}) GROUP BY doc_id, term),
      w AS (SELECT doc_id, term, tf * CASE WHEN term IN (SELECT term FROM {anch}) THEN 1.0 ELSE 2.0 END AS x FROM tf)
      SELECT doc_id, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 6) AS weight FROM w"""


@register("tfidf", lambda: _tfidf_sql(TEXT_ANCHORS))
def q_tfidf(spark, sf):
    """Unit-normalised tf · log2(4/df) per document term."""
    d = table(spark, sf, "documents", "doc_id", "text")
    return R.row_tfidf(d, "doc_id", "text", TEXT_ANCHORS, load_default_stopwords(spark))


def _sim_sql():
    return f"SELECT id AS doc_id, sim FROM {S.similarity_sql('documents', 'doc_id', 'text', PROFILE, R.REFERENCE_ANCHORS)}"


@register("profile_similarity", _sim_sql)
def q_profile_similarity(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "text")
    sim = R.row_similarity("text", R.profile_words(spark, PROFILE), stopwords=load_default_stopwords(spark))
    return spread(d).select("doc_id", sim.alias("sim"))


@register("content_filter", lambda: f"SELECT * FROM ({_sim_sql()}) WHERE sim >= {THRESHOLD}")
def q_content_filter(spark, sf):
    return R.content_filter(q_profile_similarity(spark, sf), THRESHOLD)


def _links_sql():
    return f"""SELECT page_id, pos - 1 AS pos, {S.decode_entities(f"regexp_extract(a[pos], {S.q(H.HREF_RE)}, 1)")} AS href,
                      {S.collapse_ws(S.decode_entities(S.strip_tags(f"regexp_extract(a[pos], {S.q(H.ANCHOR_TEXT_RE)}, 1)")))} AS text
               FROM (SELECT page_id, a, generate_subscripts(a, 1) AS pos
                     FROM (SELECT page_id, regexp_extract_all(html, {S.q(H.ANCHOR_RE)}, 0) AS a FROM pages))"""


def page_links_df(spark, sf):
    p = table(spark, sf, "pages", "page_id", "html")
    a = p.select("page_id", F.posexplode(H.anchors("html")).alias("pos", "a"))
    return a.select("page_id", "pos", H.anchor_href("a").alias("href"), H.anchor_text("a").alias("text"))


@register(
    "title_filter",
    lambda: f"""SELECT l.page_id, l.pos, l.href, s.sim FROM ({_links_sql()}) l
                JOIN {S.similarity_sql(f'({_links_sql()})', "page_id * 100000 + pos", 'text', PROFILE, R.REFERENCE_ANCHORS)} s
                  ON s.id = l.page_id * 100000 + l.pos
                WHERE s.sim >= {TITLE_THRESHOLD}""",
)
def q_title_filter(spark, sf):
    links = page_links_df(spark, sf)
    sim = R.row_similarity("text", R.profile_words(spark, PROFILE), stopwords=load_default_stopwords(spark))
    return R.content_filter(links.select("page_id", "pos", "href", sim.alias("sim")), TITLE_THRESHOLD)


def _sink_sql(where: str = "") -> str:
    sel = f"""SELECT page_id, url, {S.page_text('html')} AS body, {S.page_title('html')} AS title,
                     list_transform(regexp_extract_all(html, {S.q(H.IMG_RE)}, 0),
                                    lambda t: {S.decode_entities(f"regexp_extract(t, {S.q(H.SRC_RE)}, 1)")}) AS photos
              FROM (SELECT url, min(page_id) AS page_id, arg_min(html, page_id) AS html FROM pages GROUP BY url)"""
    photos = ", ".join(f"photos[{i}] AS photo{i}" for i in range(1, 6))
    return f"""SELECT CAST(NULL AS BIGINT) AS id, body, strftime(TIMESTAMP '{RUN_TS:%Y-%m-%d %H:%M:%S}', '%y/%m/%d/%H/%M/%S') AS created,
                      {photos}, url, {S.q(ARTICLE_STATUS)} AS status, {S.q(TAG)} AS tag, title,
                      CAST(NULL AS VARCHAR) AS reserved
               FROM ({sel}) t {where}"""


@register("article_sink", lambda: _sink_sql())
def q_article_sink(spark, sf):
    pages = url_dedup(table(spark, sf, "pages", "page_id", "url", "html"))
    return article_sink(text_form(pages), TAG, RUN_TS)


@register(
    "run_stamp",
    """SELECT event_id, strftime(ts, '%y/%m/%d/%H/%M/%S') AS created, strftime(ts, '%y%m%d%H%M%S') AS stage_id,
              strftime(ts, '%y%m%d-%H%M%S') AS log_stamp FROM events""",
)
def q_run_stamp(spark, sf):
    e = table(spark, sf, "events", "event_id", "ts")
    return e.select(
        "event_id",
        F.date_format("ts", "yy/MM/dd/HH/mm/ss").alias("created"),
        F.date_format("ts", "yyMMddHHmmss").alias("stage_id"),
        F.date_format("ts", "yyMMdd-HHmmss").alias("log_stamp"),
    )


@register(
    "legal_url",
    lambda: f"SELECT page_id, url, coalesce(regexp_matches(url, {S.q(T.LEGAL_URL_RE)}), false) AS is_legal FROM pages",
)
def q_legal_url(spark, sf):
    p = table(spark, sf, "pages", "page_id", "url")
    return p.select("page_id", "url", T.legal_url("url").alias("is_legal"))


@register(
    "log_severity",
    """SELECT doc_id, pos - 1 AS line_no,
              CASE WHEN strpos(lower(l[pos]), 'traceback') > 1 THEN 'traceback'
                   WHEN strpos(lower(l[pos]), 'error') > 1 THEN 'error'
                   WHEN strpos(lower(l[pos]), 'warning') > 1 THEN 'warning' ELSE 'plain' END AS severity
       FROM (SELECT doc_id, l, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))""",
)
def q_log_severity(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "text")
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.select("doc_id", "line_no", T.log_severity("line").alias("severity"))


def _flagship_sql():
    sims = S.similarity_sql("t", "url", "body", PROFILE, R.REFERENCE_ANCHORS)
    base = _sink_sql()
    return f"""WITH t AS (SELECT url, body FROM ({base})),
               s AS {sims}
               SELECT b.* FROM ({base}) b JOIN s ON s.id = b.url WHERE s.sim >= {THRESHOLD}"""


@register("relevant_articles", _flagship_sql)
def q_relevant_articles(spark, sf):
    pages = table(spark, sf, "pages", "page_id", "url", "html")
    return relevant_articles(spark, pages, PROFILE, THRESHOLD, TAG, RUN_TS, stopwords=load_default_stopwords(spark))
