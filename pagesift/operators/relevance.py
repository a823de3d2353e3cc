"""Relevance: weighted keyword profile against text by TF-IDF cosine.

The reference builds a four-document corpus per scored text ({text, ∅, ∅,
anchors}), fits TF-IDF (tf · log2(N/df), unit norm) and takes the cosine with
the profile expanded into repeated words.  That has a closed form per term:

    idf_t = 1 if t is in the text and among the anchors, else 2
    sim   = Σ_{t∈D} tf_t n_t idf_t² / (‖tf·idf‖ · ‖n·idf‖ over D ∪ anchors)

so a whole table of texts is scored with one (doc, term) aggregation, one
broadcast join with the (term, n, anchor) table and one per-document
aggregation — no model per document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.functions.joins import param_frame
from pagesift.functions.stopwords import load_default_stopwords
from pagesift.functions.text import HAN, bound, term_runs, tokens

# The two anchor words of the reference's corpus ("exam", "notes").
REFERENCE_ANCHORS = ("考试", "说明")


def stopword_frame(spark: SparkSession, words=None) -> DataFrame:
    words = load_default_stopwords(spark) if words is None else sorted(set(words))
    return param_frame(spark, [(w,) for w in words], "term STRING")


def profile_frame(spark: SparkSession, weights: dict) -> DataFrame:
    return param_frame(spark, [(str(k), float(v)) for k, v in weights.items()], "term STRING, weight DOUBLE")


def profile_counts(profile: DataFrame, group_cols: tuple[str, ...] = ()) -> DataFrame:
    """Word repetitions of a weighted profile: ``n = int(w / Σw * 100)`` per term,
    multi-word terms split into words, counts summed per word; zero counts dropped.

    ``group_cols`` scores many profiles at once (Σw per profile).
    """
    gcols = list(group_cols)
    if gcols:
        # Totals per profile by aggregation (partial, map-side) joined back on
        # the profile key: a hot profile is split by AQE's skew join instead of
        # landing in one window task.
        tot = profile.groupBy(*gcols).agg(F.sum("weight").alias("_total"))
        weighted = profile.join(tot, gcols)
    else:
        # One profile: its total is a single scalar, read once and inlined.
        total = profile.agg(F.sum("weight")).first()[0]
        weighted = profile.withColumn("_total", F.lit(float(total) if total is not None else None).cast("double"))
    n = F.floor(F.col("weight") / F.col("_total") * 100).cast("long")
    per_term = weighted.select(*gcols, "term", n.alias("n")).where(F.col("n") > 0)
    # Words are lower-cased to meet the lower-cased document tokens.
    # A keyword in Han characters becomes the bigrams that tokens() makes of texts.
    parts = F.transform(F.split(F.lower(F.trim("term")), "\\s+"), lambda w: F.when(w.rlike(HAN), tokens(w)).otherwise(F.array(w)))
    words = per_term.select(*gcols, F.explode(F.flatten(parts)).alias("word"), "n")
    return words.where(F.col("word") != "").groupBy(*gcols, "word").agg(F.sum("n").alias("n"))


def doc_terms(docs: DataFrame, id_col: str, text_col: str, stopwords: DataFrame | None, tokens_col: str | None = None) -> DataFrame:
    """``(id, term)`` per token; stop words become null terms, so a text whose
    tokens are all stop words (or that has none) still yields its id.
    ``tokens_col`` names an array column of the caller's own tokens (another
    segmenter's, say) to be used instead of ``tokens(text)``."""
    from pagesift.functions.joins import spread

    toks = F.col(tokens_col) if tokens_col else tokens(F.trim(F.col(text_col)))
    t = spread(docs).select(id_col, F.explode_outer(toks).alias("term"))
    if stopwords is not None:
        flagged = stopwords.select("term", F.lit(True).alias("_stop"))
        t = t.join(flagged, "term", "left").select(
            id_col, F.when(F.col("_stop").isNull(), F.col("term")).alias("term")
        )
    return t


def kept_tokens(text, stopwords=(), tokens_col: str | None = None) -> "F.Column":
    """A text's tokens (or the caller's) without the stop words, as an array; never null."""
    toks = F.col(tokens_col) if tokens_col else tokens(F.trim(text if not isinstance(text, str) else F.col(text)))
    toks = F.coalesce(toks, F.array().cast("array<string>"))
    stop = list(stopwords)
    return F.filter(toks, lambda t: ~t.isin(stop)) if stop else toks


def row_term_counts(docs: DataFrame, id_col: str, text_col: str, stopwords=(), tokens_col: str | None = None) -> DataFrame:
    """``(id, term, tf)`` folded within each row: no shuffle, as all tokens of a text are in its row."""
    from pagesift.functions.joins import spread

    runs = term_runs(kept_tokens(text_col, stopwords, tokens_col))
    return spread(docs).select(id_col, F.inline(runs))


def row_tfidf(docs: DataFrame, id_col: str, text_col: str, anchors=REFERENCE_ANCHORS, stopwords=(), tokens_col: str | None = None) -> DataFrame:
    """``(id, term, weight)``: unit-normalised tf · idf of the four-text corpus, within each row."""
    from pagesift.functions.joins import spread

    anchors = list(anchors)
    staged = spread(docs).select(id_col, term_runs(kept_tokens(text_col, stopwords, tokens_col)).alias("_r"))

    def x(r):
        return r["tf"] * (F.when(r["term"].isin(anchors), 1.0).otherwise(2.0) if anchors else F.lit(2.0))

    norm = F.sqrt(F.aggregate("_r", F.lit(0.0), lambda acc, r: acc + x(r) * x(r)))
    out = bound(norm, lambda n: F.transform("_r", lambda r: F.struct(r["term"].alias("term"), F.round(x(r) / n, 6).alias("weight"))))
    return staged.select(id_col, F.inline(out))


def term_counts(terms: DataFrame, id_col: str) -> DataFrame:
    """Bag of words: ``(id, term, tf)``; map-side partial aggregation before the shuffle."""
    return terms.groupBy(id_col, "term").agg(F.count("term").alias("tf"))


def term_info(spark: SparkSession, profile, anchors=REFERENCE_ANCHORS) -> tuple[DataFrame, float]:
    """Broadcast ``(term, n, is_anchor)`` for profile words ∪ anchors, and the
    constant part of the query norm (Σ over anchors of (2n)²)."""
    if isinstance(profile, dict):
        profile = profile_frame(spark, profile)
    words = profile_counts(profile)
    anchor_df = param_frame(spark, [(a,) for a in anchors], "term STRING").withColumn("is_anchor", F.lit(True))
    info = (
        words.withColumnRenamed("word", "term")
        .join(anchor_df, "term", "full")
        .select("term", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("is_anchor", F.lit(False)).alias("is_anchor"))
    )
    info = F.broadcast(info)  # made of parameter lists
    c_anchor = info.where("is_anchor AND n > 0").agg(F.sum(4.0 * F.col("n") * F.col("n"))).first()[0] or 0.0
    return info, float(c_anchor)


def similarity_from_counts(tf: DataFrame, id_col: str, info: DataFrame, c_anchor: float) -> DataFrame:
    """Cosine per document from ``(id, term, tf)`` rows (null term = empty text)."""
    j = tf.join(info, "term", "left")
    idf = F.when(F.col("is_anchor"), 1.0).otherwise(2.0)
    n = F.coalesce(F.col("n"), F.lit(0)).cast("double")
    present = F.col("term").isNotNull()
    agg = j.groupBy(id_col).agg(
        F.sum(F.when(present, F.pow(F.col("tf") * idf, 2)).otherwise(0.0)).alias("dn2"),
        F.sum(F.when(present, F.col("tf") * n * idf * idf).otherwise(0.0)).alias("dot"),
        F.sum(
            F.when(present & (n > 0), F.pow(n * idf, 2) - F.when(F.col("is_anchor"), 4.0 * n * n).otherwise(0.0))
        ).alias("qpart"),
    )
    qn2 = F.coalesce(F.col("qpart"), F.lit(0.0)) + F.lit(c_anchor)
    sim = F.when(
        (F.col("dn2") > 0) & (qn2 > 0),
        F.try_divide(F.col("dot"), F.sqrt("dn2") * F.sqrt(qn2)),
    ).otherwise(F.lit(0.0))
    return agg.select(id_col, F.round(sim, 6).alias("sim"))


def profile_similarity(
    spark: SparkSession,
    docs: DataFrame,
    id_col: str,
    text_col: str,
    profile,
    anchors=REFERENCE_ANCHORS,
    stopwords: DataFrame | None = None,
) -> DataFrame:
    """One ``sim`` per input row of ``docs`` (rounded to 6 digits)."""
    info, c_anchor = term_info(spark, profile, anchors)
    tf = term_counts(doc_terms(docs, id_col, text_col, stopwords), id_col)
    return similarity_from_counts(tf, id_col, info, c_anchor)


def content_filter(scored: DataFrame, threshold: float, sim_col: str = "sim") -> DataFrame:
    """Keep rows whose similarity reaches the threshold (``>=``, as the spider does)."""
    return scored.where(F.col(sim_col) >= F.lit(float(threshold)))


def title_filter(
    spark: SparkSession,
    links: DataFrame,
    key_cols: list[str],
    text_col: str,
    profile,
    threshold: float,
    anchors=REFERENCE_ANCHORS,
    stopwords: DataFrame | None = None,
) -> DataFrame:
    """Link rows whose anchor text passes the title threshold, with its ``sim``."""
    keyed = links.withColumn("_lk", F.struct(*key_cols))
    sims = profile_similarity(spark, keyed, "_lk", text_col, profile, anchors, stopwords)
    return content_filter(keyed.join(sims, "_lk").drop("_lk"), threshold)


def profile_words(spark: SparkSession, profile: dict) -> dict[str, int]:
    """The (small, parameter-sized) word counts of one profile, on the driver."""
    return {r["word"]: int(r["n"]) for r in profile_counts(profile_frame(spark, profile)).collect()}


def row_similarity(text, words: dict[str, int], anchors=REFERENCE_ANCHORS, stopwords=(), tokens_col: str | None = None) -> "F.Column":
    """The same cosine as ``profile_similarity``, computed inside each row.

    Tokens are sorted and folded once with ``aggregate``: a change of token
    closes a run, whose length is the term frequency.  No explode, no shuffle
    and no join back to the text row, so a scoring step can sit between a
    page's extraction and its sink in one narrow stage.  Profile and stop
    words are parameters (bounded), inlined as literals / an IN-set.
    """
    toks = kept_tokens(text, stopwords, tokens_col)
    anchors = list(anchors)
    if words:
        kv = []
        for k, v in words.items():
            kv += [F.lit(k), F.lit(int(v))]
        nmap = F.create_map(*kv)
    else:
        nmap = F.create_map().cast("map<string,int>")
    c_anchor = float(sum(4.0 * n * n for w, n in words.items() if w in anchors and n > 0))

    def close(acc):
        t = acc["prev"]
        r = acc["run"].cast("double")
        is_a = t.isin(anchors) if anchors else F.lit(False)
        i = F.when(is_a, 1.0).otherwise(2.0)
        n = F.coalesce(F.try_element_at(nmap, t), F.lit(0)).cast("double")
        live = t.isNotNull()
        return (
            acc["dn2"] + F.when(live, F.pow(r * i, 2)).otherwise(0.0),
            acc["dot"] + F.when(live, r * n * i * i).otherwise(0.0),
            acc["qp"] + F.when(live & (n > 0), F.pow(n * i, 2) - F.when(is_a, 4.0 * n * n).otherwise(0.0)).otherwise(0.0),
        )

    def acc_struct(prev, run, dn2, dot, qp):
        return F.struct(
            prev.cast("string").alias("prev"),
            run.cast("long").alias("run"),
            dn2.cast("double").alias("dn2"),
            dot.cast("double").alias("dot"),
            qp.cast("double").alias("qp"),
        )

    init = acc_struct(F.lit(None), F.lit(0), F.lit(0.0), F.lit(0.0), F.lit(0.0))

    def merge(acc, t):
        same = F.coalesce(acc["prev"] == t, F.lit(False))
        dn2, dot, qp = close(acc)
        return F.when(same, acc_struct(acc["prev"], acc["run"] + 1, acc["dn2"], acc["dot"], acc["qp"])).otherwise(
            acc_struct(t, F.lit(1), dn2, dot, qp)
        )

    def finish(acc):
        dn2, dot, qp = close(acc)
        qn2 = qp + F.lit(c_anchor)
        return F.round(
            F.when((dn2 > 0) & (qn2 > 0), F.try_divide(dot, F.sqrt(dn2) * F.sqrt(qn2))).otherwise(F.lit(0.0)), 6
        )

    return F.aggregate(F.array_sort(toks), init, merge, finish)
