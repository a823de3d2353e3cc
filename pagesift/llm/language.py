"""Language identification by Bayesian evidence fusion.

Text likelihoods come from hashed character n-gram counts of the rows that
declare a language, over the whole corpus.  What the text says alone, counted
per host, per address suffix and over all rows, gives host priors that are
smoothed towards their suffix and that towards the whole; how often texts of a
language declare which language gives the weight of a declaration.  The
posterior of a row multiplies text, declaration and prior.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.llm.common import OWN, cut, written
from pagesift.session import ship_package

UNDETERMINED = "und"
GRAM = 3
BUCKETS = 1 << 15
#: Rows a declared language needs to be a class: any row is enough, the smoothing of the counts carries thin ones.
MIN_ROWS = 1
#: Overlapping n-grams repeat each other's evidence.
TEMPER = 1.0 / GRAM
#: Share of a text's n-grams that belong to no language.
FOREIGN = 0.1
#: Copies of each host's prior that its rows are spread over, so that a host with a third of all rows is no single task.
SALTS = 16

#: N-grams of a language that a task holds before it counts them.
HELD_GRAMS = 1 << 18

_TEXT_BYTES = bytes(c if c >= 0x80 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def grams(text: str) -> np.ndarray:
    """Buckets of the byte n-grams of the lower-cased letters; runs of other characters are one blank."""
    raw = b" ".join(text.lower().encode("utf-8", "replace").translate(_TEXT_BYTES).split())
    if not raw:
        return np.zeros(0, np.uint16)
    x = np.frombuffer(b" " + raw + b" ", np.uint8).astype(np.uint32)
    code = x[:-2] | x[1:-1] << np.uint32(8) | x[2:] << np.uint32(16)
    return (code * np.uint32(0x9E3779B1) >> np.uint32(32 - 15)).astype(np.uint16)


def page_evidence(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` with ``declared`` (of the html tag), ``host`` and ``suffix`` (last part of the host's name)."""
    ship_package(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce(url_col, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    declared = F.regexp_extract(F.coalesce(html_col, F.lit("")), r"""(?i)<html\b[^>]*\blang\s*=\s*["']?([A-Za-z-]+)""", 1)
    return pages.withColumns({
        "declared": F.when(declared != "", declared),
        "host": F.when(host != "", host),
        "suffix": F.when(host.contains("."), F.element_at(F.split(host, r"\."), -1)),
    })


def primary_tag(declared: Column) -> Column:
    """``de`` of ``de-AT``; null if it is no language tag."""
    tag = F.regexp_extract(F.lower(F.trim(declared.cast("string"))), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    return F.when(tag != "", tag)


def _gram_counts(rows: DataFrame, languages: list[str]) -> np.ndarray:
    """Counts of each n-gram bucket per language over all declared rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}  # of the languages that the task meets
        at = {lang: i for i, lang in enumerate(languages)}
        waiting: dict[int, list[np.ndarray]] = {i: [] for i in range(len(languages))}
        held = [0] * len(languages)

        def settle(i: int) -> None:
            if waiting[i]:
                total[i] = total.get(i, 0) + np.bincount(np.concatenate(waiting[i]), minlength=BUCKETS)
                waiting[i], held[i] = [], 0

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                if lang in at:
                    i = at[lang]
                    waiting[i].append(grams(text.as_py() or ""))
                    held[i] += len(waiting[i][-1])
                    if held[i] >= HELD_GRAMS:
                        settle(i)
        for i in waiting:
            settle(i)
        for i, n in total.items():
            bucket = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bucket), i, np.int32)), pa.array(bucket.astype(np.int32)), pa.array(n[bucket])], ["lang", "bucket", "n"])

    sums = rows.select("declared", "text").mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    out = np.zeros((len(languages), BUCKETS))
    for r in sums.toArrow().to_batches():
        out[r.column(0).to_numpy(), r.column(1).to_numpy()] = r.column(2).to_numpy()
    return out


def text_model(counts: np.ndarray) -> np.ndarray:
    """Log-likelihood of each bucket per language, smoothed; the last row is the undetermined class (all buckets alike).

    A share of any text is in no language (names, keys, addresses), so each
    language is mixed with that class: one odd n-gram costs it little.
    """
    own = (counts + 0.1) / (counts.sum(axis=1, keepdims=True) + 0.1 * BUCKETS)
    logs = np.log((1 - FOREIGN) * own + FOREIGN / BUCKETS)
    return np.vstack([logs, np.full((1, BUCKETS), -np.log(BUCKETS))]).astype(np.float32)


def _scored(rows: DataFrame, model: np.ndarray, classes: list[str]) -> DataFrame:
    """Narrow rows with the text's log-likelihood per class and the class that the text alone says."""
    shipped = rows.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = shipped.value
        for b in batches:
            likelihood = np.zeros((b.num_rows, len(classes)))
            n = np.zeros(b.num_rows, np.int64)
            for i, text in enumerate(b.column(0)):
                g = grams(text.as_py() or "")
                n[i] = len(g)
                likelihood[i] = logs[:, g].sum(axis=1, dtype=np.float64) * TEMPER
            said = [classes[k] if m else None for k, m in zip(likelihood.argmax(axis=1).tolist(), n.tolist())]
            columns = [*b.columns[1:], pa.array(list(likelihood), pa.list_(pa.float64())), pa.array(n), pa.array(said, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*b.schema.names[1:], "likelihood", "n_grams", "said"])

    schema = f"doc_id long, {OWN}text_hash long, declared string, suffix string, host string, likelihood array<double>, n_grams long, said string"
    return rows.select("text", "doc_id", f"{OWN}text_hash", "declared", "suffix", "host").mapInArrow(score, schema)


def smoothed_priors(said: DataFrame, classes: list[str], strength: float) -> DataFrame:
    """``(suffix, host, prior)``: shares of each class per host, smoothed towards the suffix and that towards all rows.

    ``said`` has ``suffix, host, said``.  The counts are grouped once by host;
    the levels above sum them up.
    """
    counts = [F.sum(F.when(F.col("said") == c, 1).otherwise(0)).alias(f"n{i}") for i, c in enumerate(classes)]
    hosts = cut(said.groupBy("suffix", "host").agg(*counts))
    total = hosts.agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(len(classes))]).first()
    seen = [float(total[i] or 0) for i in range(len(classes))]
    top = [(n + 1.0) / (sum(seen) + len(classes)) for n in seen]

    def smoothed(names: list[Column], parent: list[Column]) -> list[Column]:
        every = sum(names[1:], names[0])
        return [(n + F.lit(strength) * p) / (every + F.lit(strength)) for n, p in zip(names, parent)]

    ks = range(len(classes))
    suffixes = hosts.groupBy("suffix").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in ks])
    level = smoothed([F.col(f"n{i}") for i in ks], [F.lit(t) for t in top])
    suffixes = suffixes.select(F.col("suffix").alias("s"), *[p.alias(f"p{i}") for i, p in enumerate(level)])
    joined = hosts.join(suffixes, F.col("suffix").eqNullSafe(F.col("s")))
    own = smoothed([F.col(f"n{i}") for i in ks], [F.col(f"p{i}") for i in ks])
    # rows without a host know no more than their suffix
    prior = F.array(*[F.when(F.col("host").isNull(), F.col(f"p{i}")).otherwise(p) for i, p in enumerate(own)])
    return joined.select("suffix", "host", prior.alias("prior"))


def _decisions(
    docs: DataFrame, id_col: str, text_col: str, declared_col: str | None, host_col: str | None, suffix_col: str | None,
    strength: float, min_posterior: float,
) -> DataFrame:
    none = F.lit(None).cast("string")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).alias("text"),
        F.xxhash64(F.col(text_col)).alias(f"{OWN}text_hash"),
        (primary_tag(F.col(declared_col)) if declared_col else none).alias("declared"),
        (F.col(suffix_col).cast("string") if suffix_col else none).alias("suffix"),
        (F.col(host_col).cast("string") if host_col else none).alias("host"),
    )
    declared = rows.where("declared IS NOT NULL").select("declared").distinct().collect()
    # a declaration of ``und`` names no language and speaks for that class
    languages = sorted(r["declared"] for r in declared if r["declared"] != UNDETERMINED)
    classes = [*languages, UNDETERMINED]
    model = text_model(_gram_counts(rows, languages)) if languages else text_model(np.zeros((0, BUCKETS)))
    scored = written(_scored(rows, model, classes), "language")

    # how often a text of each class declares each language, and nothing
    pairs = scored.where("said IS NOT NULL").groupBy("said", "declared").count().collect()
    spoken = np.full((len(classes), len(classes)), 1.0)
    place = {c: i for i, c in enumerate(classes)}
    for r in pairs:
        if r["declared"] is not None:
            spoken[place[r["said"]], place.get(r["declared"], len(languages))] += r["count"]
    spoken = np.log(spoken / spoken.sum(axis=1, keepdims=True))

    salt = F.pmod(F.xxhash64("doc_id", f"{OWN}text_hash"), F.lit(SALTS)).cast("int")
    priors = smoothed_priors(scored, classes, strength).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    priors = priors.select(F.col("suffix").alias("ps"), F.col("host").alias("ph"), F.col("salt").alias("pk"), "prior")
    on = F.col("suffix").eqNullSafe(F.col("ps")) & F.col("host").eqNullSafe(F.col("ph")) & (F.col("salt") == F.col("pk"))
    joined = scored.withColumn("salt", salt).join(priors, on).select("doc_id", f"{OWN}text_hash", "declared", "host", "likelihood", "n_grams", "prior")

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            said = b.column(2).to_pylist()
            score = np.array(b.column(4).to_pylist()) + np.log(np.array(b.column(6).to_pylist()))
            for i, d in enumerate(said):
                if d is not None:
                    score[i] += spoken[:, place.get(d, len(languages))]
            score -= score.max(axis=1, keepdims=True)
            p = np.exp(score)
            p /= p.sum(axis=1, keepdims=True)
            p[b.column(5).to_numpy() == 0, :] = np.eye(len(classes))[-1]  # no letters: no language
            best = p.argmax(axis=1)
            top = p[np.arange(len(best)), best]
            accepted = 1.0 - p[:, -1] >= min_posterior
            columns = [b.column(0), b.column(1), pa.array([classes[k] for k in best]), pa.array(top), b.column(2), b.column(3), pa.array(accepted)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", f"{OWN}text_hash", "language", "posterior", "declared", "host", "accepted"])

    return joined.mapInArrow(fuse, f"doc_id long, {OWN}text_hash long, language string, posterior double, declared string, host string, accepted boolean")


def identify_languages(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    declared_col: str | None = "lang",
    host_col: str | None = "source",
    suffix_col: str | None = None,
    strength: float = 50.0,
    min_posterior: float = 0.5,
) -> DataFrame:
    """``doc_id, language, posterior, declared, host, accepted`` of every row.

    The classes are all declared languages, however few rows name them, and
    ``und``.  A row is accepted if the languages together have a
    posterior of at least ``min_posterior``: a short text that two of them could
    claim is no reason to reject it.  Null and empty texts, and texts without letters,
    are ``und`` with posterior 1; so are all rows if none declares a language.
    A null declaration, host or suffix adds no evidence.  Null ids and repeated
    rows keep their row; an empty table gives none; other columns are not read.
    """
    ship_package(docs.sparkSession)
    return _decisions(docs, id_col, text_col, declared_col, host_col, suffix_col, strength, min_posterior).drop(f"{OWN}text_hash")


def drop_unidentified(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str | None = "lang",
    host_col: str | None = "source", suffix_col: str | None = None, strength: float = 50.0, min_posterior: float = 0.5,
) -> DataFrame:
    """The rows of ``docs`` that ``identify_languages`` accepts."""
    ship_package(docs.sparkSession)
    found = _decisions(docs, id_col, text_col, declared_col, host_col, suffix_col, strength, min_posterior)
    bad = cut(found.where("NOT accepted").select(F.col("doc_id").alias(f"{OWN}id"), f"{OWN}text_hash").distinct())
    on = F.col(id_col).cast("long").eqNullSafe(F.col(f"{OWN}id")) & (F.xxhash64(F.col(text_col)) == F.col(f"{OWN}text_hash"))
    return docs.join(bad, on, "left_anti")
