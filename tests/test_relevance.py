import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagesift.operators import relevance as R

CASES = [
    # (doc tokens, profile, anchors, expected)
    ("x x y z", {"x": 60, "y": 40}, (), 0.905822),
    ("x k1", {"x": 50, "k1": 50}, ("k1", "k2"), 1.0),
    ("x y", {"x": 50, "k1": 50}, ("k1", "k2"), 0.5),
    ("x y", {"x": 50, "q": 50}, (), 0.707107),
    ("", {"x": 50}, (), 0.0),
    ("a b", {"x": 50}, (), 0.0),
]


def brute(doc: str, profile: dict, anchors) -> float:
    """Plain TF-IDF over the four-text corpus {doc, [], [], anchors}."""
    words = doc.split()
    corpus = [words, [], [], list(anchors)]
    vocab = set(words) | set(anchors)
    df = {t: sum(1 for d in corpus if t in d) for t in vocab}
    idf = {t: math.log2(len(corpus) / df[t]) for t in vocab}
    total = sum(profile.values())
    q = Counter()
    for term, w in profile.items():
        n = int(w / total * 100)
        for word in term.split():
            q[word] += n
    dv = {t: c * idf[t] for t, c in Counter(words).items()}
    qv = {t: c * idf[t] for t, c in q.items() if t in vocab and c > 0}
    dn = math.sqrt(sum(v * v for v in dv.values()))
    qn = math.sqrt(sum(v * v for v in qv.values()))
    if dn == 0 or qn == 0:
        return 0.0
    return sum(dv[t] * qv.get(t, 0) for t in dv) / (dn * qn)


@pytest.mark.parametrize("doc,profile,anchors,expected", CASES)
def test_brute_matches_golden(doc, profile, anchors, expected):
    assert round(brute(doc, profile, anchors), 6) == pytest.approx(expected, abs=1e-6)


def test_set_and_row_forms_match_golden(spark):
    rows = [(i, c[0]) for i, c in enumerate(CASES)]
    docs = spark.createDataFrame(rows, "id long, text string")
    for i, (doc, profile, anchors, expected) in enumerate(CASES):
        one = docs.where(F.col("id") == i)
        got = R.profile_similarity(spark, one, "id", "text", profile, anchors=anchors).first()["sim"]
        assert got == pytest.approx(expected, abs=1e-6), (doc, profile)
        words = R.profile_words(spark, profile)
        row = one.select(R.row_similarity(F.col("text"), words, anchors).alias("s")).first()["s"]
        assert row == pytest.approx(expected, abs=1e-6), (doc, profile)


def test_profile_counts_truncation_and_split(spark):
    prof = R.profile_frame(spark, {"a": 0.29, "b c": 0.71})
    got = {r["word"]: r["n"] for r in R.profile_counts(prof).collect()}
    assert got == {"a": 28, "b": 71, "c": 71}
    cjk = R.profile_frame(spark, {"考研": 0.2, "研究": 0.7})
    got = {r["word"]: r["n"] for r in R.profile_counts(cjk).collect()}
    assert got == {"考研": 22, "研究": 77}


def test_brute_force_on_fixture_documents(spark, tmp_path):
    from pagesift.functions.text import tokens

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(40)
    profile = {"re": 0.5, "th": 0.3, "ble": 0.2}
    anchors = ("ble", "tion")
    got = {r["doc_id"]: r["sim"] for r in R.profile_similarity(spark, docs, "doc_id", "text", profile, anchors=anchors).collect()}
    toks = {r["doc_id"]: " ".join(r["t"]) for r in docs.select("doc_id", tokens(F.trim("text")).alias("t")).collect()}
    for d, text in toks.items():
        assert got[d] == pytest.approx(round(brute(text, profile, anchors), 6), abs=2e-6)


def test_similarity_in_unit_interval_and_filter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    s = R.profile_similarity(spark, docs, "doc_id", "text", {"re": 0.5, "th": 0.5}, stopwords=R.stopword_frame(spark))
    vals = [r["sim"] for r in s.collect()]
    assert len(vals) == docs.count()
    assert all(0.0 <= v <= 1.0 + 1e-9 for v in vals)
    kept = R.content_filter(s, 0.1).count()
    assert kept == sum(1 for v in vals if v >= 0.1)
