import itertools
import zlib

import numpy as np
import pytest

from pagesift.llm import quality as Q


def test_sum_of_squares_identity():
    rng = np.random.default_rng(1)
    m = Q.FactorisationMachine(0.3, rng.normal(size=Q.SIZE), rng.normal(size=(Q.SIZE, Q.RANK)))
    for text, n in (("Some words here, and some more.\nLine", 30), ("", None), ("x " * 50, 5)):
        index, value = Q.features(text, n)
        z = m.bias + sum(m.linear[i] * x for i, x in zip(index, value))
        z += sum(m.factors[index[a]] @ m.factors[index[b]] * value[a] * value[b] for a, b in itertools.combinations(range(len(index)), 2))
        assert m.score(index, value) == pytest.approx(1 / (1 + np.exp(-np.clip(z, -35, 35))), abs=1e-9)


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    pos = label == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = Q.score_quality(docs, labels).collect()
    assert len(rows) == docs.count()
    y = {r.doc_id: r.quality for r in labels.collect()}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(r.score, y[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in y]
    s, t, p = (np.array(c) for c in zip(*held))
    assert auc(s, t) > 0.97
    assert (p == t).mean() > 0.95


def test_labels_of_held_out_rows_and_other_columns_do_not_matter(spark):
    docs = [(i, ("good words in a line. " if i % 2 else "BAD!! BAD!! ") * (i % 9 + 1), f"l{i % 3}", "s", None) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    base = [(i, i % 2, 0) for i in range(200)]
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y, 1) for i, y, _ in base]
    schema = "doc_id long, quality int, toxic int"
    a = {r.doc_id: r.score for r in Q.score_quality(df, spark.createDataFrame(base, schema)).collect()}
    other = df.selectExpr("doc_id", "text", "'q' AS lang", "doc_id AS source", "n_chars")
    b = {r.doc_id: r.score for r in Q.score_quality(other.repartition(3), spark.createDataFrame(turned, schema)).collect()}
    assert a == pytest.approx(b)
    assert all((a[i] > 0.5) == bool(i % 2) for i in a)


def test_edge_cases(spark):
    rows = [(1, None, None), (2, "", 0), (None, "words", 5), (3, "a " * 100_000, 3), (3, "a " * 100_000, 3)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_chars long, score string")
    labels = spark.createDataFrame([(1, None), (2, 0), (2, 1), (3, 1), (None, 1)], "doc_id long, quality int")
    assert len(Q.score_quality(df, labels).collect()) == 5
    none = Q.score_quality(df, labels.limit(0)).collect()
    assert all(r.score == pytest.approx(0.5, abs=0.1) for r in none)
    assert Q.score_quality(df.limit(0), labels).count() == 0


def test_training_reads_one_row_per_id(spark, monkeypatch):
    """A labelled id that most rows share sends one row to the driver, whatever the order of the rows."""
    sizes = []
    fit = Q.FactorisationMachine.fit
    monkeypatch.setattr(Q.FactorisationMachine, "fit", lambda self, rows, *a: (sizes.append(len(rows)), fit(self, rows, *a))[1])
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5][:20]
    rows = [(i, f"text number {i} with words", None) for i in ids] + [(ids[0], f"copy {k % 7} of the text", k) for k in range(2000)]
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    models = [
        Q.train(spark.createDataFrame(part, "doc_id long, text string, n_chars long").repartition(n), labels)
        for part, n in ((rows, 5), (rows[::-1], 3))
    ]
    assert sizes == [20, 20]
    assert models[0].bias == models[1].bias and (models[0].linear == models[1].linear).all()
