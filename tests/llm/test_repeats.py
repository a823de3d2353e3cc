import hashlib
import random
import re

import pytest

from pagesift.llm import repeats as R


def brute(rows, window):
    low = 10**30
    docs = [(low if i is None else i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in docs:
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            first[k] = min(first.get(k, low), i)
    out = []
    for (own, _), (i, w) in zip(rows, docs):
        gone = {q for p in range(len(w) - window + 1) if first[tuple(w[p : p + window])] < i for q in range(p, p + window)}
        out.append((own, len(w), len(gone), " ".join(x for q, x in enumerate(w) if q not in gone)))
    return sorted(out, key=str)


def make_rows(rnd, n):
    vocab = ["a", "b", "Ün", "c\xa0d", "e", "f,", "\x1cg", "h"]
    passages = [[rnd.choice(vocab) + str(rnd.randrange(30)) for _ in range(rnd.randint(5, 60))] for _ in range(8)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(rnd.randint(0, 4)):
            w += rnd.choice(passages)[rnd.randint(0, 4) :] if rnd.random() < 0.6 else [rnd.choice(vocab) for _ in range(rnd.randint(0, 40))]
        rows.append((i, rnd.choice([" ", "\n", " \t "]).join(w)))
    return rows


@pytest.mark.parametrize("block_bytes,shard", [(1500, 3), (1 << 21, 100_000)])
def test_equals_brute_force(spark, monkeypatch, block_bytes, shard):
    monkeypatch.setattr(R, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(R, "GROUP_BYTES", block_bytes * 4)
    monkeypatch.setattr(R, "SHARD_PHRASES", shard)
    rows = make_rows(random.Random(7), 120)
    rows += [(200, None), (None, rows[5][1]), (None, rows[5][1]), (9, rows[9][1]), (9, "other " * 20), (201, "z " * 3000), (202, "z " * 50)]
    df = spark.createDataFrame([(*r, 1, "x", b"k") for r in rows], "doc_id long, text string, n_words int, source string, raw binary")
    for window, phrase in ((13, 7), (4, 4)):
        got = R.mark_repeats(df, window, phrase).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str) == brute(rows, window)
        assert {r.raw for r in got} == {b"k"} and sorted(map(str, (r.text for r in got))) == sorted(map(str, (t for _, t in rows)))


def test_remove_repeats_keeps_columns_and_untouched_texts(spark, docs_schema):
    words = " ".join(f"w{i}" for i in range(30))
    rows = [(1, f"x  {words}\ny", "en", "s", 3), (2, f"own {words} words", "de", None, None), (3, "a  b", None, "s", 4)]
    df = spark.createDataFrame(rows, docs_schema)
    out = R.remove_repeats(df)
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns == df.columns and out.dtypes == df.dtypes
    assert (got[1].text, got[2].text, got[2].n_chars, got[3].text) == (rows[0][1], "own words", 9, "a  b")


def test_empty_and_long(spark, docs_schema):
    assert R.mark_repeats(spark.createDataFrame([], docs_schema)).count() == 0
    long = " ".join(str(i) for i in range(400_000))
    df = spark.createDataFrame([(1, long), (2, long)], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in R.mark_repeats(df).collect()}
    assert got == {1: (400_000, 0), 2: (400_000, 400_000)}


def test_digest(spark):
    from pagesift.llm.registry import op7_phrase_automata

    rows = op7_phrase_automata(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = {d: (n, m, hashlib.sha256(k.encode()).hexdigest()) for d, n, m, k in brute([tuple(r) for r in docs], 13)}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows} == want


def test_more_blocks_than_buckets_and_no_table_left(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK_BYTES", 1500)
    monkeypatch.setattr(R, "GROUP_BYTES", 9000)
    rows = make_rows(random.Random(8), 100)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    limit = spark.conf.get("spark.sql.sources.bucketing.maxBuckets")
    spark.conf.set("spark.sql.sources.bucketing.maxBuckets", 3)
    try:
        got = R.mark_repeats(df).collect()
    finally:
        spark.conf.set("spark.sql.sources.bucketing.maxBuckets", limit)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str) == brute(rows, 13)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("pagesift_blocks")]


def test_words_of_several_characters():
    import pyarrow as pa

    rows = make_rows(random.Random(9), 60)
    table = R.by_id(pa.table({"id": [i for i, _ in rows], "t": [t.encode() for _, t in rows]}), "id", "t")
    block = R.Block(table, "id", "t", 13, 7)
    _, least = block.least_phrases()
    import numpy as np

    known = np.unique(least)[::2]
    want = block.located(known).tolist()
    assert want == np.flatnonzero(np.isin(least, known)).tolist()
    for characters in (7, 0xD900):
        assert block.located(known, characters).tolist() == want


def test_notes_round_trip():
    import numpy as np

    rnd = np.random.default_rng(1)
    for n in (0, 1, 1000):
        given = (np.sort(rnd.integers(0, 10**6, n)), rnd.integers(0, n + 1, n), rnd.random(n) < 0.3)
        assert all((a == b).all() and len(a) == n for a, b in zip(R._noted(R._note(*given)), given))
