"""Each stage and the whole run against brute force on the smallest tables."""

import os

import corpus_pipeline as C
from test_decontamination import semi_global, words
from test_language import brute as brute_language
from test_packing import check
from test_repeats import brute as brute_repeats
from test_simhash import brute as brute_simhash

SF = "/root/testdata/sf0.001"


def as_tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def brute_stages(docs, items):
    """Rows after each filtering stage; documents are tuples of the table's columns."""
    accepted = {r[0] for r in brute_language([(d[0], d[1], d[2], d[3]) for d in docs]) if r[3]}
    docs = [d for d in docs if d[0] in accepted]
    yield docs
    first = {i for i, _, c in brute_simhash([d[:2] for d in docs], 4) if i == c}
    docs = [d for d in docs if d[0] in first]
    yield docs
    kept = {i: (n, text) for i, _, n, text in brute_repeats([d[:2] for d in docs], 13)}
    docs = [(d[0], kept[d[0]][1], d[2], d[3], len(kept[d[0]][1])) if kept[d[0]][0] else d for d in docs]
    yield docs
    patterns = [p for p in (words(t) for t in items) if p]
    docs = [d for d in docs if not any(set(p) & set(words(d[1])) and min(semi_global(p, words(d[1])), default=9) <= int(0.2 * len(p)) for p in patterns)]
    yield docs


def test_stages_and_run_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = [tuple(r) for r in docs.collect()]
    stages = dict(zip([n for n, _ in C.STAGES], brute_stages(want, items)))
    now = docs
    for name, stage in C.STAGES[:-1]:
        now = stage(spark, now, SF).cache()
        assert now.columns == docs.columns
        assert as_tuples(now) == sorted(stages[name], key=str), name
    last = stages["benchmark decontamination"]
    assert 0 < len(last) < len(want)
    check([d[:2] for d in last], C.run(spark, SF).collect(), 2048)


def test_clean_documents_stay(spark, tmp_path, docs_schema):
    base = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = base.where("lang = 'en'").orderBy("doc_id").select("text").first()[0]
    rows = [(90_001, "Wholly new words that stand alone here, with the and of.", "en", "src1", 56), (90_002, text, "en", "src2", None),
            (90_003, None, None, None, None), (90_004, "12 34", "en", "src1", 5)]
    base.unionByName(spark.createDataFrame(rows, docs_schema)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    ids = {r.doc_id for r in C.run(spark, str(tmp_path)).select("doc_id").distinct().collect()}
    assert 90_001 in ids and not ids & {90_002, 90_003, 90_004}


def test_empty_documents(spark, tmp_path, docs_schema):
    os.makedirs(tmp_path, exist_ok=True)
    spark.createDataFrame([], docs_schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0
