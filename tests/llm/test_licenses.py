import random
import re

from pagesift.llm.licenses import scan_licenses

PHRASES = {"cc-by": ["cc", "by"], "gpl": ["general", "public", "license"], "reserved": ["all", "rights", "reserved"]}


def brute(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    hits = [(i, k) for k, p in PHRASES.items() for i in range(len(words)) if words[i : i + len(p)] == p]
    at = [i for i, _ in hits]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({k for _, k in hits}))


def test_base_columns_equal_brute_force(spark, docs_schema):
    rnd = random.Random(5)
    parts = ["CC BY", "cc-by", "General Public  License", "all rights", "reserved", "All Rights RESERVED.", "É", "by", "cc", "x_y", "K", "\n", "9z"]
    rows = [(i, " ".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))), "en", "s", 0) for i in range(200)]
    rows += [(200, None, None, None, None), (None, "cc by cc by", None, None, None), (3, "cc by " * 40000, "", "", 1), (7, "", "", "", 0)]
    got = scan_licenses(spark.createDataFrame(rows, docs_schema)).collect()
    have = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=str)
    assert have == sorted(((r[0], *brute(r[1])) for r in rows), key=str)
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)


def test_templates_need_their_key_phrase(spark):
    rows = [
        (1, "foo. Licensed under the Apache License, Version 2.0. bar"),
        (2, "the license version 2 0 licensed apache under"),
        (3, "word " * 500 + "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
         "software and its associated documentation files" + " word" * 500 + " released under the MIT License"),
        (4, "permission to copy of this software and any person obtaining documentation"),
        (5, "CC BY-NC 4.0."),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, labels string, score int")
    got = {r.doc_id: r.labels for r in scan_licenses(df).collect()}
    assert got == {1: "apache-2.0", 2: "", 3: "mit,mit-text", 4: "", 5: "cc-by,cc-by-nc"}


def test_empty(spark, docs_schema):
    assert scan_licenses(spark.createDataFrame([], docs_schema)).count() == 0
