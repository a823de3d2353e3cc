"""Operators called as a library: a plain session, another folder, nothing prepared beforehand."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "2").getOrCreate())
from pagesift.llm import decontamination, extraction, language, licenses, neighbours, packing, quality, simhash
from pagesift.llm.common import vocabulary_path
docs = spark.createDataFrame([(i, "all rights reserved by the people of word%d" % (i % 3), "en", "h%d" % (i % 2), 40) for i in range(8)],
                             "doc_id long, text string, lang string, source string, n_chars long")
pages = spark.createDataFrame([(1, "http://h.example/a", "<html lang='en'><body><article><p>some text of the page</p></article></body></html>")],
                              "page_id long, url string, html string")
labels = spark.createDataFrame([(i, i % 2, 0) for i in range(8)], "doc_id long, quality int, toxic int")
items = spark.createDataFrame([(1, "all rights reserved by the people of word1")], "item_id long, text string")
vectors = spark.createDataFrame([(i, [1.0, 0.1 * (i // 2)], "a") for i in range(8)], "vec_id long, embedding array<double>, label string")
calls = {{
    "main text": lambda: extraction.extract_main_text(pages),
    "licenses": lambda: licenses.scan_licenses(docs),
    "contamination": lambda: decontamination.drop_contaminated(docs, items),
    "language": lambda: language.drop_unidentified(docs),
    "packing": lambda: packing.pack_documents(docs, vocabulary_path(), 16),
    "quality": lambda: quality.score_quality(docs, labels, 0.3),
    "simhash": lambda: simhash.near_duplicates(docs),
    "vectors": lambda: neighbours.near_duplicate_vectors(vectors),
}}
for name, call in calls.items():
    print("rows of", name, call().count(), flush=True)
"""


def test_operators_without_a_prepared_session(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=REPO)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert run.returncode == 0, run.stderr[-2000:]
    got = dict(line[len("rows of "):].rsplit(" ", 1) for line in run.stdout.splitlines() if line.startswith("rows of "))
    assert got == {"main text": "1", "licenses": "8", "contamination": "0", "language": "8", "packing": "8", "quality": "8", "simhash": "8", "vectors": "8"}
