"""Benchmark of the headline queries.

Runs each query over the whole tables at ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) on ``local[$BENCH_CPUS]`` and prints one JSON line.
Each query is forced to completion with the ``noop`` sink (no collect to the
driver); a warm-up pass on the smallest scale runs first.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pagesift.plans import catalog  # noqa: E402
from pagesift.session import local_session  # noqa: E402

HEADLINE = [
    "relevant_articles",
    "scored_articles",
    "profile_similarity",
    "tfidf",
    "article_text",
    "url_join",
    "html_tokens",
    "frontier_expand",
    "parser_tree",
    "config_verdict",
    "stream_articles",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    keys = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2 if cpus.isdigit() else 16)
    qs = catalog.queries()
    warm = "/root/testdata/sf0.001"
    if os.path.isdir(warm):
        for k in ("relevant_articles", "article_text"):
            run(qs[k](spark, warm))
    times = {}
    for k in keys:
        t0 = time.perf_counter()
        run(qs[k](spark, sf_dir))
        times[k] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "total_sec", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": sf, "cpus": cpus, "spark": spark.version,
    }))


if __name__ == "__main__":
    main()
