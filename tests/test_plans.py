"""Plan regression checks: the shapes the design relies on."""

import io
from contextlib import redirect_stdout

from pagesift.plans import catalog

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_flagship_dedup_never_sorts_html(spark):
    p = plan(catalog.queries()["relevant_articles"](spark, SF))
    assert "SortAggregate" not in p and "SortMergeJoin" not in p
    assert "LeftSemi" in p
    assert "ReadSchema: struct<page_id:bigint,url:string,html:string>" in p
    # the threshold is applied after the projection (a generator), not pushed under it
    assert "Generate" in p


def test_column_pruning_reaches_scan(spark):
    p = plan(catalog.queries()["html_tokens"](spark, SF))
    assert "ReadSchema: struct<page_id:bigint,html:string>" in p


def test_term_work_stays_in_the_row(spark):
    conf = "spark.pagesift.parsePartitions"
    dealt = spark.conf.get(conf)
    spark.conf.unset(conf)
    try:
        for k in ("term_counts", "doc_frequency", "tfidf", "profile_similarity", "content_filter"):
            p = plan(catalog.queries()[k](spark, SF))
            assert "Exchange" not in p and "Join" not in p, k
    finally:
        spark.conf.set(conf, dealt)


def test_no_cross_products_in_registered_plans(spark):
    qs = catalog.queries()
    for k in ("url_join", "stage_route", "rule_lookup", "stage_history", "config_latest", "parser_tree", "loop_product"):
        p = plan(qs[k](spark, SF))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, k


def test_main_text_is_one_partitioning(spark):
    conf = "spark.pagesift.parsePartitions"
    dealt = spark.conf.get(conf)
    spark.conf.unset(conf)
    try:
        for k in ("node_text", "link_density", "boilerplate_filter", "paragraph_score", "top_paragraph", "article_expand", "article_text"):
            p = plan(catalog.queries()[k](spark, SF))
            assert p.partition("\n\n")[0].count("Exchange") == 1, k
            # no join, no checkpoint (a plan that starts from stored rows), no row per ancestor
            assert "Join" not in p and "Scan ExistingRDD" not in p and "explode(path" not in p, k
    finally:
        spark.conf.set(conf, dealt)


def test_verdict_of_a_rule_needs_no_join(spark):
    conf = "spark.pagesift.parsePartitions"
    dealt = spark.conf.get(conf)
    spark.conf.unset(conf)
    try:
        p = plan(catalog.queries()["config_verdict"](spark, SF))
        assert "Join" not in p and "Exchange" not in p and "Generate" not in p
    finally:
        spark.conf.set(conf, dealt)


def test_a_level_shuffles_only_what_it_reached(spark):
    from pyspark.sql import functions as F

    from pagesift.operators import frontier as FR
    from pagesift.session import new_scratch_path

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    urls = spark.range(5000).select(F.concat(F.lit("u"), "id").alias("url"))
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables too large to broadcast
    try:
        FR._bucketed(urls.withColumn("depth", F.lit(1)).repartition(n, "url"), "t_visited", new_scratch_path(spark, "v"), n)
        FR._bucketed(urls.withColumn("dst_url", F.col("url")).repartition(n, "url"), "t_links", new_scratch_path(spark, "l"), n)
        p = plan(FR.next_level(spark.table("t_visited"), spark.table("t_links"), 1))
        assert p.partition("\n\n")[0].count("Exchange") == 1, p
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
        spark.sql("DROP TABLE IF EXISTS t_visited")
        spark.sql("DROP TABLE IF EXISTS t_links")
