"""Han text: bigram tokens, and the same pairs for a profile's keywords."""

from pyspark.sql import functions as F

from pagesift.functions.text import term_runs, tokens
from pagesift.operators import relevance as R


def test_bigrams(spark):
    rows = [("研究生考试2024年 Exam", ["研究", "究生", "生考", "考试", "2024", "年", "exam"]), ("A b", ["a", "b"]), ("短", ["短"]), ("", []), ("x𠀀𠀁y", ["x", "𠀀𠀁", "y"])]
    for text, want in rows:
        assert spark.createDataFrame([(text,)], "t string").select(tokens("t")).first()[0] == want


def test_term_runs(spark):
    df = spark.createDataFrame([(["b", "a", "b", None, "b"],), ([],), (["z"],)], "t array<string>")
    got = [[(x.term, x.tf) for x in r[0]] for r in df.select(term_runs(F.col("t"))).collect()]
    assert got == [[("a", 1), ("b", 3)], [], [("z", 1)]]


def test_a_chinese_profile_scores_above_zero(spark):
    df = spark.createDataFrame([("暨南大学研究生考试招生简章发布通知",), ("今天天气很好",)], "t string")
    words = R.profile_words(spark, {"研究生": 0.5, "招生简章": 0.5})
    row = [r[0] for r in df.select(R.row_similarity("t", words)).collect()]
    assert row[0] > 0.3 and row[1] == 0.0
    ids = df.select(F.monotonically_increasing_id().alias("id"), "t")
    both = R.profile_similarity(spark, ids, "id", "t", {"研究生": 0.5, "招生简章": 0.5}).orderBy(F.desc("sim")).collect()
    assert [r.sim for r in both] == row


def test_a_token_column_of_the_caller_is_used(spark):
    df = spark.createDataFrame([("x", ["研究生", "考试"])], "t string, own array<string>")
    assert df.select(R.row_similarity("t", {"研究生": 100}, tokens_col="own")).first()[0] > 0
    assert [tuple(r) for r in R.row_term_counts(df, "t", "t", tokens_col="own").orderBy("term").collect()] == [("x", "研究生", 1), ("x", "考试", 1)]
