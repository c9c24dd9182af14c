"""Steps that hold the rows of a task in memory get more tasks, not larger ones, as the input grows."""

from pyspark.sql import functions as F

from assayer import bindings as B
from assayer.functions import overlap
from assayer.operators import retrieval as R
from assayer.session import tasks


def largest(df):
    """Rows of the largest partition of a result, and the number of partitions."""
    sizes = df.groupBy(F.spark_partition_id()).count().collect()
    return max(r["count"] for r in sizes), len(sizes)


def test_tasks_follow_the_input(spark):
    slots = spark.sparkContext.defaultParallelism
    assert [tasks(spark, n, 10) for n in (None, 0, 10, 10 * slots, 10 * slots + 1)] == [slots] * 4 + [slots + 1]


def corpus(spark, n):
    return spark.range(n).selectExpr("'x' AS layer", "id AS doc_id", "concat('common word w', char(97 + id % 26)) AS text")


def test_scores_are_spread(spark, monkeypatch):
    monkeypatch.setattr(R, "TASK_TOKENS", 300)
    asked = spark.createDataFrame([(1, "common word"), (2, "wa wb common")], "query_id long, text string")
    for n in (1000, 4000):
        scores = R.bm25_scores(corpus(spark, n), asked)
        rows, parts = largest(scores)
        assert scores.count() == 2 * n and rows <= 500 and parts >= n // 100 - 1


def test_grams_are_spread(spark, monkeypatch):
    monkeypatch.setattr(overlap, "TASK_CHARS", 1000)
    for n in (500, 2000):
        pairs = spark.range(n).selectExpr("id", "'a b c d e' AS c", "'a b c d f' AS r")
        bleu = overlap.bleu4(pairs, "id", "c", "r")
        rows, parts = largest(bleu)
        assert bleu.count() == n and rows <= 120 and parts >= n // 60
        assert bleu.select("bleu").distinct().count() == 1


def test_reports_are_spread(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(B, "TASK_LINES", 100)
    spark.range(2000).selectExpr("id AS l_orderkey", "1 AS l_linenumber", "id AS l_partkey", "id AS l_suppkey").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(2000).selectExpr("id AS o_orderkey", "'5-LOW' AS o_orderpriority").write.parquet(str(tmp_path / "orders.parquet"))
    rows, parts = largest(B.report_texts(spark, str(tmp_path)))
    assert rows <= 200 and parts == 20
