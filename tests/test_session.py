"""Written tables: read back whole, and broadcast only where their size is known to be small."""

from pyspark.sql import functions as F

from proofloom import session


def joined(spark, table):
    return table.join(spark.range(50).withColumnRenamed("id", "k"), "k")._jdf.queryExecution().executedPlan().toString()


def test_only_counted_small_tables_may_be_broadcast(spark, monkeypatch):
    narrow = session.cut(spark.range(100).select((F.col("id") % 50).alias("k"), F.lit(1.5).alias("x")))
    assert narrow.count() == 100 and "SortMergeJoin" not in joined(spark, narrow)
    texts = session.cut(spark.range(100).select((F.col("id") % 50).alias("k"), F.lit("text").alias("x")))
    assert "SortMergeJoin" in joined(spark, texts) and "SortMergeJoin" in joined(spark, texts.where("x = 'text'").select("k"))
    monkeypatch.setattr(session, "SMALL_ROWS", 99)
    large = session.cut(spark.range(100).select((F.col("id") % 50).alias("k")))
    assert "SortMergeJoin" in joined(spark, large) and large.count() == 100


def test_an_empty_table_stays_one(spark):
    empty = session.cut(spark.range(0))
    assert empty.count() == 0 and empty.columns == ["id"]
