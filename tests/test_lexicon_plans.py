"""Plans of lexicon lookups."""

from quirework.functions import text as T
from quirework.operators import lexicon as L
from pyspark.sql import functions as F


def test_deletion_keys_are_never_broadcast(spark, tmp_path):
    spark.createDataFrame([("word",), ("ward",), ("other",)], "word string").write.parquet(str(tmp_path / "u"))
    words = spark.read.parquet(str(tmp_path / "u"))
    deletes = words.select(F.explode(T.deletes(F.col("word"), 2)).alias("key"), "word")
    near = L.neighbors(words.select(F.col("word").alias("query")), deletes)
    assert {("word", "ward"), ("ward", "word"), ("other", "other")} <= {tuple(r) for r in near.collect()}
    assert "Broadcast" not in near._jdf.queryExecution().executedPlan().toString()
