"""The skew-safe ranking equals row_number, also when one group holds most rows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from chartq.operators.ranking import rank_in_group


def test_rank_equals_row_number_with_hot_group(spark):
    n = 5000
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") % 7).alias("g"),
                               (F.col("id") * 7919 % n).alias("k"), F.col("id").alias("payload"))
    got = rank_in_group(df, ["g"], ["k", "payload"], num_partitions=6)
    ref = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("k", "payload")) - 1)
    j = got.join(ref, ["g", "k", "payload"])
    assert j.count() == n
    assert j.where("rn != row_idx").count() == 0


def test_null_group_is_kept(spark):
    df = spark.createDataFrame([(None, 3), (None, 1), ("a", 2), (None, 2)], "g string, k int")
    key = lambda t: (t[0] or "", t[1])
    got = sorted(((r.g, r.k, r.row_idx) for r in rank_in_group(df, ["g"], ["k"], num_partitions=3).collect()), key=key)
    assert got == sorted([(None, 1, 0), (None, 2, 1), (None, 3, 2), ("a", 2, 0)], key=key)
