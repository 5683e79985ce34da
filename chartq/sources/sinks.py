"""Sinks (SNK-01..04): idempotent, partitioned parquet materialisation.

"Load if built, else build and save" becomes: if the target folder has Spark's
`_SUCCESS` marker, read it; otherwise write the DataFrame (overwrite, partitioned)
and read it back. The existence test goes through the Hadoop file system of the
path, so it works on any shared store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _at(spark: SparkSession, path: str):
    """The Hadoop path and its file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    p, fs = _at(spark, path)
    return bool(fs.exists(p))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that a sink wrote; one that is not there is no error."""
    p, fs = _at(spark, path)
    fs.delete(p, True)


def is_built(spark: SparkSession, path: str) -> bool:
    return _exists(spark, path.rstrip("/") + "/_SUCCESS")


def materialize(df: DataFrame, path: str, partition_by=()) -> DataFrame:
    """SNK-01 / SNK-03 / SNK-04: write once (partitioned), then always read the stored copy."""
    spark = df.sparkSession
    if not is_built(spark, path):
        w = df.write.mode("overwrite")
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(path)
    return spark.read.parquet(path)


def append(df: DataFrame, path: str, partition_by=("dataset",)) -> None:
    """SNK-02: add a batch of rows (e.g. rationales of one generation batch) to a partitioned table."""
    df.write.mode("append").partitionBy(*partition_by).parquet(path)
