"""Helpers shared by the training-data operators: staging, table access, connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartq.session import ensure_checkpoint_dir


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stage(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet under the cluster's shared folder and read it back.

    Cuts the lineage: later reads, and tasks retried after a lost executor, all see the
    same rows, and read only the columns they need.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/chartq-llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def utf8(text: str | Column = "text") -> Column:
    """The whole text as UTF-8 bytes; a null text counts as empty."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(c.cast("string"), F.lit("")).cast("binary")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out of every fit. A null id is in fold 0."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5, F.lit(0))


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph given as `edges(a, b)`: one row (node, root) per node, root = smallest node.

    Alternates the large-star and small-star steps, each a grouped minimum joined back to the
    edges, so a node with very many neighbours is an ordinary skewed join key that AQE splits.
    Every round is cut from its lineage by a reliable checkpoint; rounds stop when the edge set
    no longer changes, and the number of rounds grows with the logarithm of the node count.
    """
    ensure_checkpoint_dir(edges.sparkSession)

    def digest(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def joined(e: DataFrame) -> DataFrame:
        m = e.groupBy("a").agg(F.min("b").alias("m"))
        return e.join(m, "a")

    cur = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    seen = digest(cur)
    while True:
        both = cur.select("a", "b").union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = (joined(both).where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
                 .distinct().checkpoint())
        small = (joined(large).select(F.explode(F.array(
            F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b").where("a <> b").distinct().checkpoint())
        now = digest(small)
        cur = small
        if now == seen:
            break
        seen = now
    roots = cur.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(cur.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
