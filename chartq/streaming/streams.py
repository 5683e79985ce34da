"""Structured Streaming twins of the batch operators (STR-01, STR-02).

Rewards are stateless Column expressions, so the batch scoring function runs
unchanged on a streaming DataFrame (append mode); the embeddings of the process
reward come through a stream-static join. The scorecard is a keyed aggregation over
a bounded key space (run × dataset), kept in the state store and emitted in update
mode. Each micro-batch writes the changed keys to a folder named by its batch id,
overwriting it when the batch is replayed; `compact_scorecard` folds folders into a
snapshot. Checkpoints live under the cluster's shared checkpoint folder, so a
restarted query resumes exactly once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartq.functions.numeric import round4
from chartq.operators import metrics as M
from chartq.operators import rewards as R
from chartq.sources.sinks import is_built, remove


def stream_rewards(spark: SparkSession, source: str, schema, sink: str, checkpoint: str, embeddings: DataFrame | None = None,
                   keys: tuple[str, ...] = ("run", "dataset", "idx")) -> None:
    """STR-01: file stream of completions → the rewards → append to a parquet sink (exactly once by the sink's own log); runs every
    available file once (`availableNow`) and stops. `embeddings` (some of `keys`, one row each, e1, e2) joins the two vectors of the
    process reward to each completion; completions without a row have none. Without the table the six rule-based rewards run."""
    s = spark.readStream.schema(schema).parquet(source)
    if embeddings is not None:
        s = s.join(embeddings, [k for k in keys if k in embeddings.columns], "left")
    scored = R.score(s, None if embeddings is not None else R.RULES, pred_embedding="e1", gold_embedding="e2").drop("e1", "e2")
    q = (scored.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()


def stream_scorecard(spark: SparkSession, source: str, schema, sink: str, checkpoint: str,
                     tol: float = 0.05) -> None:
    """STR-02: running (n, em, ra) per (run, dataset) in update mode; every micro-batch writes its keys to the folder of its batch id
    (keys not in the batch keep their rows in earlier folders)."""
    s = spark.readStream.schema(schema).parquet(source)
    agg = (M.with_flags(s, tol).groupBy("run", "dataset")
           .agg(F.count(F.lit(1)).alias("n"), F.sum("em").cast("bigint").alias("em"), F.sum("ra").cast("bigint").alias("ra")))

    def upsert(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/kind=batch/id={batch_id}")

    q = (agg.writeStream.outputMode("update").foreachBatch(upsert).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def _snapshot(spark: SparkSession, sink: str, table: DataFrame) -> int:
    """The last batch id of the newest finished snapshot, -1 without one."""
    ids = [r["id"] for r in table.where("kind = 'snapshot'").select("id").distinct().collect()]
    return max((i for i in ids if is_built(spark, f"{sink}/kind=snapshot/id={i}")), default=-1)


def _state(spark: SparkSession, sink: str) -> DataFrame:
    """The last emitted row of every key: from the newest snapshot and the batches after it."""
    t = spark.read.parquet(sink)
    upto = _snapshot(spark, sink, t)
    live = t.where(((F.col("kind") == "snapshot") & (F.col("id") == upto)) | ((F.col("kind") == "batch") & (F.col("id") > upto)))
    return live.groupBy("run", "dataset").agg(F.max_by(F.struct("n", "em", "ra"), "id").alias("s")).select("run", "dataset", "s.*")


def compact_scorecard(spark: SparkSession, sink: str) -> None:
    """Fold all batches so far into one snapshot, then remove what it replaces. Readers take a snapshot only when it is finished, and
    ignore the folders it replaces, so a compaction that fails half-way changes no row and can be run again."""
    t = spark.read.parquet(sink)
    last = t.agg(F.max("id")).first()[0]
    if last is None or _snapshot(spark, sink, t) >= last:
        return
    _state(spark, sink).write.mode("overwrite").parquet(f"{sink}/kind=snapshot/id={last}")
    for row in t.select("kind", "id").distinct().collect():   # one row per folder
        if row["id"] < last or row["kind"] == "batch":
            remove(spark, f"{sink}/kind={row['kind']}/id={row['id']}")


def latest_scorecard(spark: SparkSession, sink: str) -> DataFrame:
    """The scorecard from the sink: the last emitted row of every key, with its rates."""
    return _state(spark, sink).select("run", "dataset", "n", "em", "ra", round4(F.col("em") / F.col("n")).alias("em_rate"),
                                      round4(F.col("ra") / F.col("n")).alias("ra_rate"))
