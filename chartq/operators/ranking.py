"""Skew-safe positions used across the engine.

`Window.partitionBy(group).orderBy(key)` sends a whole group to one task. A
chart, corpus or run may hold a third of all rows, so positions inside a group
are computed here without that window:

1. range-partition on (group, key) — a hot group is cut into many ranges;
2. sort inside each range and number rows by their position in the range;
3. aggregate a small table (partition, group) → (count, first position), turn it
   into per-(partition, group) offsets with a window over that small table;
4. join the offsets back on (partition, group) — a key that never holds more
   than one range of one group, so the join is not skewed either.

The result equals `row_number() - 1` over (group ORDER BY key) when `key` is
unique inside the group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartq.session import ensure_checkpoint_dir

# offsets up to so many rows (of some bytes) are sent to every executor
FEW = 100_000


def _cols(cs) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cs]


def prefix_sums(df: DataFrame, keys: list[str], pos: str, cols: list[str], fan: int = 1024, levels: int = 2) -> DataFrame:
    """`cols` replaced by their running sums in the order of the whole number `pos` (distinct within `keys`).

    Runs of `fan` positions are summed first; their running sums (by the same rule, `levels` deep) are the offsets of
    running sums inside a run, so no window holds more than a run until a hot key has `fan ** (levels + 1)` positions.
    """
    if levels == 0:
        w = Window.partitionBy(*keys).orderBy(pos)
        return df.withColumns({c: F.sum(c).over(w) for c in cols})
    at = f"_run{levels}"
    run = df.withColumn(at, F.floor(F.col(pos) / fan).cast("long"))
    own = [f"_own{levels}_{c}" for c in cols]
    sums = run.groupBy(*keys, at).agg(*[F.sum(c).alias(c) for c in cols], *[F.sum(c).alias(o) for c, o in zip(cols, own)])
    upto = prefix_sums(sums, keys, at, cols, fan, levels - 1)
    before = upto.select(*[F.col(k).alias(f"_k{levels}_{k}") for k in keys], F.col(at).alias(f"_k{at}"),
                         *[(F.col(c) - F.col(o)).alias(f"_before{levels}_{c}") for c, o in zip(cols, own)])
    w = Window.partitionBy(*keys, at).orderBy(pos)
    inside = run.withColumns({c: F.sum(c).over(w) for c in cols})
    same = [F.col(k).eqNullSafe(F.col(f"_k{levels}_{k}")) for k in keys] + [F.col(at) == F.col(f"_k{at}")]
    return (inside.join(before, same).withColumns({c: F.col(c) + F.col(f"_before{levels}_{c}") for c in cols}).select(*df.columns))


def rank_in_group(df: DataFrame, group_cols: list[str], order_cols: list, out: str = "row_idx",
                  num_partitions: int | None = None) -> DataFrame:
    """Add `out` = 0-based position of each row inside its group, ordered by `order_cols`."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*_cols(group_cols), *_cols(order_cols)]
    ranged = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_pos", F.monotonically_increasing_id() - F.shiftleft(F.col("_pid").cast("long"), 33)))
    # Range bounds are sampled with a seed that changes per execution, so two reads of
    # `ranged` may disagree on which rows a partition holds. Number the rows once and cut
    # the lineage with a reliable checkpoint in the cluster's shared checkpoint folder:
    # both reads below, and any task retried after a lost executor, see the same numbers.
    ensure_checkpoint_dir(spark)
    ranged = ranged.checkpoint(eager=True)
    counts = ranged.groupBy("_pid", *group_cols).agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_p0")).checkpoint()
    # with no group the offsets table has one row per partition, so an unpartitioned window is fine
    w = (Window.partitionBy(*group_cols) if group_cols else Window).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    # The offsets table has at most (#groups + #partitions) rows. It is counted once: a small one is broadcast, so that
    # the rows are not shuffled again (AQE would decide that after their shuffle), else a shuffle join on a key no group can skew.
    # Null-safe keys: a NULL group is a group like any other and must not drop out.
    o = offsets.select(F.col("_pid").alias("_o_pid"), *[F.col(g).alias(f"_o_{g}") for g in group_cols], "_p0", "_off")
    cond = F.col("_pid") == F.col("_o_pid")
    for g in group_cols:
        cond = cond & F.col(g).eqNullSafe(F.col(f"_o_{g}"))
    ranked = ranged.join(F.broadcast(o) if counts.count() <= FEW else o, cond)
    return (ranked.withColumn(out, (F.col("_pos") - F.col("_p0") + F.col("_off")).cast("long"))
            .drop("_pid", "_pos", "_p0", "_off", "_o_pid", *[f"_o_{g}" for g in group_cols]))
