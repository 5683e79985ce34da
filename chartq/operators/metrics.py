"""Evaluation metrics (MET-01..05, MET-09/10) as row flags plus grouped aggregations.

Flags are Column expressions (row-local, streaming-safe); the per-run numbers are
one `groupBy(run, dataset)` with partial aggregation, so a hot run never lands in a
single task before the final merge of a handful of counters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartq.functions.numeric import round4, to_float_pct
from chartq.functions.text import col_, py_strip, strip_one_trailing_dot
from chartq.operators.ranking import prefix_sums, rank_in_group


def exact_flag(target="target", prediction="prediction") -> Column:
    """MET-01: case-insensitive equality, 1/0."""
    return (F.lower(col_(prediction)) == F.lower(col_(target))).cast("int")


def relaxed_flag(target="target", prediction="prediction", tol: float = 0.05,
                 unanswerable: bool = False) -> Column:
    """MET-02 per row: one trailing dot off the prediction, both stripped, `%` → /100;
    relative error ≤ tol when both parse and the target is non-zero, else
    case-insensitive equality. With `unanswerable`, an 'unanswerable' target counts.

    Single-expression form (usable in any select); `with_flags` stages the same logic
    over several projections so that the generated code stays small."""
    p = py_strip(strip_one_trailing_dot(col_(prediction)))
    t = py_strip(col_(target))
    return _relaxed_from(p, t, to_float_pct(p), to_float_pct(t), col_(target), tol, unanswerable)


def _relaxed_from(p, t, pf, tf, raw_target, tol, unanswerable) -> Column:
    numeric = pf.isNotNull() & tf.isNotNull() & (tf != 0)
    ok = (F.when(numeric, F.try_divide(F.abs(pf - tf), F.abs(tf)) <= F.lit(tol))
          .otherwise(F.lower(p) == F.lower(t)))
    if unanswerable:
        ok = (F.lower(raw_target) == "unanswerable") | ok
    return F.coalesce(ok, F.lit(False)).cast("int")


def with_flags(df: DataFrame, tol: float = 0.05, unanswerable: bool = False,
               target: str = "target", prediction: str = "prediction") -> DataFrame:
    """Adds `em` and `ra` (MET-01, MET-02)."""
    staged = (df.withColumns({"_p": py_strip(strip_one_trailing_dot(col_(prediction))), "_t": py_strip(col_(target))})
              .withColumns({"_pf": to_float_pct("_p"), "_tf": to_float_pct("_t")}))
    flags = {"em": exact_flag(target, prediction),
             "ra": _relaxed_from(F.col("_p"), F.col("_t"), F.col("_pf"), F.col("_tf"), col_(target), tol, unanswerable)}
    return staged.withColumns(flags).drop("_p", "_t", "_pf", "_tf")


def scorecard(df: DataFrame, keys=("run", "dataset"), tol: float = 0.05, unanswerable: bool = False) -> DataFrame:
    """MET-03: n, em, ra and their rates per key."""
    f = with_flags(df, tol, unanswerable)
    agg = f.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("em").cast("bigint").alias("em"),
                               F.sum("ra").cast("bigint").alias("ra"))
    return agg.select(*keys, "n", "em", "ra", round4(F.col("em") / F.col("n")).alias("em_rate"),
                      round4(F.col("ra") / F.col("n")).alias("ra_rate"))


def breakdown(df: DataFrame, keys=("run", "dataset"), tol: float = 0.05) -> DataFrame:
    """MET-04: relaxed accuracy of augmented (tag 1) and human (tag 0) rows and their mean."""
    f = with_flags(df, tol)
    aug, hum = F.col("tag") == 1, F.col("tag") == 0
    agg = f.groupBy(*keys).agg(
        F.count_if(aug).alias("aug_total"), F.sum(F.when(aug, F.col("ra")).otherwise(0)).cast("bigint").alias("aug_correct"),
        F.count_if(hum).alias("human_total"), F.sum(F.when(hum, F.col("ra")).otherwise(0)).cast("bigint").alias("human_correct"))
    aug_acc = F.try_divide(F.col("aug_correct"), F.col("aug_total"))
    hum_acc = F.try_divide(F.col("human_correct"), F.col("human_total"))
    return agg.select(*keys, "aug_total", "aug_correct", "human_total", "human_correct",
                      round4(aug_acc).alias("aug_acc"), round4(hum_acc).alias("human_acc"),
                      round4(F.when((F.col("aug_total") > 0) & (F.col("human_total") > 0),
                                    F.lit(0.5) * (aug_acc + hum_acc))).alias("avg_acc"))


def running(df: DataFrame, batch_size: int = 32, keys=("run", "dataset"), tol: float = 0.05) -> DataFrame:
    """MET-05 / WIN-02: EM and RA after each batch of `batch_size` rows (rows ordered by idx).

    Rows are numbered with the skew-safe ranking, reduced to one row per batch, and the
    batches are added up in runs, so a run that holds most rows is no single window.
    """
    f = rank_in_group(with_flags(df, tol), list(keys), ["idx"], out="pos")
    per_batch = (f.groupBy(*keys, F.floor(F.col("pos") / batch_size).cast("bigint").alias("batch"))
                 .agg(F.count(F.lit(1)).alias("bn"), F.sum("em").alias("bem"), F.sum("ra").alias("bra")))
    cum = prefix_sums(per_batch.toDF(*keys, "batch", "n", "em", "ra"), list(keys), "batch", ["n", "em", "ra"])
    return cum.select(*keys, "batch", F.col("n").cast("bigint").alias("n"), F.col("em").cast("bigint").alias("em"),
                      F.col("ra").cast("bigint").alias("ra"), round4(F.col("em") / F.col("n")).alias("em_rate"),
                      round4(F.col("ra") / F.col("n")).alias("ra_rate"))


def mistakes_paged(df: DataFrame, page_size: int = 9, keys=("run", "dataset"), tol: float = 0.05) -> DataFrame:
    """MET-09 + SMP-07: wrong rows (relaxed flag 0) numbered per run and cut into pages of 9."""
    wrong = with_flags(df, tol).where(F.col("ra") == 0).select(*keys, "idx", "target", "prediction")
    r = rank_in_group(wrong, list(keys), ["idx"], out="pos")
    return r.select(*keys, "idx", "target", "prediction",
                    F.floor(F.col("pos") / page_size).cast("bigint").alias("page"))
