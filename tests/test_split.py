"""A split by position: few rows in front are told without storing every row's rank; ties, nulls and short inputs."""

import os
from collections import Counter

from pyspark.sql import functions as F

from chartq.operators import curate, prefs
from chartq.session import ensure_checkpoint_dir


def test_split_sizes_hold_with_equal_and_null_keys(spark):
    rows = [(None, "n")] * 3 + [(k, "x") for k in (5, 5, 5, 5, 1, 2, 9, 9)]
    df = spark.createDataFrame(rows, "k int, v string").repartition(3)
    got = curate.split_by_rank(df, ["k"], [("a", 4), ("none", 0), ("b", 3)], "rest").collect()
    assert Counter((r["k"], r["split"]) for r in got if r["k"] != 5) == {(None, "a"): 3, (1, "a"): 1, (2, "b"): 1, (9, "rest"): 2}
    assert Counter(r["split"] for r in got if r["k"] == 5) == {"b": 2, "rest": 2}
    short = curate.split_by_rank(df, ["k"], [("a", 10), ("b", 5)], "rest").collect()
    assert Counter(r["split"] for r in short) == {"a": 10, "b": 1} and len(short) == 11
    assert curate.split_by_rank(df.where("false"), ["k"], [("a", 10)], "rest").count() == 0


def test_pref_mix_stores_its_rows_once_and_compressed(spark):
    """A checkpoint wrote every row in shuffled order, in which equal questions no longer stand together, and with its key as text."""
    def held():
        root = ensure_checkpoint_dir(spark).removeprefix("file:")
        return sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(root) for f in names)

    df = spark.range(20_000).select(F.concat(F.lit("p"), "id").alias("pair_id"), F.concat(*[F.md5(F.concat(F.floor(F.col("id") / 40), F.lit(f" {i}"))) for i in range(8)])
                                    .alias("question"), F.lit("a").alias("label"), F.lit("b").alias("predicted"))
    a, b = df.where("pair_id < 'p5'"), df.where("pair_id >= 'p5'")
    before = held()
    out = prefs.pref_mix(a, b, 7, 512, ["pair_id"])
    rows = out.select("pair_id", "split", prefs.seeded_order(7, "pair_id").alias("h")).collect()
    assert held() - before < 20_000 * 100
    assert [r["h"] for r in rows] == sorted(r["h"] for r in rows) and len(rows) == 20_000
    assert [r["split"] for r in rows] == ["eval"] * 512 + ["train"] * (20_000 - 512)
