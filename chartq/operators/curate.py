"""Corpus curation: projections, filters, unions, seeded sampling and splits, positional
joins (PRJ-*, FLT-*, SET-*, SMP-*, JN-*).

Randomness is a portable seeded key `md5(seed:key)`, so every sample and split is
reproducible and checkable by another engine. Positions come from the skew-safe
ranking; a per-corpus top-n uses `row_number() <= n`, which Spark plans as a
`WindowGroupLimit` that trims every partition before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartq.functions.text import col_
from chartq.operators.ranking import FEW, rank_in_group
from chartq.sources.framing import staged


def seeded_key(seed, *cols) -> Column:
    """SMP-01: `md5('seed:key...')`."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[col_(c).cast("string") for c in cols]))


def sample_per_group(df: DataFrame, group: str, n: int, seed, key: str) -> DataFrame:
    """SMP-02: the first n rows of each group in seeded order."""
    h = seeded_key(seed, key)
    w = Window.partitionBy(group).orderBy(h, col_(key))
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def split_by_rank(df: DataFrame, order_cols, sizes, rest: str, group_cols=()) -> DataFrame:
    """Assign `split` by position in `order_cols` (per group): the first sizes[0][1] rows get
    sizes[0][0], the next sizes[1][1] rows sizes[1][0], ..., the remainder `rest`.
    Sizes may be Columns computed from the group's row count `n`. Few rows of known sizes in front of all others
    are told by the last of them, without a rank for every row."""
    if not group_cols and all(isinstance(size, int) for _, size in sizes) and sum(size for _, size in sizes) <= FEW:
        return _split_at(df, list(order_cols), sizes, rest)
    r = rank_in_group(df, list(group_cols), list(order_cols), out="_rank")
    if group_cols:
        # null-safe: the rows of a NULL group are split like any others
        n = df.groupBy(*[F.col(g).alias(f"_n_{g}") for g in group_cols]).agg(F.count(F.lit(1)).alias("n"))
        same = [F.col(g).eqNullSafe(F.col(f"_n_{g}")) for g in group_cols]
        r = r.join(n, same).drop(*[f"_n_{g}" for g in group_cols])
    else:
        r = r.withColumn("n", F.lit(None).cast("long"))
    out = None
    bound = F.lit(0)
    for name, size in sizes:
        size = size if isinstance(size, Column) else F.lit(size)
        bound = bound + size
        cond = F.col("_rank") < bound
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return r.withColumn("split", out.otherwise(F.lit(rest))).drop("_rank", "n")


def _split_at(df: DataFrame, order_cols: list, sizes, rest: str) -> DataFrame:
    """`split_by_rank` of one group and few rows: each size's last row is found by a top-n, and rows are compared with it. Rows are stored
    once, as they come (equal texts often stand together and compress) and numbered (rows equal in all order columns are told apart), and
    dealt in order afterwards, so that only the shuffle holds them a second time."""
    own = staged(df.withColumn("_row", F.monotonically_increasing_id()), "split")
    order = [col_(c) for c in order_cols]
    place = F.struct(*[c.alias(f"k{i}") for i, c in enumerate([*order, F.col("_row")])])      # compares as the rows sort, nulls first
    kinds = own.select(place.alias("p")).schema["p"].dataType.fields
    out = F.lit(rest)
    upto = sum(size for _, size in sizes)
    for name, size in reversed(sizes):
        last = own.select(place.alias("p")).orderBy("p").limit(upto).offset(upto - 1).collect() if upto else None
        if last:
            end = F.struct(*[F.lit(x).cast(f.dataType).alias(f.name) for x, f in zip(last[0]["p"], kinds)])
            out = F.when(place <= end, F.lit(name)).otherwise(out)
        elif upto:                                      # fewer rows than that
            out = F.lit(name)
        upto -= size
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return own.withColumn("split", out).drop("_row").repartitionByRange(n, *order).sortWithinPartitions(*order)


def split_80_10_10(df: DataFrame, group: str, seed, key: str) -> DataFrame:
    """SMP-03: shuffled, then train = first int(.8n), validation up to int(.9n), test the rest."""
    d = df.withColumn("_h", seeded_key(seed, key))
    n = F.col("n")
    train = F.floor(n * 0.8)
    return split_by_rank(d, ["_h", key], [("train", train), ("validation", F.floor(n * 0.9) - train)], "test",
                         [group]).drop("_h")


def split_ratio(df: DataFrame, group: str, seed, key: str, val_ratio: float = 0.1, test_ratio: float = 0.2) -> DataFrame:
    """SMP-04: n_val = int(n*val), n_test = int(n*test), train = the rest; order train, val, test."""
    d = df.withColumn("_h", seeded_key(seed, key))
    n = F.col("n")
    n_val, n_test = F.floor(n * val_ratio), F.floor(n * test_ratio)
    return split_by_rank(d, ["_h", key], [("train", n - n_val - n_test), ("validation", n_val)], "test", [group]).drop("_h")


def top_k_seeded(df: DataFrame, k: int, seed, key: str) -> DataFrame:
    """SMP-05: k in-context examples in seeded order (a top-k, planned as TakeOrderedAndProject)."""
    return df.orderBy(seeded_key(seed, key), col_(key)).limit(k)


def first_n(df: DataFrame, n: int, order: str) -> DataFrame:
    """SMP-06: the first n rows in dataset order."""
    return df.orderBy(order).limit(n)


def rename_strict(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """PRJ-06: rename, failing on a missing column (Spark alone would ignore it)."""
    missing = [c for c in mapping if c not in df.columns]
    if missing:
        raise KeyError(f"columns not found: {missing}")
    return df.withColumnsRenamed(mapping)


def union_corpora(frames: list[DataFrame]) -> DataFrame:
    """SET-01/03: concatenate corpora whose columns differ; missing columns become NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def coalesce_label(df: DataFrame, label: str = "label", answer: str = "answer") -> DataFrame:
    """PRJ-07: a NULL label takes the answer; the answer column is then dropped."""
    return df.withColumn(label, F.coalesce(F.col(label), F.col(answer))).drop(answer)


def positional_join(examples: DataFrame, records: DataFrame, keys, order: str, how: str = "inner") -> DataFrame:
    """JN-01: attach `records` (already carrying a 0-based `pos`) to examples by their position
    in `order` within `keys`: the position is assigned once, then an equi-join."""
    ex = rank_in_group(examples, list(keys), [order], out="pos")
    return ex.join(records, [*keys, "pos"], how)
