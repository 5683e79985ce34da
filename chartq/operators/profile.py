"""Chart-table profiling (CHT-01..05, FLT-05, MET-11) over long `chart_cells`
(chart_id, row_idx, col_idx, col_name, cell).

All charts are profiled by one grouped aggregation per (chart, column) and one per
chart — never a loop over tables. Column roles come from a window over the small
per-column profile (a table's width), not over cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chartq.functions.numeric import round4, to_float

# Cell texts a CSV reader takes as missing.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
             "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
LOW_CARD = 12


def column_profile(cells: DataFrame) -> DataFrame:
    """CHT-01: per (chart, column): numeric when every non-missing cell parses as a number
    (booleans stay categorical), distinct non-missing values, numeric sum."""
    c = cells.withColumn("_na", F.col("cell").isNull() | F.col("cell").isin(NA_TOKENS)).withColumn("_f", to_float("cell"))
    num_ok = F.col("_na") | (F.col("_f").isNotNull() & ~F.lower("cell").isin("true", "false"))
    return c.groupBy("chart_id", "col_name").agg(
        F.min("col_idx").alias("col_idx"),
        F.bool_and(num_ok).alias("is_numeric"),
        F.count_distinct(F.when(~F.col("_na"), F.col("cell"))).alias("nunique"),
        F.sum(F.when(~F.col("_na"), F.col("_f"))).alias("num_sum"))


def pick_chart(profile: DataFrame) -> DataFrame:
    """CHT-02 / CHT-05: the reference's decision list as one CASE over per-chart counts.
    No column is ever a datetime (the readers never produce one), so the time branches
    are kept but cannot fire on parsed tables."""
    p = profile.groupBy("chart_id").agg(
        F.count_if("is_numeric").alias("n_numeric"), F.count_if(~F.col("is_numeric")).alias("n_cat"),
        F.lit(0).alias("n_time"),
        F.coalesce(F.bool_and(F.when(~F.col("is_numeric"), F.col("nunique") <= LOW_CARD)), F.lit(True)).alias("cat_low"),
        F.coalesce(F.bool_or(F.when(~F.col("is_numeric"), F.col("nunique") > LOW_CARD)), F.lit(False)).alias("cat_high"),
        F.sum(F.when(F.col("is_numeric"), F.coalesce("num_sum", F.lit(0.0)))).alias("num_total"))
    n, c, t = F.col("n_numeric"), F.col("n_cat"), F.col("n_time") > 0
    low, high = F.col("cat_low"), F.col("cat_high")
    s = F.col("num_total")
    const_sum = (n == 1) & ~F.isnan(s) & (F.abs(s) != F.lit(float("inf"))) & (F.abs(s - 100) <= 1e-8 + 0.05 * 100)
    kind = (F.when((n == 1) & (c == 0) & ~t, "histogram")
            .when((n == 1) & (c == 1) & low, "bar")
            .when((n == 1) & (c == 1) & high & t, "line")
            .when((n == 1) & (c == 2), "grouped_bar")
            .when((n == 2) & ~t & (c == 0), "scatter")
            .when((n == 2) & ~t & (c == 1), "bubble")
            .when((n == 2) & t, "line_dual_axis")
            .when((n >= 3) & (c == 0), "scatter_matrix")
            .when((n >= 3) & (c == 1) & low, "stacked_bar")
            .when(const_sum & (c == 1), F.when(low, "pie").otherwise("stacked_bar_100"))
            .when(t & (n > 1) & (c == 0), "multi_line")
            .otherwise("bar"))
    return p.withColumn("constant_sum", const_sum).withColumn("chart_type", kind)


# Per chart type, the roles taken from the name-sorted categorical (c) and
# numeric (n) columns, in order.
ROLES = {
    "bar": [("c", 1, "category"), ("n", 1, "value")],
    "pie": [("c", 1, "category"), ("n", 1, "value")],
    "grouped_bar": [("c", 1, "group"), ("c", 2, "category"), ("n", 1, "value")],
    "histogram": [("n", 1, "value")],
    "line": [("n", 1, "x"), ("n", 2, "y")],
    "scatter": [("n", 1, "x"), ("n", 2, "y")],
    "bubble": [("n", 1, "x"), ("n", 2, "y"), ("n", 3, "size")],
    "line_dual_axis": [("n", 1, "x"), ("n", 2, "y1"), ("n", 3, "y2")],
    "stacked_bar": [("c", 1, "group"), ("c", 2, "series"), ("n", 1, "value")],
}


def auto_rename(profile: DataFrame, picked: DataFrame) -> DataFrame:
    """CHT-03 + FLT-05: canonical names for the columns each chart type needs; charts whose
    profile lacks the columns (the reference raises and skips them) are marked ineligible.
    scatter_matrix keeps all numeric names; multi_line maps x + y_1..y_n."""
    w = Window.partitionBy("chart_id", "is_numeric").orderBy("col_name")
    ranked = profile.withColumn("k", F.row_number().over(w)).withColumn("kind", F.when(F.col("is_numeric"), "n").otherwise("c"))
    j = ranked.join(picked.select("chart_id", "chart_type", "n_numeric", "n_cat"), "chart_id")
    ct, kind, k = F.col("chart_type"), F.col("kind"), F.col("k")
    canon = None
    for t, roles in ROLES.items():
        for rk, rn, name in roles:
            cond = (ct == t) & (kind == rk) & (k == rn)
            canon = F.when(cond, F.lit(name)) if canon is None else canon.when(cond, F.lit(name))
    canon = (canon.when((ct == "scatter_matrix") & (kind == "n"), F.col("col_name"))
             .when((ct == "multi_line") & (kind == "n") & (k == 1), F.lit("x"))
             .when((ct == "multi_line") & (kind == "n"), F.concat(F.lit("y_"), (k - 1).cast("string"))))
    need_n = F.greatest(*[F.lit(0)] + [F.when(ct == t, F.lit(max([r[1] for r in roles if r[0] == "n"], default=0)))
                                       .otherwise(0) for t, roles in ROLES.items()],
                        F.when(ct == "scatter_matrix", 3).otherwise(0), F.when(ct == "multi_line", 3).otherwise(0))
    need_c = F.greatest(F.lit(0), *[F.when(ct == t, F.lit(max([r[1] for r in roles if r[0] == "c"], default=0))).otherwise(0)
                                    for t, roles in ROLES.items()])
    eligible = (F.col("n_numeric") >= need_n) & (F.col("n_cat") >= need_c) & ct.isin(*ROLES, "scatter_matrix", "multi_line")
    return j.select("chart_id", "chart_type", "col_name", "col_idx", canon.alias("canonical"), eligible.alias("eligible"))


def census(picked: DataFrame) -> DataFrame:
    """MET-11: charts per chosen type."""
    return picked.groupBy("chart_type").agg(F.count(F.lit(1)).alias("n"))


def skipped(mapping: DataFrame) -> DataFrame:
    """MET-10 for tables: charts kept and skipped per type."""
    per_chart = mapping.groupBy("chart_id", "chart_type").agg(F.bool_and("eligible").alias("ok"))
    return per_chart.groupBy("chart_type").agg(F.count_if("ok").alias("kept"), F.count_if(~F.col("ok")).alias("skipped"))


NUMERIC_ROLES = ("value", "x", "y", "size", "y1", "y2")


def named_cells(cells: DataFrame, mapping: DataFrame) -> DataFrame:
    """Cells of eligible charts under their canonical names: (chart_id, chart_type, row_idx, name, cell), long
    form for every type, whatever the number of columns."""
    m = mapping.where(F.col("eligible") & F.col("canonical").isNotNull())
    return (cells.join(m.select("chart_id", "col_name", "chart_type", F.col("canonical").alias("name")), ["chart_id", "col_name"])
            .select("chart_id", "chart_type", F.col("row_idx").cast("long").alias("row_idx"), "name", "cell"))


def _typed(role: str):
    return (to_float(role) if role in NUMERIC_ROLES else F.col(role)).alias("grp" if role == "group" else role)


def wide_points(named: DataFrame) -> DataFrame:
    """Typed `chart_points` of all chart types with fixed roles in one aggregate by (chart, row): chart_id, chart_type, row_idx and a
    column for every role of any type."""
    roles = sorted({r[2] for own in ROLES.values() for r in own})
    own = named.where(F.col("chart_type").isin(*ROLES))
    wide = own.groupBy("chart_id", "chart_type", "row_idx").agg(*[F.max(F.when(F.col("name") == r, F.col("cell"))).alias(r) for r in roles])
    return wide.select("chart_id", "chart_type", "row_idx", *[_typed(r) for r in roles])


def to_points(named: DataFrame, chart_type: str) -> DataFrame:
    """The points of one chart type: of `wide_points` for types with fixed roles; those without (`scatter_matrix`, `multi_line`)
    stay long: (chart_id, row_idx, name, value)."""
    own = named.where(F.col("chart_type") == chart_type)
    if chart_type not in ROLES:
        return own.select("chart_id", "row_idx", "name", to_float("cell").alias("value"))
    return points_of(wide_points(own), chart_type)


def points_of(wide: DataFrame, chart_type: str) -> DataFrame:
    """One type's rows and roles of `wide_points`."""
    roles = ["grp" if r[2] == "group" else r[2] for r in ROLES[chart_type]]
    return wide.where(F.col("chart_type") == chart_type).select("chart_id", "row_idx", *roles)


def profile_rounded(profile: DataFrame) -> DataFrame:
    return profile.withColumn("num_sum", round4("num_sum"))
