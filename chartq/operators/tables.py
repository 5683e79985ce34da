"""Operators over predicted / gold chart tables (JSN-01..05, MET-06/07/10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartq.functions import jsontab as J
from chartq.functions.numeric import round4
from chartq.functions.text import after_last, before_first, col_, py_strip


def table_cells(df: DataFrame, block: Column, keys: list[str]) -> DataFrame:
    """Parsed table rows exploded to (r, c, cell); unparsable tables yield no cells."""
    t = df.select(*keys, block.alias("_b")).select(*keys, J.parse_table("_b").alias("tab"))
    # `posexplode_outer` + a filter on its output: with plain `posexplode` the optimizer infers
    # `size(tab.rows) > 0` and pushes it, parse and all, below the exchange into the scan.
    rows = t.select(*keys, F.posexplode_outer("tab.rows").alias("r", "row")).where(F.col("r").isNotNull())
    return rows.select(*keys, "r", F.posexplode("row").alias("c", "cell"))


def parse_failures(df: DataFrame, block: Column, keys: list[str]) -> DataFrame:
    """MET-10: count and rate of tables that are not strict JSON."""
    bad = ~J.strict_json_ok(block)
    agg = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("failures"))
    return agg.withColumn("failure_rate", round4(F.col("failures") / F.col("n")))


def type_cut(completion="completion") -> Column:
    """TXT-04 as the surrogate script cuts it: text between the last `<type>` and the next `</type>`."""
    return F.lower(py_strip(before_first(after_last(completion, "<type>"), "</type>")))


def type_accuracy(df: DataFrame, keys=("run", "dataset"), gold="chart_type", said: Column | None = None) -> DataFrame:
    """MET-06: mean of case-insensitive chart-type agreement; `said` is the type cut where rows have it in place of the completion."""
    hit = ((type_cut() if said is None else said) == F.lower(col_(gold))).cast("int")
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), round4(F.avg(hit)).alias("type_acc"))


def _pairs(g: Column, p: Column) -> Column:
    """Per zipped pair of rows: their lengths (k, m) and the cells that differ, stripped and in lower case, among those both have."""
    def pair(a, b):
        differs = F.zip_with(a, b, lambda x, y: F.coalesce(F.lower(py_strip(x)) != F.lower(py_strip(y)), F.lit(True)))
        return F.struct(F.size(a).alias("k"), F.size(b).alias("m"),
                        F.size(F.filter(F.slice(differs, 1, F.least(F.size(a), F.size(b))), lambda d: d)).alias("bad"))

    return F.slice(F.zip_with(g["rows"], p["rows"], pair), 1, F.least(F.size(g["rows"]), F.size(p["rows"])))


def with_table_error(df: DataFrame, gold: str, pred: str, out: str, compat: bool = False) -> DataFrame:
    """MET-07 per row: gold does not parse → 0; prediction does not parse (after `'`→`"`) → 1; otherwise mismatching cells / cells
    visited over zipped row pairs. A predicted row shorter than its gold row adds one error and stops the scan. A table
    without rows counts as 1 (the reference returns 1e6, quirk Q11: `compat`). Texts are validated and parsed once, and the pairs
    compared once: every step is a projection of its own that the next one reads."""
    s = df.withColumns({"_gok": J.strict_json_ok(gold), "_pok": J.strict_json_ok(pred)})
    s = s.withColumns({"_g": F.when(F.col("_gok") & F.col("_pok"), F.from_json(J.quote_number_lexemes(gold), J.TABLE_SCHEMA)),
                       "_p": F.when(F.col("_gok") & F.col("_pok"), F.from_json(J.quote_number_lexemes(pred), J.TABLE_SCHEMA))})
    g, p, pairs, stop = F.col("_g"), F.col("_p"), F.col("_pairs"), F.col("_stop")
    s = s.withColumns({"_pairs": _pairs(g, p), "_bare": g["rows"].isNull() | p["rows"].isNull()})
    s = s.withColumn("_stop", F.array_position(F.transform(pairs, lambda x: x["m"] < x["k"]), True).cast("int"))
    s = s.withColumn("_used", F.when(stop == 0, pairs).otherwise(F.slice(pairs, 1, stop)))
    more = F.when(stop > 0, 1).otherwise(0)
    err = F.aggregate("_used", F.lit(0), lambda acc, x: acc + x["bad"]) + more
    cnt = F.aggregate("_used", F.lit(0), lambda acc, x: acc + F.least(x["k"], x["m"])) + more
    value = (F.when(~F.col("_gok"), 0.0).when(~F.col("_pok"), 1.0).when(F.col("_bare"), 1.0 / 1e-6 if compat else 1.0)
             .otherwise(err / (cnt + F.lit(1e-6))))
    return s.withColumn(out, value).drop("_gok", "_pok", "_g", "_p", "_pairs", "_bare", "_stop", "_used")


def table_error(df: DataFrame, keys=("run", "dataset"), completion="completion", gold="gold_table",
                compat: bool = False) -> DataFrame:
    """MET-07 per run: the texts are cut, validated and parsed once in a first projection;
    the cell comparison then reads the parsed columns."""
    pred = F.replace(py_strip(before_first(after_last(completion, "<table>"), "</table>")), F.lit("'"), F.lit('"'))
    s1 = df.select(*keys, col_(gold).alias("_gt"), pred.alias("_pt"))
    e = with_table_error(s1, "_gt", "_pt", "err", compat)
    return e.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), round4(F.avg("err")).alias("table_err"))
