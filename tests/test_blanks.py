"""Blank cells, full precision, null groups and hot keys, with hand-computed answers."""

from chartq.functions.jsontab import parse_table
from chartq.functions.text import remove_special, whitespace_tokens
from chartq.operators import curate as C
from chartq.operators import profile as PR
from chartq.operators import qa as Q
from chartq.operators.ranking import prefix_sums
from pyspark.sql import functions as F


def _qa(df, fn):
    return {r.qid: r for r in fn(df).collect()}


def test_bar_ranks_a_blank_last_and_keeps_full_numbers(spark):
    df = spark.createDataFrame([("c", 0, "a", None), ("c", 1, "b", 0.00001), ("c", 2, "d", 0.00003)], "chart_id string, row_idx long, category string, value double")
    out = _qa(df, Q.bar_qa)
    assert out["QA-BAR-6"].label == "['d', 'b', 'a']"
    assert out["QA-BAR-4"].answer_num == 0.00002 and float(out["QA-BAR-4"].label) == 0.00002
    assert out["QA-BAR-1"].answer_num is None
    assert out["QA-BAR-4"].answer_rationale == ["sum all bar heights", "divide by count, return mean numeric value"]
    assert out["QA-BAR-4"].not_answer_rationale == ["sum heights divide by count add one", "return offset numeric value"]


def test_correlation_takes_rows_with_both_values(spark):
    rows = [("c", 0, 1.0, 2.0), ("c", 1, 2.0, 4.0), ("c", 2, 3.0, 6.0), ("c", 3, None, 50.0), ("c", 4, 90.0, None)]
    out = _qa(spark.createDataFrame(rows, "chart_id string, row_idx long, x double, y double"), Q.scatter_qa)
    assert round(out["QA-SCT-1"].answer_num, 9) == 1.0


def test_bubbles_below_the_median_with_blanks(spark):
    rows = [("c", i, 0.0, float(i), s) for i, s in enumerate((None, None, None, 1.0, 2.0, 3.0, 4.0))]
    out = _qa(spark.createDataFrame(rows, "chart_id string, row_idx long, x double, y double, size double"), Q.bubble_qa)
    assert (out["QA-BUB-3"].label, out["QA-BUB-3"].not_answer) == ("2", "2")
    assert (out["QA-BUB-5"].label, out["QA-BUB-5"].not_answer) == ("False", "False")


def test_a_histogram_with_a_blank_is_skipped(spark):
    rows = [("blank", 0, 1.0), ("blank", 1, None), ("full", 0, 1.0), ("full", 1, 2.0), ("full", 2, 4.0)]
    out = Q.histogram_qa(spark.createDataFrame(rows, "chart_id string, row_idx long, value double")).collect()
    assert {r.chart_id for r in out} == {"full"}


def test_matrix_questions_take_any_column_names(spark):
    rows = [(i, float(i), -2.0 * i, float(i * i % 7)) for i in range(6)]
    wide = spark.createDataFrame([("c", *r) for r in rows], "chart_id string, row_idx long, height double, weight double, zeal double")
    names = ["height", "weight", "zeal"]
    cells = wide.select("chart_id", "row_idx", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("string").alias("cell")) for n in names])).alias("e"))
    named = cells.select("chart_id", F.lit("scatter_matrix").alias("chart_type"), "row_idx", "e.name", "e.cell")
    want = {r.qid: tuple(r) for r in Q.scatter_matrix_qa(wide, names).collect()}
    got = {r.qid: tuple(r)[:-1] for r in Q.generate(named).collect()}
    assert got == want
    assert want["QA-MTX-1"][3] == "('height', 'weight')"


def test_blank_cells_of_a_numeric_column_become_missing_points(spark):
    named = spark.createDataFrame([("c", "scatter", 0, "x", "1"), ("c", "scatter", 0, "y", "n/a"), ("c", "scatter", 1, "x", "2"), ("c", "scatter", 1, "y", "3")],
                                  "chart_id string, chart_type string, row_idx long, name string, cell string")
    assert sorted(map(tuple, PR.to_points(named, "scatter").collect())) == [("c", 0, 1.0, None), ("c", 1, 2.0, 3.0)]


def test_a_null_corpus_is_split_like_any_other(spark):
    df = spark.createDataFrame([(i, "a" if i % 2 else None) for i in range(40)], "k long, corpus string")
    out = C.split_80_10_10(df, "corpus", 1, "k")
    assert out.count() == 40
    assert {(r["corpus"], r["split"]): r["n"] for r in out.groupBy("corpus", "split").agg(F.count(F.lit(1)).alias("n")).collect()} == {
        (c, s): n for c in ("a", None) for s, n in (("train", 16), ("validation", 2), ("test", 2))}


def test_prefix_sums_of_one_hot_key(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 50 == 0, "b").alias("k"), F.col("id").alias("pos"), (F.col("id") % 7).alias("v"))
    got = {(r["k"], r["pos"]): r["v"] for r in prefix_sums(df, ["k"], "pos", ["v"], fan=8).collect()}
    total = {}
    for i in range(3000):
        k = "b" if i % 50 == 0 else None
        total[k] = total.get(k, 0) + i % 7
        assert got[(k, i)] == total[k]


def test_unicode_white_space_and_bare_constants(spark):
    df = spark.createDataFrame([("a　b c  d", '{"columns":["x"],"rows":[[NaN],["NaN"],[-Infinity],[1.50]]}')], "t string, j string")
    r = df.select(whitespace_tokens("t").alias("w"), remove_special("t").alias("s"), parse_table("j").alias("p")).first()
    assert r["w"] == ["a", "b", "c", "d"] and r["s"] == "a　b c  d"
    assert [list(x) for x in r["p"]["rows"]] == [["NaN"], ["NaN"], ["-Infinity"], ["1.50"]]
