"""QA generators on literal charts: edge branches with hand-computed answers."""

from chartq.functions import render as R
from chartq.operators import qa as Q


def _qa(spark, fn, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return {(r.chart_id, r.qid): (r.label, r.not_answer) for r in fn(df, num=R.num).collect()}


def test_bar_ties_and_rank(spark):
    rows = [("c", 0, "a", 5.0), ("c", 1, "b", 7.0), ("c", 2, "d", 7.0), ("c", 3, "e", 1.0)]
    out = _qa(spark, Q.bar_qa, rows, "chart_id string, row_idx int, category string, value double")
    assert out[("c", "QA-BAR-1")] == ("b", "e")          # first of the tied maxima wins
    assert out[("c", "QA-BAR-4")] == ("5.0000", "6.0000")
    assert out[("c", "QA-BAR-5")] == ("2", "1")
    assert out[("c", "QA-BAR-6")] == ("['b', 'd', 'a', 'e']", "['e', 'a', 'd', 'b']")


def test_pie_needs_two_categories(spark):
    rows = [("one", 0, "a", 10.0), ("two", 0, "a", 30.0), ("two", 1, "b", 10.0), ("two", 2, "c", 60.0)]
    out = _qa(spark, Q.pie_qa, rows, "chart_id string, row_idx int, category string, value double")
    assert not any(k[0] == "one" for k in out)
    assert out[("two", "QA-PIE-2")] == ("30.0000", "70.0000")
    assert out[("two", "QA-PIE-3")] == ("a", "c")        # the larger of the two smallest slices
    assert out[("two", "QA-PIE-5")] == ("40.0000", "60.0000")
    assert out[("two", "QA-PIE-6")] == ("True", "False")


def test_line_single_point_skipped_and_crossing(spark):
    rows = [("solo", 0, 1.0, 5.0), ("l", 0, 1.0, 1.0), ("l", 1, 2.0, 4.0), ("l", 2, 4.0, 2.0)]
    out = _qa(spark, Q.line_qa, rows, "chart_id string, row_idx int, x double, y double")
    assert not any(k[0] == "solo" for k in out)
    assert out[("l", "QA-LIN-2")] == ("3.0000", "-2.0000")
    assert out[("l", "QA-LIN-3")] == ("2.0000", "1.0000")  # first x above the mean; distractor = x at min y
    assert out[("l", "QA-LIN-6")] == ("0.3333", "-0.3333")
    dual = [("d", 0, 1.0, 5.0, 1.0), ("d", 1, 2.0, 3.0, 3.0), ("d", 2, 3.0, 1.0, 4.0)]
    out = _qa(spark, Q.dual_axis_qa, dual, "chart_id string, row_idx int, x double, y1 double, y2 double")
    assert out[("d", "QA-DUA-1")] == ("2.0000", "3.0000")  # the gap hits zero at x = 2
    assert out[("d", "QA-DUA-2")] == ("y2", "y1")


def test_histogram_constant_values(spark):
    rows = [("h", i, 3.0) for i in range(5)]
    out = _qa(spark, Q.histogram_qa, rows, "chart_id string, row_idx int, value double")
    assert out[("h", "QA-HST-1")] == ("(3.0000, 3.1000)", "(2.5000, 2.6000)")
    assert out[("h", "QA-HST-2")] == ("0", "5")
    assert out[("h", "QA-HST-6")] == ("False", "True")     # zero spread: skew 0


def test_scatter_constant_x_has_no_correlation(spark):
    rows = [("s", i, 1.0, float(i)) for i in range(4)]
    out = _qa(spark, Q.scatter_qa, rows, "chart_id string, row_idx int, x double, y double")
    assert out[("s", "QA-SCT-1")] == (None, None)
    assert out[("s", "QA-SCT-6")] == ("negative", "positive")
    assert out[("s", "QA-SCT-3")] == ("0", "3")


def test_grouped_mean_tie_takes_first_sorted_group(spark):
    rows = [("g", 0, "z", "a", 2.0), ("g", 1, "y", "a", 2.0), ("g", 2, "x", "b", 9.0)]
    out = _qa(spark, Q.grouped_bar_qa, rows, "chart_id string, row_idx int, grp string, category string, value double")
    assert out[("g", "QA-GRP-4")] == ("y", "x")


def test_same_answers_under_any_partitioning(spark):
    rows = [(f"c{i % 5}", i // 5, f"k{i % 7}", float((i * 37) % 101)) for i in range(200)]
    df = spark.createDataFrame(rows, "chart_id string, row_idx int, category string, value double")
    base = sorted(map(tuple, Q.bar_qa(df).collect()))
    for n in (1, 7, 64):
        assert sorted(map(tuple, Q.bar_qa(df.repartition(n)).collect())) == base
