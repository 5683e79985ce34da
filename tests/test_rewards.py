"""Reward branches on literal completions (hand-computed expectations)."""

from chartq.operators import rewards as R

GOOD = ("<think>\n<type>bar</type>\n<table>{\"columns\":[\"a\",\"B\"],\"rows\":[[\"x\",1.50]]}</table>\n"
        "<step-1>: look<step-2>: done</think>\n<answer>10.</answer>")


def _score(spark, rows):
    df = spark.createDataFrame(rows, "completion string, label string, chart_type string, gold_table string")
    return R.score(df, R.RULES).collect()


def test_good_completion(spark):
    gold = '{"columns":["b","A"],"rows":[["x","1.50"]]}'
    r = _score(spark, [(GOOD, "10", "Bar", gold)])[0]
    assert r["r_format"] == 2.0
    assert r["r_tokens"] == 2.0
    assert r["r_accuracy"] == 1.0
    assert r["r_chart_type"] == 1.0
    # parse 0.5 + headers 2 * 0.25 + cells 2 * 0.5 + keys 0.25
    assert r["r_table"] == 2.25
    assert r["r_length"] == 1.75  # 102 characters (bonus 1.0) + 3 step pieces (0.75)


def test_format_needs_answer_at_line_end(spark):
    bad = GOOD + " trailing"
    ok_newline = GOOD + "\nnext line"
    rows = _score(spark, [(bad, "10", "bar", None), (ok_newline, "10", "bar", None)])
    assert [r["r_format"] for r in rows] == [0.0, 2.0]


def test_accuracy_branches(spark):
    comp = lambda a: f"<think>x</think><answer>{a}</answer>"
    rows = _score(spark, [(comp("104"), "100", "bar", None), (comp("106"), "100", "bar", None),
                          (comp("Yes"), "yes", "bar", None), (comp("abc"), "100", "bar", None),
                          ("<answer>100</answer>", "100", "bar", None)])
    assert [r["r_accuracy"] for r in rows] == [1.0, 0.0, 1.0, 0.0, 0.0]


def test_table_overrun_scores_zero(spark):
    comp = '<table>{"columns":["a","b","c"],"rows":[]}</table>'
    gold = '{"columns":["a","b"],"rows":[]}'
    r = _score(spark, [(comp, "1", "bar", gold)])[0]
    assert r["r_table"] == 0.75  # parse + key set; the comparison overruns the gold
