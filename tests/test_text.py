"""Differential tests: the Column macros against plain-Python restatements written from the spec."""

import math

from hypothesis import given, settings
from hypothesis import strategies as st

from chartq.functions import numeric as N
from chartq.functions import text as T
from chartq.operators import metrics as M

ALPH = st.sampled_from(list("ab1.%- _\n<>/") + ["<answer>", "</answer>", "<think>", "</think>", "1e3", "inf"])
TEXTS = st.lists(ALPH, max_size=12).map("".join)


def py_float(s):
    try:
        return float(s)
    except ValueError:
        return None


def py_relaxed(t, p, tol=0.05):
    p = p[:-1] if p.endswith(".") else p
    p, t = p.strip(), t.strip()

    def f(x):
        try:
            return float(x.rstrip("%")) / 100.0 if x.endswith("%") else float(x)
        except ValueError:
            return None

    pf, tf = f(p), f(t)
    if pf is not None and tf:
        return int(abs(pf - tf) / abs(tf) <= tol)
    return int(p.lower() == t.lower())


def _eval(spark, rows, *exprs):
    df = spark.createDataFrame(rows, "a string, b string")
    return df.select(*exprs).collect()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(TEXTS, TEXTS), min_size=1, max_size=20))
def test_tag_cut_and_float(spark, rows):
    out = _eval(spark, rows, T.tag_cut("a", "<answer>", "</answer>").alias("cut"), N.to_float("a").alias("f"))
    for (a, _), r in zip(rows, out):
        assert r["cut"] == a.split("<answer>")[-1].strip().split("</answer>")[0].strip()
        exp = py_float(a)
        if exp is None or (isinstance(exp, float) and math.isnan(exp)):
            assert r["f"] is None or math.isnan(r["f"])
        else:
            assert r["f"] == exp


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(TEXTS, TEXTS), min_size=1, max_size=20))
def test_relaxed_accuracy(spark, rows):
    out = _eval(spark, rows, M.relaxed_flag("a", "b").alias("ra"))
    for (a, b), r in zip(rows, out):
        assert r["ra"] == py_relaxed(a, b), (a, b)


def test_relaxed_examples(spark):
    cases = [("100", "104"), ("100", "106"), ("50%", "0.5"), ("Yes", "yes."), ("0", "0.0"), ("abc", " abc. ")]
    out = _eval(spark, cases, M.relaxed_flag("a", "b").alias("ra"))
    assert [r["ra"] for r in out] == [py_relaxed(a, b) for a, b in cases] == [1, 0, 1, 1, 0, 0]
