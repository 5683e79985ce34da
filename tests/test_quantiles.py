"""Quantiles by bucket counts against numpy: ties, outliers, single values, blanks, a chart with most rows."""

import random

import numpy as np
import pytest

from chartq.operators.qa import group_quantiles

QS = {"q0": 0.0, "q10": 0.1, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q90": 0.9, "q1": 1.0}


@pytest.mark.parametrize("buckets", [1, 7, 4096])
def test_quantiles_agree_with_numpy(spark, buckets):
    rng = random.Random(2)
    charts = {"one": [3.5], "two": [1.0, -2.0], "ties": [float(rng.randrange(4)) for _ in range(301)], "same": [7.25] * 50,
              "outlier": [rng.random() for _ in range(200)] + [1e300], "wide": [-1.7e308, 1.7e308, 0.0, 5.0, 6.0], "hot": [rng.gauss(0, 5) for _ in range(3000)],
              "zeros": [0.0, -0.0, 0.0], None: [2.0, 4.0, 4.0, 9.0]}
    rows = [(c, float(x)) for c, xs in charts.items() for x in xs if c is not None] + [("hot", None), ("blank", None)]
    got = {r["chart_id"]: r for r in group_quantiles(spark.createDataFrame(rows, "chart_id string, value double").repartition(5), "value", QS, buckets).collect()}
    assert set(got) == {c for c in charts if c is not None}
    for c in got:
        for name, q in QS.items():
            assert got[c][name] == pytest.approx(np.quantile(charts[c], q), rel=1e-12), (c, name)


def test_values_that_are_not_finite(spark):
    inf = float("inf")
    rows = [("i", x) for x in (-inf, 1.0, 2.0, 3.0, inf)]
    got = group_quantiles(spark.createDataFrame(rows, "chart_id string, value double"), "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75}).first()
    assert (got["q25"], got["q50"], got["q75"]) == (1.0, 2.0, 3.0)
