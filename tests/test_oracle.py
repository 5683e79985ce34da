"""Every query of the registry against its DuckDB oracle on the smallest scale factor."""

import pytest

import __spark_entry__ as E
from chartq.plans.registry import ORACLE, QUERIES, load_all
from tests.conftest import SF_SMALL
from tools.check_oracle import rows_key, type_mismatches

load_all()


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_matches_oracle(spark, duck, key):
    sdf = QUERIES[key](spark, SF_SMALL)
    cols = sdf.columns
    srows = [tuple(r) for r in sdf.collect()]
    cur = duck.execute(ORACLE[key])
    dcols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(dcols)
    order = [dcols.index(c) for c in cols]
    drows = [tuple(r[i] for i in order) for r in cur.fetchall()]
    assert rows_key(srows) == rows_key(drows)
    assert type_mismatches(sdf, duck, ORACLE[key]) == {}
    plan = sdf._jdf.queryExecution().executedPlan().toString()
    assert not any(n in plan for n in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas"))


def test_every_query_has_an_oracle():
    assert sorted(QUERIES) == sorted(ORACLE)
    assert set(QUERIES) <= set(E.queries()) and set(ORACLE) <= set(E.oracle_sql())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["run", "dataset", "n", "em", "ra", "em_rate", "ra_rate"]
