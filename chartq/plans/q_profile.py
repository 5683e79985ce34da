"""Chart-table profiling queries over FV-cells (CHT-01..05, FLT-05, MET-10/11) and the
table-to-QA flow."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartq.functions import render as R
from chartq.functions.numeric import round4
from chartq.operators import profile as PR
from chartq.operators import qa as Q
from chartq.plans import sqlmacros as S
from chartq.plans.fixture_sql import with_cells
from chartq.plans.q_qa import rounded
from chartq.plans.registry import register
from chartq.sources import fixtures as FX
from chartq.sources.readers import stage_dir

_NA = ", ".join("'" + t.replace("'", "''") + "'" for t in PR.NA_TOKENS)

PROFILE_CTE = with_cells() + f""",
c0 as (select *, cell is null or cell in ({_NA}) as na, {S.to_float('cell')} as f from fv_cells),
prof as (select chart_id, col_name, min(col_idx) as col_idx,
  bool_and(na or (f is not null and lower(cell) not in ('true', 'false'))) as is_numeric,
  count(distinct case when not na then cell end) as nunique, sum(case when not na then f end) as num_sum
  from c0 group by chart_id, col_name),
pc as (select chart_id, count(*) filter (where is_numeric) as n_numeric, count(*) filter (where not is_numeric) as n_cat,
  coalesce(bool_and(nunique <= {PR.LOW_CARD}) filter (where not is_numeric), true) as cat_low,
  coalesce(bool_or(nunique > {PR.LOW_CARD}) filter (where not is_numeric), false) as cat_high,
  sum(coalesce(num_sum, 0.0)) filter (where is_numeric) as num_total from prof group by chart_id),
pk as (select *, n_numeric = 1 and not isnan(num_total) and not isinf(num_total) and abs(num_total - 100) <= 1e-8 + 0.05 * 100 as constant_sum
  from pc),
picked as (select *, case
  when n_numeric = 1 and n_cat = 0 then 'histogram'
  when n_numeric = 1 and n_cat = 1 and cat_low then 'bar'
  when n_numeric = 1 and n_cat = 2 then 'grouped_bar'
  when n_numeric = 2 and n_cat = 0 then 'scatter'
  when n_numeric = 2 and n_cat = 1 then 'bubble'
  when n_numeric >= 3 and n_cat = 0 then 'scatter_matrix'
  when n_numeric >= 3 and n_cat = 1 and cat_low then 'stacked_bar'
  when constant_sum and n_cat = 1 then case when cat_low then 'pie' else 'stacked_bar_100' end
  else 'bar' end as chart_type from pk)
"""


def _rename_sql():
    cases = []
    for t, roles in PR.ROLES.items():
        for rk, rn, name in roles:
            cases.append(f"when chart_type = '{t}' and kind = '{rk}' and k = {rn} then '{name}'")
    cases.append("when chart_type = 'scatter_matrix' and kind = 'n' then col_name")
    cases.append("when chart_type = 'multi_line' and kind = 'n' and k = 1 then 'x'")
    cases.append("when chart_type = 'multi_line' and kind = 'n' then 'y_' || cast(k - 1 as varchar)")
    need = []
    for t, roles in PR.ROLES.items():
        nn = max([r[1] for r in roles if r[0] == "n"], default=0)
        nc = max([r[1] for r in roles if r[0] == "c"], default=0)
        need.append(f"when chart_type = '{t}' then n_numeric >= {nn} and n_cat >= {nc}")
    need.append("when chart_type in ('scatter_matrix', 'multi_line') then n_numeric >= 3")
    return f""", rk as (select prof.*, case when is_numeric then 'n' else 'c' end as kind,
  row_number() over (partition by chart_id, is_numeric order by col_name) as k from prof),
mp as (select rk.chart_id, chart_type, col_name, col_idx, case {' '.join(cases)} end as canonical,
  case {' '.join(need)} else false end as eligible from rk join picked using (chart_id))
"""


@register("column_profile", PROFILE_CTE + f"select chart_id, col_name, col_idx, is_numeric, nunique, {S.r4('num_sum')} as num_sum from prof")
def column_profile(spark, sf_dir):
    """CHT-01: per-column kind, distinct count and numeric sum of every chart table."""
    p = PR.column_profile(FX.fv_cells(spark, sf_dir, positions=False))
    return p.select("chart_id", "col_name", "col_idx", "is_numeric", "nunique", round4("num_sum").alias("num_sum"))


@register("pick_chart", PROFILE_CTE + "select chart_id, n_numeric, n_cat, constant_sum, chart_type from picked")
def pick_chart(spark, sf_dir):
    """CHT-02 / CHT-05: chart type per table from the decision list."""
    p = PR.pick_chart(PR.column_profile(FX.fv_cells(spark, sf_dir, positions=False)))
    return p.select("chart_id", "n_numeric", "n_cat", "constant_sum", "chart_type")


@register("auto_rename", PROFILE_CTE + _rename_sql() + "select chart_id, chart_type, col_name, col_idx, canonical, eligible from mp")
def auto_rename(spark, sf_dir):
    """CHT-03 + FLT-05: canonical column names per chart and whether the chart is usable."""
    prof = PR.column_profile(FX.fv_cells(spark, sf_dir, positions=False))
    return PR.auto_rename(prof, PR.pick_chart(prof))


@register("chart_census", PROFILE_CTE + "select chart_type, count(*) as n from picked group by chart_type")
def chart_census(spark, sf_dir):
    """MET-11: tables per chosen chart type."""
    return PR.census(PR.pick_chart(PR.column_profile(FX.fv_cells(spark, sf_dir, positions=False))))


@register("chart_skips", PROFILE_CTE + _rename_sql() + """select chart_type, count(*) filter (where ok) as kept,
 count(*) filter (where not ok) as skipped from (select chart_id, chart_type, bool_and(eligible) as ok from mp group by chart_id, chart_type)
 group by chart_type""")
def chart_skips(spark, sf_dir):
    """MET-10 for tables: charts kept and skipped per chosen type."""
    prof = PR.column_profile(FX.fv_cells(spark, sf_dir, positions=False))
    return PR.skipped(PR.auto_rename(prof, PR.pick_chart(prof)))


@register("table_qa")
def table_qa(spark, sf_dir):
    """Table to QA: profile every table, pick its type, rename its columns, and generate the
    questions of that type."""
    # the cells feed the profile and the points: written once to the shared folder
    path = stage_dir(spark, "cells")
    FX.fv_cells(spark, sf_dir).write.parquet(path)
    cells = spark.read.parquet(path)
    prof = PR.column_profile(cells)
    mapping = PR.auto_rename(prof, PR.pick_chart(prof))
    # the points of a type are read several times by its generator alone: stored once, partitioned by type
    names, points = stage_dir(spark, "names"), stage_dir(spark, "points")
    PR.named_cells(cells, mapping).write.partitionBy("chart_type").parquet(names)
    named = spark.read.parquet(names)
    PR.wide_points(named).write.partitionBy("chart_type").parquet(points)
    return rounded(Q.generate(named, num=R.num, wide=spark.read.parquet(points)))
