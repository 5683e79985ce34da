"""QA generator queries (QA-*, 61 questions) with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartq.functions import render as R
from chartq.functions.numeric import round4
from chartq.operators import qa as Q
from chartq.operators.rationales import RATIONALES
from chartq.plans import sqlmacros as S
from chartq.plans.fixture_sql import with_fv
from chartq.plans.registry import register
from chartq.sources import fixtures as FX


def _q(qid: str, **slots) -> str:
    out = "'" + Q.QUESTIONS[qid].replace("'", "''") + "'"
    for k, v in slots.items():
        out = f"replace({out}, '{{{k}}}', {v})"
    return out


def _emit(src: str, specs) -> str:
    return "\nunion all\n".join(
        f"select cast(chart_id as varchar) as chart_id, '{qid}' as qid, {_q(qid, **slots)} as question, "
        f"{a} as label, {n} as not_answer, {S.number(a)} as answer_num, {S.number(n)} as not_answer_num, "
        f"{_steps(qid, 0)} as answer_rationale, {_steps(qid, 1)} as not_answer_rationale from {src}" for qid, slots, a, n in specs)


def _steps(qid: str, which: int) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in RATIONALES[qid][which]) + "]"


def rounded(qa):
    """Answers as doubles, rounded in the query for comparison with another engine."""
    return qa.withColumns({c: round4(c) for c in ("answer_num", "not_answer_num")})


def fmax(x, v, flt=None):
    f = f" filter (where {flt})" if flt else ""
    return f"first({x} order by {v} desc nulls last, row_idx){f}"


def fmin(x, v, flt=None):
    f = f" filter (where {flt})" if flt else ""
    return f"first({x} order by {v} asc nulls last, row_idx){f}"


def desc_list(label, key):
    return f"list({label} order by {key} desc, {label})"


BAR_SQL = with_fv("fv_bar") + f""",
st as (select chart_id, {fmax('category', 'value')} as am, {fmin('category', 'value')} as an, max(value) as mx, min(value) as mn,
  avg(value) as mean, list(category order by value desc, row_idx) as rnk from fv_bar group by chart_id),
c as (select p.chart_id, count(*) filter (where value > mean) as gt, count(*) filter (where value < mean) as lt
  from fv_bar p join st using (chart_id) group by p.chart_id),
s as (select * from st join c using (chart_id))
""" + _emit("s", [
    ("QA-BAR-1", {}, "am", "an"), ("QA-BAR-2", {}, "an", "am"),
    ("QA-BAR-3", {}, S.num("mx - mn"), S.num("mn - mx")), ("QA-BAR-4", {}, S.num("mean"), S.num("mean + 1")),
    ("QA-BAR-5", {}, S.integer("gt"), S.integer("lt")),
    ("QA-BAR-6", {}, S.quoted_list("rnk"), S.quoted_list("list_reverse(rnk)")),
])

PIE_SQL = with_fv("fv_bar") + f""",
st as (select chart_id, sum(value) as total, first(category order by row_idx) as c0, first(value order by row_idx) as v0,
  {fmax('category', 'value')} as am, {fmin('category', 'value')} as an from fv_bar group by chart_id),
cats as (select chart_id, category, min(row_idx) as fr, sum(value) as cs from fv_bar group by chart_id, category),
tc as (select chart_id, max(category) filter (where rn = 2) as c1, sum(cs) as s01, count(*) as ncat from
  (select *, row_number() over (partition by chart_id order by fr) as rn from cats) where rn <= 2 group by chart_id),
low2 as (select chart_id, first(category order by value desc, row_idx) as second from
  (select *, row_number() over (partition by chart_id order by value, row_idx) as rn from fv_bar) where rn <= 2 group by chart_id),
sh as (select p.chart_id, count(*) filter (where value / total * 100 < 10) as lt10, count(*) filter (where value / total * 100 > 10) as gt10,
  coalesce(bool_or(value / total * 100 > 50), false) as any50, coalesce(bool_and(value / total * 100 <= 50), true) as all50
  from fv_bar p join st using (chart_id) group by p.chart_id),
s as (select *, round_even(v0 / total * 100, 2) as pct0, round_even(s01 / total * 100, 2) as pct01
  from st join tc using (chart_id) join low2 using (chart_id) join sh using (chart_id) where ncat >= 2)
""" + _emit("s", [
    ("QA-PIE-1", {}, "am", "an"),
    ("QA-PIE-2", {"c0": "c0"}, S.num("pct0"), S.num("round_even(100 - pct0, 2)")),
    ("QA-PIE-3", {}, "second", "am"),
    ("QA-PIE-4", {}, S.integer("lt10"), S.integer("gt10")),
    ("QA-PIE-5", {"c0": "c0", "c1": "c1"}, S.num("pct01"), S.num("round_even(100 - pct01, 2)")),
    ("QA-PIE-6", {}, S.boolean("any50"), S.boolean("all50")),
])

GRP_SQL = with_fv("fv_grp") + f""",
st as (select chart_id, first(grp order by row_idx) as g0, first(category order by row_idx) as c0,
  {fmax('category', 'value')} as am, {fmin('category', 'value')} as an from fv_grp group by chart_id),
j as (select p.*, g0, c0 from fv_grp p join st using (chart_id)),
g0s as (select chart_id, {fmax('category', 'value', 'grp = g0')} as g0_max, {fmin('category', 'value', 'grp = g0')} as g0_min,
  sum(value) filter (where grp = g0) as g0_sum, min(value) filter (where grp = g0) as g0_low from j group by chart_id),
pg as (select chart_id, grp, avg(value) as gm, sum(value) as gs,
  max(value) filter (where category = c0) - min(value) filter (where category = c0) as c0_range,
  avg(value) filter (where category = c0) as c0_mean from j group by chart_id, grp),
gs as (select chart_id, first(grp order by gm, grp) as low_mean, first(grp order by gm desc, grp) as high_mean,
  max(c0_range) as c0_range, max(c0_mean) as c0_mean, {desc_list('grp', 'gs')} as by_total from pg group by chart_id),
s as (select * from st join g0s using (chart_id) join gs using (chart_id))
""" + _emit("s", [
    ("QA-GRP-1", {"g0": "g0"}, "g0_max", "g0_min"),
    ("QA-GRP-2", {"g0": "g0"}, S.num("g0_sum"), S.num("g0_low")),
    ("QA-GRP-3", {}, "am", "an"), ("QA-GRP-4", {}, "low_mean", "high_mean"),
    ("QA-GRP-5", {"c0": "c0"}, S.num("c0_range"), S.num("c0_mean")),
    ("QA-GRP-6", {}, S.quoted_list("by_total"), S.quoted_list("list_reverse(by_total)")),
])


def _edge(k):
    return f"(case when {k} = 10 then hi else {k} * step + lo end)"


HIST_SQL = with_fv("fv_hist") + f""",
st0 as (select chart_id, min(value) as lo0, max(value) as hi0, count(value) as n, avg(value) as mean, stddev_samp(value) as sd,
  stddev_pop(value) as sdp, skewness(value) as skew,
  quantile_cont(value, 0.5) as q50, quantile_cont(value, 0.25) as q25, quantile_cont(value, 0.75) as q75,
  quantile_cont(value, 0.1) as q10, quantile_cont(value, 0.9) as q90 from fv_hist group by chart_id),
st as (select *, case when lo0 = hi0 then lo0 - 0.5 else lo0 end as lo, case when lo0 = hi0 then hi0 + 0.5 else hi0 end as hi,
  (case when lo0 = hi0 then hi0 + 0.5 else hi0 end - case when lo0 = hi0 then lo0 - 0.5 else lo0 end) / 10 as step from st0),
j as (select p.chart_id, p.value, lo, hi, step, mean, sd, q50,
  case when floor((p.value - lo) * (10.0 / (hi - lo))) = 10 then 9 else cast(floor((p.value - lo) * (10.0 / (hi - lo))) as bigint) end as k1
  from fv_hist p join st using (chart_id)),
b as (select *, case when value < {_edge('k1')} then k1 - 1 when value >= {_edge('(k1 + 1)')} and k1 <> 9 then k1 + 1 else k1 end as k from j),
c as (select chart_id, list_value({', '.join(f'count(*) filter (where k = {i})' for i in range(10))}) as cnt,
  count(*) filter (where value < q50) as lt_med, count(*) filter (where value >= q50) as ge_med,
  count(*) filter (where value > mean + sd) as hi_sd, count(*) filter (where value < mean - sd) as lo_sd from b group by chart_id),
s as (select *, list_position(cnt, list_max(cnt)) - 1 as kmax, list_position(cnt, list_min(cnt)) - 1 as kmin,
  case when sdp = 0 then false else n >= 3 and coalesce(skew > 0, false) end as rs,
  case when n >= 3 and sdp = 0 then true else n >= 3 and coalesce(skew <= 0, false) end as nrs
  from st join c using (chart_id))
""" + _emit("s", [
    ("QA-HST-1", {}, S.pair(S.num(_edge("kmax")), S.num(_edge("(kmax + 1)"))), S.pair(S.num(_edge("kmin")), S.num(_edge("(kmin + 1)")))),
    ("QA-HST-2", {}, S.integer("lt_med"), S.integer("ge_med")),
    ("QA-HST-3", {}, S.num("mean"), S.num("mean + 1")),
    ("QA-HST-4", {}, S.num("q75 - q25"), S.num("q90 - q10")),
    ("QA-HST-5", {}, S.integer("hi_sd"), S.integer("lo_sd")),
    ("QA-HST-6", {}, S.boolean("rs"), S.boolean("nrs")),
])

LINE_SQL = with_fv("fv_line") + f""",
st as (select chart_id, count(*) as n, {fmax('x', 'y')} as x_at_max, {fmin('x', 'y')} as x_at_min, avg(y) as mean,
  first(y order by row_idx) as y0, first(y order by row_idx desc) as y1, first(x order by row_idx) as x0,
  first(x order by row_idx desc) as x1 from fv_line group by chart_id),
d as (select chart_id, max(y - py) as dmax, min(y - py) as dmin, first(x order by row_idx) filter (where y > mean) as x_exceed from
  (select p.*, mean, lag(y) over (partition by chart_id order by row_idx) as py from fv_line p join st using (chart_id)) group by chart_id),
s as (select *, case when x1 - x0 <> 0 then (y1 - y0) / (x1 - x0) end as slope from st join d using (chart_id) where n >= 2)
""" + _emit("s", [
    ("QA-LIN-1", {}, S.num("x_at_max"), S.num("x_at_min")),
    ("QA-LIN-2", {}, S.num("dmax"), S.num("dmin")),
    ("QA-LIN-3", {"thr": S.fmt2("mean")}, S.num("x_exceed"), S.num("case when x_exceed is not null then x_at_min else x0 end")),
    ("QA-LIN-4", {}, S.num("mean"), S.num("mean + 1")),
    ("QA-LIN-5", {}, S.boolean("y1 > y0"), S.boolean("y1 <= y0")),
    ("QA-LIN-6", {}, S.num("slope"), S.num("-slope")),
])


def pearson(a, b):
    return f"(case when stddev_samp({a}) * stddev_samp({b}) <> 0 then covar_samp({a}, {b}) / (stddev_samp({a}) * stddev_samp({b})) end)"


SCATTER_SQL = with_fv("fv_scatter") + f""",
s as (select chart_id, {pearson('x', 'y')} as r, count(*) filter (where x > 0 and y > 0) as pp, count(*) filter (where x < 0 and y < 0) as nn,
  {fmin('row_idx', 'x*x + y*y')} as near, {fmax('row_idx', 'x*x + y*y')} as far, {fmax('row_idx', 'y')} as ymax, {fmin('row_idx', 'y')} as ymin,
  round_even(count(*) filter (where y > x) / count(*), 3) as above from fv_scatter group by chart_id)
""" + _emit("s", [
    ("QA-SCT-1", {}, S.num("r"), S.num("case when r = 0 then 0.5 else -r end")),
    ("QA-SCT-2", {}, S.integer("pp"), S.integer("nn")),
    ("QA-SCT-3", {}, S.integer("near"), S.integer("far")),
    ("QA-SCT-4", {}, S.integer("ymax"), S.integer("ymin")),
    ("QA-SCT-5", {}, S.num("above"), S.num("round_even(1 - above, 3)")),
    ("QA-SCT-6", {}, "case when coalesce(r > 0, false) then 'positive' else 'negative' end",
     "case when coalesce(r > 0, false) then 'negative' else 'positive' end"),
])

BUBBLE_SQL = with_fv("fv_bubble") + f""",
st as (select chart_id, {fmax('row_idx', 'size')} as big, {fmin('row_idx', 'size')} as small, avg(size) as mean,
  {fmax('row_idx', 'y')} as ymax, {fmin('row_idx', 'y')} as ymin, {pearson('size', 'y')} as r, quantile_cont(size, 0.5) as med
  from fv_bubble group by chart_id),
c as (select chart_id, count(*) filter (where size < med) as lt, count(*) filter (where size > med) as gt from fv_bubble join st using (chart_id)
  group by chart_id),
s as (select * from st join c using (chart_id))
""" + _emit("s", [
    ("QA-BUB-1", {}, S.integer("big"), S.integer("small")),
    ("QA-BUB-2", {}, S.num("mean"), S.num("mean + 1")),
    ("QA-BUB-3", {}, S.integer("lt"), S.integer("gt")),
    ("QA-BUB-4", {}, S.integer("ymax"), S.integer("ymin")),
    ("QA-BUB-5", {}, S.boolean("coalesce(r > 0, false)"), S.boolean("coalesce(r <= 0, false)")),
])

DUAL_SQL = with_fv("fv_dual") + """,
j as (select *, sign(y1 - y2) as sg, lag(sign(y1 - y2)) over (partition by chart_id order by row_idx) as psg from fv_dual),
s as (select chart_id, first(x order by row_idx) filter (where psg is not null and sg <> psg) as cross_x,
  first(x order by row_idx) as x0, first(x order by row_idx desc) as xl, first(y1 - y2 order by row_idx desc) as last_gap,
  max(abs(y1 - y2)) as gmax, min(abs(y1 - y2)) as gmin, avg(y1) as m1, first(y2 order by row_idx) as y2_0,
  first(y2 order by row_idx desc) as y2_l from j group by chart_id)
""" + _emit("s", [
    ("QA-DUA-1", {}, S.num("cross_x"), S.num("case when cross_x is not null then xl else x0 end")),
    ("QA-DUA-2", {}, "case when coalesce(last_gap > 0, false) then 'y1' else 'y2' end",
     "case when coalesce(last_gap > 0, false) then 'y2' else 'y1' end"),
    ("QA-DUA-3", {}, S.num("gmax"), S.num("gmin")),
    ("QA-DUA-4", {}, S.num("m1"), S.num("m1 + 1")),
    ("QA-DUA-5", {}, S.boolean("y2_l > y2_0"), S.boolean("y2_l <= y2_0")),
])

_V = list(FX.MATRIX_VARS)
_UP = [(i, j) for i in range(len(_V)) for j in range(len(_V)) if i < j]


def _r(i, j):
    return f"r_{min(i, j)}_{max(i, j)}"


_neg_all = " or ".join("(" + " and ".join(f"coalesce({_r(i, j)} < 0, false)" for j in range(len(_V)) if j != i) + ")"
                       for i in range(len(_V)))
MATRIX_SQL = with_fv("fv_matrix") + f""",
st as (select chart_id, {', '.join(f'var_samp({v}) as var_{i}' for i, v in enumerate(_V))},
  {', '.join(f"{pearson(_V[i], _V[j])} as {_r(i, j)}" for i, j in _UP)} from fv_matrix group by chart_id),
u as (select *, list_filter([{', '.join(f"{{'k': {k}, 'a': '{_V[i]}', 'b': '{_V[j]}', 'ar': abs({_r(i, j)})}}" for k, (i, j) in enumerate(_UP))}],
    lambda e: e.ar is not null and not isnan(e.ar)) as up,
  list_filter([{', '.join(f"{{'s': -var_{i}, 'i': {i}, 'v': '{v}'}}" for i, v in enumerate(_V))}], lambda e: e.s is not null) as vr from st),
s as (select chart_id,
  list_sort(list_transform(up, lambda e: {{'s': -e.ar, 'k': e.k, 'a': e.a, 'b': e.b}}))[1] as best,
  list_sort(list_transform(up, lambda e: {{'s': e.ar, 'k': e.k, 'a': e.a, 'b': e.b}}))[1] as worst,
  list_transform(list_sort(vr), lambda e: e.v) as by_var,
  list_transform(list_sort(list_transform(vr, lambda e: {{'s': -e.s, 'i': e.i, 'v': e.v}})), lambda e: e.v) as low_var,
  ({_neg_all}) as neg_all, len(list_filter(up, lambda e: e.ar > 0.8)) as hi, len(list_filter(up, lambda e: e.ar <= 0.8)) as lo
  from u where len(up) > 0)
""" + _emit("s", [
    ("QA-MTX-1", {}, S.pair("'''' || best.a || ''''", "'''' || best.b || ''''"), S.pair("'''' || worst.a || ''''", "'''' || worst.b || ''''")),
    ("QA-MTX-2", {}, "by_var[1]", "low_var[1]"),
    ("QA-MTX-3", {}, S.boolean("neg_all"), S.boolean("not neg_all")),
    ("QA-MTX-4", {}, S.integer("hi"), S.integer("lo")),
    ("QA-MTX-5", {}, S.quoted_list("by_var"), S.quoted_list("list_reverse(by_var)")),
])

STACK_SQL = with_fv("fv_stack") + f""",
st as (select chart_id, first(grp order by row_idx) as g0, first(series order by row_idx) as s0,
  {fmax('series', 'value')} as seg_max, {fmin('series', 'value')} as seg_min from fv_stack group by chart_id),
pg as (select chart_id, grp, sum(value) as gt, first(g0) as g0, sum(value) filter (where series = s0) as g_s0
  from fv_stack join st using (chart_id) group by chart_id, grp),
ps as (select chart_id, series, sum(value) as st from fv_stack group by chart_id, series),
gs as (select chart_id, max(gt) filter (where grp = g0) as g0_total, max(g_s0) filter (where grp = g0) as g0_s0, min(gt) as min_total,
  first(grp order by gt desc, grp) as g_top, first(grp order by gt, grp) as g_low from pg group by chart_id),
ss as (select chart_id, first(series order by st desc, series) as s_top, first(series order by st, series) as s_low from ps group by chart_id),
s as (select *, round_even(case when g0_total <> 0 then coalesce(g0_s0, 0.0) / g0_total end * 100, 2) as pct
  from st join gs using (chart_id) join ss using (chart_id))
""" + _emit("s", [
    ("QA-STK-1", {"g0": "g0"}, S.num("g0_total"), S.num("min_total")),
    ("QA-STK-2", {}, "s_top", "s_low"), ("QA-STK-3", {}, "g_top", "g_low"),
    ("QA-STK-4", {"g0": "g0", "s0": "s0"}, S.num("pct"), S.num("round_even(100 - pct, 2)")),
    ("QA-STK-5", {}, "seg_max", "seg_min"),
])

_Y = ["y_1", "y_2", "y_3"]


def _arg(vals, largest):
    items = ", ".join(f"{{'s': {'-' if largest else ''}({v}), 'i': {i}, 'c': '{_Y[i]}'}}" for i, v in enumerate(vals))
    return f"list_sort(list_filter([{items}], lambda e: e.s is not null))[1].c"


def _slope(i):
    return f"(case when xl - x0 <> 0 then (l{i} - f{i}) / (xl - x0) end)"


def _means(off):
    return "'{' || " + " || ', ' || ".join(f"'''{c}'': ' || {S.num(f'm{i} + {off}')}" for i, c in enumerate(_Y)) + " || '}'"


MULTI_SQL = with_fv("fv_multi") + f""",
st as (select chart_id, first(x order by row_idx) as x0, first(x order by row_idx desc) as xl,
  {', '.join(f'max({c}) as mx{i}, first({c} order by row_idx) as f{i}, first({c} order by row_idx desc) as l{i}, avg({c}) as m{i}' for i, c in enumerate(_Y))}
  from fv_multi group by chart_id),
s as (select chart_id, {_arg([f'mx{i}' for i in range(3)], True)} as line_max, {_arg([f'mx{i}' for i in range(3)], False)} as line_min,
  {_arg([f'l{i}' for i in range(3)], False)} as final_low, {_arg([f'l{i}' for i in range(3)], True)} as final_high,
  {_arg([_slope(i) for i in range(3)], True)} as steep, {_arg([_slope(i) for i in range(3)], False)} as flat,
  {' + '.join(f'cast(coalesce({_slope(i)} > 0, false) as int)' for i in range(3))} as up,
  {' + '.join(f'cast(coalesce({_slope(i)} <= 0, false) as int)' for i in range(3))} as down,
  {_means(0)} as means, {_means(1)} as means1 from st)
""" + _emit("s", [
    ("QA-MUL-1", {}, "line_max", "line_min"), ("QA-MUL-2", {}, "final_low", "final_high"),
    ("QA-MUL-3", {}, "steep", "flat"), ("QA-MUL-4", {}, S.integer("up"), S.integer("down")),
    ("QA-MUL-5", {}, "means", "means1"),
])


QA_VIEWS = {
    "qa_bar": (lambda sp, d: rounded(Q.bar_qa(FX.fv_bar(sp, d), num=R.num)), BAR_SQL),
    "qa_pie": (lambda sp, d: rounded(Q.pie_qa(FX.fv_bar(sp, d), num=R.num)), PIE_SQL),
    "qa_grouped_bar": (lambda sp, d: rounded(Q.grouped_bar_qa(FX.fv_grp(sp, d), num=R.num)), GRP_SQL),
    "qa_histogram": (lambda sp, d: rounded(Q.histogram_qa(FX.fv_hist(sp, d), num=R.num)), HIST_SQL),
    "qa_line": (lambda sp, d: rounded(Q.line_qa(FX.fv_line(sp, d), num=R.num)), LINE_SQL),
    "qa_scatter": (lambda sp, d: rounded(Q.scatter_qa(FX.fv_scatter(sp, d), num=R.num)), SCATTER_SQL),
    "qa_bubble": (lambda sp, d: rounded(Q.bubble_qa(FX.fv_bubble(sp, d), num=R.num)), BUBBLE_SQL),
    "qa_dual_axis": (lambda sp, d: rounded(Q.dual_axis_qa(FX.fv_dual(sp, d), num=R.num)), DUAL_SQL),
    "qa_scatter_matrix": (lambda sp, d: rounded(Q.scatter_matrix_qa(FX.fv_matrix(sp, d), FX.MATRIX_VARS, num=R.num)), MATRIX_SQL),
    "qa_stacked_bar": (lambda sp, d: rounded(Q.stacked_bar_qa(FX.fv_stack(sp, d), num=R.num)), STACK_SQL),
    "qa_multi_line": (lambda sp, d: rounded(Q.multi_line_qa(FX.fv_multi(sp, d), num=R.num)), MULTI_SQL),
}

for _key, (_fn, _sql) in QA_VIEWS.items():
    register(_key, _sql, doc=f"QA-* for {_key[3:].replace('_', ' ')} charts: question, answer and distractor rows "
                             f"from one per-chart aggregate (plus join-backs where rows meet a chart statistic).")(_fn)


@register("qa_all_prefs")
def qa_all_prefs(spark, sf_dir):
    """QA-ALL: every generator over its chart view, unioned into one preference table."""
    parts = [fn(spark, sf_dir).withColumn("chart_type", F.lit(k[3:])) for k, (fn, _) in QA_VIEWS.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


from chartq.plans.registry import ORACLE as _ORACLE  # noqa: E402

_ORACLE["qa_all_prefs"] = "\nunion all\n".join(
    f"select *, '{k[3:]}' as chart_type from ({sql})" for k, (_, sql) in QA_VIEWS.items())


def _compat_sql():
    bar = BAR_SQL.replace("list(category order by value desc, row_idx) as rnk",
                          "list(cast(row_idx as varchar) order by value desc, row_idx) as rnk")
    dual = DUAL_SQL.replace("first(x order by row_idx) filter (where psg is not null and sg <> psg) as cross_x",
                            "first(cast(row_idx as double) order by row_idx) filter (where psg is not null and sg <> psg) as cross_x")
    mtx = MATRIX_SQL.replace(f"({_neg_all}) as neg_all", "false as neg_all")
    return (f"select * from ({bar}) where qid = 'QA-BAR-6' union all select * from ({dual}) where qid = 'QA-DUA-1' "
            f"union all select * from ({mtx}) where qid = 'QA-MTX-3'")


@register("qa_compat", _compat_sql().replace(S.quoted_list("rnk"), S.int_list("rnk")).replace(
    S.quoted_list("list_reverse(rnk)"), S.int_list("list_reverse(rnk)")))
def qa_compat(spark, sf_dir):
    """Compat mode: the three questions where the reference's answers differ
    from the intended ones — bar ranking as row indexes (Q17), crossing as a row index
    (Q18), "negative with all others" always False (Q20)."""
    bar = Q.bar_qa(FX.fv_bar(spark, sf_dir), compat=True, num=R.num).where(F.col("qid") == "QA-BAR-6")
    dual = Q.dual_axis_qa(FX.fv_dual(spark, sf_dir), compat=True, num=R.num).where(F.col("qid") == "QA-DUA-1")
    mtx = Q.scatter_matrix_qa(FX.fv_matrix(spark, sf_dir), FX.MATRIX_VARS, compat=True, num=R.num).where(F.col("qid") == "QA-MTX-3")
    return rounded(bar.unionByName(dual).unionByName(mtx))
