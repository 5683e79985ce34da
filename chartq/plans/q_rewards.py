"""Reward, tag-extraction and JSON-table queries over FV-completions / FV-emb
(RWD-01..09, TXT-01/04/05/06/08, JSN-01..06/09, MET-06/07/10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartq.functions import jsontab as J
from chartq.functions.numeric import round4
from chartq.functions.text import after_last, before_first, py_strip, step_count, strip_newlines, tag_cut
from chartq.operators import rewards as R
from chartq.operators import tables as T
from chartq.plans import sqlmacros as S
from chartq.plans.fixture_sql import FV, with_fv
from chartq.plans.registry import register
from chartq.sources.fixtures import fv_completions, fv_emb

NL = "chr(10)"
TABLE_TYPE = """'{"columns":["VARCHAR"],"rows":[["VARCHAR"]]}'"""


# ---- DuckDB twins of the reward expressions (oracle only) -------------------------------

def d_format(c="completion"):
    return (rf"(case when coalesce(regexp_matches({c}, '(?s)\A<think>\n<type>.*?</type>\n<table>.*?</table>.*?</think>\n"
            rf"<answer>.*?</answer>(?m:$)'), false) then 2.0 else 0.0 end)")


def d_tokens(c="completion"):
    parts = []
    for p in R.TOKEN_PATTERNS:
        lit = " || ".join(f"'{x}'" for x in p.split("\n"))
        lit = lit.replace(" || ", f" || {NL} || ") if "\n" in p else lit
        parts.append(f"((length({c}) - length(replace({c}, {lit}, ''))) // {len(p)}) = 1")
    return f"(case when coalesce({' and '.join(parts)}, false) then 2.0 else 0.0 end)"


def d_answer(c="completion"):
    return f"(case when contains({c}, '<answer>') and contains({c}, '<think>') then regexp_replace({S.tag_cut(c, '<answer>', '</answer>')}, '\\.+$', '') end)"


def d_accuracy(c="completion", label="label", compat=False):
    a = d_answer(c)
    gf, af = S.to_float(label), S.to_float(a)
    s = f"({gf} + 1e-6)"
    div = s if compat else f"abs({s})"
    rel = f"(case when {s} <> 0 then abs({af} - {s}) / {div} end)"
    numeric = f"(case when {af} is null then false else coalesce({rel} <= 0.05, false) end)"
    ok = f"(case when length({a}) = 0 then false when {gf} is not null then {numeric} else lower({label}) = lower({a}) end)"
    return f"(case when coalesce({ok}, false) then 1.0 else 0.0 end)"


def d_length(c="completion"):
    r = S.tag_cut(c, "<think>", "</think>")
    return (f"((case when length({r}) > 70 and length({r}) <= 250 then 1.0 else 0.0 end) "
            f"+ least(0.25 * len(string_split({r}, '<step-')), 1.5))")


def d_type(c="completion", t="chart_type"):
    return f"(case when coalesce(lower({S.tag_cut(c, '<type>', '</type>')}) = lower({t}), false) then 1.0 else 0.0 end)"


def d_block(c="completion"):
    tab = S.strip(S.before_first(S.strip(S.after_last(c, "<table>")), "</table>"))
    fenced = S.strip(S.before_first(S.after_last(tab, "```json"), "```"))
    return f"(case when contains({tab}, '```json') then {fenced} else {S.strip(f'replace({tab}, {NL}, {chr(39)}{chr(39)})')} end)"


def d_quote(b):
    return (f"""array_to_string(list_transform(regexp_extract_all({b}, '"(?:[^"\\\\]|\\\\.)*"|[^"]+'), """
            f"""lambda t: case when starts_with(t, '"') then t else regexp_replace(t, '-?[0-9][0-9.eE+-]*', '"\\0"', 'g') end), '')""")


def d_parse(b):
    return f"(case when json_valid({b}) then from_json({d_quote(b)}, {TABLE_TYPE}) end)"


def d_sort_ci(a):
    return f"list_transform(list_sort(list_transform({a}, lambda x, i: {{'k': lower(x), 'i': i, 'v': x}})), lambda s: s.v)"


def d_compare(p, g):
    """SQL twin of jsontab.compare_tables over parsed struct columns p and g."""
    pc, gc = d_sort_ci(f"{p}.columns"), d_sort_ci(f"{g}.columns")
    pr, gr = f"list_sort({p}.rows)", f"list_sort({g}.rows)"
    long_row = f"coalesce(list_bool_or(list_transform(range(1, len({pr}) + 1), lambda i: len({pr}[i]) > coalesce(len({gr}[i]), 0))), false)"
    overrun = f"(len({pc}) > len({gc}) or len({pr}) > len({gr}) or {long_row})"
    col_hits = f"len(list_filter(list_transform(range(1, len({pc}) + 1), lambda i: lower({pc}[i]) = lower({gc}[i])), lambda x: coalesce(x, false)))"
    cell_hits = (f"coalesce(list_sum(list_transform(range(1, len({pr}) + 1), lambda i: len(list_filter(list_transform("
                 f"range(1, len({pr}[i]) + 1), lambda j: {pr}[i][j] = {gr}[i][j]), lambda z: coalesce(z, false))))), 0)")
    score = (f"((case when len({pc}) > 0 then 0.5 * {col_hits} / len({pc}) else 0.0 end) + "
             f"(case when len({pr}) > 0 then 0.5 * {cell_hits} / len({pr}) else 0.0 end))")
    ok = f"({p}.columns is not null and {p}.rows is not null and {g}.columns is not null and {g}.rows is not null)"
    return f"(case when {ok} and not {overrun} then {score} else 0.0 end)"


_TABLE_CTE = f"""t0 as (select *, {d_block()} as block from fv_completions),
t1 as (select *, json_valid(block) as ok, {d_parse('block')} as pred, {d_parse('gold_table')} as gold from t0),
t2 as (select *, (case when ok then 0.5 else 0.0 end)
   + (case when ok and gold is not null then {d_compare('pred', 'gold')} else 0.0 end)
   + (case when ok and list_sort(list_distinct(json_keys(block))) = ['columns', 'rows'] then 0.25 else 0.0 end) as r_table from t1)
"""

_ALL_CTE = with_fv("fv_completions") + ", " + _TABLE_CTE + f""",
sc as (select run, dataset, idx, chart_type, {d_format()} as r_format, {d_accuracy()} as r_accuracy, {d_length()} as r_length,
  {d_tokens()} as r_tokens, {d_type()} as r_chart_type, r_table from t2),
tot as (select *, r_format + r_accuracy + r_length + r_tokens + r_chart_type + r_table as r_total from sc)
"""


def _one(name, sql_expr):
    return with_fv("fv_completions") + f"select run, dataset, idx, {S.r4(sql_expr)} as reward from fv_completions"


def _spark_one(fn, **kw):
    def q(spark, sf_dir):
        df = fv_completions(spark, sf_dir)
        return df.select("run", "dataset", "idx", round4(fn(**kw)).alias("reward"))
    return q


register("reward_format", _one("format", d_format()),
         doc="RWD-01: 2.0 when a completion starts with the think / type / table / answer layout.")(
    _spark_one(R.format_reward))
register("reward_tokens", _one("tokens", d_tokens()),
         doc="RWD-04: 2.0 when each of the ten tag patterns occurs exactly once.")(_spark_one(R.num_token_reward))
register("reward_accuracy", _one("accuracy", d_accuracy()),
         doc="RWD-02: relative-error (numeric gold) or case-insensitive (text gold) answer match.")(
    _spark_one(R.accuracy_reward))


@register("reward_accuracy_signed", with_fv("fv_completions") + f""", neg as (select run, dataset, idx, completion,
  case when idx % 2 = 1 then '-' || label else label end as label from fv_completions)
select run, dataset, idx, {S.r4(d_accuracy())} as reward, {S.r4(d_accuracy(compat=True))} as reward_compat from neg""")
def reward_accuracy_signed(spark, sf_dir):
    """RWD-02 on negative gold values: the intended absolute divisor next to the reference's
    signed one (`compat`, quirk Q6), which accepts any answer not far above a negative gold."""
    df = fv_completions(spark, sf_dir)
    neg = df.withColumn("label", F.when(F.col("idx") % 2 == 1, F.concat(F.lit("-"), "label")).otherwise(F.col("label")))
    return neg.select("run", "dataset", "idx", round4(R.accuracy_reward()).alias("reward"),
                      round4(R.accuracy_reward(compat=True)).alias("reward_compat"))


register("reward_length", _one("length", d_length()),
         doc="RWD-03: rationale-length band plus a capped bonus per reasoning step.")(_spark_one(R.length_think_reward))
register("reward_type", _one("chart_type", d_type()),
         doc="RWD-05: 1.0 when the predicted chart type equals the gold type.")(_spark_one(R.chart_type_reward))


@register("reward_table", with_fv("fv_completions") + ", " + _TABLE_CTE
          + f"select run, dataset, idx, {S.r4('r_table')} as reward from t2")
def reward_table(spark, sf_dir):
    """RWD-06: JSON validity, sorted header / cell matches against the gold table, exact key set."""
    df = R.with_table_parts(fv_completions(spark, sf_dir))
    return df.select("run", "dataset", "idx", round4(R.table_style_reward()).alias("reward"))


_SEVEN_CTE = _ALL_CTE + f""", fv_emb as ({FV['fv_emb']}),
seven as (select tot.* exclude (r_total), p.r_process, tot.r_total + coalesce(p.r_process, 0.0) as r_total from tot
  left join (select idx, list_cosine_similarity(cast(e1 as double[]), cast(e2 as double[])) as r_process from fv_emb) p using (idx))
"""


def _scored(spark, sf_dir):
    """All rewards of the completions and their sum. Both sides are scored before the join, which moves numbers in place of texts and vectors."""
    rules = R.score(fv_completions(spark, sf_dir, spread=True), [n for n in R.REWARDS if n != "process"])
    process = R.score(fv_emb(spark, sf_dir), ["process"], pred_embedding="e1", gold_embedding="e2").select("idx", "r_process")
    cols = ["run", "dataset", "idx", "chart_type", *[f"r_{n}" for n in R.REWARDS]]
    return R.with_total(rules.drop("r_total").join(process, "idx", "left").select(*cols))


@register("reward_total", _SEVEN_CTE + "select run, dataset, idx, " + ", ".join(
    f"{S.r4(c)} as {c}" for c in ("r_format", "r_accuracy", "r_length", "r_tokens", "r_chart_type", "r_table", "r_process", "r_total"))
          + " from seven")
def reward_total(spark, sf_dir):
    """RWD-08: all seven rewards and their sum per completion."""
    s = _scored(spark, sf_dir)
    cols = [c for c in s.columns if c.startswith("r_")]
    return s.select("run", "dataset", "idx", *[round4(c).alias(c) for c in cols])


@register("reward_summary", _SEVEN_CTE + "select dataset, chart_type, count(*) as n, " + ", ".join(
    f"{S.r4(f'avg(r_{n})')} as avg_{n}" for n in ("format", "accuracy", "length", "tokens", "chart_type", "table", "process", "total"))
          + " from seven group by dataset, chart_type")
def reward_summary(spark, sf_dir):
    """RWD-09: mean of every reward per dataset and chart type."""
    return R.summary(_scored(spark, sf_dir))


@register("reward_process", with_fv("fv_emb")
          + f"select idx, {S.r4('list_cosine_similarity(cast(e1 as double[]), cast(e2 as double[]))')} as reward from fv_emb")
def reward_process(spark, sf_dir):
    """RWD-07 / JSN-09: cosine of the predicted-steps and gold-reasoning embeddings."""
    return fv_emb(spark, sf_dir).select("idx", round4(R.process_style_reward("e1", "e2")).alias("reward"))


# ---- tag extraction ------------------------------------------------------------------------

@register("extract_blocks", with_fv("fv_completions") + f"""
select run, dataset, idx, {S.tag_cut('completion', '<answer>', '</answer>')} as answer,
 regexp_replace({S.before_first(S.strip(S.after_last('completion', '<think>')), '</think>')}, '^\\n+|\\n+$', '', 'g') as think,
 lower({S.strip(S.before_first(S.after_last('completion', '<type>'), '</type>'))}) as type,
 {d_block()} as table_text,
 {S.strip(S.before_first(S.strip(S.after_last('completion', '</table>')), '</think>'))} as reasoning,
 len(string_split({S.tag_cut('completion', '<think>', '</think>')}, '<step-')) as steps
from fv_completions""")
def extract_blocks(spark, sf_dir):
    """TXT-01/04/05/06/08: answer, rationale, chart type, table text, reasoning after the
    table, and step count, all by substring cuts."""
    c = F.col("completion")
    return fv_completions(spark, sf_dir).select(
        "run", "dataset", "idx", tag_cut(c, "<answer>", "</answer>").alias("answer"),
        strip_newlines(before_first(py_strip(after_last(c, "<think>")), "</think>")).alias("think"),
        F.lower(py_strip(before_first(after_last(c, "<type>"), "</type>"))).alias("type"),
        J.table_block(c).alias("table_text"),
        py_strip(before_first(py_strip(after_last(c, "</table>")), "</think>")).alias("reasoning"),
        step_count(tag_cut(c, "<think>", "</think>")).cast("bigint").alias("steps"))


# ---- JSON tables -----------------------------------------------------------------------------

@register("json_table_cells", with_fv("fv_completions") + f"""
, t0 as (select run, dataset, idx, {d_block()} as block from fv_completions),
t1 as (select run, dataset, idx, {d_parse('block')} as tab from t0),
r as (select run, dataset, idx, unnest(range(0, len(tab.rows))) as r, tab from t1 where tab.rows is not null)
select run, dataset, idx, cast(r as int) as r, cast(c - 1 as int) as c, tab.rows[r + 1][c] as cell
from (select *, unnest(range(1, len(tab.rows[r + 1]) + 1)) as c from r)""")
def json_table_cells(spark, sf_dir):
    """JSN-01/02/03: predicted tables parsed with number lexemes kept, exploded to cells."""
    return T.table_cells(fv_completions(spark, sf_dir), J.table_block("completion"), ["run", "dataset", "idx"])


@register("json_parse_failures", with_fv("fv_completions") + f"""
, t0 as (select run, dataset, {d_block()} as block from fv_completions)
select run, dataset, count(*) as n, count(*) filter (where not json_valid(block)) as failures,
 {S.r4('count(*) filter (where not json_valid(block)) / count(*)')} as failure_rate from t0 group by run, dataset""")
def json_parse_failures(spark, sf_dir):
    """MET-10: predicted tables that do not parse, per run and dataset."""
    return T.parse_failures(fv_completions(spark, sf_dir), J.table_block("completion"), ["run", "dataset"])


def _pred_table_text(c):
    return f"{S.strip(S.before_first(S.after_last(c, '<table>'), '</table>'))}"


@register("type_accuracy", with_fv("fv_completions") + f"""
select run, dataset, count(*) as n,
 {S.r4(f"avg(cast(lower({S.strip(S.before_first(S.after_last('completion', '<type>'), '</type>'))}) = lower(chart_type) as int))")} as type_acc
from fv_completions group by run, dataset""")
def type_accuracy(spark, sf_dir):
    """MET-06: chart-type accuracy per run and dataset."""
    return T.type_accuracy(fv_completions(spark, sf_dir))


def _d_table_err():
    gt = "json_valid(gold_table)"
    pt = f"replace({_pred_table_text('completion')}, '''', '\"')"
    return f"""e0 as (select run, dataset, idx, gold_table, {pt} as pt from fv_completions),
e1 as (select *, json_valid(gold_table) as gok, json_valid(pt) as pok,
   case when json_valid(gold_table) then from_json({d_quote('gold_table')}, {TABLE_TYPE}) end as g,
   case when json_valid(pt) then from_json({d_quote('pt')}, {TABLE_TYPE}) end as p from e0),
e2 as (select *, list_transform(range(1, least(len(g.rows), len(p.rows)) + 1), lambda i: {{
     'k': len(g.rows[i]), 'm': len(p.rows[i]),
     'bad': len(list_filter(range(1, least(len(g.rows[i]), len(p.rows[i])) + 1),
             lambda j: lower({S.strip('g.rows[i][j]')}) <> lower({S.strip('p.rows[i][j]')}) or g.rows[i][j] is null or p.rows[i][j] is null))}}) as pairs
   from e1),
e3 as (select *, coalesce(list_position(list_transform(pairs, lambda x: x.m < x.k), true), 0) as f from e2),
e4 as (select *, case when not gok then 0.0 when not pok then 1.0
   when g.rows is null or p.rows is null then 1.0
   else least(
     (coalesce(list_sum(list_transform(case when f = 0 then pairs else pairs[1:f] end, lambda x: x.bad)), 0) + case when f > 0 then 1 else 0 end)
     / (coalesce(list_sum(list_transform(case when f = 0 then pairs else pairs[1:f] end, lambda x: least(x.k, x.m))), 0) + case when f > 0 then 1 else 0 end + 1e-6),
     1.0) end as err from e3)
"""


@register("table_error", with_fv("fv_completions") + ", " + _d_table_err() + f"""
select run, dataset, count(*) as n, {S.r4('avg(err)')} as table_err from e4 group by run, dataset""")
def table_error(spark, sf_dir):
    """MET-07: mean cell error rate of predicted tables against the gold table."""
    return T.table_error(fv_completions(spark, sf_dir))


@register("table_error_compat", with_fv("fv_completions") + ", " + _d_table_err().replace(
    "when g.rows is null or p.rows is null then 1.0", "when g.rows is null or p.rows is null then 1.0 / 1e-6").replace(
    "     1.0) end as err from e3)", "     1e300) end as err from e3)") + f"""
select run, dataset, count(*) as n, {S.r4('avg(err)')} as table_err from e4 group by run, dataset""")
def table_error_compat(spark, sf_dir):
    """MET-07 in compat mode: no cap, so a table without rows scores 1e6 (quirk Q11)."""
    return T.table_error(fv_completions(spark, sf_dir), compat=True)
