"""Evaluation queries over FV-eval (MET-01..05, MET-09, TXT-09/10)."""

from __future__ import annotations

from chartq.operators import metrics as M
from chartq.plans import sqlmacros as S
from chartq.plans.fixture_sql import with_fv
from chartq.plans.registry import register
from chartq.sources.fixtures import fv_eval

_FLAGS = f"""flags as (select run, dataset, idx, target, prediction, tag, {S.exact()} as em, {S.relaxed()} as ra from fv_eval)
"""


def _scorecard_sql(tol=0.05, unanswerable=False):
    return with_fv("fv_eval") + f""", flags as (select run, dataset, {S.exact()} as em,
  {S.relaxed(tol=tol, unanswerable=unanswerable)} as ra from fv_eval)
select run, dataset, count(*) as n, cast(sum(em) as bigint) as em, cast(sum(ra) as bigint) as ra,
 {S.r4('sum(em) / count(*)')} as em_rate, {S.r4('sum(ra) / count(*)')} as ra_rate
from flags group by run, dataset"""


@register("eval_scorecard", _scorecard_sql())
def eval_scorecard(spark, sf_dir):
    """Flagship: exact match and relaxed accuracy per (run, dataset)."""
    return M.scorecard(fv_eval(spark, sf_dir))


@register("eval_compat_tol1", _scorecard_sql(tol=1.0))
def eval_compat_tol1(spark, sf_dir):
    """The scorecard with tolerance 1.0, as the reference binds for one corpus (quirk Q1)."""
    return M.scorecard(fv_eval(spark, sf_dir), tol=1.0)


@register("eval_unanswerable", _scorecard_sql(unanswerable=True))
def eval_unanswerable(spark, sf_dir):
    """The scorecard with 'unanswerable' targets counted as correct (FLT-07)."""
    return M.scorecard(fv_eval(spark, sf_dir), unanswerable=True)


@register("eval_flags", with_fv("fv_eval") + ", " + _FLAGS + "select run, dataset, idx, em, ra from flags")
def eval_flags(spark, sf_dir):
    """MET-01 / MET-02 per row: exact-match and relaxed-accuracy flags."""
    return M.with_flags(fv_eval(spark, sf_dir)).select("run", "dataset", "idx", "em", "ra")


@register("eval_breakdown", with_fv("fv_eval") + ", " + _FLAGS + f""",
b as (select run, dataset, count(*) filter (where tag = 1) as aug_total, cast(coalesce(sum(ra) filter (where tag = 1), 0) as bigint) as aug_correct,
  count(*) filter (where tag = 0) as human_total, cast(coalesce(sum(ra) filter (where tag = 0), 0) as bigint) as human_correct from flags group by run, dataset)
select run, dataset, aug_total, aug_correct, human_total, human_correct,
 {S.r4('case when aug_total > 0 then aug_correct / aug_total end')} as aug_acc,
 {S.r4('case when human_total > 0 then human_correct / human_total end')} as human_acc,
 {S.r4('case when aug_total > 0 and human_total > 0 then 0.5 * (aug_correct / aug_total + human_correct / human_total) end')} as avg_acc
from b""")
def eval_breakdown(spark, sf_dir):
    """MET-04: relaxed accuracy of augmented vs human rows and their mean."""
    return M.breakdown(fv_eval(spark, sf_dir))


RUNNING_SQL = with_fv("fv_eval") + ", " + _FLAGS + f""",
p as (select *, row_number() over (partition by run, dataset order by idx) - 1 as pos from flags),
b as (select run, dataset, cast(floor(pos / 32) as bigint) as batch, count(*) as bn, sum(em) as bem, sum(ra) as bra from p group by all),
c as (select run, dataset, batch, sum(bn) over w as n, sum(bem) over w as em, sum(bra) over w as ra from b
  window w as (partition by run, dataset order by batch rows between unbounded preceding and current row))
select run, dataset, batch, cast(n as bigint) as n, cast(em as bigint) as em, cast(ra as bigint) as ra,
 {S.r4('em / n')} as em_rate, {S.r4('ra / n')} as ra_rate from c"""


@register("eval_running", RUNNING_SQL)
def eval_running(spark, sf_dir):
    """MET-05 / WIN-02: running EM and relaxed accuracy after each batch of 32 rows."""
    return M.running(fv_eval(spark, sf_dir))


@register("eval_mistakes_paged", with_fv("fv_eval") + ", " + _FLAGS + """
select run, dataset, idx, target, prediction,
 cast(floor((row_number() over (partition by run, dataset order by idx) - 1) / 9) as bigint) as page
from flags where ra = 0""")
def eval_mistakes_paged(spark, sf_dir):
    """MET-09 / SMP-07: wrong rows numbered per run and cut into review pages of 9."""
    return M.mistakes_paged(fv_eval(spark, sf_dir))
