"""Manifest, preference, prompt, curation, uplift and masking queries with DuckDB oracles
(IMG-*, PRF-*, PMT-*, SMP-*, SET-*, PRJ-*, FLT-*, JN-01/06, MET-08, JSN-07)."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartq.functions.numeric import round4
from chartq.operators import curate as C
from chartq.operators import manifest as MF
from chartq.operators import prefs as P
from chartq.operators import prompts as PM
from chartq.operators.ranking import rank_in_group
from chartq.plans import sqlmacros as S
from chartq.plans.fixture_sql import with_fv
from chartq.plans.q_qa import qa_all_prefs
from chartq.plans.registry import ORACLE as _ORACLE
from chartq.plans.registry import register
from chartq.sources import fixtures as FX

SEED = 2026


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ---- image manifest -------------------------------------------------------------------------

def _resize_sql(lo, hi):
    p = "(width * height)"
    scale = f"pow(greatest(least({p}, {hi}), {lo}) / {p}, 0.5)"
    return (f"select image_id, width, height, cast(case when {p} between {lo} and {hi} then width else floor(width * {scale}) end as bigint) as new_width,"
            f" cast(case when {p} between {lo} and {hi} then height else floor(height * {scale}) end as bigint) as new_height from fv_manifest")


@register("resize_plan", with_fv("fv_manifest") + _resize_sql(MF.EVAL_PIXELS, MF.EVAL_PIXELS))
def resize_plan(spark, sf_dir):
    """IMG-01 with the evaluation budget (480·28² pixels)."""
    return MF.resize_plan(FX.fv_manifest(spark, sf_dir)).select("image_id", "width", "height", "new_width", "new_height")


@register("resize_plan_rationale", with_fv("fv_manifest") + _resize_sql(MF.RATIONALE_MIN_PIXELS, MF.RATIONALE_MAX_PIXELS))
def resize_plan_rationale(spark, sf_dir):
    """IMG-01 with the rationale-generation budget (320·28² to 640·28² pixels)."""
    return MF.resize_plan(FX.fv_manifest(spark, sf_dir), MF.RATIONALE_MIN_PIXELS, MF.RATIONALE_MAX_PIXELS).select(
        "image_id", "width", "height", "new_width", "new_height")


_GRID = MF.grid_candidates(1, 6)
_GRID_SQL = with_fv("fv_manifest") + f""",
g as (select * from (values {', '.join(f'({k}, {i}, {j})' for k, (i, j) in enumerate(_GRID))}) t(k, i, j)),
d as (select image_id, width, height, k, i, j, abs(width / height - i / j) as diff,
   width * height > 0.5 * 448 * 448 * i * j as big from fv_manifest, g),
m as (select image_id, min(diff) as dmin from d group by image_id),
f as (select d.image_id, min(k) as k0 from d join m on d.image_id = m.image_id and d.diff = m.dmin group by d.image_id),
b as (select d.image_id, max(k) as kb from d join m on d.image_id = m.image_id and d.diff = m.dmin join f on f.image_id = d.image_id
   where d.k = f.k0 or d.big group by d.image_id),
t as (select fv_manifest.image_id, width, height, g.i as cols, g.j as rows from fv_manifest join b using (image_id) join g on g.k = b.kb)
"""


@register("tile_grid", _GRID_SQL + """select image_id, width, height, cols, rows, cols * 448 as target_width, rows * 448 as target_height,
 cols * rows as blocks from t""")
def tile_grid(spark, sf_dir):
    """IMG-02: closest tile grid (up to 6 tiles of 448 px)."""
    return MF.tile_grid(FX.fv_manifest(spark, sf_dir)).select(
        "image_id", "width", "height", "cols", "rows", "target_width", "target_height", "blocks")


@register("tile_boxes", _GRID_SQL + """, tb as (select image_id, cols, cols * rows as blocks from t)
select image_id, cast(tile as int) as tile, false as thumbnail, cast((tile % cols) * 448 as int) as "left", cast(floor(tile / cols) * 448 as int) as top,
 cast((tile % cols + 1) * 448 as int) as "right", cast((floor(tile / cols) + 1) * 448 as int) as bottom
from (select *, unnest(range(0, blocks)) as tile from tb)
union all
select image_id, cast(blocks as int) as tile, true, 0, 0, 448, 448 from tb where blocks <> 1""")
def tile_boxes(spark, sf_dir):
    """IMG-03: crop boxes per tile plus a thumbnail for multi-tile images."""
    b = MF.tile_boxes(MF.tile_grid(FX.fv_manifest(spark, sf_dir)))
    return b.select("image_id", F.col("tile").cast("int").alias("tile"), "thumbnail", F.col("left").cast("int").alias("left"),
                    F.col("top").cast("int").alias("top"), F.col("right").cast("int").alias("right"),
                    F.col("bottom").cast("int").alias("bottom"))


# ---- preference pairs -----------------------------------------------------------------------

_HN_SQL = with_fv("fv_pref") + r""",
x as (select *, list_filter(string_split_regex(predicted, '\s+'), lambda t: t <> '') as toks from fv_pref),
e as (select conv_id, turn, question, label, toks, unnest(range(1, len(toks) + 1)) as k from x),
hn as (select conv_id, turn, question, label, predicted, 'model' as source, -1 as tok_pos from fv_pref
 union all
 select conv_id, turn, question, label, regexp_replace(regexp_replace(toks[k], '[^\p{L}\p{N}\s]', '', 'g'), '^\s+|\s+$', '', 'g'),
   'ocr', cast(k - 1 as int) from e where lower(toks[k]) <> lower(label))
"""


@register("hard_negatives", _HN_SQL + "select * from hn")
def hard_negatives(spark, sf_dir):
    """PRF-01/02 (TXT-11/12, FLT-03): base pairs plus cleaned OCR-token negatives."""
    return P.hard_negatives(FX.fv_pref(spark, sf_dir))


def _tmpl_sql(t, col):
    return f"replace({lit(t)}, '{{text}}', {col})"


@register("pref_records", _HN_SQL + f"""select conv_id, turn, source, tok_pos, {_tmpl_sql(P.CHAT_TEMPLATE['user'], 'question')} as prompt,
 {_tmpl_sql(P.CHAT_TEMPLATE['assistant'], 'label')} as chosen, {_tmpl_sql(P.CHAT_TEMPLATE['assistant'], 'predicted')} as rejected from hn""")
def pref_records(spark, sf_dir):
    """PRF-03: prompt / chosen / rejected strings in a chat template."""
    return P.pref_records(P.hard_negatives(FX.fv_pref(spark, sf_dir)))


def _qa_pairs(spark, sf_dir):
    qa = qa_all_prefs(spark, sf_dir)
    return qa.select(F.concat_ws(":", F.lit("qa"), "chart_id", "qid").alias("pair_id"), "question", "label",
                     F.col("not_answer").alias("predicted"))


@register("pref_mix")
def pref_mix(spark, sf_dir):
    """PRF-05: OCR hard negatives + the QA pairs of every chart type, seeded shuffle, first 512 = eval, rest = train."""
    hn = P.hard_negatives(FX.fv_pref(spark, sf_dir)).select(
        F.concat_ws(":", F.lit("hn"), "conv_id", "turn", "tok_pos").alias("pair_id"), "question", "label", "predicted")
    return P.pref_mix(hn, _qa_pairs(spark, sf_dir), SEED, 512, ["pair_id"])


# ---- prompts --------------------------------------------------------------------------------

def _render_sql(name):
    t = PM.TEMPLATES[name]
    st = PM.STYLES[t.style]
    fill = lambda s: lit(s.replace("{sep}", t.sep).replace("{sep2}", t.sep2))
    text = "replace(replace(text, chr(13) || chr(10), chr(10)), chr(10) || chr(10), chr(10))" if st.squeeze_newlines else "text"
    sp = f"replace({lit(t.system_template)}, '{{system_message}}', system_message)"
    head = {"sep": f"{sp} || {lit(t.sep)}", "plain": sp,
            "sep_if": f"case when length({sp}) = 0 then '' else {sp} || {lit(t.sep)} end",
            "chatml": f"case when length({sp}) = 0 then '' else {sp} || {lit(t.sep + chr(10))} end",
            "sep_if_msg": f"case when length(system_message) > 0 then {sp} || {lit(t.sep)} else '' end",
            "plain_if_msg": f"case when length(system_message) > 0 then {sp} else '' end",
            "sep2": f"system_message || {lit(t.sep2)}",
            "llama2": f"case when length(system_message) > 0 then {sp} else '[INST] ' end"}[st.head]
    role = (f"(case when i % 2 = 0 then {lit(t.roles[0])} else {lit(t.roles[1])} end)" if st.first_plain
            else f"(case when role = 'user' then {lit(t.roles[0])} else {lit(t.roles[1])} end)")
    full = f"{role} || {lit(st.mid)} || {text} || (case when i % 2 = 0 then {fill(st.tail_even)} else {fill(st.tail_odd)} end)"
    if st.first_plain:
        full = f"(case when i = 0 then {text} || ' ' else {full} end)"
    piece = f"(case when coalesce(length(text), 0) > 0 then {full} else {role} || {lit(st.empty)} end)"
    if st.rounds:
        piece = (f"(case when i % 2 = 0 then '[Round ' || cast(i // 2 + {t.round_base} as varchar) || ']' || {lit(t.sep)}"
                 f" else '' end) || {piece}")
    return with_fv("fv_turns") + f""",
m as (select conv_id, turn, role, text, row_number() over (partition by conv_id order by turn) - 1 as i from fv_turns where role <> 'system'),
p as (select conv_id, string_agg({piece}, '' order by i) as body from m group by conv_id),
s as (select conv_id, coalesce(arg_max(text, turn) filter (where role = 'system'), {lit(t.system_message)}) as system_message
  from fv_turns group by conv_id)
select conv_id, {head} || coalesce(body, '') as prompt from s left join p using (conv_id)"""


for _name, _key in [("internvl2_5", "render_prompt_internvl2_5"), ("phi3-chat", "render_prompt_phi3"),
                    ("internvl_zh", "render_prompt_internvl_zh"), ("chatml", "render_prompt_chatml"),
                    ("colon_two", "render_prompt_colon_two"), ("dolly", "render_prompt_dolly"),
                    ("llama2", "render_prompt_llama2"), ("chatglm2", "render_prompt_chatglm2")]:
    register(_key, _render_sql(_name), doc=f"PMT-01: every conversation rendered to one prompt with the {_name} template "
                                           f"({PM.TEMPLATES[_name].style} separator style).")(
        lambda spark, sf_dir, _n=_name: PM.render(FX.fv_turns(spark, sf_dir), _n))

_MSG = with_fv("fv_turns") + """,
m as (select conv_id, turn, role, text, row_number() over (partition by conv_id order by turn) - 1 as i from fv_turns where role <> 'system')
"""


@register("turn_pairs", _MSG + """select a.conv_id, cast(a.i // 2 as int) as pair, a.text as first, b.text as second
from m a left join m b on a.conv_id = b.conv_id and b.i = a.i + 1 where a.i % 2 = 0""")
def turn_pairs(spark, sf_dir):
    """PMT-03: user / reply pairs."""
    return PM.turn_pairs(FX.fv_turns(spark, sf_dir))


@register("message_list", _MSG + """select conv_id, 0 as pos, 'system' as role,
  coalesce(arg_max(text, turn) filter (where role = 'system'), '') as content from fv_turns group by conv_id
union all
select conv_id, cast(i + 1 as int), case when i % 2 = 0 then 'user' else 'assistant' end, text from m where i % 2 = 0 or text is not null""")
def message_list(spark, sf_dir):
    """PMT-04 / PRJ-09: system + user / assistant messages in long form."""
    return PM.message_list(FX.fv_turns(spark, sf_dir))


@register("message_list_offset", _MSG + """select conv_id, 0 as pos, 'system' as role,
  coalesce(arg_max(text, turn) filter (where role = 'system'), '') as content from fv_turns group by conv_id
union all
select conv_id, cast(i - 2 as int), case when i % 2 = 1 then 'user' else 'assistant' end, text from m
where i >= 3 and (i % 2 = 1 or text is not null)""")
def message_list_offset(spark, sf_dir):
    """PMT-04: the message list after an offset of three messages."""
    return PM.message_list(FX.fv_turns(spark, sf_dir), offset=3)


@register("set_system_message", with_fv("fv_turns") + """select conv_id, turn, role, text from fv_turns where role is distinct from 'system'
union all select conv_id, coalesce(min(turn) filter (where role = 'system'), min(turn) - 1), 'system', 'Answer briefly.'
from fv_turns group by conv_id""")
def set_system_message(spark, sf_dir):
    """PMT-06: one system message set in every conversation."""
    return PM.set_system_message(FX.fv_turns(spark, sf_dir), "Answer briefly.")


@register("append_turn", with_fv("fv_turns") + """select conv_id, turn, role, text from fv_turns
union all select conv_id, max(turn) + 1, 'assistant', cast(null as varchar) from fv_turns group by conv_id""")
def append_turn(spark, sf_dir):
    """PMT-06: an empty assistant slot after every conversation's last turn."""
    return PM.append_turn(FX.fv_turns(spark, sf_dir))


@register("replace_last_turn", with_fv("fv_turns") + """select conv_id, turn, role,
 case when turn = max(turn) over (partition by conv_id) then '[revised] ' || text else text end as text from fv_turns""")
def replace_last_turn(spark, sf_dir):
    """PMT-06: replace the last turn's text (here by a marked revision of it)."""
    t = FX.fv_turns(spark, sf_dir)
    return PM.replace_last(t, F.concat(F.lit("[revised] "), F.col("text")))


# ---- curation -------------------------------------------------------------------------------

def _h(key):
    return f"md5(concat_ws(':', '{SEED}', cast({key} as varchar)))"


@register("corpus_mix", with_fv("fv_qa") + """, a as (select dataset, split, qid, image_path, query, label, source_tag from fv_qa where source_tag = 0),
b as (select dataset, split, qid, image_path, query, chart_type as answer from fv_qa where label is null)
select dataset, split, qid, image_path, query, coalesce(label, answer) as label, source_tag from
 (select dataset, split, qid, image_path, query, label, source_tag, null as answer from a
  union all select dataset, split, qid, image_path, query, null, null, answer from b)""")
def corpus_mix(spark, sf_dir):
    """FLT-01 + SET-01/03 + PRJ-05/07: human-only labelled rows unioned with unlabelled rows
    whose answer column differs; label coalesced with answer."""
    qa = FX.fv_qa(spark, sf_dir)
    a = qa.where(F.col("source_tag") == 0).drop("chart_type")
    b = qa.where(F.col("label").isNull()).select("dataset", "split", "qid", "image_path", "query", F.col("chart_type").alias("answer"))
    return C.coalesce_label(C.union_corpora([a, b]))


@register("corpus_normalise", with_fv("fv_qa") + r"""select dataset, qid, image_path, query || '. Answer yes/no.' as query,
 regexp_replace(label, '^\.+|\.+$', '', 'g') as label, lower(regexp_replace(chart_type, '^\s+|\s+$', '', 'g')) as chart_type from fv_qa""")
def corpus_normalise(spark, sf_dir):
    """PRJ-01..06, PRJ-10: field map to the canonical schema, a yes/no suffix on the query,
    dots stripped from both ends of the label, a lower-cased vocabulary column."""
    from chartq.functions.text import py_strip
    qa = C.rename_strict(FX.fv_qa(spark, sf_dir), {"chart_type": "ctype"})
    return qa.select("dataset", "qid", "image_path", F.concat("query", F.lit(". Answer yes/no.")).alias("query"),
                     F.regexp_replace("label", r"\A\.+|\.+\z", "").alias("label"),
                     F.lower(py_strip("ctype")).alias("chart_type"))


@register("sample_per_corpus", with_fv("fv_qa") + f"""select dataset, qid, rn from
 (select dataset, qid, row_number() over (partition by dataset order by {_h('qid')}, qid) as rn from fv_qa) where rn <= 20""")
def sample_per_corpus(spark, sf_dir):
    """SMP-01/02: 20 rows per corpus in seeded order."""
    return C.sample_per_group(FX.fv_qa(spark, sf_dir), "dataset", 20, SEED, "qid").select("dataset", "qid", F.col("rn").cast("bigint").alias("rn"))


def _split_sql(bounds):
    return with_fv("fv_qa") + f""", r as (select dataset, qid, row_number() over (partition by dataset order by {_h('qid')}, qid) - 1 as pos,
  count(*) over (partition by dataset) as n from fv_qa)
select dataset, qid, case {bounds} else 'test' end as split from r"""


@register("split_80_10_10", _split_sql("when pos < floor(n * 0.8) then 'train' when pos < floor(n * 0.9) then 'validation'"))
def split_80_10_10(spark, sf_dir):
    """SMP-03: seeded 80 / 10 / 10 split per corpus."""
    return C.split_80_10_10(FX.fv_qa(spark, sf_dir).select("dataset", "qid"), "dataset", SEED, "qid")


@register("split_ratio", _split_sql("when pos < n - floor(n * 0.1) - floor(n * 0.2) then 'train' "
                                    "when pos < n - floor(n * 0.2) then 'validation'"))
def split_ratio(spark, sf_dir):
    """SMP-04: n_val = int(.1n), n_test = int(.2n), train first."""
    return C.split_ratio(FX.fv_qa(spark, sf_dir).select("dataset", "qid"), "dataset", SEED, "qid")


@register("icl_topk", with_fv("fv_qa") + f"select dataset, qid, query, label from fv_qa order by {_h('qid')}, qid limit 5")
def icl_topk(spark, sf_dir):
    """SMP-05: five in-context examples in seeded order."""
    return C.top_k_seeded(FX.fv_qa(spark, sf_dir).select("dataset", "qid", "query", "label"), 5, SEED, "qid")


@register("first_n", with_fv("fv_eval") + "select run, dataset, idx, target, prediction from fv_eval order by idx limit 512")
def first_n(spark, sf_dir):
    """SMP-06: the first 512 evaluation rows."""
    return C.first_n(FX.fv_eval(spark, sf_dir).select("run", "dataset", "idx", "target", "prediction"), 512, "idx")


# ---- rationale uplift (MET-08, JN-06, FLT-02) -----------------------------------------------

@register("rationale_uplift", with_fv("fv_prob") + f""",
base as (select dataset, idx, p as p0, row_number() over (partition by dataset order by idx) - 1 as pos from fv_prob where run = 'none')
select r.dataset, r.run, count(*) as n, {S.r4('avg(r.p - b.p0)')} as mean_delta
from fv_prob r join base b on r.dataset = b.dataset and r.idx = b.idx where r.run <> 'none' and b.pos >= 1250 group by r.dataset, r.run""")
def rationale_uplift(spark, sf_dir):
    """Mean probability gain of each rationale run over the no-rationale run, skipping the
    first 1250 positions of every dataset."""
    pr = FX.fv_prob(spark, sf_dir)
    base = rank_in_group(pr.where(F.col("run") == "none").select("dataset", "idx", F.col("p").alias("p0")),
                         ["dataset"], ["idx"], out="pos").where(F.col("pos") >= 1250)
    d = pr.where(F.col("run") != "none").join(base, ["dataset", "idx"])
    return d.groupBy("dataset", "run").agg(F.count(F.lit(1)).alias("n"), round4(F.avg(F.col("p") - F.col("p0"))).alias("mean_delta"))


# ---- label masking (JSN-07) -----------------------------------------------------------------

@register("mask_labels", with_fv("fv_tok") + """select conv_id, turn,
 list_transform(ids, lambda x: case when x in (1, 2, 3) or x = 0 then -100 else x end) as masked from fv_tok""")
def mask_labels(spark, sf_dir):
    """Token ids in a mask set, or the pad id, become -100 (ids of the loss labels)."""
    t = FX.fv_tok(spark, sf_dir)
    mask = F.array(F.lit(1), F.lit(2), F.lit(3))
    return t.select("conv_id", "turn", F.transform("ids", lambda x: F.when(F.array_contains(mask, x) | (x == 0), F.lit(-100))
                                                  .otherwise(x)).alias("masked"))



_ORACLE["pref_mix"] = _HN_SQL + f""",
u as (select concat_ws(':', 'hn', conv_id, turn, tok_pos) as pair_id, question, label, predicted from hn
  union all
  select concat_ws(':', 'qa', chart_id, qid), question, label, not_answer from ({_ORACLE['qa_all_prefs']}) b),
r as (select *, row_number() over (order by md5(concat_ws(':', '{SEED}', pair_id)), pair_id) - 1 as pos from u)
select pair_id, question, label, predicted, case when pos < 512 then 'eval' else 'train' end as split from r"""


@register("resize_fixed_width", with_fv("fv_manifest") + """select image_id, width, height, cast(200 as bigint) as new_width,
 cast(floor(height * (200.0 / width)) as bigint) as new_height from fv_manifest""")
def resize_fixed_width(spark, sf_dir):
    """IMG-01 variant: width 200, proportional height (OCR input)."""
    return MF.fixed_width_plan(FX.fv_manifest(spark, sf_dir)).select("image_id", "width", "height", "new_width", "new_height")


@register("resize_half", with_fv("fv_manifest") + """select image_id, width, height, cast(width // 2 as bigint) as new_width,
 cast(height // 2 as bigint) as new_height from fv_manifest""")
def resize_half(spark, sf_dir):
    """IMG-01 variant: half size (training collator)."""
    return MF.half_size_plan(FX.fv_manifest(spark, sf_dir)).select("image_id", "width", "height", "new_width", "new_height")


def _chat_replies_spark(spark, sf_dir):
    from chartq.functions.text import tag_cut
    c = FX.fv_completions(spark, sf_dir)
    think, ans = tag_cut("completion", "<think>", "</think>"), tag_cut("completion", "<answer>", "</answer>")
    llava = F.concat(F.lit("[INST] <image>\nQuestion [/INST] Reason: "), think, F.lit("\nAnswer: "), ans)
    intern = F.concat(F.lit("### Reason:\n"), think, F.lit("\n### Answer: "), ans)
    return c.select("run", "dataset", "idx", llava.alias("llava"), intern.alias("internvl"))


_T = S.tag_cut
_LLAVA_OUT = S.strip(S.after_last("llava", "[/INST]"))


@register("extract_reason_answer", with_fv("fv_completions") + f""",
c as (select run, dataset, idx, '[INST] <image>' || chr(10) || 'Question [/INST] Reason: ' || {_T('completion', '<think>', '</think>')}
   || chr(10) || 'Answer: ' || {_T('completion', '<answer>', '</answer>')} as llava,
   '### Reason:' || chr(10) || {_T('completion', '<think>', '</think>')} || chr(10) || '### Answer: '
   || {_T('completion', '<answer>', '</answer>')} as internvl from fv_completions)
select run, dataset, idx, {S.strip(S.after_last(_LLAVA_OUT, 'Answer:'))} as llava_answer,
 regexp_replace({S.before_first(S.after_last(_LLAVA_OUT, 'Reason:'), 'Answer:')}, '^\\n+|\\n+$', '', 'g') as llava_reason,
 {S.strip(S.after_last('internvl', '### Answer:'))} as internvl_answer,
 regexp_replace({S.before_first(S.after_last('internvl', '### Reason:'), '### Answer')}, '^\\n+|\\n+$', '', 'g') as internvl_reason from c""")
def extract_reason_answer(spark, sf_dir):
    """TXT-02 / TXT-03: answer and reason cuts of the two chat-model reply styles."""
    from chartq.functions.text import reason_answer_cut
    r = _chat_replies_spark(spark, sf_dir)
    la, lr = reason_answer_cut("llava", "llava")
    ia, ir = reason_answer_cut("internvl", "internvl")
    return r.select("run", "dataset", "idx", la.alias("llava_answer"), lr.alias("llava_reason"),
                    ia.alias("internvl_answer"), ir.alias("internvl_reason"))


# The forms are written out here, apart from the operator's.
_COT_ASK = ("'Look at the chart. Think step-by-step based on the question and chart. ' || chr(10) || repeat(' ', 17) || "
            "'Generate a reasoning chain first and output it as Reason. ' || chr(10) || repeat(' ', 17) || "
            "'In the next line, answer the question with a single word only without units or symbols.' || chr(10) || repeat(' ', 17) || "
            "'Format:  ' || repeat(' ', 16) || '### Question: ' || question || repeat(' ', 17) || '### Reason: ' || repeat(' ', 16) || "
            "'step-1 ... ' || repeat(' ', 16) || 'step-2 ... ' || repeat(' ', 16) || '....' || repeat(' ', 16) || 'step-n ... ' || "
            "repeat(' ', 16) || '### Answer: ' || chr(10)")


def _cot_reply(steps, answer):
    return (f"'### Reason: ' || repeat(' ', 27) || 'step-1: ' || {steps}[1] || '.' || chr(10) || 'step-2: ' || {steps}[2] || '.' || chr(10) || "
            f"repeat(' ', 28) || '###Answer: ' || coalesce({answer}, 'None')")


@register("qa_cot_prefs", f"""select chart_id, qid, chart_type, {_COT_ASK} as prompt, {_cot_reply('answer_rationale', 'label')} as chosen,
 {_cot_reply('not_answer_rationale', 'not_answer')} as rejected from ({_ORACLE['qa_all_prefs']})""")
def qa_cot_prefs(spark, sf_dir):
    """PRF-04: the QA pairs of every chart type in the reason-then-answer form."""
    return P.cot_pairs(qa_all_prefs(spark, sf_dir), keys=("chart_id", "qid", "chart_type"))


_TPL_VALUES = ", ".join(f"({i}, {lit(t.name)}, {lit(t.system_template.replace('{system_message}', t.system_message))})"
                        for i, t in enumerate(PM.TEMPLATES.values()))


@register("training_prompt_first", with_fv("fv_turns") + f""", tp as (select * from (values {_TPL_VALUES}) t(template_id, template, system_prompt)),
fu as (select conv_id, arg_min(text, turn) as query from fv_turns where role = 'user' group by conv_id)
select conv_id, template, concat_ws(chr(10), system_prompt, query) as prompt
from fu join tp on tp.template_id = cast(conv_id % {len(PM.TEMPLATES)} as int)""")
def training_prompt_first(spark, sf_dir):
    """PMT-05 / JN-04: system prompt looked up by template id, then the first question of a conversation (`training_prompt` has
    every question)."""
    first = PM.first_user_turns(FX.fv_turns(spark, sf_dir))
    return PM.training_prompt(first, PM.template_table(spark)).select("conv_id", "template", "prompt")


_TPL_N = len(PM.TEMPLATES)
_PROMPT_SQL = with_fv("fv_turns") + f""", tp as (select * from (values {_TPL_VALUES}) t(template_id, template, system_prompt))
select conv_id, turn, template, concat_ws(chr(10), system_prompt, text) as prompt from fv_turns
join tp on tp.template_id = coalesce(((conv_id % {_TPL_N}) + {_TPL_N}) % {_TPL_N}, 0) where role = 'user'"""


@register("training_prompt", _PROMPT_SQL)
def training_prompt(spark, sf_dir):
    """PMT-05 / JN-04: one training prompt per user turn, the system prompt looked up by template id."""
    return PM.training_prompt(FX.fv_turns(spark, sf_dir), PM.template_table(spark))


@register("training_prompt_turns", _PROMPT_SQL)
def training_prompt_turns(spark, sf_dir):
    """The same as `training_prompt`, under its earlier name."""
    return training_prompt(spark, sf_dir)


@register("training_prompt_blocks", with_fv("fv_turns") + """, p as (select item_id, min(text) as system_prompt from benchmark where item_id is not null group by item_id)
select conv_id, turn, concat_ws(chr(10), coalesce(system_prompt, 'Look at the chart.'), text) as prompt from fv_turns
left join p on item_id = conv_id % 60 where role = 'user'""")
def training_prompt_blocks(spark, sf_dir):
    """PMT-05 / JN-04: the system prompt of a block id from a supplied table (here the benchmark texts by item id), with a default
    for blocks that it lacks."""
    turns = FX.fv_turns(spark, sf_dir).where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("query"), (F.col("conv_id") % 60).alias("block_id"))
    prompts = FX.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("block_id"), F.col("text").alias("system_prompt"))
    return PM.block_prompts(turns, prompts, default="Look at the chart.").select("conv_id", "turn", "prompt")


@register("ocr_batches", _HN_SQL + """select batch, count(*) as n from
 (select cast(floor((row_number() over (order by conv_id, turn, tok_pos) - 1) / 512) as bigint) as batch from hn) group by batch""")
def ocr_batches(spark, sf_dir):
    """WIN-07: preference rows cut into micro-batches of 512 in a global order (the numbering
    is the skew-safe ranking without a group; every row is kept, the last batch included)."""
    hn = P.hard_negatives(FX.fv_pref(spark, sf_dir)).select("conv_id", "turn", "tok_pos")
    r = rank_in_group(hn, [], ["conv_id", "turn", "tok_pos"], out="pos")
    return r.groupBy(F.floor(F.col("pos") / 512).cast("bigint").alias("batch")).agg(F.count(F.lit(1)).alias("n"))
