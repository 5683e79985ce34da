"""Source queries (SRC-11/12/13, JN-01/05, TXT-07, JSN-01, MET-06 through logs).

Files are written by Spark from the driver tables into a fresh folder under the
cluster's shared checkpoint folder and read back with the corpus readers, so the
readers' whole path (layout, separators, positions) is exercised on data that grows
with the tables.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from chartq.functions import jsontab as J
from chartq.functions.text import after_last, before_first, first_word, py_strip
from chartq.operators import curate as C
from chartq.operators import tables as T
from chartq.plans import sqlmacros as S
from chartq.plans.fixture_sql import with_cells, with_fv
from chartq.plans.q_eval import RUNNING_SQL
from chartq.plans.q_rewards import d_block
from chartq.plans.registry import register
from chartq.sources import fixtures as FX
from chartq.sources import readers as RD


def _logs(spark, sf_dir):
    comp = FX.fv_completions(spark, sf_dir)
    path = RD.stage_dir(spark, "logs")
    RD.write_logs(comp, path, ["run", "dataset"], "idx", "completion")
    return RD.read_logs(spark, path, ["run", "dataset"])


@register("log_segments", with_fv("fv_completions") + """select run, dataset,
 row_number() over (partition by run, dataset order by idx) - 1 as pos, completion from fv_completions""")
def log_segments(spark, sf_dir):
    """SRC-13: completions written as `#####`-separated run logs, read back and numbered."""
    seg = _logs(spark, sf_dir)
    return seg.select("run", "dataset", "pos", py_strip("piece").alias("completion"))


@register("log_type_accuracy", with_fv("fv_completions") + f"""select run, dataset, count(*) as n,
 {S.r4(f"avg(cast(lower({S.strip(S.before_first(S.after_last('completion', '<type>'), '</type>'))}) = lower(chart_type) as int))")} as type_acc
from fv_completions group by run, dataset""")
def log_type_accuracy(spark, sf_dir):
    """JN-01 / JN-05 + MET-06: log segments joined to their examples by position, then
    chart-type accuracy per run (the surrogate-evaluation flow)."""
    # the type is cut before the join, which moves it in place of the completion
    seg = _logs(spark, sf_dir).select("run", "dataset", "pos", T.type_cut(py_strip("piece")).alias("said"))
    ex = FX.fv_completions(spark, sf_dir).select("run", "dataset", "idx", "chart_type")
    joined = C.positional_join(ex, seg, ["run", "dataset"], "idx")
    return T.type_accuracy(joined, said=F.col("said"))


def _md_view(spark, sf_dir):
    bar = FX.fv_bar(spark, sf_dir).withColumn("chart_id", F.col("chart_id").cast("string"))
    line = F.concat(F.lit("| "), F.col("category"), F.lit(" | "), F.col("value").cast("decimal(20,2)").cast("string"), F.lit(" |"))
    body = bar.groupBy("chart_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", line.alias("l")))), lambda e: e["l"]), "\n")
        .alias("body"))
    return body.select("chart_id", F.concat(F.lit("Chart data\n\n| category | value |\n|:---|---:|\n"), F.col("body"),
                                            F.lit("\n\nSource: table")).alias("md"))


@register("markdown_cells", with_fv("fv_bar") + """select cast(chart_id as varchar) as chart_id, 0 as r, 0 as c, 'category' as cell from fv_bar group by chart_id
union all select cast(chart_id as varchar), 0, 1, 'value' from fv_bar group by chart_id
union all select cast(chart_id as varchar), row_idx + 1, 0, category from fv_bar
union all select cast(chart_id as varchar), row_idx + 1, 1, cast(cast(value as decimal(20,2)) as varchar) from fv_bar""")
def markdown_cells(spark, sf_dir):
    """SRC-12: bar charts rendered as Markdown tables inside text, parsed back to cells."""
    return RD.markdown_cells(_md_view(spark, sf_dir))


@register("csv_tables", with_cells() + "select chart_id, row_idx, col_idx, col_name, cell from fv_cells")
def csv_tables(spark, sf_dir):
    """SRC-11: every chart table written as CSV files (each with a header, in row order; a large chart
    over several range-partitioned files) and read back as cells."""
    path = RD.stage_dir(spark, "tables")
    for prefix, _, cols in FX.CELL_SOURCES:
        _write_rows(FX.fv_chart_rows(spark, sf_dir, prefix).where("chart_id is not null"), cols, path)
    return RD.read_table_dir(spark, path, key_col="chart_id")


def _write_tables(spark, cells, path):
    for prefix, _, cols in FX.CELL_SOURCES:
        _write_rows(cells.where(F.col("chart_id").startswith(prefix + ":"))
                    .groupBy("chart_id", "row_idx").pivot("col_name", list(cols)).agg(F.first("cell")), cols, path)


def _write_rows(wide, cols, path):
    n = int(wide.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (wide.repartitionByRange(n, "chart_id", "row_idx").sortWithinPartitions("chart_id", "row_idx").select("chart_id", *cols)
     .write.mode("append").partitionBy("chart_id").option("header", True).csv(path))


@register("csv_quoted_cells", """with d as (select coalesce(source, 'none') as chart_id, doc_id, lang, text,
 row_number() over (partition by coalesce(source, 'none') order by doc_id) - 1 as row_idx from documents)
select chart_id, row_idx, 0 as col_idx, 'doc, id' as col_name, cast(doc_id as varchar) as cell from d
union all select chart_id, row_idx, 1, 'lang', coalesce(lang, '') from d
union all select chart_id, row_idx, 2, 'the "text"', coalesce(text, '') from d""")
def csv_quoted_cells(spark, sf_dir):
    """SRC-11: documents as CSV tables by source, whose cells hold line breaks, quotes and commas, read back whole."""
    path = RD.stage_dir(spark, "quoted-tables")
    d = _docs(spark, sf_dir).select(F.coalesce("source", F.lit("none")).alias("chart_id"), F.col("doc_id").alias("doc, id"), "lang", F.col("text").alias('the "text"'))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (d.repartitionByRange(n, "chart_id", "doc, id").sortWithinPartitions("chart_id", "doc, id").write.partitionBy("chart_id")
     .options(header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path))
    return RD.read_table_dir(spark, path, key_col="chart_id")


# ---- rationale records (TXT-07, JSN-01) -----------------------------------------------------

def _rationale_spark(spark, sf_dir):
    c = FX.fv_completions(spark, sf_dir)
    tab = J.table_block("completion")
    rsn = py_strip(before_first(py_strip(after_last("completion", "</table>")), "</think>"))
    typed = F.when(F.col("idx") % 11 == 0, F.lit("")).otherwise(F.concat(F.lit("\n### Type: "), F.col("chart_type")))
    return c.select("run", "dataset", "idx", F.concat(F.lit("```json\n"), tab, F.lit("\n```\n### Reasoning: "), rsn, typed).alias("rationale"))


_RAT_SQL = with_fv("fv_completions") + f""",
r0 as (select run, dataset, idx, '```json' || chr(10) || {d_block()} || chr(10) || '```'
   || chr(10) || '### Reasoning: ' || {S.strip(S.before_first(S.strip(S.after_last('completion', '</table>')), '</think>'))}
   || case when idx % 11 = 0 then '' else chr(10) || '### Type: ' || chart_type end as rationale from fv_completions),
r1 as (select *, {S.before_first(S.strip(S.after_last('rationale', '### Reasoning: ')), '### Type: ')} as reasoning,
   case when contains(rationale, '### Type: ') then {S.strip(S.after_last('rationale', '### Type: '))} else 'bar' end as type,
   replace({S.strip(S.before_first(S.before_first(S.after_last('rationale', '```json'), '```'), '### Reasoning'))}, chr(10), '') as t0 from r0),
r2 as (select *, case when ends_with(t0, '}}') then t0 else t0 || '}}' end as tab from r1)
select run, dataset, idx, reasoning, type, json_valid(tab) as table_ok,
 case when json_valid(tab) then len(from_json(tab, '{{"rows":[["VARCHAR"]]}}').rows) end as n_rows from r2"""


@register("rationale_fields", _RAT_SQL)
def rationale_fields(spark, sf_dir):
    """TXT-07 + JSN-01: reasoning between `### Reasoning: ` and `### Type: `, the type after
    `### Type: ` (default "bar"), and the fenced table repaired with a closing brace."""
    rat = F.col("rationale")
    reasoning = before_first(py_strip(after_last(rat, "### Reasoning: ")), "### Type: ")
    typ = F.when(rat.contains("### Type: "), py_strip(after_last(rat, "### Type: "))).otherwise(F.lit("bar"))
    # staged over projections: the table is cut, validated and parsed once a row
    r = _rationale_spark(spark, sf_dir).select("run", "dataset", "idx", reasoning.alias("reasoning"), typ.alias("type"), J.repair_table_text(rat).alias("tab"))
    r = r.withColumn("table_ok", J.strict_json_ok("tab"))
    rows = F.when(F.col("table_ok"), F.from_json(J.quote_number_lexemes("tab"), J.TABLE_SCHEMA))
    return r.select("run", "dataset", "idx", "reasoning", "type", "table_ok", F.size(rows["rows"]).cast("bigint").alias("n_rows"))


# ---- evaluation traces (SRC-16, MET-05) -----------------------------------------------------

def _py_repr(c):
    """A Python-style string literal: single quotes unless the text holds a single quote
    and no double quote."""
    esc = F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), "\n", r"\\n")
    dq = esc.contains("'") & ~esc.contains('"')
    return F.when(dq, F.concat(F.lit('"'), esc, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.regexp_replace(esc, "'", r"\\'"), F.lit("'")))


def _py_list(items, field):
    return F.concat(F.lit("["), F.array_join(F.transform(items, lambda e: _py_repr(e[field])), ", "), F.lit("]"))


def _traces(spark, sf_dir):
    from chartq.operators import metrics as M
    from chartq.operators.ranking import rank_in_group
    ev = FX.fv_eval(spark, sf_dir)
    keys = ["run", "dataset"]
    pos = rank_in_group(ev.select(*keys, "idx", "target", "prediction"), keys, ["idx"], out="pos")
    items = (pos.groupBy(*keys, F.floor(F.col("pos") / 32).cast("bigint").alias("batch"))
             .agg(F.array_sort(F.collect_list(F.struct(F.col("pos"), F.lower("prediction").alias("p"), F.col("target").alias("t"),
                                                       F.col("prediction").alias("r")))).alias("items")))
    run = M.running(ev).select(*keys, "batch", "em_rate", "ra_rate")
    rec = items.join(run, [*keys, "batch"]).select(
        *keys, "batch", F.concat_ws("\n", _py_list("items", "p"), _py_list("items", "t"), _py_list("items", "r"),
                                    F.concat(F.lit("EM:  "), F.col("em_rate").cast("string")),
                                    F.concat(F.lit("Relaxed Accuracy:  "), F.col("ra_rate").cast("string")),
                                    F.lit("BLEU Score:  0.0")).alias("text"))
    path = RD.stage_dir(spark, "traces")
    (rec.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys, "batch")
     .sortWithinPartitions(*keys, "batch").select(*keys, "text")
     .write.mode("overwrite").partitionBy(*keys).text(path))
    return RD.read_traces(spark, path, keys)


@register("trace_records", with_fv("fv_eval") + """select run, dataset, cast(floor(pos / 32) as bigint) as batch, cast(pos % 32 as int) as pos,
 lower(prediction) as pred_norm, target as label, prediction as pred_raw from
 (select *, row_number() over (partition by run, dataset order by idx) - 1 as pos from fv_eval)""")
def trace_records(spark, sf_dir):
    """SRC-16: evaluation traces (3 list literals + 3 metric lines per batch of 32) written as
    text and parsed back to one row per traced item."""
    return RD.trace_items(_traces(spark, sf_dir), ["run", "dataset"])


@register("trace_running", f"select run, dataset, batch, em_rate, ra_rate from ({RUNNING_SQL})")
def trace_running(spark, sf_dir):
    """MET-05: the running EM / relaxed accuracy lines of the traces, per batch."""
    t = _traces(spark, sf_dir)
    return t.select("run", "dataset", F.col("batch").cast("bigint").alias("batch"), F.col("em").alias("em_rate"),
                    F.col("ra").alias("ra_rate"))


# ---- JSON corpora, preference runs and files by stem ----------------------------------------

def _json_lines(df, name: str, sub: str = "") -> str:
    path = RD.stage_dir(df.sparkSession, name)
    df.write.json(path + sub)
    return path


def _json_arrays(df, path: str) -> None:
    """Write JSON text rows (one string column) as array files, one per partition, a line per element."""
    def bracketed(batches):
        opened = False
        for batch in batches:
            rows = batch.column(0).to_pylist()
            yield pa.record_batch([pa.array([("," if opened or i else "[") + r for i, r in enumerate(rows)], pa.string())], ["value"])
            opened = opened or bool(rows)
        yield pa.record_batch([pa.array(["]" if opened else "[]"])], ["value"])

    df.mapInArrow(bracketed, "value string").write.text(path)


def _docs(spark, sf_dir):
    return FX.table(spark, sf_dir, "documents")


def _tail(df):
    """Image paths without the staged folder's own name."""
    return df.withColumn("image_path", F.substring_index("image_path", "/", -2))


_CANON = "cast(null as int) as source_tag, cast(null as varchar) as chart_type"


@register("src_augmented_human", """select 'chartqa-src' as dataset, 'train' as split, 'png/' || doc_id || '.png' as image_path, text as query,
 lang as label, cast(doc_id % 2 as int) as source_tag, cast(null as varchar) as chart_type from documents""")
def src_augmented_human(spark, sf_dir):
    """SRC-01: augmented and human question files of a split, as JSON lines."""
    d = _docs(spark, sf_dir).select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".png")).alias("imgname"), F.col("text").alias("query"), F.col("lang").alias("label"))
    path = RD.stage_dir(spark, "augmented-human")
    d.where("doc_id % 2 = 1").drop("doc_id").write.json(f"{path}/train_augmented.json")
    d.where("doc_id % 2 = 0").drop("doc_id").write.json(f"{path}/train_human.json")
    return _tail(RD.read_augmented_human(spark, path, "train", lines=True))


@register("src_array_files", """select 'chartqa-src' as dataset, 'train' as split, 'png/' || doc_id || '.png' as image_path, text as query,
 lang as label, cast(doc_id % 2 as int) as source_tag, cast(null as varchar) as chart_type from documents""")
def src_array_files(spark, sf_dir):
    """SRC-01: augmented and human question files of a split as JSON arrays, cut into elements in as many tasks as they have splits."""
    d = _docs(spark, sf_dir)
    path = RD.stage_dir(spark, "array-files")
    row = F.to_json(F.struct(F.concat(F.col("doc_id").cast("string"), F.lit(".png")).alias("imgname"), F.col("text").alias("query"), F.col("lang").alias("label"))).alias("value")
    _json_arrays(d.where("doc_id % 2 = 1").select(row), f"{path}/train_augmented.json")
    _json_arrays(d.where("doc_id % 2 = 0").select(row), f"{path}/train_human.json")
    return _tail(RD.read_augmented_human(spark, path, "train"))


@register("rationale_arrays", "select row_number() over (order by doc_id) - 1 as pos, coalesce(text, '') as text from documents")
def rationale_arrays(spark, sf_dir):
    """SRC-14: rationales as JSON arrays of strings, several files in order, numbered over all of them."""
    path = RD.stage_dir(spark, "rationale-arrays")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = _docs(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    one = F.to_json(F.struct(F.col("text").alias("t")))      # {"t":...}: the string's own JSON form stands between the colon and the brace
    _json_arrays(d.select(F.substring(one, F.lit(6), F.length(one) - 6).alias("value")), path)
    r = RD.read_rationales(spark, path)
    sizes = r.groupBy("file").agg(F.count(F.lit(1)).alias("n"))     # one row per file
    w = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    off = sizes.select("file", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("off"))
    return r.join(off, "file").select((F.col("off") + F.col("pos")).alias("pos"), "text")


@register("label_first_word", with_fv("fv_qa") + "select dataset, qid, string_split(label, ' ')[1] as answer, string_split(query, ' ')[1] as word from fv_qa")
def label_first_word(spark, sf_dir):
    """TXT-14: the first word of a label, and of a question."""
    return FX.fv_qa(spark, sf_dir).select("dataset", "qid", first_word("label").alias("answer"), first_word("query").alias("word"))


@register("src_fact_check", f"""select 'chartfc' as dataset, 'test' as split, 'img/' || doc_id || '.png' as image_path, text as query,
 case when doc_id % 3 = 1 then 'Yes' else 'No' end as label, {_CANON} from documents""")
def src_fact_check(spark, sf_dir):
    """SRC-03: fact-check records; answer 1 is Yes, any other No."""
    d = _docs(spark, sf_dir).select(F.concat(F.col("doc_id").cast("string"), F.lit(".png")).alias("image_filename"),
                                    (F.col("doc_id") % 3).cast("int").alias("answer"), F.col("text").alias("question"))
    return RD.read_fact_check(spark, _json_lines(d, "fact-check"), "test", "img/", lines=True)


@register("src_flat", f"""select 'evochart' as dataset, 'test' as split, 'img/' || doc_id || '.png' as image_path, text as query, source as label,
 {_CANON} from documents""")
def src_flat(spark, sf_dir):
    """SRC-04: flat records."""
    d = _docs(spark, sf_dir).select(F.concat(F.col("doc_id").cast("string"), F.lit(".png")).alias("imgname"), F.col("source").alias("label"), F.col("text").alias("query"))
    return RD.read_flat(spark, _json_lines(d, "flat"), "img/", lines=True)


@register("explode_conversations", """select 'chartbench' as dataset, 'test' as split, 'img/' || doc_id || '.png' as image_path,
 trim(lang || ' q' || k) || ' For binary questions, answer in yes/no.' as query, trim('  a' || k || '  ') as label, cast(null as int) as source_tag, source as chart_type
from (select *, unnest(range(0, case when doc_id % 3 = 1 then 2 else 1 end)) as k from documents)""")
def explode_conversations(spark, sf_dir):
    """SRC-06 / FLT-06: conversations of one to three turns; exactly two turns give two rows, others one."""
    turn = F.transform(F.sequence(F.lit(0), F.col("doc_id") % 3), lambda k: F.struct(
        F.concat(F.lit(" "), "lang", F.lit(" q"), k.cast("string")).alias("query"), F.concat(F.lit("  a"), k.cast("string"), F.lit("  ")).alias("label")))
    d = _docs(spark, sf_dir).select(F.concat(F.lit("./"), F.col("doc_id").cast("string"), F.lit(".png")).alias("image"), turn.alias("conversation"),
                                    F.struct(F.col("source").alias("chart")).alias("type"))
    return RD.read_conversation_lines(spark, _json_lines(d, "conversation-lines"), "img/")


@register("explode_nested_qa", f"""select 'figqa' as dataset, 'train' as split, 'img/' || doc_id || '.png' as image_path, lang || k as query, source || k as label,
 {_CANON} from (select *, unnest(range(0, doc_id % 4)) as k from documents)""")
def explode_nested_qa(spark, sf_dir):
    """SRC-07: one record per image with its questions; one row per question."""
    qa = F.filter(F.transform(F.sequence(F.lit(-1).cast("bigint"), F.col("doc_id") % 4 - 1), lambda k: F.struct(
        F.concat("lang", k.cast("string")).alias("question"), F.concat("source", k.cast("string")).alias("answer"), k.alias("k"))), lambda e: e["k"] >= 0)
    d = _docs(spark, sf_dir).select(F.concat(F.lit("img/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("image_path"), qa.alias("qa"))
    return RD.read_nested_qa(spark, _json_lines(d, "nested-qa"))


@register("src_struct_qa", """select 'chartx' as dataset, 'test' as split, 'img/' || doc_id || '.png' as image_path, lang || ' ?' as query, source as label,
 cast(null as int) as source_tag, lang as chart_type from documents""")
def src_struct_qa(spark, sf_dir):
    """SRC-08: nested question records; question, answer and chart type stripped."""
    pad = lambda c: F.concat(F.lit(" \t"), c, F.lit("\n "))
    d = _docs(spark, sf_dir).select(F.concat(F.lit("./"), F.col("doc_id").cast("string"), F.lit(".png")).alias("img"), pad(F.col("lang")).alias("chart_type"),
                                    F.struct(pad(F.concat("lang", F.lit(" ?"))).alias("input"), pad(F.col("source")).alias("output")).alias("QA"))
    return RD.read_struct_qa(spark, _json_lines(d, "struct-qa"), "img/", lines=True)


@register("src_qa_pairs", """select 'plotqa' as dataset, 'train' as split, 'img/' || (doc_id // 3) || '.png' as image_path, lang || ' of ' || source as query,
 cast(n_chars as varchar) as label, cast(null as int) as source_tag, lang as chart_type from documents""")
def src_qa_pairs(spark, sf_dir):
    """SRC-09: question pairs by image index, one pair per line."""
    d = _docs(spark, sf_dir).select(F.floor(F.col("doc_id") / 3).cast("bigint").alias("image_index"), F.col("lang").alias("type"),
                                    F.concat("lang", F.lit(" of "), "source").alias("question_string"), "n_chars", F.col("doc_id").alias("question_id")
                                    ).withColumnRenamed("n_chars", "answer")
    return RD.read_qa_pairs(spark, _json_lines(d, "qa-pairs"), "img", "train", lines=True)


@register("src_parquet_corpus", """select 'chartqa' as dataset, 'train' as split, 'img/' || doc_id || '.png' as image_path, text as query, lang as label,
 cast(doc_id % 2 as int) as source_tag, cast(null as varchar) as chart_type from documents""")
def src_parquet_corpus(spark, sf_dir):
    """SRC-02 / PRJ-01: a parquet corpus through its field map; other columns are pruned from the scan."""
    path = RD.stage_dir(spark, "parquet-corpus")
    _docs(spark, sf_dir).select(F.concat(F.lit("img/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("image"), F.col("text").alias("query"),
                                F.col("lang").alias("label"), (F.col("doc_id") % 2).cast("int").alias("human_or_machine"), "source").write.parquet(path)
    return RD.read_parquet_corpus(spark, path, "chartqa", "train")


@register("pref_runs", with_fv("fv_pref") + """select conv_id || '-' || turn as image, question, label, cast(conv_id % 2 as int) as human_or_machine, predicted from fv_pref""")
def pref_runs(spark, sf_dir):
    """SRC-15 / PRJ-08: stored preference runs reshaped to flat rows."""
    p = FX.fv_pref(spark, sf_dir)
    example = F.struct(F.concat_ws("-", "conv_id", "turn").alias("image"), F.col("question").alias("query"), F.array("label", F.lit("other")).alias("label"),
                       (F.col("conv_id") % 2).cast("int").alias("human_or_machine"))
    return RD.read_pref_runs(spark, _json_lines(p.select(example.alias("example"), "predicted"), "pref-runs"))


def _files(spark, sf_dir):
    d = _docs(spark, sf_dir)
    text = d.select(F.concat(F.lit("corpus/captions/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("caption_path"), F.col("text").alias("caption"))
    image = d.where("doc_id % 3 <> 0").select(F.concat(F.lit("corpus/imgs/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("image_path"))
    return text, image


@register("stem_join", """select cast(doc_id as varchar) as stem, 'corpus/captions/' || doc_id || '.txt' as caption_path, text as caption,
 'corpus/imgs/' || doc_id || '.png' as image_path from documents where doc_id % 3 <> 0""")
def stem_join(spark, sf_dir):
    """JN-02 / JN-03 / FLT-04: captions with the image of the same stem."""
    text, image = _files(spark, sf_dir)
    return RD.join_by_stem(text, image, "caption_path", "image_path")


@register("stem_anti", """select cast(doc_id as varchar) as stem, 'corpus/captions/' || doc_id || '.txt' as caption_path, text as caption from documents where doc_id % 3 = 0""")
def stem_anti(spark, sf_dir):
    """JN-07: captions without an image."""
    text, image = _files(spark, sf_dir)
    return RD.join_by_stem(text, image, "caption_path", "image_path", "left_anti")
