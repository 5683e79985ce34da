"""Fixture views (FIXTURES.md §3): the canonical inputs of every operator, derived by
Spark from the driver's tables so that their size grows with the tables.

Views whose rows are already aggregated per chart use the portable SQL of the
fixture spec through `spark.sql(..., name=df)`; views whose groups grow with the
data (a brand of `part`, a user of `events`, a flag pair of `lineitem`) number
their rows with the skew-safe `rank_in_group` instead of a per-chart window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartq.operators.ranking import rank_in_group
from chartq.sources.tables import table


def _sql(spark: SparkSession, sf_dir: str, text: str, *names: str) -> DataFrame:
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in names})


def fv_eval(spark, sf_dir) -> DataFrame:
    """eval_records: run, dataset, idx, target, prediction, tag (MET-*)."""
    return _sql(spark, sf_dir, """
select case o_orderkey % 3 when 0 then 'cot' when 1 then 'sft' else 'grpo' end as run, o_orderstatus as dataset, o_orderkey as idx,
 case when o_orderkey % 8 = 5 then cast(o_orderkey % 100 as string) || '%' when o_orderkey % 8 = 6 then o_orderpriority
      when o_orderkey % 8 = 7 then 'Unanswerable' else cast(cast(round(o_totalprice*100) as bigint) as string) end as target,
 case o_orderkey % 8 when 0 then cast(cast(round(o_totalprice*100) as bigint) as string)
   when 1 then cast(cast(floor(round(o_totalprice*100)*1.04) as bigint) as string)
   when 2 then cast(cast(floor(round(o_totalprice*100)*1.1) as bigint) as string)
   when 3 then ' ' || cast(cast(round(o_totalprice*100) as bigint) as string) || '.'
   when 4 then 'n/a' when 5 then '0.' || lpad(cast(o_orderkey % 100 as string),2,'0')
   when 6 then lower(o_orderpriority) || '.' else 'unknown' end as prediction,
 cast(o_orderkey % 2 as int) as tag from {orders}""", "orders")


def fv_completions(spark, sf_dir, spread: bool = False) -> DataFrame:
    """completions: run, dataset, idx, completion, label, chart_type, gold_table (RWD-*, JSN-*). With `spread` the orders are dealt
    evenly before texts are made of them, for work on each text that is long next to reading a file's few row groups."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    if spread:
        orders = orders.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return spark.sql("""
select case o_orderkey % 3 when 0 then 'cot' when 1 then 'sft' else 'grpo' end as run, o_orderstatus as dataset, o_orderkey as idx,
 '<think>' || chr(10) || '<type>' || case when o_orderkey % 4 = 0 then 'Bar' else 'line' end || '</type>' || chr(10)
  || case when o_orderkey % 5 = 0 then '' else '<table>{{"columns":["Year","Value"],"rows":[["' || o_orderpriority || '",'
  || cast(cast(round(o_totalprice*100) as bigint) as string) || '],["b",1.50]]' || case when o_orderkey % 7 = 0 then '' else '}}' end || '</table>' end
  || chr(10) || '<step-1>: ' || repeat('w ', cast(o_orderkey % 90 as int)) || '<step-2>: done</think>' || chr(10) || '<answer>'
  || cast(cast(round(o_totalprice*100) as bigint) + (o_orderkey % 3) * 4000000 as string) || case when o_orderkey % 2 = 0 then '.' else '' end || '</answer>' as completion,
 cast(cast(round(o_totalprice*100) as bigint) as string) as label,
 case when o_orderkey % 2 = 0 then 'bar' else 'line' end as chart_type,
 '{{"columns":["value","year"],"rows":[["b","1.50"],["' || o_orderpriority || '","' || cast(cast(round(o_totalprice*100) as bigint) as string) || '"]]}}' as gold_table
from {orders}""", orders=orders)


def fv_bar(spark, sf_dir) -> DataFrame:
    """Bar / pie points: chart_id, row_idx, category, value (aggregated, ≤ one row per segment)."""
    return _sql(spark, sf_dir, """
select c_nationkey as chart_id, cast(row_number() over (partition by c_nationkey order by c_mktsegment) - 1 as bigint) as row_idx,
 c_mktsegment as category, cast(sum(cast(round(c_acctbal*100) as bigint)) as double) as value from {customer} group by c_nationkey, c_mktsegment""",
                "customer")


def fv_grp(spark, sf_dir) -> DataFrame:
    return _sql(spark, sf_dir, """
select c_nationkey as chart_id, cast(row_number() over (partition by c_nationkey order by c_mktsegment, o_orderpriority) - 1 as bigint) as row_idx,
 c_mktsegment as grp, o_orderpriority as category, cast(sum(cast(round(o_totalprice*100) as bigint)) as double) as value
from {orders} join {customer} on o_custkey = c_custkey group by c_nationkey, c_mktsegment, o_orderpriority""", "orders", "customer")


def _placed(df: DataFrame, order: list[str], positions: bool) -> DataFrame:
    """`row_idx` within each chart; null where nothing reads positions (the ranking is not run then)."""
    if not positions:
        return df.withColumn("row_idx", F.lit(None).cast("long"))
    return rank_in_group(df, ["chart_id"], order)


def fv_hist(spark, sf_dir, positions: bool = True) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_brand").alias("chart_id"), "p_partkey",
                                               F.col("p_retailprice").alias("value"))
    return _placed(part, ["p_partkey"], positions).select("chart_id", "row_idx", "value")


def fv_scatter(spark, sf_dir, positions: bool = True) -> DataFrame:
    part = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("chart_id"), "p_partkey",
        (F.col("p_size") - 25).cast("double").alias("x"),
        ((F.col("p_partkey") * 37) % 101 - 50).cast("double").alias("y"))
    return _placed(part, ["p_partkey"], positions).select("chart_id", "row_idx", "x", "y")


def fv_line(spark, sf_dir) -> DataFrame:
    ev = table(spark, sf_dir, "events").select(F.col("user_id").alias("chart_id"), "event_id",
                                              F.col("event_id").cast("double").alias("x"), F.col("value").alias("y"))
    return rank_in_group(ev, ["chart_id"], ["event_id"]).select("chart_id", "row_idx", "x", "y")


def fv_bubble(spark, sf_dir) -> DataFrame:
    cu = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("chart_id"), "c_custkey",
        F.col("c_custkey").cast("double").alias("x"), F.col("c_acctbal").alias("y"),
        ((F.col("c_custkey") * 13) % 97).cast("double").alias("size"))
    return rank_in_group(cu, ["chart_id"], ["c_custkey"]).select("chart_id", "row_idx", "x", "y", "size")


def fv_dual(spark, sf_dir) -> DataFrame:
    return _sql(spark, sf_dir, """
select o_orderpriority as chart_id, cast(row_number() over (partition by o_orderpriority order by ym) - 1 as bigint) as row_idx,
 cast(ym as double) as x, cast(y1 as double) as y1, cast(y2 as double) as y2 from
 (select o_orderpriority, cast(extract(year from o_orderdate) as int)*12 + cast(extract(month from o_orderdate) as int) as ym,
   sum(case when o_orderstatus='F' then cast(round(o_totalprice*100) as bigint) else 0 end) as y1,
   sum(case when o_orderstatus='O' then cast(round(o_totalprice*100) as bigint) else 0 end) as y2 from {orders} group by 1,2) q""",
                "orders")


MATRIX_VARS = ("v1", "v2", "v3", "v4")


def fv_matrix(spark, sf_dir, with_row_idx: bool = False) -> DataFrame:
    """Scatter-matrix points; the matrix questions are order-free, so the position is only
    computed when asked for."""
    li = table(spark, sf_dir, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("chart_id"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.col("l_quantity").alias("v1"), F.col("l_extendedprice").alias("v2"),
        F.col("l_discount").alias("v3"), F.col("l_tax").alias("v4"))
    if not with_row_idx:
        return li.select("chart_id", *MATRIX_VARS)
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "v2", "v1", "v3", "v4"]
    return rank_in_group(li, ["chart_id"], order).select("chart_id", "row_idx", *MATRIX_VARS)


def fv_stack(spark, sf_dir) -> DataFrame:
    return _sql(spark, sf_dir, """
select l_suppkey as chart_id, cast(row_number() over (partition by l_suppkey order by l_returnflag,l_linestatus) - 1 as bigint) as row_idx,
 l_returnflag as grp, l_linestatus as series, cast(sum(cast(round(l_extendedprice*100) as bigint)) as double) as value
from {lineitem} group by l_suppkey,l_returnflag,l_linestatus""", "lineitem")


def fv_multi(spark, sf_dir) -> DataFrame:
    return _sql(spark, sf_dir, """
select ch as chart_id, cast(row_number() over (partition by ch order by dy) - 1 as bigint) as row_idx, cast(dy as double) as x,
 cast(y_1 as double) as y_1, cast(y_2 as double) as y_2, cast(y_3 as double) as y_3 from
 (select user_id % 3 as ch, cast(extract(day from ts) as int) as dy, sum(case when event_type='view' then 1 else 0 end) as y_1,
  sum(case when event_type='click' then 1 else 0 end) as y_2, sum(case when event_type='purchase' then 1 else 0 end) as y_3
  from {events} group by 1,2) q""", "events")


def fv_prob(spark, sf_dir) -> DataFrame:
    """(dataset, idx, run, p): one probability per order and run; the four runs come from an
    inline array, not a join."""
    runs = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(k).alias("k"))
                     for r, k in (("none", 31), ("cot", 37), ("sft", 41), ("grpo", 43))])
    o = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey", F.explode(runs).alias("m"))
    return o.select(F.col("o_orderstatus").alias("dataset"), F.col("o_orderkey").alias("idx"),
                    F.col("m.r").alias("run"),
                    ((F.col("o_orderkey") * F.col("m.k")) % 100).cast("double") / F.lit(100.0)).toDF(
        "dataset", "idx", "run", "p")


def fv_turns(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def fv_pref(spark, sf_dir) -> DataFrame:
    """(conv_id, turn, question, predicted, label): each user turn answered by the next turn.
    The next turn is found by an equi-join on (conv_id, turn + 1), which no long conversation
    can skew."""
    t = fv_turns(spark, sf_dir)
    nxt = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("nrole"),
                   F.col("text").alias("predicted"))
    q = (t.where(F.col("role") == "user").join(nxt.where(F.col("nrole") == "assistant"), ["conv_id", "turn"])
         .select("conv_id", "turn", F.col("text").alias("question"), "predicted"))
    return q.withColumn("label", F.split("predicted", " ").getItem(0))


def fv_manifest(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("image_id"), (F.lit(100) + F.col("p_size") * 37).alias("width"),
                    (F.lit(80) + (F.col("p_partkey") % 50) * 29).alias("height"))


def fv_emb(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("e2"))
    return e.join(b, "vec_id").select(F.col("vec_id").alias("idx"), F.col("embedding").alias("e1"), "e2")


def fv_qa(spark, sf_dir) -> DataFrame:
    """Canonical qa rows from documents (+ labels): dataset = source, qid = doc_id, query = the
    whole text, label = the quality flag rendered Yes / No (as the fact-check loader does),
    source_tag = the toxic flag (0 = human, 1 = augmented), chart_type = lang."""
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels")
    j = d.join(lab, "doc_id", "left")
    return j.select(F.col("source").alias("dataset"), F.lit("train").alias("split"), F.col("doc_id").alias("qid"),
                    F.concat(F.lit("images/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("image_path"),
                    F.col("text").alias("query"),
                    F.when(F.col("quality") == 1, "Yes").when(F.col("quality") == 0, "No").alias("label"),
                    F.col("toxic").cast("int").alias("source_tag"), F.col("lang").alias("chart_type"))


def fv_tok(spark, sf_dir) -> DataFrame:
    """Token-id arrays: the length of every space-separated word of each turn."""
    t = fv_turns(spark, sf_dir)
    return t.select("conv_id", "turn", F.transform(F.split("text", " "), lambda w: F.length(w)).alias("ids"))


# (prefix, view, columns) of the charts flattened into FV-cells.
CELL_SOURCES = (("bar", "fv_bar", ("category", "value")), ("scatter", "fv_scatter", ("x", "y")),
                ("hist", "fv_hist", ("value",)), ("grp", "fv_grp", ("grp", "category", "value")),
                ("matrix", "fv_matrix", ("v1", "v2", "v3", "v4")))


def _cell_text(df: DataFrame, c: str) -> F.Column:
    dt = dict(df.dtypes)[c]
    return F.col(c).cast("decimal(20,2)").cast("string") if dt in ("double", "float") else F.col(c).cast("string")


def fv_chart_rows(spark, sf_dir, source: str, positions: bool = True) -> DataFrame:
    """(chart_id, row_idx, the view's columns as text): the rows of one source's charts, `chart_id` prefixed by the source."""
    views = {"fv_bar": fv_bar, "fv_scatter": lambda s, d: fv_scatter(s, d, positions), "fv_hist": lambda s, d: fv_hist(s, d, positions), "fv_grp": fv_grp,
             "fv_matrix": lambda s, d: fv_matrix(s, d, with_row_idx=True) if positions else fv_matrix(s, d).withColumn("row_idx", F.lit(None).cast("long"))}
    view, cols = next((v, c) for p, v, c in CELL_SOURCES if p == source)
    df = views[view](spark, sf_dir)
    return df.select(F.concat(F.lit(source + ":"), F.col("chart_id").cast("string")).alias("chart_id"),
                     F.col("row_idx").cast("long").alias("row_idx"), *[_cell_text(df, c).alias(c) for c in cols])


def fv_cells(spark, sf_dir, positions: bool = True) -> DataFrame:
    """chart_cells (chart_id, row_idx, col_idx, col_name, cell): every chart of five views as
    string cells, `chart_id` prefixed by its source. Profiles do not read positions."""
    out = None
    for prefix, _, cols in CELL_SOURCES:
        df = fv_chart_rows(spark, sf_dir, prefix, positions)
        cells = F.array(*[F.struct(F.lit(i).alias("col_idx"), F.lit(c).alias("col_name"), F.col(c).alias("cell")) for i, c in enumerate(cols)])
        part = df.select("chart_id", "row_idx", F.inline(cells))
        out = part if out is None else out.unionByName(part)
    return out
