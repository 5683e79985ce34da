"""Fixture views as DuckDB SQL (FIXTURES.md §3), used as CTEs by the oracle queries."""

from __future__ import annotations

FV = {
    "fv_eval": """
select case o_orderkey % 3 when 0 then 'cot' when 1 then 'sft' else 'grpo' end as run, o_orderstatus as dataset, o_orderkey as idx,
 case when o_orderkey % 8 = 5 then cast(o_orderkey % 100 as varchar) || '%' when o_orderkey % 8 = 6 then o_orderpriority
      when o_orderkey % 8 = 7 then 'Unanswerable' else cast(cast(round(o_totalprice*100) as bigint) as varchar) end as target,
 case o_orderkey % 8 when 0 then cast(cast(round(o_totalprice*100) as bigint) as varchar)
   when 1 then cast(cast(floor(round(o_totalprice*100)*1.04) as bigint) as varchar)
   when 2 then cast(cast(floor(round(o_totalprice*100)*1.1) as bigint) as varchar)
   when 3 then ' ' || cast(cast(round(o_totalprice*100) as bigint) as varchar) || '.'
   when 4 then 'n/a' when 5 then '0.' || lpad(cast(o_orderkey % 100 as varchar),2,'0')
   when 6 then lower(o_orderpriority) || '.' else 'unknown' end as prediction,
 cast(o_orderkey % 2 as int) as tag from orders""",
    "fv_completions": """
select case o_orderkey % 3 when 0 then 'cot' when 1 then 'sft' else 'grpo' end as run, o_orderstatus as dataset, o_orderkey as idx,
 '<think>' || chr(10) || '<type>' || case when o_orderkey % 4 = 0 then 'Bar' else 'line' end || '</type>' || chr(10)
  || case when o_orderkey % 5 = 0 then '' else '<table>{"columns":["Year","Value"],"rows":[["' || o_orderpriority || '",'
  || cast(cast(round(o_totalprice*100) as bigint) as varchar) || '],["b",1.50]]' || case when o_orderkey % 7 = 0 then '' else '}' end || '</table>' end
  || chr(10) || '<step-1>: ' || repeat('w ', cast(o_orderkey % 90 as int)) || '<step-2>: done</think>' || chr(10) || '<answer>'
  || cast(cast(round(o_totalprice*100) as bigint) + (o_orderkey % 3) * 4000000 as varchar) || case when o_orderkey % 2 = 0 then '.' else '' end || '</answer>' as completion,
 cast(cast(round(o_totalprice*100) as bigint) as varchar) as label,
 case when o_orderkey % 2 = 0 then 'bar' else 'line' end as chart_type,
 '{"columns":["value","year"],"rows":[["b","1.50"],["' || o_orderpriority || '","' || cast(cast(round(o_totalprice*100) as bigint) as varchar) || '"]]}' as gold_table
from orders""",
    "fv_bar": """
select c_nationkey as chart_id, cast(row_number() over (partition by c_nationkey order by c_mktsegment) - 1 as bigint) as row_idx,
 c_mktsegment as category, cast(sum(cast(round(c_acctbal*100) as bigint)) as double) as value from customer group by c_nationkey, c_mktsegment""",
    "fv_grp": """
select c_nationkey as chart_id, cast(row_number() over (partition by c_nationkey order by c_mktsegment, o_orderpriority) - 1 as bigint) as row_idx,
 c_mktsegment as grp, o_orderpriority as category, cast(sum(cast(round(o_totalprice*100) as bigint)) as double) as value
from orders join customer on o_custkey = c_custkey group by c_nationkey, c_mktsegment, o_orderpriority""",
    "fv_hist": """
select p_brand as chart_id, cast(row_number() over (partition by p_brand order by p_partkey) - 1 as bigint) as row_idx, p_retailprice as value from part""",
    "fv_line": """
select user_id as chart_id, cast(row_number() over (partition by user_id order by event_id) - 1 as bigint) as row_idx, cast(event_id as double) as x, value as y from events""",
    "fv_scatter": """
select p_brand as chart_id, cast(row_number() over (partition by p_brand order by p_partkey) - 1 as bigint) as row_idx,
 cast(p_size - 25 as double) as x, cast((p_partkey * 37) % 101 - 50 as double) as y from part""",
    "fv_bubble": """
select c_nationkey as chart_id, cast(row_number() over (partition by c_nationkey order by c_custkey) - 1 as bigint) as row_idx,
 cast(c_custkey as double) as x, c_acctbal as y, cast((c_custkey * 13) % 97 as double) as size from customer""",
    "fv_dual": """
select o_orderpriority as chart_id, cast(row_number() over (partition by o_orderpriority order by ym) - 1 as bigint) as row_idx,
 cast(ym as double) as x, cast(y1 as double) as y1, cast(y2 as double) as y2 from
 (select o_orderpriority, cast(extract(year from o_orderdate) as int)*12 + cast(extract(month from o_orderdate) as int) as ym,
   sum(case when o_orderstatus='F' then cast(round(o_totalprice*100) as bigint) else 0 end) as y1,
   sum(case when o_orderstatus='O' then cast(round(o_totalprice*100) as bigint) else 0 end) as y2 from orders group by 1,2) q""",
    "fv_matrix": """
select l_returnflag || l_linestatus as chart_id, cast(row_number() over (partition by l_returnflag, l_linestatus
  order by l_orderkey,l_linenumber,l_partkey,l_suppkey,l_extendedprice,l_quantity,l_discount,l_tax) - 1 as bigint) as row_idx,
 l_quantity as v1, l_extendedprice as v2, l_discount as v3, l_tax as v4 from lineitem""",
    "fv_stack": """
select l_suppkey as chart_id, cast(row_number() over (partition by l_suppkey order by l_returnflag,l_linestatus) - 1 as bigint) as row_idx,
 l_returnflag as grp, l_linestatus as series, cast(sum(cast(round(l_extendedprice*100) as bigint)) as double) as value
from lineitem group by l_suppkey,l_returnflag,l_linestatus""",
    "fv_multi": """
select ch as chart_id, cast(row_number() over (partition by ch order by dy) - 1 as bigint) as row_idx, cast(dy as double) as x,
 cast(y_1 as double) as y_1, cast(y_2 as double) as y_2, cast(y_3 as double) as y_3 from
 (select user_id % 3 as ch, cast(extract(day from ts) as int) as dy, sum(case when event_type='view' then 1 else 0 end) as y_1,
  sum(case when event_type='click' then 1 else 0 end) as y_2, sum(case when event_type='purchase' then 1 else 0 end) as y_3 from events group by 1,2) q""",
    "fv_prob": """
select o_orderstatus as dataset, o_orderkey as idx, r as run, cast((o_orderkey * k) % 100 as double) / 100.0 as p from orders
cross join (select 'none' as r, 31 as k union all select 'cot', 37 union all select 'sft', 41 union all select 'grpo', 43) m""",
    "fv_pref": """
select conv_id, turn, question, prediction as predicted, split(prediction, ' ')[1] as label from
 (select conv_id, turn, role, text as question, lead(text) over (partition by conv_id order by turn) as prediction,
         lead(role) over (partition by conv_id order by turn) as nrole from conversations) q where role='user' and nrole='assistant'""",
    "fv_manifest": """
select p_partkey as image_id, 100 + p_size * 37 as width, 80 + (p_partkey % 50) * 29 as height from part""",
    "fv_emb": """
select a.vec_id as idx, a.embedding as e1, b.embedding as e2 from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""",
    "fv_turns": "select * from conversations",
    "fv_qa": """
select source as dataset, 'train' as split, d.doc_id as qid, 'images/' || cast(d.doc_id as varchar) || '.png' as image_path,
 text as query, case when quality = 1 then 'Yes' when quality = 0 then 'No' end as label, cast(toxic as int) as source_tag,
 lang as chart_type from documents d left join labels l on d.doc_id = l.doc_id""",
    "fv_tok": """
select conv_id, turn, list_transform(string_split(text, ' '), lambda w: cast(length(w) as int)) as ids from conversations""",
}


def with_fv(*names: str) -> str:
    """`WITH` clause defining the named fixture views."""
    return "with " + ",\n".join(f"{n} as ({FV[n]})" for n in names) + "\n"


def fv_cells_sql() -> str:
    """FV-cells as one SELECT over the other fixture CTEs (which must be in the WITH list)."""
    from chartq.sources.fixtures import CELL_SOURCES
    types = {"fv_bar": {"value"}, "fv_scatter": {"x", "y"}, "fv_hist": {"value"}, "fv_grp": {"value"},
             "fv_matrix": {"v1", "v2", "v3", "v4"}}
    parts = []
    for prefix, view, cols in CELL_SOURCES:
        items = ", ".join(
            "{'col_idx': %d, 'col_name': '%s', 'cell': %s}" % (
                i, c, f"cast(cast({c} as decimal(20,2)) as varchar)" if c in types[view] else f"cast({c} as varchar)")
            for i, c in enumerate(cols))
        parts.append(f"select '{prefix}:' || cast(chart_id as varchar) as chart_id, cast(row_idx as bigint) as row_idx, "
                     f"unnest([{items}], recursive := true) from {view}")
    return "\nunion all\n".join(parts)


def with_cells() -> str:
    return with_fv("fv_bar", "fv_scatter", "fv_hist", "fv_grp", "fv_matrix") + ", fv_cells as (" + fv_cells_sql() + ")\n"
