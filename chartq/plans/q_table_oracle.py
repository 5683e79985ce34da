"""DuckDB oracle for `table_qa`: the per-type QA SQL fed by chart views rebuilt from
FV-cells with the roles the profile assigns (alphabetical within kind)."""

from __future__ import annotations

from chartq.plans import q_qa as QQ
from chartq.plans.fixture_sql import FV, fv_cells_sql, with_fv
from chartq.plans.registry import ORACLE

# the fixture views under source names, so the rebuilt views can take the fixture names
_BASE = ", ".join(f"{n.replace('fv_', 'src_')} as ({FV[n]})" for n in ("fv_bar", "fv_scatter", "fv_hist", "fv_grp", "fv_matrix"))


def _num(col):
    return f"cast(max(cell) filter (where col_name = '{col}') as double)"


def _txt(col):
    return f"max(cell) filter (where col_name = '{col}')"


# chart views from cells, named as the per-type SQL expects them
_VIEWS = {
    "fv_bar": ("bar:", f"{_txt('category')} as category, {_num('value')} as value"),
    "fv_scatter": ("scatter:", f"{_num('x')} as x, {_num('y')} as y"),
    "fv_hist": ("hist:", f"{_num('value')} as value"),
    # the two categorical columns sorted by name: 'category' takes the group role, 'grp' the category role
    "fv_grp": ("grp:", f"{_txt('category')} as grp, {_txt('grp')} as category, {_num('value')} as value"),
    "fv_matrix": ("matrix:", ", ".join(f"{_num(v)} as {v}" for v in ("v1", "v2", "v3", "v4"))),
}


def _typed(view: str, sql: str, chart_type: str) -> str:
    prefix, cols = _VIEWS[view]
    rest = sql[len(with_fv(view)):]
    head = (f"with {_BASE}, "
            f"fv_cells as ({fv_cells_sql().replace(' from fv_', ' from src_')}),\n"
            f"{view} as (select chart_id, row_idx, {cols} from fv_cells where chart_id like '{prefix}%' group by chart_id, row_idx)\n")
    return f"select *, '{chart_type}' as chart_type from ({head}{rest})"


ORACLE["table_qa"] = "\nunion all\n".join([
    _typed("fv_bar", QQ.BAR_SQL, "bar"), _typed("fv_scatter", QQ.SCATTER_SQL, "scatter"),
    _typed("fv_hist", QQ.HIST_SQL, "histogram"), _typed("fv_grp", QQ.GRP_SQL, "grouped_bar"),
    _typed("fv_matrix", QQ.MATRIX_SQL, "scatter_matrix")])
