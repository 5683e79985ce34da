"""DuckDB-side twins of the Column macros, used to write the oracle SQL.

These build SQL text for the independent DuckDB oracle only; the engine itself
never runs them.
"""

from __future__ import annotations

from chartq.functions.numeric import FLOAT_LEXEME, FLOAT_SPECIAL


def strip(e: str) -> str:
    return rf"regexp_replace({e}, '^\s+|\s+$', '', 'g')"


def after_last(e: str, d: str) -> str:
    return f"string_split({e}, '{d}')[-1]"


def before_first(e: str, d: str) -> str:
    return f"string_split({e}, '{d}')[1]"


def tag_cut(e: str, o: str, c: str) -> str:
    return strip(before_first(strip(after_last(e, o)), c))


def to_float(e: str) -> str:
    s = strip(e)
    return (f"(case when regexp_matches({s}, '{FLOAT_LEXEME}') or regexp_matches(lower({s}), '{FLOAT_SPECIAL}') "
            f"then try_cast(replace({s}, '_', '') as double) end)")


def to_float_pct(e: str) -> str:
    cut = f"regexp_replace({e}, '%+$', '')"
    return f"(case when ends_with({e}, '%') then {to_float(cut)} / 100.0 else {to_float(e)} end)"


def count_occ(e: str, p: str) -> str:
    return f"((length({e}) - length(replace({e}, '{p}', ''))) // {len(p)})"


def r4(e: str) -> str:
    return f"round(round(cast({e} as double), 8), 4)"


def relaxed(target: str = "target", prediction: str = "prediction", tol: float = 0.05,
            unanswerable: bool = False) -> str:
    p = strip(rf"regexp_replace({prediction}, '\.$', '')")
    t = strip(target)
    pf, tf = to_float_pct(p), to_float_pct(t)
    ok = (f"(case when {pf} is not null and {tf} is not null and {tf} <> 0 "
          f"then abs({pf} - {tf}) / abs({tf}) <= {tol} else lower({p}) = lower({t}) end)")
    if unanswerable:
        ok = f"(lower({target}) = 'unanswerable' or {ok})"
    return f"cast(coalesce({ok}, false) as int)"


def exact(target: str = "target", prediction: str = "prediction") -> str:
    return f"cast(lower({prediction}) = lower({target}) as int)"


# ---- answer rendering (twins of chartq.functions.render) ----

class Number(str):
    """SQL of a rendered number that still knows the expression behind it."""

    expr: str


def _number(text: str, expr: str) -> Number:
    out = Number(text)
    out.expr = expr
    return out


def num(e: str) -> Number:
    return _number(f"cast(try_cast(round(round(cast({e} as double), 8), 4) as decimal(38,4)) as varchar)", e)


def integer(e: str) -> Number:
    return _number(f"cast(cast({e} as bigint) as varchar)", e)


def number(e: str) -> str:
    """The answer as a double, rounded for comparison; null for answers that are no numbers."""
    return r4(e.expr) if isinstance(e, Number) else "cast(null as double)"


def boolean(e: str) -> str:
    return f"(case when {e} then 'True' when not ({e}) then 'False' end)"


def quoted_list(e: str) -> str:
    return f"('[' || array_to_string(list_transform({e}, lambda x: '''' || x || ''''), ', ') || ']')"


def pair(a: str, b: str) -> str:
    return f"('(' || {a} || ', ' || {b} || ')')"


def fmt2(e: str) -> str:
    return f"printf('%.2f', {e})"


def int_list(e: str) -> str:
    return f"('[' || array_to_string({e}, ', ') || ']')"
