"""Column macros for the string work (TXT-*).

Every macro returns a `Column` built from JVM built-ins, so it stays inside
whole-stage codegen and works on batch and streaming DataFrames alike.
`substring_index(s, d, -1)` is Python's `s.split(d)[-1]` and
`substring_index(s, d, 1)` is `s.split(d)[0]`, including the case where the
delimiter is missing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Fixed value: the characters Python's str.strip() removes (str.isspace()).
PY_WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
                 "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def py_strip(c) -> Column:
    """`s.strip()`: a character-set trim (no regex) over Python's white-space set."""
    return F.btrim(col_(c), F.lit(PY_WHITESPACE))


def strip_newlines(c) -> Column:
    """`s.strip("\\n")`."""
    return F.regexp_replace(col_(c), r"\A\n+|\n+\z", "")


def after_last(c, delim: str) -> Column:
    """`s.split(delim)[-1]`."""
    return F.substring_index(col_(c), delim, -1)


def before_first(c, delim: str) -> Column:
    """`s.split(delim)[0]`."""
    return F.substring_index(col_(c), delim, 1)


def tag_cut(c, open_tag: str, close_tag: str) -> Column:
    """`s.split(open)[-1].strip().split(close)[0].strip()` (TXT-01, TXT-04)."""
    return py_strip(before_first(py_strip(after_last(c, open_tag)), close_tag))


def count_occurrences(c, pattern: str) -> Column:
    """Non-overlapping occurrences of a literal substring."""
    s = col_(c)
    return F.floor((F.length(s) - F.length(F.replace(s, F.lit(pattern), F.lit("")))) / F.lit(len(pattern)))


def strip_one_trailing_dot(c) -> Column:
    """`s[:-1] if s.endswith('.') else s` (TXT-10, metrics variant)."""
    s = col_(c)
    return F.regexp_replace(s, r"\.\z", "")


def strip_trailing_dots(c) -> Column:
    """`s.rstrip('.')` (TXT-10, reward variant)."""
    return F.regexp_replace(col_(c), r"\.+\z", "")


def remove_special(c) -> Column:
    """Keep letters, digits and white space, then strip (TXT-11)."""
    return py_strip(F.regexp_replace(col_(c), rf"[^\p{{L}}\p{{N}}{PY_WHITESPACE}]", ""))


def whitespace_tokens(c) -> Column:
    """`s.split()` as an array (TXT-12): Spark keeps empty edge tokens, so drop them."""
    return F.filter(F.split(col_(c), f"[{PY_WHITESPACE}]+"), lambda t: t != "")


def step_count(c) -> Column:
    """Pieces of `s.split('<step-')` (TXT-08)."""
    return F.size(F.split(col_(c), "<step-", -1))


def first_word(c) -> Column:
    """`s.split(' ')[0]` (TXT-14)."""
    return before_first(c, " ")


def fill_template(template, **fields) -> Column:
    """`template.format(question=..., ...)` for `{name}` slots (TXT-13)."""
    out = col_(template) if not isinstance(template, str) else F.lit(template)
    for name, value in fields.items():
        out = F.replace(out, F.lit("{" + name + "}"), col_(value))
    return out


def reason_answer_cut(c, family: str = "llava"):
    """TXT-02 / TXT-03: (answer, reason) of a chain-of-thought reply.

    llava: the text after the last `[/INST]` (stripped), answer after the last `Answer:`,
    reason between the last `Reason:` and the next `Answer:`; internvl: `### Answer:` and
    `### Reason:` markers on the whole text. Reasons are stripped of newlines only."""
    s = py_strip(after_last(c, "[/INST]")) if family == "llava" else col_(c)
    ans, rsn = ("Answer:", "Reason:") if family == "llava" else ("### Answer:", "### Reason:")
    stop = "Answer:" if family == "llava" else "### Answer"
    return py_strip(after_last(s, ans)), strip_newlines(before_first(after_last(s, rsn), stop))
