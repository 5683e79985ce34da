"""Python-`float()`-compatible parsing as a Column expression (TXT-09).

Spark's string→double cast is laxer than Python in some places ("1d", "1f")
and stricter in others ("1_000"), so the lexeme is validated with the grammar
Python accepts before the guarded `try_cast`. The same regex is used by the
DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chartq.functions.text import col_, py_strip

# Fixed value: the decimal-literal grammar of Python's float() (digits may be
# grouped by single underscores), plus the special names it accepts.
FLOAT_LEXEME = r"^[+-]?((\d+(_\d+)*)(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"
FLOAT_SPECIAL = r"^[+-]?(inf|infinity|nan)$"
FLOAT_ANY = r"^[+-]?((\d+(_\d+)*)(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$|^[+-]?(?i:inf|infinity|nan)$"


def to_float(c) -> Column:
    """`float(s)` or NULL where Python raises ValueError."""
    s = py_strip(col_(c))
    return F.when(s.rlike(FLOAT_ANY), F.regexp_replace(s, "_", "").try_cast("double"))


def to_float_pct(c) -> Column:
    """`float(s.rstrip('%')) / 100 if s.endswith('%') else float(s)`."""
    s = col_(c)
    return F.when(s.endswith("%"), to_float(F.regexp_replace(s, r"%+\z", "")) / F.lit(100.0)).otherwise(to_float(s))


def is_num(c) -> Column:
    return to_float(c).isNotNull()


def round4(c) -> Column:
    """Doubles are reported rounded to 4 places on both the Spark and the oracle side."""
    return F.round(F.round(col_(c).cast("double"), 8), 4)
