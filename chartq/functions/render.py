"""Rendering typed answers to text the same way on every engine.

Operators write numbers in full; registered queries write them as fixed-point decimals with
4 places (the oracles do the same). Booleans are `True` / `False`, lists and tuples in Python's literal style.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chartq.functions.text import col_


def full(c) -> Column:
    """The shortest text that reads back as the same double."""
    return col_(c).cast("double").cast("string")


def num(c) -> Column:
    """Four decimals, for comparison with another engine."""
    return F.round(F.round(col_(c).cast("double"), 8), 4).try_cast("decimal(38,4)").cast("string")


def integer(c) -> Column:
    return col_(c).cast("bigint").cast("string")


def boolean(c) -> Column:
    c = col_(c)
    return F.when(c, F.lit("True")).when(~c, F.lit("False"))


def quoted_list(arr) -> Column:
    """`['a', 'b']`."""
    return F.concat(F.lit("["), F.array_join(F.transform(col_(arr), lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "),
                    F.lit("]"))


def pair(a, b) -> Column:
    """`(a, b)` of already rendered parts."""
    return F.concat(F.lit("("), col_(a), F.lit(", "), col_(b), F.lit(")"))


def fmt2(c) -> Column:
    """`f"{x:.2f}"`: a value half way between two hundredths (an eighth, in binary) goes to the even one."""
    x = col_(c).cast("double")
    return F.format_string("%.2f", F.when(x * 8 == F.floor(x * 8), F.bround(x, 2)).otherwise(x))


def int_list(arr) -> Column:
    """`[3, 0, 1]` from an array of integer texts."""
    return F.concat(F.lit("["), F.array_join(col_(arr), ", "), F.lit("]"))
