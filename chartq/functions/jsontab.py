"""JSON chart tables as Column expressions (JSN-01..06, SRT-02, SET-04).

A table is `struct<columns: array<string>, rows: array<array<string>>>`. Number
lexemes are kept as written (`1.50` stays "1.50", as Python's
`json.loads(parse_int=str, parse_float=str)` keeps them): bare numbers outside
string literals are quoted before `from_json`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartq.functions.text import col_, py_strip

TABLE_SCHEMA = "columns array<string>, rows array<array<string>>"

# A JSON string literal (with escapes) and the shapes of a bare number and of Python's bare constants.
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_NUMBER = r"-?[0-9][0-9.eE+-]*"
_CONSTANT = r"-?\bInfinity\b|\bNaN\b"


def _quoted(c, lexeme: str) -> Column:
    """`c` with the lexemes outside of string literals in quotes, in one pass: a literal gets two marks behind it, a lexeme one
    on either side; pairs of marks go, single ones become quotes. (A mark is no character of valid JSON.)"""
    marked = F.regexp_replace(c, f"({_STRING})|({lexeme})", "$1\x01$2\x01")
    return F.replace(F.replace(marked, F.lit("\x01\x01"), F.lit("")), F.lit("\x01"), F.lit('"'))


def strict_json_ok(c) -> Column:
    """True when the whole string is one JSON value (Python `json.loads` would not raise).

    `try_parse_json` alone accepts trailing text. Here the text is the first of two items of an array, the second being the
    text's own digest: a text that is not one whole value leaves something else, or nothing, in second place."""
    s = col_(c)
    own = F.md5(s)
    # without a value, or cut off inside an object: the parser would state that by an exception, which is slow
    cut = (s == "") | (s.startswith("{") & ~F.rtrim(s, F.lit(" \t\r\n")).endswith("}"))
    v = F.try_parse_json(F.concat(F.lit("["), quote_constants(s), F.lit(',"'), own, F.lit('"]')))
    return F.when(cut, F.lit(False)).otherwise(F.coalesce(F.try_variant_get(v, "$[1]", "string") == own, F.lit(False)))


def quote_constants(c) -> Column:
    """Bare NaN / Infinity / -Infinity outside string literals become strings, as Python's parser hands them to `parse_constant=str`."""
    s = col_(c)
    return F.when(s.contains("NaN") | s.contains("Infinity"), _quoted(s, _CONSTANT)).otherwise(s)


def quote_number_lexemes(c) -> Column:
    """Bare numbers and constants become strings."""
    return _quoted(col_(c), f"{_CONSTANT}|{_NUMBER}")


def parse_table(c) -> Column:
    """JSN-02: lexeme-preserving parse to the table struct; NULL unless strictly valid JSON."""
    s = col_(c)
    return F.when(strict_json_ok(s), F.from_json(quote_number_lexemes(s), TABLE_SCHEMA))


def table_block(c) -> Column:
    """TXT-05: the text of the `<table>` block; a ```json fence wins, else newlines are dropped."""
    tab = py_strip(F.substring_index(py_strip(F.substring_index(col_(c), "<table>", -1)), "</table>", 1))
    fenced = py_strip(F.substring_index(F.substring_index(tab, "```json", -1), "```", 1))
    return F.when(tab.contains("```json"), fenced).otherwise(py_strip(F.replace(tab, F.lit("\n"), F.lit(""))))


def repair_table_text(c) -> Column:
    """JSN-01: rationale table text: fence cut, newlines dropped, a missing closing brace appended."""
    s = F.replace(py_strip(F.substring_index(F.substring_index(F.substring_index(col_(c), "```json", -1), "```", 1),
                                             "### Reasoning", 1)), F.lit("\n"), F.lit(""))
    return F.when(s.endswith("}"), s).otherwise(F.concat(s, F.lit("}")))


def has_exact_keys(c, keys=("columns", "rows")) -> Column:
    """SET-04: the top-level key set of a JSON object equals `keys`."""
    k = F.sort_array(F.array_distinct(F.json_object_keys(col_(c))))
    return F.coalesce(k == F.array(*[F.lit(x) for x in sorted(keys)]), F.lit(False))


def sort_ci(arr) -> Column:
    """Stable sort of strings by their lower-case form (`sorted(xs, key=str.lower)`)."""
    tagged = F.transform(col_(arr), lambda x, i: F.struct(F.lower(x).alias("k"), i.alias("i"), x.alias("v")))
    return F.transform(F.sort_array(tagged), lambda s: s["v"])


def sort_rows(rows) -> Column:
    """`array_sort(rows)`, nulls last, without its comparator, which is slow."""
    tagged = F.transform(rows, lambda r: F.struct(r.isNull().alias("none"), r.alias("v")))
    return F.transform(F.sort_array(tagged), lambda s: s["v"])


def with_compare(df: DataFrame, pred: str, gold: str, out: str) -> DataFrame:
    """JSN-06 / RWD-06 core, as staged projections: sorted headers matched
    case-insensitively (0.5 / n pred columns each), cells of sorted rows matched exactly
    (0.5 / n pred rows each). A prediction that runs past the gold (more columns, more
    rows, or a longer row) scores 0 as a whole."""
    p, g = F.col(pred), F.col(gold)
    s = df.withColumns({"_pc": sort_ci(p["columns"]), "_gc": sort_ci(g["columns"]),
                        "_pr": sort_rows(p["rows"]), "_gr": sort_rows(g["rows"])})
    pc, gc, pr, gr = F.col("_pc"), F.col("_gc"), F.col("_pr"), F.col("_gr")
    long_row = F.exists(F.zip_with(pr, gr, lambda a, b: F.coalesce(F.size(a), F.lit(0)) > F.coalesce(F.size(b), F.lit(0))),
                        lambda x: x)
    overrun = (F.size(pc) > F.size(gc)) | (F.size(pr) > F.size(gr)) | F.coalesce(long_row, F.lit(False))
    col_hits = F.size(F.filter(F.zip_with(pc, gc, lambda a, b: F.lower(a) == F.lower(b)), lambda x: F.coalesce(x, F.lit(False))))
    cell_hits = F.aggregate(
        F.zip_with(pr, gr, lambda a, b: F.coalesce(F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y),
                                                                    lambda z: F.coalesce(z, F.lit(False)))), F.lit(0))),
        F.lit(0), lambda acc, x: acc + F.coalesce(x, F.lit(0)))
    score = (F.when(F.size(pc) > 0, F.lit(0.5) * col_hits / F.size(pc)).otherwise(0.0)
             + F.when(F.size(pr) > 0, F.lit(0.5) * cell_hits / F.size(pr)).otherwise(0.0))
    ok = p["columns"].isNotNull() & p["rows"].isNotNull() & g["columns"].isNotNull() & g["rows"].isNotNull()
    return s.withColumn(out, F.when(ok & ~overrun, score).otherwise(F.lit(0.0))).drop("_pc", "_gc", "_pr", "_gr")


def cosine(a, b) -> Column:
    """JSN-09: cosine similarity of two equal-length vectors, NULL on a zero vector."""
    a, b = col_(a), col_(b)
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    na = F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    nb = F.aggregate(b, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    return F.try_divide(dot, F.sqrt(na) * F.sqrt(nb))
