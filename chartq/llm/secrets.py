"""Secret scans in DataFrame functions only: patterns, then a randomness test battery over other tokens.

Base spans come from three patterns (assignments, access keys, hex runs) over the whole text. The method
adds spans: every other maximal token of `[A-Za-z0-9+/_=-]` with `MIN_TOKEN` or more characters gets an inferred
encoding (hex, also in groups; base32 and base36 of one case; alphanumeric, base64, base64url) and three tests over its symbols:

* chi-squared uniformity over the alphabet of the encoding,
* the runs test over symbol kinds (lower case, upper case, digit, other),
* serial correlation of neighbouring symbols' alphabet positions.

A token is random-looking if no test rejects the uniform source (Bonferroni at `REJECT`). Short tokens pass
that easily, so ordinary text needs to be ruled out as well: under ordinary words the number of
equal symbol pairs (the chi-squared statistic's other direction) is high and changes of kind are rare. Both give
a p-value that grows sharper with the token's length, combined by Fisher's method; discoveries are then
controlled at rate `FDR` by the Benjamini-Hochberg rule within each class of encoding and length (length-aware:
many short tokens do not spend the error budget of the long ones). The rule needs only the count of tokens
per class and p-value bin, a table of fixed size, so no task sees the tokens of a class together.

Positions are code points, end exclusive. Positions of regex matches are lengths of the texts between
matches: each extraction also consumes the gap before its match, and the tail, in one pass.

Edge cases: a null text is empty and has no spans; spans of different kinds may overlap, added ones never overlap
base ones; repeated rows are scanned like any other; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns and the lengths below which a match is dropped.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex")

TOKEN = r"[A-Za-z0-9+/_=-]"
MIN_TOKEN = 20
REJECT = 0.001            # level at which the uniform source is rejected
FDR = 0.01
SAME = 0.065              # chance that two letters of ordinary text are equal
SAME_SPREAD = 0.002       # variance of their count beyond the binomial one, per cubed length
CHANGE = 0.12             # chance that neighbouring symbols of an ordinary token differ in kind
P_BINS = 60               # p-value bins: powers of two down to 2 ** -60
LENGTHS = (24, 32, 40, 48, 64, 96, 128, 256, 512)   # lower ends of the length classes above the first

# The smallest alphabet that a token fits; hyphens of grouped hex (as in UUIDs) are no symbols.
ENCODINGS = (("hex", "^[0-9a-fA-F]+$", 16), ("hexgroups", "^[0-9a-fA-F]+(?:-[0-9a-fA-F]+)+$", 16),
             ("base32", "^(?:[A-Z2-7]+|[a-z2-7]+)=*$", 32), ("base36", "^(?:[A-Z0-9]+|[a-z0-9]+)$", 36), ("alnum", "^[A-Za-z0-9]+$", 62),
             ("base64", "^[A-Za-z0-9+/]+=*$", 64), ("base64url", "^[A-Za-z0-9_-]+=*$", 64))
_SYMBOLS = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_-="

_FOUND = "array<struct<start:bigint,order:int,kind:string,end:bigint,value:string>>"
_CHUNK = 256              # matches of one text whose positions are added up at a time


def _span(start: Column, order: Column, kind: Column, end: Column, value: Column) -> Column:
    return F.struct(start.cast("bigint").alias("start"), order.alias("order"), kind.alias("kind"), end.cast("bigint").alias("end"), value.alias("value"))


def _located(text: Column, pattern: str, value: int, guard: str, order: int, kind: str) -> Column:
    """Matches of `pattern` as (start, order, kind, end, value); `value` is the number of the value's group,
    where 2 is the whole match and the pattern's own groups follow.

    One alternative takes the gap and the match, the other the tail, so each scan is a single pass.
    Positions are running sums of lengths, within chunks of matches first and then over the chunks.
    """
    whole = F.lit(rf"(?s)(.*?)(?:({pattern})|\z)")
    none = F.array().cast(_FOUND)
    parts = F.arrays_zip(*[F.regexp_extract_all(text, whole, F.lit(g)).alias(n) for n, g in (("gap", 1), ("hit", 2), ("value", value))])

    def step(acc, p):
        start = acc["at"] + F.length(p["gap"])
        end = start + F.length(p["hit"])
        one = _span(start, F.lit(order), F.lit(kind), end, p["value"])
        return F.struct(end.cast("bigint").alias("at"), F.when(p["hit"] == "", acc["found"]).otherwise(F.concat(acc["found"], F.array(one))).alias("found"))

    def shift(acc, c):
        moved = F.transform(c["found"], lambda s: _span(s["start"] + acc["at"], s["order"], s["kind"], s["end"] + acc["at"], s["value"]))
        return F.struct((acc["at"] + c["at"]).alias("at"), F.concat(acc["found"], moved).alias("found"))

    zero = F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("found"))
    cut = F.filter(parts, lambda p: (p["gap"] != "") | (p["hit"] != ""))
    chunks = F.transform(F.array(cut), lambda all_: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / _CHUNK).cast("int")), lambda i: F.slice(all_, i * _CHUNK + 1, F.lit(_CHUNK))))[0]
    sums = F.transform(chunks, lambda c: F.aggregate(c, zero, step))
    return F.when(text.rlike(guard), F.aggregate(sums, zero, shift, lambda acc: acc["found"])).otherwise(none)


def _without_value(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["order"].alias("order"), s["kind"].alias("kind"), s["end"].alias("end")))


def _runs(text: Column, chars: str, least: int, order: int, kind: str) -> Column:
    """Maximal runs of a character class with at least `least` characters."""
    return _located(text, rf"{chars}{{{least},}}+", 2, rf"{chars}{{{least}}}", order, kind)


def base_spans(docs: DataFrame, text: Column) -> DataFrame:
    """`docs` as struct `row`, `t` (the whole text, null as empty) and the base spans `base`, by start and kind."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), t.alias("t"))
    c = F.col("t")
    assign = F.filter(_located(c, ASSIGN, 4, r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]""", 0, "assign"),
                      lambda s: F.length(s["value"]) >= 6)
    access = F.filter(_located(c, ACCESS, 2, r"AKIA[A-Z0-9]", 1, "access"), lambda s: s["end"] - s["start"] >= 20)
    hexes = _runs(c, "[0-9a-f]", 24, 2, "hex")
    spans = F.array_sort(F.concat(*[_without_value(x) for x in (assign, access, hexes)]))
    return packed.select("row", "t", spans.alias("base"))


def _normal_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal: the usual rational approximation, extended by its asymptotic form."""
    x = F.abs(z)
    k = 1 / (1 + 0.2316419 * x)
    poly = k * (0.319381530 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429))))
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _neighbours(a: Column) -> Column:
    return F.zip_with(F.slice(a, 1, F.size(a) - 1), F.slice(a, 2, F.size(a)), lambda x, y: F.struct(x.alias("x"), y.alias("y")))


def _square(x: Column) -> Column:
    return x * x


def _total(a: Column, fn) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + fn(x))


def battery(tokens: Column) -> Column:
    """Token spans with encoding, length class, `p_uniform` and `p_ordinary`, as array of structs.

    Every step is a `transform` over the tokens that adds what the next one reads.
    """
    def encoded(s):
        enc, size = F.lit("mixed"), F.lit(66.0)
        for name, pattern, k in reversed(ENCODINGS):
            enc = F.when(s["value"].rlike(pattern), F.lit(name)).otherwise(enc)
            size = F.when(s["value"].rlike(pattern), F.lit(float(k))).otherwise(size)
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), enc.alias("enc"), size.alias("k"), s["value"].alias("value"))

    def symbols(s):
        body = F.regexp_replace(s["value"], "=+$", "")
        body = F.when(s["enc"].isin("hex", "hexgroups"), F.lower(F.replace(body, F.lit("-"), F.lit("")))).otherwise(body)
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["enc"].alias("enc"), s["k"].alias("k"),
                        F.filter(F.split(body, ""), lambda c: c != "").alias("sym"))

    def kind_of(c):
        return F.when(c.between("a", "z"), 0).when(c.between("A", "Z"), 1).when(c.between("0", "9"), 2).otherwise(3)

    def counted(s):
        n = F.greatest(F.size(s["sym"]), F.lit(2)).cast("double")
        square = _total(F.array_distinct(s["sym"]), lambda c: _square(F.size(F.filter(s["sym"], lambda x: x == c)).cast("double")))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["enc"].alias("enc"), s["k"].alias("k"), n.alias("n"), square.alias("o2"),
                        F.transform(s["sym"], lambda c: F.instr(F.lit(_SYMBOLS), c).cast("double")).alias("v"), F.transform(s["sym"], kind_of).alias("c"))

    def summed(s):
        same = _total(F.array(*[F.lit(i) for i in range(4)]), lambda i: _square(F.size(F.filter(s["c"], lambda x: x == i)) / s["n"]))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["enc"].alias("enc"), s["k"].alias("k"), s["n"].alias("n"), s["o2"].alias("o2"),
                        s["v"].alias("v"), (_total(s["v"], lambda v: v) / s["n"]).alias("mean"), same.alias("same"),
                        _total(_neighbours(s["c"]), lambda p: F.when(p["x"] != p["y"], 1.0).otherwise(0.0)).alias("changes"))

    def moments(s):
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["enc"].alias("enc"), s["k"].alias("k"), s["n"].alias("n"), s["o2"].alias("o2"),
                        s["same"].alias("same"), s["changes"].alias("changes"), _total(s["v"], lambda v: _square(v - s["mean"])).alias("var"),
                        _total(_neighbours(s["v"]), lambda p: (p["x"] - s["mean"]) * (p["y"] - s["mean"])).alias("cov"))

    def scored(s):
        n, k = s["n"], s["k"]
        chi = s["o2"] * k / n - n
        z_chi = (chi - (k - 1)) / F.sqrt(2 * (k - 1) * (1 - 1 / n))
        expect = (n - 1) * (1 - s["same"])
        z_runs = F.abs(s["changes"] - expect) / F.sqrt(F.greatest((n - 1) * s["same"] * (1 - s["same"]), F.lit(0.25)))
        z_serial = F.when(s["var"] > 0, F.abs(s["cov"] / s["var"] + 1 / n)).otherwise(F.lit(1.0)) * F.sqrt(n)
        pairs = n * (n - 1) / 2
        z_equal = (pairs * SAME - (s["o2"] - n) / 2) / F.sqrt(pairs * SAME * (1 - SAME) + n * n * n * SAME_SPREAD)
        z_change = (s["changes"] - (n - 1) * CHANGE) / F.sqrt((n - 1) * CHANGE * (1 - CHANGE))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["enc"].alias("enc"),
                        sum(F.when(n >= x, 1).otherwise(0) for x in LENGTHS).alias("len"),
                        (F.least(_normal_tail(z_chi), 2 * _normal_tail(z_runs), 2 * _normal_tail(z_serial)) * 3).alias("p_uniform"),
                        (_normal_tail(z_equal)).alias("p1"), _normal_tail(z_change).alias("p2"))

    def combined(s):  # Fisher: the chi-squared tail with four degrees of freedom
        both = F.greatest(s["p1"], F.lit(1e-15)) * F.greatest(s["p2"], F.lit(1e-15))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat_ws(":", s["enc"], s["len"].cast("string")).alias("cls"),
                        s["p_uniform"].alias("p_uniform"), _bin(both * (1 - F.log(both))).alias("bin"))

    for fn in (encoded, symbols, counted, summed, moments, scored, combined):
        tokens = F.transform(tokens, fn)
    return tokens


def _bin(p: Column) -> Column:
    """Bin i holds p in (2 ** -(i + 1), 2 ** -i]; the last bin holds all below."""
    return F.least(F.floor(-F.log2(F.least(p, F.lit(1.0)))).cast("int"), F.lit(P_BINS))


def thresholds(tested: DataFrame) -> DataFrame:
    """Benjamini-Hochberg per class of encoding and length over binned p-values: `cls` and its smallest accepted bin.

    A bin's upper end stands for its p-values, so the rate is never exceeded. Every class has at most
    P_BINS + 1 rows, whatever the input.
    """
    counts = tested.groupBy("cls", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("p_uniform") > REJECT).cast("long")).alias("r"))
    per_class = counts.groupBy("cls").agg(F.sum("n").alias("m"), F.collect_list(F.struct("bin", "r")).alias("bins"))

    def passes(b):
        found = F.aggregate(F.filter("bins", lambda o: o["bin"] >= b["bin"]), F.lit(0).cast("bigint"), lambda acc, o: acc + o["r"])
        return F.pow(F.lit(2.0), -b["bin"].cast("double")) * F.col("m") <= FDR * found

    ok = F.transform(F.filter("bins", passes), lambda b: b["bin"])
    return per_class.select("cls", F.array_min(ok).alias("bin")).where("bin is not null")


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Each input row as struct `row`, the text `t`, base spans `base` and added spans `added` (both sorted)."""
    based = base_spans(docs, F.col(text))
    free = F.filter(_runs(F.col("t"), TOKEN, MIN_TOKEN, 3, "random"),
                    lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    tested = based.withColumn("tested", battery(free))
    cut = thresholds(tested.select(F.explode("tested").alias("s")).select("s.*"))
    # one row: a map with at most (encodings + 1) * (length classes + 1) entries
    limits = cut.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("cls", "bin"))).alias("limits")).scalar()
    judged = tested.withColumn("limits", limits)
    added = F.filter("tested", lambda s: (s["p_uniform"] > REJECT) & (s["bin"] >= F.try_element_at("limits", s["cls"])))
    named = F.transform(added, lambda s: F.struct(s["start"].alias("start"), F.lit(3).alias("order"), F.lit("random").alias("kind"), s["end"].alias("end")))
    return judged.select("row", "t", "base", F.coalesce(named, F.array().cast("array<struct<start:bigint,order:int,kind:string,end:bigint>>")).alias("added"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined in the order given."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """`docs` with every span (overlapping ones as one) replaced by `mark`; n_chars follows where that column exists."""
    found = scan(docs, text)
    spans = F.array_sort(F.concat("base", "added"))

    def step(acc, s):
        piece = F.array(F.substring(F.col("t"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                        F.when(s["start"] >= acc["at"], F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))
    new = F.aggregate(spans, zero, step, lambda acc: F.array_join(F.concat(acc["out"], F.array(F.substring(F.col("t"), (acc["at"] + 1).cast("int"), F.length("t")))), ""))
    any_ = F.size(spans) > 0
    done = found.select("row", any_.alias("any"), F.when(any_, new).otherwise(F.col("row")[text]).alias("new"))
    cols = []
    for c in docs.columns:
        v = F.col(f"row.`{c}`")
        if c == text:
            v = F.col("new")
        elif c == "n_chars":
            v = F.when(F.col("any"), F.length("new").cast(docs.schema[c].dataType)).otherwise(v)
        cols.append(v.alias(c))
    return done.select(*cols)
