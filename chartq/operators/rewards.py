"""Rule-based rewards over tagged completions (RWD-01..09) and the reward registry.

Each reward is a Column expression, so all of them are evaluated in one `select`
over the completions: one pass, no shuffle, and the shared tag cuts are computed
once by subexpression elimination. They work unchanged on streaming DataFrames.
A user adds a reward by registering `name -> fn(**columns) -> Column`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartq.functions import jsontab as J
from chartq.functions.numeric import round4, to_float
from chartq.functions.text import col_, count_occurrences, step_count, strip_trailing_dots, tag_cut

# The completion layout the format reward accepts, and the ten tag
# patterns that must each occur exactly once.
FORMAT_PATTERN = r"\A<think>\n<type>.*?</type>\n<table>.*?</table>.*?</think>\n<answer>.*?</answer>$"
TOKEN_PATTERNS = ("<type>", "</type>", "<think>", "</think>", "<answer>", "</answer>", "<table>", "</table>",
                  "<think>\n<type>", "</type>\n<table>")


def format_reward(completion="completion", **_) -> Column:
    """RWD-01: 2.0 when the completion starts with the think/type/table/answer layout.
    `(?d)` keeps `$` to `\\n` line ends, as in Python's multiline mode."""
    return F.when(F.coalesce(col_(completion).rlike("(?smd)" + FORMAT_PATTERN), F.lit(False)), 2.0).otherwise(0.0)


def num_token_reward(completion="completion", **_) -> Column:
    """RWD-04: 2.0 when each of the ten patterns occurs exactly once."""
    c = col_(completion)
    ok = F.lit(True)
    for p in TOKEN_PATTERNS:
        ok = ok & (count_occurrences(c, p) == 1)
    return F.when(F.coalesce(ok, F.lit(False)), 2.0).otherwise(0.0)


def answer_text(completion="completion") -> Column:
    """The `<answer>` cut with all trailing dots removed; NULL without both tags."""
    c = col_(completion)
    return F.when(c.contains("<answer>") & c.contains("<think>"),
                  strip_trailing_dots(tag_cut(c, "<answer>", "</answer>")))


def accuracy_reward(completion="completion", label="label", compat: bool = False, **_) -> Column:
    """RWD-02: numeric gold → relative error against gold + 1e-6 within 5 %; text gold →
    case-insensitive equality; a numeric gold with a non-numeric answer scores 0.
    The reference divides by the signed gold (quirk Q6); `compat=True` keeps that."""
    a, lab = answer_text(completion), col_(label)
    return _accuracy(a, lab, to_float(lab), to_float(a), compat)


def _accuracy(a: Column, lab: Column, gf: Column, af: Column, compat: bool = False) -> Column:
    s = gf + F.lit(1e-6)
    rel = F.try_divide(F.abs(af - s), s if compat else F.abs(s))
    numeric = F.when(af.isNull(), F.lit(False)).otherwise(F.coalesce(rel <= F.lit(0.05), F.lit(False)))
    ok = F.when(F.length(a) == 0, F.lit(False)).when(gf.isNotNull(), numeric).otherwise(F.lower(lab) == F.lower(a))
    return F.when(F.coalesce(ok, F.lit(False)), 1.0).otherwise(0.0)


def rationale_text(completion="completion") -> Column:
    return tag_cut(completion, "<think>", "</think>")


def length_think_reward(completion="completion", **_) -> Column:
    """RWD-03: 1.0 for a rationale of 71..250 characters, plus 0.25 per `<step-` piece (max 1.5)."""
    r = rationale_text(completion)
    n = F.length(r)
    return (F.when((n > 70) & (n <= 250), 1.0).otherwise(0.0)
            + F.least(F.lit(0.25) * step_count(r), F.lit(1.5)))


def chart_type_reward(completion="completion", chart_type="chart_type", **_) -> Column:
    """RWD-05: 1.0 when the `<type>` cut equals the gold chart type, case-insensitively."""
    t = F.lower(tag_cut(completion, "<type>", "</type>"))
    return F.when(F.coalesce(t == F.lower(col_(chart_type)), F.lit(False)), 1.0).otherwise(0.0)


def table_style_reward(completion="completion", gold_table="gold_table", **_) -> Column:
    """RWD-06: +0.5 strict JSON, + header/cell matches (JSN-06), +0.25 exact key set.
    A row whose table does not parse scores 0 (the reference reuses the previous row's
    table there, quirk Q5). Expects the staged columns of `with_table_parts`."""
    return F.col("_tab_reward")


def with_table_parts(df: DataFrame, completion="completion", gold_table="gold_table") -> DataFrame:
    """Stage the table reward over projections so that each table is cut, validated, parsed
    and sorted once per row (an inlined struct would be re-parsed at every reference)."""
    s1 = df.withColumn("_tab_block", J.table_block(completion))
    s2 = s1.withColumns({"_tab_ok": J.strict_json_ok("_tab_block"),
                         "_tab_gold": J.parse_table(gold_table)})
    s3 = s2.withColumns({"_tab_pred": F.when(F.col("_tab_ok"), F.from_json(J.quote_number_lexemes("_tab_block"), J.TABLE_SCHEMA)),
                         "_tab_keys": F.when(F.col("_tab_ok"), J.has_exact_keys("_tab_block"))})
    s4 = J.with_compare(s3, "_tab_pred", "_tab_gold", "_tab_cmp")
    ok = F.col("_tab_ok")
    reward = (F.when(ok, 0.5).otherwise(0.0)
              + F.when(ok & F.col("_tab_gold").isNotNull(), F.col("_tab_cmp")).otherwise(0.0)
              + F.when(ok & F.col("_tab_keys"), 0.25).otherwise(0.0))
    return s4.withColumn("_tab_reward", reward).drop("_tab_block", "_tab_ok", "_tab_keys", "_tab_gold", "_tab_pred", "_tab_cmp")


def with_answer_parts(df: DataFrame, completion="completion", label="label") -> DataFrame:
    """The answer cut and both parsed numbers in projections of their own, so that the branches of the accuracy
    reward read columns instead of cutting and parsing again."""
    s = df.withColumns({"_acc_a": answer_text(completion), "_acc_l": col_(label)})
    return s.withColumns({"_acc_gf": to_float("_acc_l"), "_acc_af": to_float("_acc_a")})


def process_style_reward(pred_embedding="e1", gold_embedding="e2", **_) -> Column:
    """RWD-07: cosine of the (given) embeddings of the predicted steps and the gold reasoning."""
    return J.cosine(pred_embedding, gold_embedding)


REWARDS: dict[str, Callable[..., Column]] = {
    "format": format_reward,
    "accuracy": accuracy_reward,
    "length": length_think_reward,
    "tokens": num_token_reward,
    "chart_type": chart_type_reward,
    "table": table_style_reward,
    "process": process_style_reward,
}
# the rewards that read the completion alone; `process` also needs the two embeddings
RULES = ("format", "accuracy", "length", "tokens", "chart_type", "table")


def register_reward(name: str, fn: Callable[..., Column]) -> None:
    REWARDS[name] = fn


def score(df: DataFrame, names=None, **columns) -> DataFrame:
    """RWD-08: all seven rewards and their sum; a reward that is null (no embedding) adds nothing."""
    names = list(names or REWARDS)
    if "accuracy" in names and REWARDS["accuracy"] is accuracy_reward:
        df = with_answer_parts(df, **{k: v for k, v in columns.items() if k in ("completion", "label")})
    if "table" in names:
        df = with_table_parts(df, **{k: v for k, v in columns.items() if k in ("completion", "gold_table")})
    def one(name):
        if name == "accuracy" and REWARDS[name] is accuracy_reward:
            return _accuracy(F.col("_acc_a"), F.col("_acc_l"), F.col("_acc_gf"), F.col("_acc_af"), columns.get("compat", False))
        return REWARDS[name](**columns)

    out = df.select("*", *[one(n).alias(f"r_{n}") for n in names]).drop("_tab_reward", "_acc_a", "_acc_l", "_acc_gf", "_acc_af")
    return with_total(out, names)


def with_total(df: DataFrame, names=None) -> DataFrame:
    """RWD-08: the sum of scored rewards; one that is null (no embedding) adds nothing."""
    return df.withColumn("r_total", sum((F.coalesce(F.col(f"r_{n}"), F.lit(0.0)) for n in names or REWARDS), F.lit(0.0)))


def summary(scored: DataFrame, keys=("dataset", "chart_type"), names=None) -> DataFrame:
    """RWD-09: mean of each reward per key (partial aggregation, one shuffle)."""
    names = list(names or REWARDS) + ["total"]
    return scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"),
                                     *[round4(F.avg(f"r_{n}")).alias(f"avg_{n}") for n in names])
