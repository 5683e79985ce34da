"""Preference pairs (PRF-01..05).

Hard negatives are an `explode` of the OCR tokens of each row: the work per row is
bounded by that row's own text, and the whole text is always used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartq.functions.text import fill_template, remove_special, whitespace_tokens
from chartq.operators.prompts import render_messages


def base_pairs(df: DataFrame, keys=("conv_id", "turn")) -> DataFrame:
    """PRF-01: (question, label, predicted) as given."""
    return df.select(*keys, "question", "label", "predicted", F.lit("model").alias("source"),
                     F.lit(-1).alias("tok_pos"))


def hard_negatives(df: DataFrame, ocr_text: str = "predicted", keys=("conv_id", "turn")) -> DataFrame:
    """PRF-02: every whitespace token of the OCR text that is not the gold label
    (case-insensitively) becomes a rejected answer, cleaned to letters, digits and spaces;
    unioned with the base pairs."""
    toks = df.select(*keys, "question", "label", F.posexplode(whitespace_tokens(ocr_text)).alias("tok_pos", "tok"))
    neg = (toks.where(F.lower("tok") != F.lower("label"))
           .select(*keys, "question", "label", remove_special("tok").alias("predicted"), F.lit("ocr").alias("source"),
                   F.col("tok_pos").cast("int").alias("tok_pos")))
    return base_pairs(df, keys).unionByName(neg)


# A ChatML-like stand-in (not a fixed value) for the model processor's chat template.
CHAT_TEMPLATE = {"user": "<|im_start|>user\n<image>{text}<|im_end|>\n",
                 "assistant": "<|im_start|>assistant\n{text}<|im_end|>\n"}


def pref_records(pairs: DataFrame, keys=("conv_id", "turn", "source", "tok_pos")) -> DataFrame:
    """PRF-03: prompt / chosen / rejected strings."""
    return pairs.select(*keys,
                        render_messages(CHAT_TEMPLATE["user"], "question").alias("prompt"),
                        render_messages(CHAT_TEMPLATE["assistant"], "label").alias("chosen"),
                        render_messages(CHAT_TEMPLATE["assistant"], "predicted").alias("rejected"))


# The prompt and the reply of the reasoning form, white space included.
COT_PROMPT = (
    "Look at the chart. Think step-by-step based on the question and chart. \n "
    "                Generate a reasoning chain first and output it as Reason. \n "
    "                In the next line, answer the question with a single word only without units or symbols.\n "
    "                Format:  "
    "                ### Question: {question} "
    "                ### Reason: "
    "                step-1 ... "
    "                step-2 ... "
    "                ...."
    "                step-n ... "
    "                ### Answer: \n")
COT_REPLY = (
    "### Reason: "
    "                           step-1: {step1}.\nstep-2: {step2}.\n "
    "                           ###Answer: {answer}")


def cot_pairs(qa: DataFrame, keys=("chart_id", "qid")) -> DataFrame:
    """PRF-04: prompt, chosen and rejected in the reason-then-answer form; a missing answer reads `None`."""
    def reply(steps: str, answer: str):
        return fill_template(COT_REPLY, step1=F.get(steps, 0), step2=F.get(steps, 1), answer=F.coalesce(F.col(answer), F.lit("None")))

    return qa.select(*keys, fill_template(COT_PROMPT, question=F.col("question")).alias("prompt"),
                     reply("answer_rationale", "label").alias("chosen"), reply("not_answer_rationale", "not_answer").alias("rejected"))


def seeded_order(seed: int | str, *key_cols) -> F.Column:
    """SMP-01: a portable seeded shuffle key, `md5(seed:key...)` (same value in any engine)."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in key_cols]))


def pref_mix(a: DataFrame, b: DataFrame, seed: int, n_eval: int, key_cols) -> DataFrame:
    """PRF-05: union of two preference sets, shuffled by a seeded key; the first `n_eval`
    rows of the shuffle are the evaluation split, the rest train (disjoint, quirk Q13)."""
    u = a.unionByName(b, allowMissingColumns=True)
    from chartq.operators.curate import split_by_rank
    # the seeded key is computed where it is compared: stored, it would be as long as a short row
    return split_by_rank(u, [seeded_order(seed, *key_cols), *key_cols], [("eval", n_eval)], rest="train")
