"""Conversation rendering and turn operators (PMT-01..06, PRJ-09).

A conversation is rows `(conv_id, turn, role, text)`. Rendering makes every turn's
piece row-locally (it depends only on the turn's position parity, role and text), and
only concatenates the pieces of one conversation in turn order at the end. A
separator style is a small literal spec; a template names the roles, separators and
default system message.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartq.functions.text import col_
from chartq.operators.ranking import rank_in_group


def render_messages(template: str, text) -> Column:
    """`template.format(text=...)` for a single message."""
    return F.replace(F.lit(template), F.lit("{text}"), col_(text))


@dataclass(frozen=True)
class Style:
    """How a separator style lays out a prompt.

    head: 'sep' = system + sep; 'plain' = system; 'sep_if' = system + sep unless the
    system prompt is empty; 'chatml' = system + sep + newline unless empty; 'sep_if_msg' =
    system + sep only with a system message; 'plain_if_msg'; 'sep2' = system message +
    sep2. mid joins role and text; tails are the separators after even / odd turns (a
    `{sep}` / `{sep2}` slot); empty is what follows the role of an empty turn.
    """
    head: str
    mid: str
    tail_even: str
    tail_odd: str
    empty: str
    squeeze_newlines: bool = False
    # LLAMA2: roles by position parity, and the first message without its role tag
    first_plain: bool = False
    # CHATGLM: a "[Round k]" line before every even message
    rounds: bool = False


# The separator styles.
STYLES = {
    "ADD_COLON_SINGLE": Style("sep", ": ", "{sep}", "{sep}", ":"),
    "ADD_COLON_TWO": Style("sep", ": ", "{sep}", "{sep2}", ":"),
    "ADD_COLON_SPACE_SINGLE": Style("sep", ": ", "{sep}", "{sep}", ": "),
    "ADD_NEW_LINE_SINGLE": Style("sep_if", "\n", "{sep}", "{sep}", "\n"),
    "NO_COLON_SINGLE": Style("plain", "", "{sep}", "{sep}", ""),
    "NO_COLON_TWO": Style("plain", "", "{sep}", "{sep2}", ""),
    "RWKV": Style("plain", ": ", "\n\n", "\n\n", ":", squeeze_newlines=True),
    "CHATML": Style("chatml", "\n", "{sep}\n", "{sep}\n", "\n"),
    "CHATGLM3": Style("plain_if_msg", "\n ", "", "", ""),
    "CHATINTERN": Style("plain", ":", "{sep}\n", "{sep2}\n", ":"),
    "DOLLY": Style("plain", ":\n", "{sep}", "{sep2}\n\n", ":\n"),
    "PHOENIX": Style("plain", ": <s>", "</s>", "</s>", ": <s>"),
    "ROBIN": Style("sep", ":\n", "{sep}", "{sep}", ":\n"),
    "FALCON_CHAT": Style("sep_if_msg", ": ", "{sep}", "{sep}", ":"),
    "INTERNVL_ZH": Style("sep2", ": ", "{sep2}", "{sep}", ":"),
    "MPT": Style("sep", "", "{sep}", "{sep}", ""),
    "LLAMA2": Style("llama2", " ", "{sep}", "{sep2}", "", first_plain=True),
    "CHATGLM": Style("sep_if", "：", "{sep}", "{sep}", "：", rounds=True),
}


@dataclass(frozen=True)
class Template:
    name: str
    style: str
    roles: tuple[str, str] = ("USER", "ASSISTANT")
    system_template: str = "{system_message}"
    system_message: str = ""
    sep: str = "\n"
    sep2: str = ""
    round_base: int = 0


# The registered templates (PMT-02) and two generic ones.
TEMPLATES = {t.name: t for t in [
    Template("internvl_zh", "INTERNVL_ZH", ("<human>", "<bot>"), "", "", "</s>", " "),
    Template("Hermes-2", "MPT", ("<|im_start|>user\n", "<|im_start|>assistant\n"), "<|im_start|>system\n{system_message}",
             "你是由上海人工智能实验室联合商汤科技开发的书生多模态大模型，英文名叫InternVL, 是一个有用无害的人工智能助手。", "<|im_end|>"),
    Template("internlm2-chat", "MPT", ("<|im_start|>user\n", "<|im_start|>assistant\n"), "<|im_start|>system\n{system_message}",
             "你是由上海人工智能实验室联合商汤科技开发的书生多模态大模型，英文名叫InternVL, 是一个有用无害的人工智能助手。", "<|im_end|>"),
    Template("phi3-chat", "MPT", ("<|user|>\n", "<|assistant|>\n"), "<|system|>\n{system_message}",
             "你是由上海人工智能实验室联合商汤科技开发的书生多模态大模型，英文名叫InternVL, 是一个有用无害的人工智能助手。", "<|end|>"),
    Template("internvl2_5", "MPT", ("<|im_start|>user\n", "<|im_start|>assistant\n"), "<|im_start|>system\n{system_message}",
             "你是书生·万象，英文名是InternVL，是由上海人工智能实验室、清华大学及多家合作单位联合开发的多模态大语言模型。", "<|im_end|>\n"),
    Template("chatml", "CHATML", ("<|im_start|>user", "<|im_start|>assistant"), "<|im_start|>system\n{system_message}", "", "<|im_end|>"),
    Template("colon_two", "ADD_COLON_TWO", ("USER", "ASSISTANT"), "{system_message}", "", " ", "</s>"),
    Template("dolly", "DOLLY", ("### Instruction", "### Response"), "{system_message}", "", "\n\n", "### End"),
    Template("llama2", "LLAMA2", ("[INST]", "[/INST]"), "[INST] <<SYS>>\n{system_message}\n<</SYS>>\n\n", "", " ", " </s><s>"),
    Template("chatglm2", "CHATGLM", ("问", "答"), "{system_message}", "", "\n\n", "", 1),
]}


def _left_by_key(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on null-safe keys: a conversation without an id is a conversation like any other."""
    there = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(there, reduce(Column.__and__, same), "left").drop(*[f"_r_{k}" for k in keys])


def _fill(s: str, t: Template) -> str:
    return s.replace("{sep}", t.sep).replace("{sep2}", t.sep2)


def numbered_messages(turns: DataFrame) -> DataFrame:
    """Non-system turns with their 0-based position `i` inside the conversation."""
    msgs = turns.where(F.col("role") != "system").select("conv_id", "turn", "role", "text")
    return rank_in_group(msgs, ["conv_id"], ["turn"], out="i")


def system_messages(turns: DataFrame, default: str) -> DataFrame:
    """The conversation's system message: its last system turn, else the template default."""
    sysm = turns.where(F.col("role") == "system").groupBy("conv_id").agg(F.max_by("text", "turn").alias("sys_text"))
    convs = turns.select("conv_id").distinct()
    return _left_by_key(convs, sysm, ["conv_id"]).select("conv_id", F.coalesce("sys_text", F.lit(default)).alias("system_message"))


def render(turns: DataFrame, template: str) -> DataFrame:
    """PMT-01: one prompt string per conversation, in the template's separator style."""
    t = TEMPLATES[template]
    st = STYLES[t.style]
    m = numbered_messages(turns)
    even = F.col("i") % 2 == 0
    if st.first_plain:
        role = F.when(even, F.lit(t.roles[0])).otherwise(F.lit(t.roles[1]))
    else:
        role = F.when(F.col("role") == "user", F.lit(t.roles[0])).otherwise(F.lit(t.roles[1]))
    text = F.col("text")
    if st.squeeze_newlines:
        text = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\n\n"), F.lit("\n"))
    tail = F.when(even, F.lit(_fill(st.tail_even, t))).otherwise(F.lit(_fill(st.tail_odd, t)))
    full = F.concat(role, F.lit(st.mid), text, tail)
    if st.first_plain:
        full = F.when(F.col("i") == 0, F.concat(text, F.lit(" "))).otherwise(full)
    piece = F.when(F.coalesce(F.length("text"), F.lit(0)) > 0, full).otherwise(F.concat(role, F.lit(st.empty)))
    if st.rounds:
        rnd = F.concat(F.lit("[Round "), (F.floor(F.col("i") / 2) + t.round_base).cast("string"), F.lit("]" + t.sep))
        piece = F.concat(F.when(even, rnd).otherwise(F.lit("")), piece)
    body = (m.select("conv_id", "i", piece.alias("piece")).groupBy("conv_id")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "piece"))), lambda e: e["piece"]), "")
                 .alias("body")))
    sysm = system_messages(turns, t.system_message)
    sp = F.replace(F.lit(t.system_template), F.lit("{system_message}"), F.col("system_message"))
    has_msg = F.length(F.col("system_message")) > 0
    head = {"sep": F.concat(sp, F.lit(t.sep)), "plain": sp,
            "sep_if": F.when(F.length(sp) == 0, F.lit("")).otherwise(F.concat(sp, F.lit(t.sep))),
            "chatml": F.when(F.length(sp) == 0, F.lit("")).otherwise(F.concat(sp, F.lit(t.sep + "\n"))),
            "sep_if_msg": F.when(has_msg, F.concat(sp, F.lit(t.sep))).otherwise(F.lit("")),
            "plain_if_msg": F.when(has_msg, sp).otherwise(F.lit("")),
            "sep2": F.concat(F.col("system_message"), F.lit(t.sep2)),
            "llama2": F.when(has_msg, sp).otherwise(F.lit("[INST] "))}[st.head]
    return _left_by_key(sysm, body, ["conv_id"]).select("conv_id", F.concat(head, F.coalesce("body", F.lit(""))).alias("prompt"))


def turn_pairs(turns: DataFrame, offset: int = 0) -> DataFrame:
    """PMT-03: (user, reply) pairs after `offset` messages; a trailing user turn pairs with NULL."""
    m = numbered_messages(turns).where(F.col("i") >= offset).withColumn("j", F.col("i") - offset)
    first = m.where(F.col("j") % 2 == 0).select("conv_id", F.floor(F.col("j") / 2).cast("int").alias("pair"),
                                               F.col("text").alias("first"))
    second = m.where(F.col("j") % 2 == 1).select("conv_id", F.floor(F.col("j") / 2).cast("int").alias("pair"),
                                                F.col("text").alias("second"))
    return _left_by_key(first, second, ["conv_id", "pair"]).select("conv_id", "pair", "first", "second")


def message_list(turns: DataFrame, default_system: str = "", offset: int = 0) -> DataFrame:
    """PMT-04 / PRJ-09: chat messages in long form (conv_id, pos, role, content): the system
    message first, then user / assistant by position parity after `offset` messages; empty
    assistant turns dropped."""
    m = numbered_messages(turns).where(F.col("i") >= offset).withColumn("j", F.col("i") - offset)
    msgs = m.select("conv_id", (F.col("j") + 1).alias("pos"),
                    F.when(F.col("j") % 2 == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"),
                    F.col("text").alias("content"))
    msgs = msgs.where((F.col("role") == "user") | F.col("content").isNotNull())
    sysm = system_messages(turns, default_system).select("conv_id", F.lit(0).cast("int").alias("pos"),
                                                         F.lit("system").alias("role"), F.col("system_message").alias("content"))
    return sysm.unionByName(msgs.withColumn("pos", F.col("pos").cast("int")))


def append_turn(turns: DataFrame, role: str = "assistant", text: str | None = None) -> DataFrame:
    """PMT-06: add one turn after the last turn of every conversation (text NULL = a slot to
    be filled by generation)."""
    nxt = turns.groupBy("conv_id").agg((F.max("turn") + 1).alias("turn"))
    new = nxt.select("conv_id", "turn", F.lit(role).alias("role"), F.lit(text).cast("string").alias("text"))
    return turns.select("conv_id", "turn", "role", "text").unionByName(new)


def replace_last(turns: DataFrame, text) -> DataFrame:
    """PMT-06: replace the text of each conversation's last turn."""
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("_last"))
    j = _left_by_key(turns, last, ["conv_id"])
    return j.select("conv_id", "turn", "role",
                    F.when(F.col("turn") == F.col("_last"), col_(text)).otherwise(F.col("text")).alias("text"))


def set_system_message(turns: DataFrame, text: str) -> DataFrame:
    """PMT-06: every conversation gets this system message: it takes the place of the first system
    turn, or stands before the first turn; other system turns go."""
    is_system = F.col("role").eqNullSafe("system")
    at = turns.groupBy("conv_id").agg(F.coalesce(F.min(F.when(is_system, F.col("turn"))), F.min("turn") - 1).alias("turn"))
    new = at.select("conv_id", "turn", F.lit("system").alias("role"), F.lit(text).cast("string").alias("text"))
    return turns.where(~is_system).select("conv_id", "turn", "role", "text").unionByName(new)


def template_table(spark):
    """PMT-02: the template registry as a small DataFrame (fixed size, safe to broadcast)."""
    rows = [(i, t.name, t.system_template.replace("{system_message}", t.system_message)) for i, t in enumerate(TEMPLATES.values())]
    return spark.createDataFrame(rows, "template_id int, template string, system_prompt string")


def first_user_turns(turns: DataFrame) -> DataFrame:
    """The first user turn of every conversation."""
    return (turns.where(F.col("role") == "user").groupBy("conv_id")
            .agg(F.min("turn").alias("turn"), F.first("role").alias("role"), F.min_by("text", "turn").alias("text")))


def training_prompt(turns: DataFrame, templates: DataFrame) -> DataFrame:
    """PMT-05 / JN-04: every user turn gets the system prompt of its conversation's template id (a
    lookup join against the registry, a literal table of ten rows) followed by its text. Negative
    ids count from the end of the registry; a conversation without an id takes the first template."""
    n = templates.agg(F.count(F.lit(1))).scalar()     # part of the plan, no job of its own
    tid = F.coalesce(F.pmod(F.col("conv_id"), n), F.lit(0)).cast("int")
    users = turns.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("query"), tid.alias("template_id"))
    j = users.join(F.broadcast(templates), "template_id")
    return j.select("conv_id", "turn", "template", F.concat_ws("\n", "system_prompt", "query").alias("prompt"))


def block_prompts(examples: DataFrame, prompts: DataFrame, default: str = "", block: str = "block_id", query: str = "query") -> DataFrame:
    """PMT-05 / JN-04: each example gets the system prompt of its block id, from a table (block_id, system_prompt) that the user
    supplies, followed by its query (`prompt`). An id that the table lacks, or none, takes `default`; of several prompts with one
    id the smallest text counts. The table's size is measured at run time, so a small one is broadcast and a large one
    shuffled."""
    one = prompts.where(F.col("block_id").isNotNull()).groupBy(F.col("block_id").alias("_b")).agg(F.min("system_prompt").alias("_sys"))
    j = examples.join(one, F.col(block) == F.col("_b"), "left")
    return j.withColumn("prompt", F.concat_ws("\n", F.coalesce("_sys", F.lit(default)), query)).drop("_b", "_sys")
