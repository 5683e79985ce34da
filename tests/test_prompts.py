"""Every separator style: Spark rendering against a plain-Python restatement of the layout."""

import pytest
from pyspark.sql import functions as F

from chartq.operators import prompts as PM


def py_render(t, st, system, msgs):
    """msgs: list of (role_name, text) in order."""
    sp = t.system_template.replace("{system_message}", system)
    fill = lambda s: s.replace("{sep}", t.sep).replace("{sep2}", t.sep2)
    head = {"sep": sp + t.sep, "plain": sp, "sep_if": "" if sp == "" else sp + t.sep,
            "chatml": "" if sp == "" else sp + t.sep + "\n", "sep_if_msg": sp + t.sep if system else "",
            "plain_if_msg": sp if system else "", "sep2": system + t.sep2,
            "llama2": sp if system else "[INST] "}[st.head]
    out = head
    for i, (role, text) in enumerate(msgs):
        if st.first_plain:
            role = t.roles[i % 2]
        if st.rounds and i % 2 == 0:
            out += f"[Round {i // 2 + t.round_base}]{t.sep}"
        if text:
            if st.squeeze_newlines:
                text = text.replace("\r\n", "\n").replace("\n\n", "\n")
            if st.first_plain and i == 0:
                out += text + " "
            else:
                out += role + st.mid + text + fill(st.tail_even if i % 2 == 0 else st.tail_odd)
        else:
            out += role + st.empty
    return out


CONVS = [
    (1, [("system", "be brief"), ("user", "hi\n\nthere"), ("assistant", "hello"), ("user", "q2"), ("assistant", "")]),
    (2, [("user", "only one")]),
    (3, [("user", "a"), ("assistant", "b\r\nc"), ("user", "")]),
]


@pytest.mark.parametrize("style", sorted(PM.STYLES))
def test_style_matches_python(spark, style):
    t = PM.Template("t", style, ("U", "A"), "<sys>{system_message}</sys>", "default sys", "|", "#", 1)
    PM.TEMPLATES["_test"] = t
    try:
        rows = [(cid, k, role, text) for cid, turns in CONVS for k, (role, text) in enumerate(turns)]
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        got = {r.conv_id: r.prompt for r in PM.render(df, "_test").collect()}
    finally:
        del PM.TEMPLATES["_test"]
    st = PM.STYLES[style]
    for cid, turns in CONVS:
        sysm = [x for r, x in turns if r == "system"]
        msgs = [("U" if r == "user" else "A", x) for r, x in turns if r != "system"]
        assert got[cid] == py_render(t, st, sysm[-1] if sysm else "default sys", msgs), (style, cid)


def test_training_prompt_of_every_user_turn(spark):
    rows = [(1, 0, "system", "be brief"), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (1, 3, "user", "c"), (1, 5, "user", "d"),
            (-1, 0, "user", "e"), (None, 0, "user", "f"), (2, 0, "assistant", "g")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    tpl = spark.createDataFrame([(0, "t0", "s0"), (1, "t1", "s1"), (2, "t2", "s2")], "template_id int, template string, system_prompt string")
    got = {(r.conv_id, r.turn, r.template, r.prompt) for r in PM.training_prompt(turns, tpl).collect()}
    assert got == {(1, 1, "t1", "s1\na"), (1, 3, "t1", "s1\nc"), (1, 5, "t1", "s1\nd"), (-1, 0, "t2", "s2\ne"), (None, 0, "t0", "s0\nf")}


def test_message_list_offset(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (1, 3, "user", "c"), (1, 4, "assistant", None), (2, 0, "user", "d")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = lambda **k: sorted((r.conv_id, r.pos, r.role, r.content) for r in PM.message_list(turns, **k).collect())
    assert got(offset=1) == [(1, 0, "system", "s"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (1, 3, "user", None), (2, 0, "system", "")]
    assert got(offset=2) == [(1, 0, "system", "s"), (1, 1, "user", "c"), (2, 0, "system", "")]


def test_set_system_message(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "a"), (1, 2, "system", "t"), (2, 0, "user", "d"), (None, 4, "user", "e")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    new = PM.set_system_message(turns, "new")
    assert {tuple(r) for r in new.collect()} == {(1, 0, "system", "new"), (1, 1, "user", "a"), (2, -1, "system", "new"), (2, 0, "user", "d"),
                                                 (None, 3, "system", "new"), (None, 4, "user", "e")}
    assert {r.system_message for r in PM.system_messages(new, "").where("conv_id = 1").collect()} == {"new"}


def test_a_conversation_without_an_id_keeps_its_rows(spark):
    turns = spark.createDataFrame([(None, 0, "system", "sys"), (None, 1, "user", "q"), (None, 2, "assistant", "a"), (7, 0, "user", "z")],
                                  "conv_id long, turn int, role string, text string")
    last = {(r.conv_id, r.turn): r.text for r in PM.replace_last(turns, F.lit("new")).collect()}
    assert last == {(None, 0): "sys", (None, 1): "q", (None, 2): "new", (7, 0): "new"}
    pairs = {(r.conv_id, r.pair): (r["first"], r.second) for r in PM.turn_pairs(turns).collect()}
    assert pairs == {(None, 0): ("q", "a"), (7, 0): ("z", None)}
    prompts = {r.conv_id: r.prompt for r in PM.render(turns, next(iter(PM.TEMPLATES))).collect()}
    assert "sys" in prompts[None] and "a" in prompts[None]


def test_prompts_by_block_id(spark):
    examples = spark.createDataFrame([(1, 3, "q1"), (2, None, "q2"), (3, 9, "q3")], "i int, block_id long, query string")
    prompts = spark.createDataFrame([(3, "b"), (3, "a"), (None, "x"), (4, "y")], "block_id long, system_prompt string")
    assert {r.i: r.prompt for r in PM.block_prompts(examples, prompts, "d").collect()} == {1: "a\nq1", 2: "d\nq2", 3: "d\nq3"}
