"""Logs, traces, CSV tables and JSON arrays larger than a split give the same rows as small files."""

import csv
import json
import os
import random
import tempfile

import pytest

from chartq.sources import framing, jsonarray
from chartq.sources import readers as RD


@pytest.fixture()
def tmp():
    return tempfile.mkdtemp(prefix="chartq-test-")


@pytest.fixture(params=[89, 1 << 27])
def split(spark, request):
    """The largest split in bytes: files of the tests are cut at many places, or not at all."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    old = {n: spark.conf.get(n) for n in names}
    for n, v in zip(names, (request.param, 1)):
        spark.conf.set(n, str(v))
    yield request.param
    for n, v in old.items():
        spark.conf.set(n, v)


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)


def test_logs_of_one_large_file_or_many(spark, tmp, split):
    rng = random.Random(7)
    said = ["".join(rng.choice(["a", "é漢", "#", "##", "######", "\n", "\r\n", " ", "x" * 40]) for _ in range(rng.randint(0, 9))) for _ in range(24)]
    texts = {"run=r1/a": "#####".join(said), "run=r2/a": "#####".join(said[:9]) + "#####", "run=r2/b": "tail only", "run=r2/c": "", "run=r2/d": "#####".join(said[9:])}
    for name, text in texts.items():
        _write(f"{tmp}/{name}.txt", text)
    want = {}
    for name in sorted(texts):
        want.setdefault(name[4:6], []).extend(texts[name].split("#####")[:-1])
    got = {}
    for r in RD.read_logs(spark, tmp, ["run"]).orderBy("run", "pos").collect():
        assert r["pos"] == len(got.setdefault(r["run"], []))
        got[r["run"]].append(r["piece"])
    assert got == want


def test_separators_are_literal(spark, tmp):
    _write(f"{tmp}/k=1/a.txt", "a.b\\Ec..\\Ed.\\E")
    rows = framing.separated(spark, tmp, ["k"], ".\\E").orderBy("pos").collect()
    assert [r["piece"] for r in rows] == ["a.b\\Ec.", "d"]
    with pytest.raises(ValueError):
        framing.separated(spark, tmp, ["k"], "a\nb")


def test_traces_over_splits_and_files(spark, tmp, split):
    records = [([f"p{i}", "it's"], [f"l{i}", "a\\b"], [f"R{i}", 'say "x"'], i / 64, i / 32) for i in range(16)]
    lines = [x for p, lab, r, em, ra in records for x in (repr(p), repr(lab), repr(r), f"EM:  {em}", f"Relaxed Accuracy:  {ra}", "BLEU Score:  0.0")]
    _write(f"{tmp}/run=a/1.out", "\n".join(lines[:40]) + "\n")       # a record goes on in the next file
    _write(f"{tmp}/run=a/2.out", "\n".join(lines[40:]))              # no line feed at the end
    _write(f"{tmp}/run=b/1.out", "\n".join(lines) + "\n")
    got = RD.read_traces(spark, tmp, ["run"]).orderBy("run", "batch").collect()
    assert [(r["run"], r["batch"], r["preds"], r["labels"], r["raws"], r["em"], r["ra"], r["bleu"]) for r in got] == [
        (run, i, *rec, 0.0) for run in "ab" for i, rec in enumerate(records)]


def test_csv_cells_with_line_breaks_quotes_and_commas(spark, tmp, split):
    rng = random.Random(3)
    cell = lambda: "".join(rng.choice(["a", "b c", '"', ",", "\n", "\r\n", "é", " ", ";", "\\", "'", "\t"]) for _ in range(rng.randint(0, 12)))
    tables = {f"t{i}": [["name", 'the "value"', "line\nbreak, too"]] + [[f"r{j}", cell(), cell()] for j in range(n)] for i, n in enumerate((0, 1, 12, 30))}
    for name, rows in tables.items():
        with open(f"{tmp}/{name}.csv", "w", encoding="utf-8", newline="") as f:
            csv.writer(f, lineterminator="\r\n" if name == "t2" else "\n").writerows(rows)
    got = sorted((r.chart_id, r.row_idx, r.col_idx, r.col_name, r.cell) for r in RD.read_table_dir(spark, tmp).collect())
    assert got == sorted((t, i, c, rows[0][c], v) for t, rows in tables.items() for i, row in enumerate(rows[1:]) for c, v in enumerate(row))


def test_csv_blank_lines_short_and_long_records(spark, tmp):
    _write(f"{tmp}/t.csv", "\n \na,b\n\n1\n\t\n2,3,4\n,\n\"\n\n\",5\n")
    got = sorted((r.row_idx, r.col_name, r.cell) for r in RD.read_table_dir(spark, tmp).collect())
    assert got == [(0, "a", "1"), (0, "b", ""), (1, "a", "2"), (1, "b", "3"), (2, "a", ""), (2, "b", ""), (3, "a", "\n\n"), (3, "b", "5")]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_chunks_end_inside_records(spark, tmp, monkeypatch):
    """Records over several chunks; whole records are not shuffled: text goes over an exchange at the ends of chunks only."""
    monkeypatch.setattr(framing, "CHUNK", 40)
    rng = random.Random(5)
    said = ["".join(rng.choice(["a", "#", "\n", "x" * 30, "é"]) for _ in range(rng.randint(0, 8))) for _ in range(30)]
    _write(f"{tmp}/logs/k=1/a.txt", "#####".join(said) + "#####")
    rows = RD.read_logs(spark, f"{tmp}/logs", ["k"])
    assert [r["piece"] for r in rows.orderBy("pos").collect()] == ("#####".join(said) + "#####").split("#####")[:-1]
    cells = [["n", "v"], *[[f"r{i}", "".join(rng.choice(["a", '"', "\n", "\n\n", ",", "y" * 30]) for _ in range(rng.randint(0, 8)))] for i in range(30)]]
    os.makedirs(f"{tmp}/csv")
    with open(f"{tmp}/csv/t.csv", "w", encoding="utf-8", newline="") as f:
        csv.writer(f, lineterminator="\n").writerows(cells)
    got = RD.read_table_dir(spark, f"{tmp}/csv")
    assert sorted((r.row_idx, r.col_idx, r.cell) for r in got.collect()) == sorted((i, c, v) for i, row in enumerate(cells[1:]) for c, v in enumerate(row))
    for df, large in ((rows, "_text"), (got, "record")):
        assert not [x for x in _plan(df).split("\n") if "SortMergeJoin" in x], _plan(df)
        assert "Window" not in _plan(df) or large not in "".join(x for x in _plan(df).split("\n") if "Window" in x)


def test_quoted_cut():
    assert framing.quoted_cut(b'a\n \r\n"b\n\n"\nc', 0, b'"') == [(0, True, b"a"), (1, True, b'"b\n\n"'), (2, True, b"c")]
    assert framing.quoted_cut(b'a\n"\n\nb\nc"', 1, b'"') == [(-1, False, b'a\n"'), (0, True, b"b"), (1, False, b'c"')]
    assert framing.quoted_cut(b"a\nb", 1, b'"') == [(-1, False, b"a\nb")] and framing.quoted_cut(b"", 0, b'"') == []


def _value(rng, depth=0):
    text = lambda: "".join(rng.choice(['"', "\\", "\\\\", "a", "é", "{", "]", ",", "\n", " ", "x" * 30]) for _ in range(rng.randint(0, 6)))
    kind = rng.randrange(6 if depth < 3 else 3)
    if kind < 2:
        return text()
    if kind == 2:
        return rng.choice([1, -2.5, None, True, 1e9])
    if kind == 3:
        return [_value(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    return {text() + str(i): _value(rng, depth + 1) for i in range(rng.randint(0, 3))}


def test_array_elements(spark, tmp, split, monkeypatch):
    monkeypatch.setattr(jsonarray, "CHUNK", {89: 30}.get(split, 1))
    rng = random.Random(11)
    arrays = {"a": [_value(rng) for _ in range(30)], "b": [], "c": [1, 2, [3, [4]], "]"], "d": ["only"], "e": [{"k": "v" * 400}, {"k": "\\"}]}
    for name, array in arrays.items():
        _write(f"{tmp}/{name}.json", json.dumps(array, indent=None if name < "c" else 1, ensure_ascii=name == "a"))
    got = {}
    for r in jsonarray.elements(spark, tmp).orderBy("file", "pos").collect():
        name = os.path.basename(r["file"])[0]
        assert r["pos"] == len(got.setdefault(name, []))
        got[name].append(json.loads(r["text"]))
    assert got == {k: v for k, v in arrays.items() if v}


def test_array_inside_an_object(spark, tmp, split):
    pairs = [{"image_index": i, "type": "t,[", "question_string": f"q \\ {i}", "answer": i / 2 if i % 2 else f"a{i}", "answer_bbox": {}} for i in range(16)]
    _write(f"{tmp}/p.json", json.dumps({"version": "1, 2 [", "qa_pairs": pairs, "n": 16}))
    rows = RD.read_qa_pairs(spark, f"{tmp}/p.json", "png", "train").collect()
    assert sorted((r.image_path, r.query, r.label, r.chart_type) for r in rows) == sorted(
        (f"png/{p['image_index']}.png", p["question_string"], str(p["answer"]), "t,[") for p in pairs)


def test_rationales_and_empty_files(spark, tmp, split):
    texts = [f'step {i} "quoted", \\ and\n a line' * (i % 5) for i in range(16)]
    _write(f"{tmp}/r.json", json.dumps(texts))
    _write(f"{tmp}/s.json", "[]")
    rows = RD.read_rationales(spark, tmp).orderBy("pos").collect()
    assert [(r["file"], r["pos"], r["text"]) for r in rows] == [("r.json", i, t) for i, t in enumerate(texts)]
