"""Corpus readers on small files written from the driver tables (expectations restated in Python)."""

import glob
import json
import os
import tempfile

import duckdb
import pytest

from chartq.sources import readers as RD
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def docs():
    con = duckdb.connect()
    return con.execute(f"select doc_id, text, lang, source from read_parquet('{SF_SMALL}/documents.parquet') "
                       f"order by doc_id limit 40").fetchall()


@pytest.fixture()
def tmp():
    return tempfile.mkdtemp(prefix="chartq-test-")


def _dump(path, obj):
    with open(path, "w", encoding="utf-8") as f:
        json.dump(obj, f)


def test_augmented_and_human(spark, docs, tmp):
    aug = [{"imgname": f"{d[0]}.png", "query": d[1][:50], "label": d[2]} for d in docs[:10]]
    hum = [{"imgname": f"{d[0]}.png", "query": d[1][:30], "label": d[3]} for d in docs[10:15]]
    _dump(f"{tmp}/train_augmented.json", aug)
    _dump(f"{tmp}/train_human.json", hum)
    rows = RD.read_augmented_human(spark, tmp, "train").collect()
    assert len(rows) == 15
    assert sum(r.source_tag for r in rows) == 10
    assert {r.label for r in rows if r.source_tag == 0} == {d[3] for d in docs[10:15]}


def test_fact_check_labels(spark, docs, tmp):
    data = [{"image_filename": f"{d[0]}.png", "answer": d[0] % 2, "question": d[2]} for d in docs]
    _dump(f"{tmp}/fc.json", data)
    rows = RD.read_fact_check(spark, f"{tmp}/fc.json", "train", "charts/").collect()
    exp = sorted(("charts/" + x["image_filename"], "Yes" if x["answer"] == 1 else "No") for x in data)
    assert sorted((r.image_path, r.label) for r in rows) == exp


def test_conversation_lines(spark, docs, tmp):
    lines = []
    for i, d in enumerate(docs[:9]):
        conv = [{"query": f" q{j} ", "label": f" a{j} "} for j in range(1 + i % 3)]
        lines.append({"image": f"./img/{d[0]}.png", "conversation": conv, "type": {"chart": d[2]}})
    with open(f"{tmp}/bench.jsonl", "w") as f:
        f.write("\n".join(json.dumps(x) for x in lines))
    rows = RD.read_conversation_lines(spark, f"{tmp}/bench.jsonl", "root/").collect()
    exp = sum(2 if len(x["conversation"]) == 2 else 1 for x in lines)
    assert len(rows) == exp
    assert all(r.query.endswith(RD.BINARY_SUFFIX) and r.image_path.startswith("root/img/") for r in rows)
    assert {r.label for r in rows} <= {"a0", "a1"}


def test_typed_conversations(spark, docs, tmp):
    paths = []
    for t in ("funnel_chart", "polar_chart"):
        data = [{"image": f"{d[0]}.png", "conversations": [{"value": f"<image>\n x <image> {d[2]} "}, {"value": d[3]}]}
                for d in docs[:5]]
        p = f"{tmp}/{t}_100examples_simplified_qa.json"
        _dump(p, data)
        paths.append(p)
    rows = RD.read_typed_conversations(spark, paths, "cl/").collect()
    assert len(rows) == 10
    assert {r.chart_type for r in rows} == {"funnel_chart", "polar_chart"}
    assert all(r.query in {d[2] for d in docs[:5]} for r in rows)


def test_nested_and_struct_and_pairs(spark, docs, tmp):
    with open(f"{tmp}/fig.jsonl", "w") as f:
        for d in docs[:6]:
            f.write(json.dumps({"image_path": f"{d[0]}.png", "qa": [{"question": "q", "answer": "1"}] * (d[0] % 3)}) + "\n")
    assert RD.read_nested_qa(spark, f"{tmp}/fig.jsonl").count() == sum(d[0] % 3 for d in docs[:6])
    _dump(f"{tmp}/chartx.json", [{"img": f"./{d[0]}.png", "chart_type": d[2], "QA": {"input": f" {d[3]} ", "output": " y "}}
                                 for d in docs[:4]])
    r = RD.read_struct_qa(spark, f"{tmp}/chartx.json", "cx/").collect()
    assert {x.image_path for x in r} == {f"cx/{d[0]}.png" for d in docs[:4]} and {x.label for x in r} == {"y"}
    pairs = [{"image_index": d[0], "qid": "q", "question_id": 1, "answer_id": 2, "type": "t", "question_string": d[2],
              "answer": str(d[0]), "template": "x", "answer_bbox": "b"} for d in docs[:7]]
    _dump(f"{tmp}/plot.json", {"qa_pairs": pairs})
    r = RD.read_qa_pairs(spark, f"{tmp}/plot.json", "png", "train").collect()
    assert sorted(x.label for x in r) == sorted(str(d[0]) for d in docs[:7])


def test_captions_join_and_anti(spark, docs, tmp):
    os.makedirs(f"{tmp}/cap")
    os.makedirs(f"{tmp}/img")
    for d in docs[:8]:
        with open(f"{tmp}/cap/{d[0]}.txt", "w") as f:
            f.write(d[1][:40])
    for d in docs[4:12]:
        with open(f"{tmp}/img/{d[0]}.png", "wb") as f:
            f.write(b"\x89")  # Spark scans skip zero-byte files
    rows = RD.read_captions(spark, f"{tmp}/cap", f"{tmp}/img", "pew").collect()
    assert sorted(int(os.path.basename(r.image_path)[:-4]) for r in rows) == [d[0] for d in docs[4:8]]
    anti = RD.unmatched_stems(spark, f"{tmp}/cap", f"{tmp}/img").collect()
    assert sorted(int(r.stem) for r in anti) == [d[0] for d in docs[:4]]


def test_markdown_edge_cases(spark):
    md = "intro\n\nA | B\n:--|--:\n| x \\| y | 1 | extra |\n| z |\n\nafter | table\n"
    df = spark.createDataFrame([("t1", md)], "chart_id string, md string")
    cells = sorted((r.r, r.c, r.cell) for r in RD.markdown_cells(df).collect())
    assert cells == [(0, 0, "A"), (0, 1, "B"), (1, 0, "x | y"), (1, 1, "1"), (2, 0, "z")]


def test_csv_quoted_commas(spark, tmp):
    with open(f"{tmp}/t1.csv", "w") as f:
        f.write('name,value\n"a, b",1\n"say ""hi""",2\n')
    cells = sorted((r.row_idx, r.col_name, r.cell) for r in RD.read_table_dir(spark, f"{tmp}/t1.csv").collect())
    assert cells == [(0, "name", "a, b"), (0, "value", "1"), (1, "name", 'say "hi"'), (1, "value", "2")]


def test_csv_chart_over_several_files_and_splits(spark, tmp):
    rows = [[f"c{i}", str(i)] for i in range(3000)]
    os.makedirs(f"{tmp}/chart_id=m")
    for k, part in enumerate((rows[:10], rows[10:], [])):
        with open(f"{tmp}/chart_id=m/part-{k}.csv", "w") as f:
            f.write("".join(",".join(r) + "\n" for r in [["name", "value"], *part]))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = sorted((r.chart_id, r.row_idx, r.col_idx, r.col_name, r.cell) for r in RD.read_table_dir(spark, tmp, key_col="chart_id").collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [("m", i, c, n, r[c]) for i, r in enumerate(rows) for c, n in enumerate(("name", "value"))]


def test_csv_hot_chart_is_written_to_several_files(spark, tmp):
    from chartq.plans.q_sources import _write_tables

    rows = [("bar:1", i, c, n, v) for i in range(2000) for c, (n, v) in enumerate((("category", f"k{i}"), ("value", str(i))))]
    cells = spark.createDataFrame(rows, "chart_id string, row_idx long, col_idx int, col_name string, cell string")
    _write_tables(spark, cells, f"{tmp}/t")
    assert len(glob.glob(f"{tmp}/t/chart_id=*/*.csv")) > 1
    got = sorted((r.row_idx, r.cell) for r in RD.read_table_dir(spark, f"{tmp}/t", key_col="chart_id").collect() if r.col_idx == 1)
    assert got == [(i, str(i)) for i in range(2000)]


def test_rationale_array_positions(spark, docs, tmp):
    _dump(f"{tmp}/r.json", [d[2] for d in docs[:12]])
    rows = sorted((r.pos, r.text) for r in RD.read_rationales(spark, f"{tmp}/r.json").collect())
    assert rows == [(i, d[2]) for i, d in enumerate(docs[:12])]


def test_parquet_corpus_mapping(spark, docs, tmp):
    rows = [(bytes([d[0] % 256]), d[2], [d[3], "x"], "reasoning") for d in docs[:6]]
    df = spark.createDataFrame(rows, "image binary, Question string, Answer array<string>, `Question Type` string")
    df.write.parquet(f"{tmp}/pro")
    out = RD.read_parquet_corpus(spark, f"{tmp}/pro", "chartqapro", "test")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "image" not in plan.split("ReadSchema:")[1].split("\n")[0]
    got = sorted((r.query, r.label, r.chart_type) for r in out.collect())
    assert got == sorted((d[2], d[3], "reasoning") for d in docs[:6])
    fig = spark.createDataFrame([("i.png", "q", "..yes.")], "image string, query string, label string")
    assert RD.normalise(fig, "figqa").first().label == "yes"
