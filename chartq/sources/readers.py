"""Corpus readers (SRC-01..17): every corpus shape into the canonical `qa` schema
(dataset, split, image_path, query, label, source_tag, chart_type).

Schemas are declared, never inferred. JSON arrays become one element per row
(`jsonarray`), JSON lines are read as they are; nested questions are exploded; file
stems come from `_metadata.file_path`. Run logs, traces and CSV tables are framed from
lines (`framing`), so a large file is many tasks and records may reach over splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chartq.functions.text import py_strip
from chartq.sources.framing import numbered_lines, quoted_records, separated, stage_dir, staged
from chartq.sources.jsonarray import elements

QA_COLS = ["dataset", "split", "image_path", "query", "label", "source_tag", "chart_type"]


def _qa(df: DataFrame, dataset: str, split: str | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """Fill missing canonical columns with NULL and order them, `extra` ones last."""
    out = df.withColumn("dataset", F.lit(dataset))
    if "split" not in out.columns:
        out = out.withColumn("split", F.lit(split))
    for c, t in (("source_tag", "int"), ("chart_type", "string"), ("label", "string"), ("image_path", "string")):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast(t))
    return out.select(*QA_COLS, *extra)


def _json(spark: SparkSession, path, schema: str, lines: bool, depth: int = 1) -> DataFrame:
    """Records of JSON files in `schema`, with their `file`: arrays by default, one record a line with `lines`."""
    if lines:
        return spark.read.schema(schema).json(path).withColumn("file", F.col("_metadata.file_path"))
    return elements(spark, path, depth).select(F.from_json("text", schema).alias("r"), "file").select("r.*", "file")


# ---- JSON corpora ---------------------------------------------------------------------------

def read_augmented_human(spark: SparkSession, split_dir: str, split: str, dataset: str = "chartqa-src", lines: bool = False) -> DataFrame:
    """SRC-01: `<split>_augmented.json` (flag 1) and `<split>_human.json` (flag 0), JSON arrays."""
    schema = "imgname string, query string, label string"
    parts = []
    for suffix, flag in (("augmented", 1), ("human", 0)):
        df = _json(spark, f"{split_dir}/{split}_{suffix}.json", schema, lines)
        parts.append(df.select(F.concat(F.lit(f"{split_dir}/png/"), "imgname").alias("image_path"), "query", "label",
                               F.lit(flag).alias("source_tag")))
    return _qa(parts[0].unionByName(parts[1]), dataset, split)


def read_fact_check(spark: SparkSession, path: str, split: str, image_prefix: str, dataset: str = "chartfc", lines: bool = False) -> DataFrame:
    """SRC-03: answer 1 → "Yes", else "No"; image path prefixed."""
    df = _json(spark, path, "image_filename string, answer int, question string", lines)
    return _qa(df.select(F.concat(F.lit(image_prefix), "image_filename").alias("image_path"),
                         F.col("question").alias("query"),
                         F.when(F.col("answer") == 1, "Yes").otherwise("No").alias("label")), dataset, split)


def read_flat(spark: SparkSession, path: str, image_prefix: str, split: str = "test", dataset: str = "evochart", lines: bool = False) -> DataFrame:
    """SRC-04: a flat JSON array of {imgname, label, query}."""
    df = _json(spark, path, "imgname string, label string, query string", lines)
    return _qa(df.select(F.concat(F.lit(image_prefix), "imgname").alias("image_path"), "query", "label"), dataset, split)


def read_typed_conversations(spark: SparkSession, paths: list[str], image_prefix: str, split: str = "test",
                             dataset: str = "chartllama", lines: bool = False) -> DataFrame:
    """SRC-05: several per-chart-type files; type = file stem up to the first `_1`; query = the
    text after the last `<image>` of turn 0, stripped; label = turn 1."""
    schema = "image string, conversations array<struct<value:string>>"
    df = _json(spark, paths, schema, lines)
    stem = F.regexp_extract("file", r"([^/]*?)_100examples", 1)
    return _qa(df.select(F.concat(F.lit(image_prefix), "image").alias("image_path"),
                         py_strip(F.substring_index(F.col("conversations")[0]["value"], "<image>", -1)).alias("query"),
                         py_strip(F.col("conversations")[1]["value"]).alias("label"), stem.alias("chart_type")), dataset, split)


# Fixed value: the suffix the benchmark loader appends to every question.
BINARY_SUFFIX = " For binary questions, answer in yes/no."


def read_conversation_lines(spark: SparkSession, path: str, image_prefix: str, split: str = "test",
                            dataset: str = "chartbench") -> DataFrame:
    """SRC-06: JSON lines; a conversation of exactly two turns gives two rows, any other only
    turn 0; the binary-question suffix is appended; image path drops its first two characters."""
    schema = "image string, conversation array<struct<query:string,label:string>>, type struct<chart:string>"
    df = spark.read.schema(schema).json(path)
    keep = F.slice("conversation", 1, F.when(F.size("conversation") == 2, 2).otherwise(1))
    e = df.select(F.concat(F.lit(image_prefix), F.expr("substring(image, 3)")).alias("image_path"),
                  F.col("type.chart").alias("chart_type"), F.explode(keep).alias("c"))
    return _qa(e.select("image_path", F.concat(py_strip("c.query"), F.lit(BINARY_SUFFIX)).alias("query"),
                        py_strip("c.label").alias("label"), "chart_type"), dataset, split)


def read_nested_qa(spark: SparkSession, path: str, split: str = "train", dataset: str = "figqa") -> DataFrame:
    """SRC-07: one record per image with an array of {question, answer}; one row per question."""
    df = spark.read.schema("image_path string, qa array<struct<question:string,answer:string>>").json(path)
    e = df.select("image_path", F.explode("qa").alias("q"))
    return _qa(e.select("image_path", F.col("q.question").alias("query"), F.col("q.answer").alias("label")), dataset, split)


def read_struct_qa(spark: SparkSession, path: str, image_prefix: str, split: str = "test", dataset: str = "chartx", lines: bool = False) -> DataFrame:
    """SRC-08: nested `QA.input` / `QA.output`, chart type, stripped; image path drops 2 chars."""
    df = _json(spark, path, "img string, chart_type string, QA struct<input:string,output:string>", lines)
    return _qa(df.select(F.concat(F.lit(image_prefix), F.expr("substring(img, 3)")).alias("image_path"),
                         py_strip("QA.input").alias("query"), py_strip("QA.output").alias("label"), py_strip("chart_type").alias("chart_type")),
               dataset, split)


def read_qa_pairs(spark: SparkSession, path: str, image_dir: str, split: str, dataset: str = "plotqa", lines: bool = False) -> DataFrame:
    """SRC-09: one object {"qa_pairs": [...]}, or one pair per line (`lines`, which splits into tasks); question and
    answer cast to text; the bookkeeping fields dropped; image path from the image index."""
    pair = ("image_index bigint, qid string, question_id bigint, answer_id bigint, type string,"
            " question_string string, answer string, template string, answer_bbox string")
    e = _json(spark, path, pair, lines, depth=2)
    return _qa(e.select(F.concat(F.lit(image_dir + "/"), F.col("image_index").cast("string"), F.lit(".png")).alias("image_path"),
                        F.col("question_string").alias("query"), F.col("answer").alias("label"),
                        F.col("type").alias("chart_type")), dataset, split)


# ---- preference runs ------------------------------------------------------------------------

def read_pref_runs(spark: SparkSession, path: str) -> DataFrame:
    """SRC-15 / PRJ-08: stored runs of (example, prediction) pairs, an example having image, query, a list of labels
    and the human flag → (image, question, label, human_or_machine, predicted); the first label counts."""
    schema = "example struct<image:string,query:string,label:array<string>,human_or_machine:int>, predicted string"
    r = spark.read.schema(schema).json(path)
    return r.select("example.image", F.col("example.query").alias("question"), F.get("example.label", 0).alias("label"),
                    "example.human_or_machine", "predicted")


# ---- files by stem --------------------------------------------------------------------------

# Fixed value: the constant query of the caption corpus.
CAPTION_QUERY = "Summarize the chart."


def read_captions(spark: SparkSession, caption_dir: str, image_dir: str, corpus: str, split: str = "train") -> DataFrame:
    """SRC-10 / SRC-17 / JN-02: one caption file per image; only stems with an image are kept
    (join on the stem); `answer` = the stripped caption, label = the corpus name."""
    caps = (spark.read.text(caption_dir, wholetext=True)
            .select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.txt$", 1).alias("stem"), F.col("value").alias("caption")))
    imgs = image_listing(spark, image_dir)
    j = caps.join(imgs, "stem")
    rows = j.select("image_path", F.lit(CAPTION_QUERY).alias("query"), py_strip("caption").alias("answer"), F.lit(corpus).alias("label"))
    return _qa(rows, corpus, split, extra=("answer",))


def stem(path: str) -> F.Column:
    """File name without folder and last extension."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def join_by_stem(left: DataFrame, right: DataFrame, left_path: str, right_path: str, how: str = "inner") -> DataFrame:
    """JN-02 / JN-03 / JN-07: rows of two file tables whose paths have the same stem (captions and images, chart tables
    and plots); `left_anti` gives the unmatched."""
    return left.withColumn("stem", stem(left_path)).join(right.withColumn("stem", stem(right_path)), "stem", how)


def image_listing(spark: SparkSession, image_dir: str) -> DataFrame:
    """SRC-17: image files as (stem, image_path); only the listing is read, never the pixels."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(image_dir).select("path")
    return files.select(F.regexp_extract("path", r"([^/]+)\.png$", 1).alias("stem"), F.col("path").alias("image_path"))


def unmatched_stems(spark: SparkSession, caption_dir: str, image_dir: str) -> DataFrame:
    """JN-07: caption stems without an image (anti join)."""
    caps = spark.read.text(caption_dir, wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.txt$", 1).alias("stem"))
    return caps.join(image_listing(spark, image_dir), "stem", "left_anti")


# ---- chart tables ---------------------------------------------------------------------------

_CSV = {"quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}


def read_table_dir(spark: SparkSession, path: str, key_col: str | None = None) -> DataFrame:
    """SRC-11: a folder of CSV tables → chart_cells. A chart is one file (named by its stem) or, with `key_col`, the files of one
    partition folder in path order, each with its header. Records are framed from chunks of lines, so a large file splits into tasks and a quoted
    cell may hold line breaks; each record goes through Spark's CSV parser. As in pandas, blank lines are skipped; cells that are
    empty or missing at the end of a short record are empty, cells beyond the header are left out."""
    key = (F.col(key_col).cast("string") if key_col
           else F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.csv$", 1))
    records = staged(quoted_records(spark, path, "chart_id", key), "csv-records")
    commas = F.length("record") - F.length(F.replace("record", F.lit(","), F.lit("")))
    # one row per file: its header, and how many header lines its chart has up to it
    first = records.groupBy("chart_id", "file").agg(F.min("pos").alias("p0")).select(F.col("chart_id").alias("h_chart"), F.col("file").alias("h_file"), "p0")
    own = (F.col("file") == F.col("h_file")) & F.col("chart_id").eqNullSafe(F.col("h_chart"))
    heads = records.join(F.broadcast(first), own & (F.col("pos") == F.col("p0"))).select("chart_id", "file", "p0", "record")
    width = 1 + (heads.agg(F.max(commas)).first()[0] or 0)
    cells = F.from_csv("record", ", ".join(f"c{i} string" for i in range(width)), _CSV)

    def values(record):
        return F.array(*[F.coalesce(record[f"c{i}"], F.lit("")) for i in range(width)])

    w = Window.partitionBy("chart_id").orderBy("file")
    heads = heads.withColumn("c", cells).select(
        F.col("chart_id").alias("h_chart"), F.col("file").alias("h_file"), "p0", F.row_number().over(w).alias("n_heads"),
        F.filter(F.array(*[F.col("c")[f"c{i}"] for i in range(width)]), lambda x: x.isNotNull()).alias("names"))
    body = records.join(F.broadcast(heads), own).where(F.col("pos") > F.col("p0"))
    rows = body.withColumn("c", cells).select("chart_id", (F.col("pos") - F.col("n_heads")).cast("long").alias("row_idx"), "names",
                                              F.posexplode(values(F.col("c"))).alias("col_idx", "cell"))
    return rows.where(F.col("col_idx") < F.size("names")).select(
        "chart_id", "row_idx", F.col("col_idx").cast("int").alias("col_idx"), F.get("names", F.col("col_idx")).alias("col_name"), "cell")


# Fixed value: a Markdown delimiter row (optional pipes, optional alignment colons).
MD_DELIM = r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$"


def markdown_cells(df: DataFrame, key: str = "chart_id", md: str = "md") -> DataFrame:
    """SRC-12: the first Markdown table of each text → (key, r, c, cell), r = 0 the header.
    The first delimiter row fixes the header above it; the body is the run of non-blank
    lines below it. Cells are split on unescaped pipes and stripped; body rows are padded
    or cut to the header's width."""
    lines = df.select(key, F.posexplode(F.split(md, "\n")).alias("ln", "line"))
    delim = lines.where(F.col("line").rlike(MD_DELIM)).groupBy(key).agg(F.min("ln").alias("d"))
    j = lines.join(delim, key)
    end = (j.where((F.col("ln") > F.col("d")) & (F.trim("line") == "")).groupBy(key).agg(F.min("ln").alias("e")))
    j = j.join(end, key, "left")
    rows = j.where((F.col("ln") == F.col("d") - 1) | ((F.col("ln") > F.col("d")) & (F.col("e").isNull() | (F.col("ln") < F.col("e")))))
    rows = rows.withColumn("r", F.when(F.col("ln") == F.col("d") - 1, 0).otherwise(F.col("ln") - F.col("d")))
    body = F.regexp_replace(py_strip("line"), r"^\||(?<!\\)\|$", "")
    cells = rows.select(key, "r", F.posexplode(F.split(body, r"(?<!\\)\|")).alias("c", "cell"))
    width = cells.where(F.col("r") == 0).groupBy(key).agg(F.count(F.lit(1)).alias("w"))
    cells = cells.join(width, key).where(F.col("c") < F.col("w"))
    return cells.select(key, F.col("r").cast("long").alias("r"), F.col("c").cast("int").alias("c"),
                        F.replace(py_strip("cell"), F.lit("\\|"), F.lit("|")).alias("cell"))


# ---- logs -----------------------------------------------------------------------------------

def read_logs(spark: SparkSession, path: str, keys: list[str], sep: str = "#####") -> DataFrame:
    """SRC-13: run logs (segments separated by `#####`), partitioned folders give the keys; (keys, pos, piece), numbered across
    the files of a run. The text after a file's last separator is no segment."""
    return separated(spark, path, keys, sep)


def write_logs(df: DataFrame, path: str, keys: list[str], order: str, text: str, sep: str = "#####",
               files_per_key: int | None = None) -> None:
    """Write records as `#####`-separated logs, one folder per key; a run is spread over
    range-partitioned files whose names keep the record order."""
    spark = df.sparkSession
    n = files_per_key or int(spark.conf.get("spark.sql.shuffle.partitions"))
    (df.repartitionByRange(n, *keys, order).sortWithinPartitions(*keys, order)
     .select(*keys, F.col(text).alias("value"))
     .write.mode("overwrite").partitionBy(*keys).option("lineSep", "\n" + sep + "\n").text(path))


def read_rationales(spark: SparkSession, path: str) -> DataFrame:
    """SRC-14: a JSON array of strings per file; position = array index."""
    text = F.get(F.from_json(F.concat(F.lit("["), "text", F.lit("]")), "array<string>"), F.lit(0))
    return elements(spark, path).select(F.substring_index("file", "/", -1).alias("file"), F.col("pos").cast("int").alias("pos"), text.alias("text"))


# ---- evaluation traces (SRC-16) -------------------------------------------------------------

# Fixed value: a Python string literal in either quote style, with backslash escapes.
PY_STR = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*\""""


def py_list_items(c) -> F.Column:
    """Items of a printed Python list of strings, unquoted and unescaped."""
    toks = F.regexp_extract_all(c, F.lit(PY_STR), 0)

    def unq(t):
        body = F.regexp_replace(F.substring(t, F.lit(2), F.length(t)), r"(?s).\z", "")
        return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(
            body, r"\\n", "\n"), r"\\'", "'"), r'\\"', '"'), r"\\\\", "\\\\")
    return F.transform(toks, unq)


def read_traces(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """SRC-16: 6-line records (normalised predictions, labels, raw predictions as list
    literals, then `EM:`, `Relaxed Accuracy:`, `BLEU Score:`), numbered across files; a record
    may reach over splits and files.
    Returns one row per record: (keys, batch, preds, labels, raws, em, ra, bleu)."""
    lines = numbered_lines(spark, path, keys)
    rec = lines.select(*keys, F.floor(F.col("pos") / 6).alias("batch"), (F.col("pos") % 6).alias("kind"), "line")
    val = lambda k: F.max(F.when(F.col("kind") == k, F.col("line")))
    num = lambda k: F.regexp_extract(val(k), r":\s*(\S+)\s*$", 1).try_cast("double")
    return rec.groupBy(*keys, "batch").agg(
        py_list_items(val(0)).alias("preds"), py_list_items(val(1)).alias("labels"), py_list_items(val(2)).alias("raws"),
        num(3).alias("em"), num(4).alias("ra"), num(5).alias("bleu"))


def trace_items(records: DataFrame, keys: list[str]) -> DataFrame:
    """One row per traced item: (keys, batch, pos, pred_norm, label, pred_raw)."""
    z = records.select(*keys, "batch", F.posexplode(F.arrays_zip("preds", "labels", "raws")).alias("pos", "z"))
    return z.select(*keys, F.col("batch").cast("long").alias("batch"), F.col("pos").cast("int").alias("pos"),
                    F.col("z.preds").alias("pred_norm"), F.col("z.labels").alias("label"), F.col("z.raws").alias("pred_raw"))


# ---- per-corpus field maps (PRJ-01..04) and parquet corpora (SRC-02) -------------------------

# How each corpus' fields map onto (image_path, query, label, source_tag, chart_type).
FIELD_MAPS = {
    "chartqa": {"image_path": "image", "query": "query", "label": "label", "source_tag": "human_or_machine"},
    "chartfc": {"image_path": "image", "query": "concat(question, '. Answer yes/no.')", "label": "label"},
    "evochart": {"image_path": "image", "query": "query", "label": "label"},
    "chartllama": {"image_path": "image", "query": "query", "label": "label", "chart_type": "type"},
    "chartqapro": {"query": "Question", "label": "element_at(Answer, 1)", "chart_type": "`Question Type`"},
    "figqa": {"image_path": "image", "query": "query", "label": "trim(BOTH '.' FROM label)"},
    "plotqa": {"image_path": "image", "query": "question_string", "label": "answer", "chart_type": "type"},
    "chartbench": {"image_path": "image", "query": "query", "label": "label", "chart_type": "type"},
    "chartx": {"image_path": "image", "query": "query", "label": "label", "chart_type": "type"},
}


def normalise(df: DataFrame, corpus: str, split: str | None = None) -> DataFrame:
    """PRJ-01: one declarative select per corpus into the canonical schema."""
    m = FIELD_MAPS[corpus]
    return _qa(df.selectExpr(*[f"{expr} AS {name}" for name, expr in m.items()]), corpus, split)


def read_parquet_corpus(spark: SparkSession, path: str, corpus: str, split: str | None = None) -> DataFrame:
    """SRC-02: a parquet mirror of a hub corpus; only the mapped columns are read (the image
    bytes column is pruned from the scan)."""
    return normalise(spark.read.parquet(path), corpus, split)
