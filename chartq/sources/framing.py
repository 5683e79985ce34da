"""Records that span lines, cut out of text files of any size (SRC-11, SRC-13, SRC-16).

Files are read by Spark's text source in lines, so a large file is many tasks, and a record may begin in one split and end in
another. Each task joins the lines of a split to chunks of about `CHUNK` bytes and counts what a chunk holds (separators, quotes,
records). Chunks are staged once: later steps, and tasks run again after a lost executor, see one numbering whatever the splits of
a second scan would be. The counts, a row per chunk, are summed over earlier chunks and joined back, so every chunk is
cut into records by itself, in any order, without a shuffle of the text; only the pieces at a chunk's ends, whose record reaches
over chunks, are grouped. No step holds more than a chunk, or one record.

Cutting records by the text source's own `lineSep` is not exact: where a split begins inside a run of separator characters, a
separator of several characters is found at another place than from the start of the file (tried with `#####` and runs of 2 to 9).
Lines end at a single byte, so splits do not matter to them.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chartq.session import ensure_checkpoint_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])   # the functions below run in tasks

CHUNK = 1 << 20
_BLANK = b" \r\t"


def stage_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder for staged files."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/chartq-stage/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet to a staged folder and read back."""
    path = stage_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_lines(spark: SparkSession, path, keys: dict[str, Column]) -> DataFrame:
    """The lines of text files: (keys, _file, _start, _seq, _line); `_start` is where a line's split begins in its file and `_seq`
    orders the lines of a split. The line ends with the byte before the line feed."""
    lines = spark.read.option("lineSep", "\n").text(path)
    own = lines.select(*[c.alias(k) for k, c in keys.items()], F.col("_metadata.file_path").alias("_file"),
                       F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_seq"), F.col("value").alias("_line"))
    return staged(own, "lines")


def before(lines: DataFrame, keys: list[str], out: str) -> DataFrame:
    """`lines` with the number of earlier lines of the same keys, files in the order of their paths. Equal keys compare null-safe."""
    splits = lines.groupBy(*keys, "_file", "_start").agg(F.count(F.lit(1)).alias("_sum"), F.min("_seq").alias("_first"))
    w = Window.partitionBy(*keys).orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_off", F.coalesce(F.sum("_sum").over(w), F.lit(0)))
    joined = _with(lines, splits, [*keys, "_file", "_start"], ["_first", "_off"])
    return joined.withColumn(out, (F.col("_off") + F.col("_seq") - F.col("_first")).cast("long")).select(*lines.columns, out)


def _with(df: DataFrame, small: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """`df` with `cols` of a table of a row per split, chunk or file (some bytes for a megabyte of text), null-safe by `keys`."""
    own = small.select(*[F.col(k).alias(f"_s_{k}") for k in keys], *cols)
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_s_{k}")) for k in keys])
    return df.join(F.broadcast(own), same).drop(*[f"_s_{k}" for k in keys])


def chunks(spark: SparkSession, path, keys: dict[str, Column], count: Callable[[bytes], tuple[int, ...]], counts: list[str]) -> DataFrame:
    """Text files as staged chunks of whole lines: (keys, _file, _start, _k, _text, `counts`), in order by _file, _start and _k."""
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
                         F.col("value").cast("binary").alias("_line"), *[c.alias(k) for k, c in keys.items()])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema if f.name in keys)
    most, names = CHUNK, list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, own, held, n, k = None, [], [], 0, 0

        def chunk() -> pa.RecordBatch:
            text = b"\n".join(held)
            mine = [pa.array([v], t) for v, t in zip((*place, k, text), (pa.string(), pa.int64(), pa.int64(), pa.binary()))]
            return pa.record_batch([*own, *mine, *[pa.array([c], pa.int64()) for c in count(text)]],
                                   [*names, "_file", "_start", "_k", "_text", *counts])

        for batch in batches:
            ends = set()        # where the file or the split changes, found without a loop over lines
            for c in ("_file", "_start"):
                ends.update(pc.run_end_encode(batch[c]).run_ends.to_pylist())
            ends = sorted(ends)
            lines = batch["_line"].to_numpy(zero_copy_only=False)
            size = np.cumsum(pc.binary_length(batch["_line"]).to_numpy() + 1)
            for a, b in zip([0, *ends], ends):
                here = (batch["_file"][a].as_py(), batch["_start"][a].as_py())
                if here != place:
                    if held:
                        yield chunk()
                    place, own, held, n, k = here, [batch[c].slice(a, 1) for c in names], [], 0, 0
                while a < b:
                    done = int(size[a - 1]) if a else 0
                    to = min(int(np.searchsorted(size, done + most - n)) + 1, b)
                    held.extend(lines[a:to].tolist())
                    n += int(size[to - 1]) - done
                    a = to
                    if n >= most:
                        yield chunk()
                        held, n, k = [], 0, k + 1
        if held:
            yield chunk()

    made = lines.mapInArrow(run, ", ".join([schema, "_file string, _start long, _k long, _text binary", *[f"{c} long" for c in counts]]))
    return staged(made, "chunks")


def _earlier(df: DataFrame, scope: list[str], value: str | Column) -> Column:
    """The sum of `value` over earlier chunks of the same `scope`."""
    rest = [c for c in ("_file", "_start", "_k") if c not in scope]
    w = Window.partitionBy(*scope).orderBy(*rest).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0))


def _pieces(placed: DataFrame, keys: list[str], args: list[str], cut: Callable[..., list[tuple[int, bool, bytes]]]) -> tuple[DataFrame, DataFrame]:
    """(whole records, pieces of records that reach over chunks) of the chunks: (keys, _file, _start, _k, _n, _piece), where `cut`
    gives a chunk's (number from its own beginning, is it whole, text)."""
    df = placed.select(*keys, "_file", "_start", "_k", *args, "_text")
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in (*args, "_text")], "_n long", "_piece binary"])
    names = [*keys, "_file", "_start", "_k"]

    def only(wanted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                given = [batch[a].to_pylist() for a in args]
                for i in range(batch.num_rows):
                    found = [(n, t) for n, whole, t in cut(batch["_text"][i].as_py(), *[g[i] for g in given]) if whole == wanted]
                    if found:
                        n, t = zip(*found)
                        same = [pa.repeat(batch[c][i], len(n)) for c in names]
                        yield pa.record_batch([*same, pa.array(n, pa.int64()), pa.array(t, pa.binary())], [*names, "_n", "_piece"])
        return run

    whole, ends = (df.mapInArrow(only(w), schema).withColumn("_piece", F.col("_piece").cast("string")) for w in (True, False))
    return whole, ends


def _joined(pieces: str, order: list[str]) -> Column:
    """The pieces of a group, in order, with line feeds between them."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(pieces).alias("_text"))))
    return F.array_join(F.transform(rows, lambda r: r["_text"]), "\n")


def separated(spark: SparkSession, path, keys: list[str], sep: str) -> DataFrame:
    """Text cut at every `sep` (leftmost first, none across a line feed): (keys, pos, piece), numbered across the files of a key in
    path order. What follows the last separator of a file is no record; a record never goes on in the next file."""
    if not sep or "\n" in sep:
        raise ValueError("the separator must be text without a line feed")
    mark = sep.encode()
    text = chunks(spark, path, {k: F.col(k) for k in keys}, lambda t: (t.count(mark),), ["_seps"])
    small = text.select(*keys, "_file", "_start", "_k", "_seps")
    small = small.withColumn("_off", _earlier(small, keys, "_seps"))
    # text after a file's last separator has the number of the next file's first record
    small = small.withColumn("_end", F.max(F.col("_off") + F.col("_seps")).over(Window.partitionBy(*keys, "_file")))

    def cut(t: bytes) -> list[tuple[int, bool, bytes]]:
        parts = t.split(mark)
        return [(i, 0 < i < len(parts) - 1, x) for i, x in enumerate(parts)]

    whole, ends = (_with(p, small, [*keys, "_file", "_start", "_k"], ["_off", "_end"]).withColumn("pos", F.col("_off") + F.col("_n"))
                   for p in _pieces(text, keys, [], cut))
    ends = ends.where(F.col("pos") < F.col("_end")).groupBy(*keys, "pos").agg(_joined("_piece", ["_file", "_start", "_k"]).alias("piece"))
    return whole.select(*keys, "pos", F.col("_piece").alias("piece")).union(ends)


def numbered_lines(spark: SparkSession, path, keys: list[str]) -> DataFrame:
    """(keys, pos, line): lines numbered across the files of a key in path order."""
    lines = staged_lines(spark, path, {k: F.col(k) for k in keys})
    return before(lines, keys, "pos").select(*keys, "pos", F.col("_line").alias("line"))


def quoted_cut(text: bytes, inside: int, quote: bytes) -> list[tuple[int, bool, bytes]]:
    """The records of whole lines, `inside` saying whether these begin in a quoted cell: (number, is it whole, text); what goes on
    from earlier lines has the number -1."""
    lines = text.split(b"\n")
    if quote not in text:
        return [(-1, False, text)] if inside else [(i, True, x) for i, x in enumerate(x for x in lines if x.strip(_BLANK))]
    out, n, held, begun = [], 0, [], False
    for line in lines:
        odd = line.count(quote) % 2
        if inside:
            held.append(line)
            if odd:
                out.append((n if begun else -1, begun, b"\n".join(held)))
                n, held = n + begun, []
        elif odd:
            held, begun = [line], True
        elif line.strip(_BLANK):
            out.append((n, True, line))
            n += 1
        inside ^= odd
    if held:
        out.append((n if begun else -1, False, b"\n".join(held)))
    return out


def quoted_records(spark: SparkSession, path, key: str, name: Column, quote: str = '"') -> DataFrame:
    """CSV records, quoted line feeds included: (key, file, pos, record), `pos` counted over the files of a key in path order.
    A line begins a record where the quotes before it in its file are paired; blank lines between records are skipped."""
    mark = quote.encode()

    def count(t: bytes) -> tuple[int, ...]:     # records that begin in the chunk, for both states that it may begin in
        return t.count(mark), *[sum(n >= 0 for n, _, _ in quoted_cut(t, inside, mark)) for inside in (0, 1)]

    text = chunks(spark, path, {key: name}, count, ["_quotes", "_n0", "_n1"])
    ids = [key, "_file", "_start", "_k"]
    small = text.select(*ids, "_quotes", "_n0", "_n1")
    small = small.withColumn("_inside", (_earlier(small, [key, "_file"], "_quotes") % 2).cast("int"))
    small = small.withColumn("_begun", F.when(F.col("_inside") == 0, F.col("_n0")).otherwise(F.col("_n1")))
    small = small.withColumn("_off", _earlier(small, [key], "_begun"))
    placed = _with(text.drop("_quotes", "_n0", "_n1"), small, ids, ["_inside", "_off"])
    whole, ends = _pieces(placed, [key, "_off"], ["_inside"], lambda t, inside: quoted_cut(t, inside, mark))
    cols = [key, F.col("_file").alias("file"), (F.col("_off") + F.col("_n")).cast("long").alias("pos")]
    found = whole.select(*cols, F.col("_piece").alias("record")).union(
        ends.groupBy(*cols).agg(_joined("_piece", ["_start", "_k"]).alias("record")))
    return found.withColumn("record", F.when(F.col("record").endswith("\r"), F.substring("record", F.lit(1), F.length("record") - 1)).otherwise(F.col("record")))
