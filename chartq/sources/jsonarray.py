"""JSON array files of any size as one element per row (SRC-01, 03, 04, 05, 08, 09, 14).

A JSON array is often one line, so it does not split by lines, and the JSON source reads it with one task and one list. Here
the text source cuts it at every quote character, in as many tasks as the file has splits. Each task joins its cuts to chunks
of about `CHUNK` bytes that end at a quote, and states for both possible beginnings (inside a string or not) how the chunk changes the
nesting and how many commas it has at each depth. These few numbers per chunk, summed over the chunks of a file in order, say how every
chunk really begins and which element it is in. So every chunk is cut into elements by itself, and only an element that reaches
over chunks is put together from its pieces. Chunks and elements are staged: elements are the JSON lines that all later reads use.

An array inside an object ({"name": [...]}) is read with depth=2; it must then be the object's only member that is no plain value.
Files must be valid JSON; a file with an empty array (or nothing) has no rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chartq.sources.framing import staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])   # the functions below run in tasks

CHUNK = 1 << 20

_QUOTE, _ESCAPE = ord('"'), ord("\\")
_STEP = np.zeros(256, np.int8)
_STEP[[ord("["), ord("{")]] = 1
_STEP[[ord("]"), ord("}")]] = -1
_MARK = np.zeros(256, bool)
_MARK[[_QUOTE, ord(","), *(ord(c) for c in "[]{}")]] = True


def marks(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of quotes, brackets and commas, their characters, and which are quotes that open or close a string."""
    raw = np.frombuffer(text, np.uint8)
    at = np.flatnonzero(_MARK[raw])
    kind = raw[at]
    real = kind == _QUOTE
    for i in np.flatnonzero(real & (raw[at - 1] == _ESCAPE) & (at > 0)).tolist():
        run = int(at[i])
        while run and text[run - 1] == _ESCAPE:
            run -= 1
        real[i] = (int(at[i]) - run) % 2 == 0
    return at, kind, real


def depths(kind: np.ndarray, real: np.ndarray, inside: int) -> tuple[np.ndarray, np.ndarray]:
    """Which marks are outside of strings, and the nesting after each mark, both counted from a chunk's beginning."""
    outside = ((inside + np.cumsum(real)) % 2 == 0) & (kind != _QUOTE)
    return outside, np.cumsum(np.where(outside, _STEP[kind], 0))


def _summary(text: bytes) -> tuple:
    _, kind, real = marks(text)
    out = [int(real.sum() % 2)]
    for inside in (0, 1):
        outside, depth = depths(kind, real, inside)
        level, n = np.unique(depth[outside & (kind == ord(","))], return_counts=True)
        out += [int(depth[-1]) if len(depth) else 0, list(zip(level.tolist(), n.tolist()))]
    return tuple(out)


_CHUNKS = "file string, start long, k long, text binary, quotes int, d0 long, c0 map<long,long>, d1 long, c1 map<long,long>"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), *[pa.int64(), pa.map_(pa.int64(), pa.int64())] * 2]
    names = ["file", "start", "k", "text", "quotes", "d0", "c0", "d1", "c1"]
    place, k, held, size = None, 0, [], 0

    def chunk() -> pa.RecordBatch:
        text = b'"'.join([*held, b""])      # a quote follows every cut, and does no harm after the last one of a file
        row = (*place, k, text, *_summary(text))
        return pa.record_batch([pa.array([v], t) for v, t in zip(row, kinds)], names)

    for batch in batches:
        for file, start, value in zip(*(batch[c].to_pylist() for c in ("file", "start", "value"))):
            if place != (file, start):
                if held:
                    yield chunk()
                place, k, held, size = (file, start), 0, [], 0
            held.append(value)
            size += len(value) + 1
            if size >= CHUNK:
                yield chunk()
                k, held, size = k + 1, [], 0
    if held:
        yield chunk()


_ELEMENTS = "file string, pos long, whole boolean, start long, k long, text binary"


def _elements(depth: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out = list(_cut(row["text"], row["inside"], row["depth"], depth))
                n = len(out)
                columns = [[row["file"]] * n, [row["pos"] + i for i, _, _ in out], [w for _, w, _ in out], [row["start"]] * n, [row["k"]] * n,
                           [t for _, _, t in out]]
                kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], ["file", "pos", "whole", "start", "k", "text"])

    return cut


def _cut(text: bytes, inside: int, entered: int, depth: int) -> Iterator[tuple[int, bool, bytes]]:
    """Pieces of elements in a chunk: (elements begun before in the chunk, whether it is whole, its text)."""
    at, kind, real = marks(text)
    outside, level = depths(kind, real, inside)
    level = level + entered
    opens = np.flatnonzero(outside & (_STEP[kind] > 0) & (level == depth))
    closes = np.flatnonzero(outside & (_STEP[kind] < 0) & (level == depth - 1))
    begun, ended = entered >= depth, len(text)
    if begun:
        first = 0
    elif len(opens):
        first = int(at[opens[0]]) + 1
    else:
        return
    closes = closes[at[closes] >= first]
    done = len(closes) > 0
    if done:
        ended = int(at[closes[0]])
    commas = at[np.flatnonzero(outside & (kind == ord(",")) & (level == depth))]
    edges = [first, *commas[(commas >= first) & (commas < ended)].tolist(), ended]
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        whole = (i > 0 or not begun) and (i + 2 < len(edges) or done)
        yield i, whole, text[a + (i > 0):b]


def elements(spark: SparkSession, path, depth: int = 1) -> DataFrame:
    """(file, pos, text): the elements of the array in each file as JSON text, with their index."""
    cuts = spark.read.option("lineSep", '"').text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))
    chunks = staged(cuts.mapInArrow(_chunks, _CHUNKS), "array-chunks")
    w = Window.partitionBy("file").orderBy("start", "k").rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda c: F.coalesce(F.sum(c).over(w), F.lit(0))
    known = (chunks.drop("text").withColumn("inside", (upto("quotes") % 2).cast("int"))
             .withColumn("d", F.when(F.col("inside") == 0, F.col("d0")).otherwise(F.col("d1")))
             .withColumn("c", F.when(F.col("inside") == 0, F.col("c0")).otherwise(F.col("c1")))
             .withColumn("depth", upto("d"))
             .withColumn("pos", upto(F.coalesce(F.try_element_at("c", F.lit(depth) - F.col("depth")), F.lit(0))))
             .select("file", "start", "k", "inside", "depth", "pos"))
    cut = chunks.select("file", "start", "k", "text").join(known, ["file", "start", "k"]).mapInArrow(_elements(depth), _ELEMENTS)
    found = staged(cut, "array-elements")
    pieces = F.array_sort(F.collect_list(F.struct("start", "k", F.hex("text").alias("piece"))))
    put = found.where("not whole").groupBy("file", "pos").agg(
        F.unhex(F.array_join(F.transform(pieces, lambda p: p["piece"]), "")).alias("text"))
    both = found.where("whole").select("file", "pos", "text").union(put)
    return both.select("file", "pos", F.col("text").cast("string").alias("text")).where(F.col("text").rlike(r"\S"))
