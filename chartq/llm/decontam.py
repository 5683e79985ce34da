"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over training token windows.

Words are lower-cased (A-Z) runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`, cut from the UTF-8 bytes of the
whole text (bytes of other characters are all above 0x7F). Only words of the benchmark have a number;
a window is looked up only where `n` consecutive words all have one, and the lookup compares the whole
number sequence, so every hit is verified. An item of fewer than `n` words is one window of its length.

The set is broadcast in bounded parts: the benchmark's windows are counted and items are dealt by hash into as many parts as
`PART_WINDOWS` asks for; each part is one pass over the documents that adds its hits to those of the passes before (staged
in between), so no broadcast grows with the benchmark. A part is flat arrays (a row of word numbers per distinct window, sorted by
hash, and the items of each) and the numbers of its words; an item is never cut, so only one item could exceed a part.

Edge cases: null texts have no words; an item with a null id is matched and removed like any other but is
not listed or counted; items with equal ids count once; an empty benchmark hits nothing; an empty
document table gives an empty result; columns other than text are passed through or not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartq.llm.common import stage, utf8

WINDOW = 10
PART_WINDOWS = 500_000    # benchmark windows behind one broadcast set

_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))

HITS = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("runs", T.ArrayType(T.ArrayType(T.LongType()))),       # maximal runs of hit words, [first, last + 1)
    T.StructField("items", T.ArrayType(T.StringType())),                  # sorted ids of items with an occurring window
])


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORD).split()


_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _hashes(rows: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every row of word numbers."""
    out = np.zeros(len(rows), np.uint64)
    for column in rows.T:
        out = (out ^ (column.astype(np.uint64) + np.uint64(1))) * _PRIME
        out ^= out >> np.uint64(29)
    return out


def window_set(items, n: int = WINDOW) -> tuple[dict, list, list]:
    """Numbers of the words of some items; per window length the distinct windows sorted by hash, as (hashes, rows of word
    numbers, first owner, owners); and the items' ids, which owners count."""
    numbers: dict[bytes, int] = {}
    by_length: dict[int, list] = {}
    ids = []
    for item_id, text in items:
        seq = words(bytes(text))
        if not seq:
            continue
        own = np.array([numbers.setdefault(w, len(numbers)) for w in seq], dtype=np.int32)
        by_length.setdefault(min(n, len(own)), []).append((len(ids), own))
        ids.append(item_id)
    tables = []
    for size, owned in by_length.items():
        rows = np.concatenate([np.lib.stride_tricks.sliding_window_view(own, size) for _, own in owned])
        owner = np.repeat(np.array([i for i, _ in owned], np.int32), [len(own) - size + 1 for _, own in owned])
        order = np.lexsort((owner, *rows.T, h := _hashes(rows)))
        h, rows, owner = h[order], rows[order], owner[order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
        again = ~new & np.concatenate(([False], owner[1:] == owner[:-1]))    # a window twice in one item
        first = np.flatnonzero(new)
        kept = np.cumsum(~again)
        tables.append((size, h[first], rows[first], np.append(kept[first] - 1, kept[-1]).astype(np.int64), owner[~again]))
    return numbers, tables, ids


def find_windows(windows: tuple[dict, list, list], seq: list[bytes]) -> tuple[np.ndarray, set]:
    """Mask of the words inside an occurring window, and the ids of the items found."""
    numbers, tables, item_ids = windows
    hit = np.zeros(len(seq) + 1, dtype=np.int32)
    found: set = set()
    ids = np.array([numbers.get(w, -1) for w in seq], dtype=np.int32)
    known = np.concatenate(([0], np.cumsum(ids >= 0)))
    for size, hashes, rows, first, owners in tables:
        if size > len(seq):
            continue
        at = np.flatnonzero(known[size:] - known[:-size] == size)
        if not len(at):
            continue
        own = np.lib.stride_tricks.sliding_window_view(ids, size)[at]
        h = _hashes(own)
        low, high = np.searchsorted(hashes, h), np.searchsorted(hashes, h, side="right")
        while len(at):      # windows that share a hash are next to each other: almost always one
            open_ = low < high
            at, own, low, high = at[open_], own[open_], low[open_], high[open_]
            same = (rows[low] == own).all(axis=1)
            for p, w in zip(at[same].tolist(), low[same].tolist()):
                hit[p] += 1
                hit[p + size] -= 1
                found.update(item_ids[o] for o in owners[first[w]:first[w + 1]].tolist())
            at, own, low, high = at[~same], own[~same], low[~same] + 1, high[~same]
    return np.cumsum(hit[:-1]) > 0, found


def _runs(mask: np.ndarray) -> list[list[int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return edge.reshape(-1, 2).tolist()


def _pass(held, found_before: Column | None, text: Column) -> Column:
    def scan(t: bytes, before):
        seq = words(t)
        mask, found = find_windows(held.value, seq) if seq else (np.zeros(0, dtype=bool), set())
        ids = {x for x in found if x is not None}
        if before is not None:
            for a, b in before["runs"]:
                mask[a:b] = True
            ids |= set(before["items"])
        return len(seq), int(mask.sum()), _runs(mask), sorted(ids)

    def once(udf):
        """A filter on the hits must not run the scan a second time below it, as it would for a deterministic function."""
        return udf.asNondeterministic()

    names = ["n_words", "n_hit", "runs", "items"]
    if found_before is None:
        @F.pandas_udf(HITS)
        def first(texts: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([scan(t, None) for t in texts], columns=names)

        return once(first)(text)

    @F.pandas_udf(HITS)
    def more(texts: pd.Series, before: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([scan(t, b) for t, b in zip(texts, before.to_dict("records"))], columns=names)

    return once(more)(text, found_before)


def scan(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, part_windows: int = PART_WINDOWS) -> DataFrame:
    """Every input row as struct `row`, with `hits` (see HITS)."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("id"), utf8("text").alias("t"))
    found = F.regexp_count(F.col("t").cast("string"), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    windows = F.when(found > 0, F.greatest(found - (n - 1), F.lit(1))).otherwise(0)
    total = items.agg(F.sum(windows.cast("long"))).first()[0] or 0
    parts = max(1, math.ceil(total / part_windows))
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    dealt = F.pmod(F.xxhash64("id", "t"), F.lit(parts))
    for part in range(parts):
        rows = items.where(dealt == part).collect() if parts > 1 else items.collect()  # the text of about part_windows windows
        held = spark.sparkContext.broadcast(window_set([(r["id"], r["t"]) for r in rows], n))
        out = out.select("row", _pass(held, F.col("hits") if part else None, utf8(F.col("row.text"))).alias("hits"))
        if part + 1 < parts:
            out = stage(out)
    return out


def cut_runs(text: bytes, runs) -> bytes:
    """The text without its hit runs: from the first byte of a run's first word to the last byte of its last."""
    plain = text.translate(_WORD)
    starts, stops, at = [], [], 0
    for w in plain.split():
        at = plain.index(w, at)
        starts.append(at)
        at += len(w)
        stops.append(at)
    out, last = [], 0
    for a, b in runs:
        out.append(text[last:starts[a]])
        last = stops[b - 1]
    out.append(text[last:])
    return b"".join(out)


def clean(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, remove: str = "spans", part_windows: int = PART_WINDOWS) -> DataFrame:
    """The documents without benchmark windows, in the columns of `docs`.

    remove="spans" cuts every hit run out of the text and updates n_chars where that column exists; a
    document of which no word is left goes. remove="documents" drops every document with a hit.
    Documents without a hit stay as they are.
    """
    found = scan(docs, benchmark, n, part_windows)
    if remove == "documents":
        return found.where("hits.n_hit = 0").select("row.*")
    if remove != "spans":
        raise ValueError(f"remove must be 'spans' or 'documents', not {remove!r}")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, runs: pd.Series) -> pd.Series:
        return pd.Series([cut_runs(t, r).decode("utf-8", "replace") for t, r in zip(texts, runs)], dtype=object)

    left = found.where("hits.n_hit = 0 or hits.n_hit < hits.n_words")
    new = F.when(F.col("hits.n_hit") > 0, cut(utf8(F.col("row.text")), F.col("hits.runs"))).otherwise(F.col("row.text"))
    packed = left.select("row", "hits", new.alias("new"))
    cols = []
    for c in docs.columns:
        v = F.col(f"row.`{c}`")
        if c == "text":
            v = F.col("new")
        elif c == "n_chars":
            v = F.when(F.col("hits.n_hit") > 0, F.length("new").cast(docs.schema[c].dataType)).otherwise(v)
        cols.append(v.alias(c))
    return packed.select(*cols)
