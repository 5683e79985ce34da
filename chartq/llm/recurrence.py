"""Which windows of `length` consecutive tokens (words or bytes) occur anywhere else: the distributed frame that
substring dedup and suffix-array dedup share.

1. Every window elects an anchor: the k-gram with the smallest hash among those it holds (leftmost of ties). Equal windows
   elect at the same offset, so windows are only ever compared under equal anchors, and there is about one anchor per
   `length` / 2 tokens. An anchor row has the anchor's hash `a`, the range of windows that elected it, and the hash `c`
   of all text those windows cover (their context).
2. Counts by (a, c): where a context occurs twice, all its windows recur (kind 0) and no text is looked at again. Where `a`
   occurs with other contexts, single contexts are open (kind 1): some of their windows may recur. For an anchor with open
   contexts one copy of each repeated context is a witness (kind 2).
3. Open contexts and witnesses are cut from the texts and meet by anchor; a resolver given by the operator compares their
   windows exactly. An anchor with more than `DENSE` contexts is not gathered: its windows are counted by their
   128-bit hashes in a grouped aggregate instead.
4. The covered ranges go back to the texts.

Everything is keyed by a 128-bit hash of the text, so copies share their work, ids may be null or repeated, and
no list of a whole group is built. Very long texts are cut into pieces of `PIECE` tokens that overlap by a window;
an anchor at a cut is merely open instead of repeated.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartq.llm.common import stage, utf8

PIECE = 1 << 20
_ROWS = 2000             # rows that a task hands back at a time
DENSE = 20_000            # contexts of one anchor beyond which windows are counted in an aggregate
_MASK = np.uint64((1 << 24) - 1)
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93))

OCCURRENCES = "n long, sha string, a array<long>, c array<long>, lo array<long>, cnt array<int>, off array<int>"
CONTEXTS = "a long, kind int, h1 long, h2 long, lo long, cnt int, off int, ctx binary"
RANGES = "h1 long, h2 long, first long, last long"


@dataclass(frozen=True)
class Units:
    """What a token is, the window length and the anchor length."""

    words: bool
    length: int
    gram: int


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the hash bases and of their inverses modulo 2 ** 64, grown as needed."""

    def __init__(self):
        self.size = 0
        self.table: list[tuple[np.ndarray, np.ndarray]] = []

    def of(self, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.size:
            self.size = max(n, 2 * self.size, 1 << 14)
            self.table = []
            for b in _BASES:
                inv = np.uint64(pow(int(b), -1, 1 << 64))
                both = []
                for x in (b, inv):
                    p = np.full(self.size + 1, x, dtype=np.uint64)
                    p[0] = 1
                    both.append(np.cumprod(p, dtype=np.uint64))
                self.table.append((both[0], both[1]))
        return self.table[base]


def _prefix(t: np.ndarray, base: int, powers: Powers) -> np.ndarray:
    up, _ = powers.of(base, len(t) + 1)
    out = np.zeros(len(t) + 1, dtype=np.uint64)
    np.cumsum(t * up[:len(t)], out=out[1:], dtype=np.uint64)
    return out


def _ranges(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray, base: int, powers: Powers) -> np.ndarray:
    _, down = powers.of(base, len(prefix))
    return (prefix[stop] - prefix[start]) * down[start]


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * _BASES[0])
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def tokens(text: bytes, units: Units, powers: Powers) -> np.ndarray:
    """64-bit tokens: a table value per byte, or a hash per word."""
    if not units.words:
        return _BYTE[np.frombuffer(text, dtype=np.uint8)]
    out, at = [], 0
    while at < len(text):
        stop = min(len(text), at + PIECE)
        while stop < len(text) and not _SPACE[text[stop]]:   # pieces end between words
            stop += 1
        b = np.frombuffer(text, dtype=np.uint8, count=stop - at, offset=at)
        edge = np.flatnonzero(np.diff(np.concatenate(([True], _SPACE[b], [True])).astype(np.int8)))
        start, end = edge[::2], edge[1::2]
        p = _prefix(_BYTE[b], 2, powers)
        out.append(_mix(_ranges(p, start, end, 2, powers) + (end - start).astype(np.uint64)))
        at = stop
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def _window_min(keys: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every `w` consecutive keys."""
    n = len(keys)
    padded = np.full(-(-n // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF), dtype=np.uint64)
    padded[:n] = keys
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - w + 1], ahead[w - 1:n])


def anchors(t: np.ndarray, units: Units, powers: Powers):
    """Arrays (a, c, first window, number of windows, offset of the anchor in the first window)."""
    out = []
    for at in range(0, max(0, len(t) - units.length + 1), PIECE):
        s = t[at:at + PIECE + units.length - 1]
        p = _prefix(s, 0, powers)
        start = np.arange(len(s) - units.gram + 1)
        grams = _mix(_ranges(p, start, start + units.gram, 0, powers))
        least = _window_min((grams & ~_MASK) | start.astype(np.uint64), units.length - units.gram + 1)
        elected = (least & _MASK).astype(np.int64)
        lo = np.concatenate(([0], np.flatnonzero(np.diff(elected)) + 1))
        cnt = np.diff(np.concatenate((lo, [len(elected)])))
        pos = elected[lo]
        q = _prefix(s, 1, powers)
        c = _mix(_ranges(q, lo, lo + cnt + units.length - 1, 1, powers) + (pos - lo).astype(np.uint64) * _BASES[2] + cnt.astype(np.uint64))
        out.append((grams[pos].view(np.int64), c.view(np.int64), lo + at, cnt, pos - lo))
    if not out:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z, z, z
    return tuple(np.concatenate(x) for x in zip(*out))


def _occurrences(units: Units):
    @F.pandas_udf(OCCURRENCES)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        powers = Powers()
        for texts in batches:
            rows = []
            for text in texts:
                t = tokens(text, units, powers)
                a, c, lo, cnt, off = anchors(t, units, powers)
                kept = b" ".join(text.split()) if units.words else text
                rows.append((len(t), hashlib.sha256(kept).hexdigest(), a, c, lo, cnt.astype(np.int32), off.astype(np.int32)))
            yield pd.DataFrame(rows, columns=["n", "sha", "a", "c", "lo", "cnt", "off"])

    return run(F.col("t"))


def word_spans(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    b = np.frombuffer(text, dtype=np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], _SPACE[b], [True])).astype(np.int8)))
    return edge[::2], edge[1::2]


def _contexts(units: Units):
    """Cut the requested contexts out of the texts."""
    names = ["a", "kind", "h1", "h2", "lo", "cnt", "off", "ctx"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, h1, h2, *hits in zip(*[batch[c] for c in ("t", "h1", "h2", "a", "kind", "lo", "cnt", "off")]):
                if units.words:
                    start, end = word_spans(text)
                for a, kind, first, cnt, off in zip(*[x.tolist() for x in hits]):
                    last = first + cnt + units.length - 1
                    ctx = b" ".join(text[start[first]:end[last - 1]].split()) if units.words else text[first:last]
                    rows.append((a, kind, h1, h2, first, cnt, off, ctx))
                if len(rows) >= _ROWS:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    return run


def _window_hashes(units: Units):
    """128-bit hashes of all windows of the contexts of dense anchors."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = Powers()
        for batch in batches:
            for r in batch.itertuples():
                t = tokens(r.ctx, units, powers)
                i = np.arange(r.cnt)
                w = [_mix(_ranges(_prefix(t, b, powers), i, i + units.length, b, powers)).view(np.int64) for b in (0, 1)]
                yield pd.DataFrame({"w1": w[0], "w2": w[1], "kind": r.kind, "h1": r.h1, "h2": r.h2, "first": r.lo + i})

    return run


def _by_anchor(resolve: Callable) -> Callable:
    """Feed whole anchors, some millions of context bytes at a time, to the resolver."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            while len(batch):
                if held and size > 4 << 20:
                    last = held[-1]["a"].iloc[-1]
                    more = batch[batch["a"] == last]
                    held.append(more)
                    batch = batch[batch["a"] != last]
                    if len(batch):
                        yield resolve(pd.concat(held, ignore_index=True))
                        held, size = [], 0
                else:
                    held.append(batch)
                    size += int(batch["ctx"].str.len().sum())
                    batch = batch[:0]
        if held:
            yield resolve(pd.concat(held, ignore_index=True))

    return run


def flags_to_ranges(rows: pd.DataFrame, flags: list[np.ndarray], length: int) -> pd.DataFrame:
    """Covered token ranges of open contexts from per-window flags."""
    out = []
    for (kind, h1, h2, lo), f in zip(rows[["kind", "h1", "h2", "lo"]].itertuples(index=False), flags):
        if kind != 1 or not f.any():
            continue
        edge = np.flatnonzero(np.diff(np.concatenate(([0], f.astype(np.int8), [0])))).reshape(-1, 2)
        out += [(h1, h2, lo + a, lo + b - 1 + length) for a, b in edge.tolist()]
    return pd.DataFrame(out, columns=["h1", "h2", "first", "last"])


def _free(spark) -> None:
    """Let Spark drop the shuffle files of steps whose results are staged."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def covered(docs: DataFrame, units: Units, resolve: Callable[[pd.DataFrame], pd.DataFrame], dense: int = DENSE) -> tuple[DataFrame, DataFrame]:
    """(plain, marked): documents without a recurring window as (doc_id, n, sha of the whole), and the others as
    (doc_id, t, first, last), arrays of [first, last) token ranges (they may overlap)."""
    spark = docs.sparkSession
    keyed = docs.select("doc_id", utf8("text").alias("t")).withColumns(
        {"h1": F.xxhash64("t"), "h2": F.xxhash64(F.lit(units.length), F.col("t"))})
    found = stage(keyed.select("doc_id", "h1", "h2", _occurrences(units).alias("o")).select("doc_id", "h1", "h2", "o.*"))
    rows = found.select("h1", "h2", F.explode(F.arrays_zip("a", "c", "lo", "cnt", "off")).alias("x")).select("h1", "h2", "x.*")
    pairs = stage(rows.groupBy("a", "c").agg(F.count(F.lit(1)).alias("n")))
    single = F.col("n") == 1
    sums = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("contexts"), F.max("n").alias("most"), F.sum(single.cast("int")).alias("open"))
    met = sums.where("contexts > 1 or most > 1")
    judged = stage(pairs.join(met, "a").select("a", "c", "contexts", F.when(single, 1).otherwise(0).alias("kind"), (F.col("open") > 0).alias("open")))
    marked = stage(rows.join(judged, ["a", "c"]))
    _free(spark)
    witness = (marked.where("kind = 0 and open").groupBy("a", "c")
               .agg(F.min(F.struct("h1", "h2", "lo", "cnt", "off", "contexts")).alias("w")).select("a", "w.*", F.lit(2).alias("kind")))
    cols = ["h1", "h2", "lo", "cnt", "off", "a", "kind", "contexts"]
    asked = marked.select(*cols).union(witness.select(*cols))
    hits = stage(asked.groupBy("h1", "h2").agg(F.collect_set(F.struct(
        "lo", "cnt", "off", "kind", F.when(F.col("kind") > 0, F.col("a")).alias("a"),
        F.when(F.col("kind") > 0, F.col("contexts") > dense).alias("dense"))).alias("hits")))
    texts = stage(keyed.join(hits, ["h1", "h2"]))
    _free(spark)
    wanted = F.filter("hits", lambda x: x["kind"] > 0)
    contexts = texts.select("t", "h1", "h2", wanted.alias("hits")).where(F.size("hits") > 0)

    def cut(is_dense: bool) -> DataFrame:
        part = contexts.select("t", "h1", "h2", F.filter("hits", lambda x: x["dense"] == is_dense).alias("hits")).where(F.size("hits") > 0)
        part = part.select("t", "h1", "h2", *[_field("hits", c) for c in ("a", "kind", "lo", "cnt", "off")])
        out = part.mapInPandas(_contexts(units), CONTEXTS)
        once = out.where("kind = 2").dropDuplicates(["a", "h1", "h2", "lo"])   # copies of a witness's text
        return out.where("kind = 1").union(once)

    sparse = cut(False).repartition("a").sortWithinPartitions("a").mapInPandas(_by_anchor(resolve), RANGES)
    windows = stage(cut(True).mapInPandas(_window_hashes(units), "w1 long, w2 long, kind int, h1 long, h2 long, first long"))
    again = windows.groupBy("w1", "w2").agg(F.sum("kind").alias("n")).where("n > 1").select("w1", "w2")
    counted = (windows.where("kind = 1").join(again, ["w1", "w2"])
               .select("h1", "h2", "first", (F.col("first") + units.length).alias("last")))
    open_ranges = sparse.union(counted).groupBy("h1", "h2").agg(F.collect_list(F.struct("first", "last")).alias("more"))
    whole = F.transform(F.filter("hits", lambda x: x["kind"] == 0), lambda x: F.struct(
        x["lo"].alias("first"), (x["lo"] + x["cnt"] + (units.length - 1)).alias("last")))
    none = F.array().cast("array<struct<first:bigint,last:bigint>>")
    done = texts.join(stage(open_ranges), ["h1", "h2"], "left").select("doc_id", "t", F.concat(whole, F.coalesce("more", none)).alias("ranges"))
    plain = found.select("doc_id", "h1", "h2", "n", "sha").join(hits.select("h1", "h2"), ["h1", "h2"], "left_anti")
    return plain.select("doc_id", "n", "sha"), done.select("doc_id", "t", _field("ranges", "first"), _field("ranges", "last"))


def slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for i in range(0, len(batch), _ROWS):
            yield batch.iloc[i:i + _ROWS]


def _field(structs: str, name: str):
    """One field of an array of structs as an array of its own: a flat array in Python, not an object per element."""
    return F.transform(structs, lambda x: x[name]).alias(name)


def mask(first: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, last, -1)
    return np.cumsum(edge[:-1]) > 0
