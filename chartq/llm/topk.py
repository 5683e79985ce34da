"""Exact top-k search: BM25 over sharded inverted indexes with block-max dynamic pruning, merged with global statistics.

A query is a set of words. Document frequencies, the number of documents and their mean length come from one pass over
all documents and are joined to the query words, so scores do not depend on the sharding. Every shard (about
`SHARD_BYTES` of text) builds an inverted index whose documents are ordered by their commonest word and length and cut into
blocks of `BLOCK` documents. The lists of the commonest words, which make up most postings, are columns of counts with the
largest impact per block; the lists of all others are walked in full, `RUN` postings at a time. Queries stream through the shard, some at a
time: a block's upper bound is the sum of the block maxima and the best of its scores so far, and the k-th best of the blocks' best
scores is a limit that rises while blocks are scored. Only blocks whose bound still reaches it are scored (WAND at block grain: no
document that could enter the result is skipped). Columns are multiplied in single precision, with a margin for its errors; what
reaches the limit is scored again in double. The k best of every shard are merged by one ranked window.

A task holds no text but the one at hand: a shard's documents become postings as they arrive, `PART` at a time, in narrow columns.

Documents are sent once, to one task a shard; each distinct query text is sent to every shard once, packed with others whose words
are written once (`_pack`), and its result joined to the ids that ask it. Ties in score go to the smaller doc_id (nulls last).

Edge cases: null or empty texts have no words: as queries they give no rows, as documents they never match; queries with
equal id and text are one query; repeated documents are separate results; a null query id is a query of its own;
an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chartq.llm.common import stage, utf8
from chartq.llm.decontam import words

K = 10
K1, B = 1.2, 0.75
SHARD_BYTES = 64 << 20
BLOCK = 128               # documents of a block
DENSE_WORDS = 512         # words of a shard that are stored as dense columns, the commonest ones
RUN = 16                  # postings read together; shorter lists are read one by one
PART = 1 << 16            # postings handled together while an index is built
COUNTED = 1 << 18         # distinct terms that are counted together
AT_ONCE = 512             # queries answered together at most,
CELLS = 5 << 20           # and their scores of all documents
RISE = 8                  # blocks scored before the limits are raised
PACKED = 1 << 20          # words of the queries that are packed together
SURE = 1 - DENSE_WORDS * 2.0 ** -21       # limits in single precision are lowered by more than its errors can be

_hash = xxhash.xxh64_intdigest


def _terms(text: bytes) -> Counter:
    return Counter(words(text))


def _numbers(terms) -> np.ndarray:
    return np.array([_hash(w) for w in terms], dtype=np.uint64).view(np.int64)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of documents of each term, some at a time; a row without a term has the number of words."""
    def rows(df: Counter, size: int) -> pa.RecordBatch:
        term = pa.array(np.append(_numbers(df), 0), mask=np.arange(len(df) + 1) == len(df))
        return pa.record_batch([term, pa.array([*df.values(), size], pa.int64())], ["term", "df"])

    for batch in batches:
        df: Counter = Counter()
        size = 0
        for t in batch["t"]:
            seq = words(t.as_py())
            size += len(seq)
            df.update(set(seq))
            if len(df) >= COUNTED:
                yield rows(df, size)
                df, size = Counter(), 0
        yield rows(df, size)


def _query_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        asked, terms = [], []
        for q, t in zip(batch["q"], batch["t"]):
            own = _numbers(set(words(t)))
            asked += [q] * len(own)
            terms.append(own)
        yield pd.DataFrame({"q": pd.Series(asked, dtype=object), "term": np.concatenate(terms) if terms else np.zeros(0, np.int64)})


class Shard:
    """Inverted index of one shard: the commonest words' counts as dense columns cut into blocks of documents, with the
    largest impact per word and block, and posting lists of all other words. Texts are read once, one by one, and ids after them."""

    def __init__(self, ids: list, texts: Iterable[bytes], mean: float):
        size, held = [], []
        for part in _postings(texts):
            size.append(part.pop())
            held.append(part)
        self.vocab = np.unique(np.concatenate([np.zeros(0, np.int64), *(x[0] for x in held)]))
        in_docs = np.zeros(len(self.vocab), np.int64)
        starts = np.cumsum([0, *map(len, size)]).tolist()
        size = np.concatenate([np.zeros(0), *size])
        n = len(size)
        common = np.zeros(n)
        for x in held:
            x[0] = np.searchsorted(self.vocab, x[0]).astype(np.int32)
            in_docs[x[0]] += np.bincount(x[1], minlength=len(x[0]))
        for first, (names, at, _, doc) in zip(starts, held):
            np.maximum.at(common, doc.astype(np.int32) + first, in_docs[names][at].astype(float))
        order = np.lexsort((size, common))
        place = np.empty(n, dtype=np.int32)
        place[order] = np.arange(n)
        self.ids = [ids[i] for i in order.tolist()]
        self.blocks = -(-n // BLOCK)
        norm = K1 * (1 - B + B * size / mean)
        self.norm = np.ones((self.blocks * BLOCK, 1))
        self.norm[place, 0] = norm
        top = np.argsort(-in_docs, kind="stable")[:DENSE_WORDS]
        self.column = np.full(len(self.vocab), -1, dtype=np.int64)
        self.column[top] = np.arange(len(top))
        self.table = np.zeros((self.blocks * BLOCK, len(top)), np.result_type(np.uint8, *(x[2] for x in held)))
        in_docs[top] = 0
        self.size = np.where(in_docs < RUN, in_docs, -(-in_docs // RUN) * RUN)      # whole runs, filled up by impacts of 0
        in_runs = np.where(in_docs < RUN, 0, self.size)
        self.runs = int(in_runs.sum())
        self.first = np.where(in_docs < RUN, self.runs + np.cumsum(self.size - in_runs), np.cumsum(in_runs)) - self.size
        self.doc, self.impact = np.zeros(self.size.sum(), np.int32), np.zeros(self.size.sum())
        self.weighed = np.zeros(len(self.vocab), bool)
        free = self.first.copy()
        for i, first in enumerate(starts[:-1]):
            (names, at, tf, doc), held[i] = held[i], None
            at, doc = names[at], doc.astype(np.int32) + first
            column = self.column[at]
            dense = np.flatnonzero(column >= 0)
            self.table[place[doc[dense]], column[dense]] = tf[dense]
            rest = np.flatnonzero(column < 0)
            rest = rest[np.argsort(at[rest], kind="stable")]
            at, doc, tf = at[rest], doc[rest], tf[rest]
            run = np.flatnonzero(np.diff(at, prepend=-1))
            many = np.diff(run, append=len(at))
            to = np.arange(len(at)) + np.repeat(free[at[run]] - run, many)
            free[at[run]] += many
            self.doc[to], self.impact[to] = place[doc], _impact(tf, norm[doc])
        self.narrow = self.norm.astype(np.float32)
        self.most = np.zeros((self.blocks, len(top)), np.float32)
        for b in range(self.blocks):
            self.most[b] = self._dense(slice(b * BLOCK, (b + 1) * BLOCK)).max(axis=0)

    def _dense(self, rows: slice) -> np.ndarray:
        """Impacts of the commonest words in some places, in single precision."""
        return _impact(self.table[rows].astype(np.float32), self.narrow[rows])

    def enter(self, terms: np.ndarray, idf: np.ndarray) -> np.ndarray:
        """The place of each of some sorted terms in the vocabulary, -1 if it has none. The impacts in their lists are weighed
        when a term comes for the first time: it has the same weight in all queries."""
        at = np.minimum(np.searchsorted(self.vocab, terms), len(self.vocab) - 1)
        here = self.vocab[at] == terms
        new = np.flatnonzero(here & ~self.weighed[at])
        self.weighed[at[new]] = True
        for own in np.split(new, np.flatnonzero(np.diff(np.cumsum(self.size[at[new]]) // PART)) + 1):
            postings, owner = _spread(self.first[at[own]], self.size[at[own]])
            self.impact[postings] *= idf[own][owner]
        return np.where(here, at, -1)

    def search(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[list[int], list[float]]]:
        """Places and scores of each query's k best documents (and of all that tie with the last), a query being its terms and weights."""
        at = np.concatenate([np.zeros(0, np.int64), *(self.enter(terms, idf) for terms, idf in queries)])
        owner = np.repeat(np.arange(len(queries)), [len(terms) for terms, _ in queries])
        here = at >= 0
        q, place, own = self.ranked(len(queries), owner[here], at[here], np.concatenate([np.zeros(0), *(idf for _, idf in queries)])[here], k)
        return [(place[q == i].tolist(), own[q == i].tolist()) for i in range(len(queries))]

    def ranked(self, n: int, owner: np.ndarray, at: np.ndarray, idf: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, place, score) of the k best documents of n queries, and of all that tie with the last, by query. The queries' words
        are given by the query that has it, its place in the vocabulary and its weight, by query."""
        column = self.column[at]
        dense = column >= 0
        weights = np.zeros((n, self.table.shape[1]))
        weights[owner[dense], column[dense]] = idf[dense]
        narrow = weights.astype(np.float32)
        scores = self._walk(n, owner[~dense], at[~dense])
        best = scores.reshape(n, self.blocks, BLOCK).max(axis=2)
        bound = best + narrow @ self.most.T
        left = np.argsort(-bound.sum(axis=0), kind="stable")
        found = []
        while len(left):
            limit = _kth(best, k) * SURE
            wanted = (bound[:, left] >= limit[:, None]) & (bound[:, left] > 0)
            going = wanted.any(axis=0)
            left, wanted = left[going], wanted[:, going]
            for i, b in enumerate(left[:RISE].tolist()):
                q, rows = np.flatnonzero(wanted[:, i]), slice(b * BLOCK, (b + 1) * BLOCK)
                own = narrow[q] @ self._dense(rows).T + scores[q, rows]
                best[q, b] = most = own.max(axis=1)
                hit = np.flatnonzero((most >= limit[q]) & (most > 0))
                q, own = q[hit], own[hit]
                hit, place = np.nonzero((own >= limit[q, None]) & (own > 0))
                found.append((q[hit], place + b * BLOCK, own[hit, place]))
            left = left[RISE:]
        q, place, near = (np.concatenate([x[i] for x in found]) if found else np.zeros(0, np.int64) for i in range(3))
        keep = near >= (_kth(best, k) * SURE)[q]
        q, place, near = q[keep], place[keep], near[keep]
        order = np.lexsort((-near, q))
        q, place, near = q[order], place[order], near[order]
        limit = _last(q, near, n, k) * SURE
        keep = near >= limit[q]
        q, place = q[keep], place[keep]
        own = np.zeros(len(q))
        for i in range(0, len(q), AT_ONCE):
            cut = slice(i, i + AT_ONCE)
            own[cut] = (_impact(self.table[place[cut]].astype(float), self.norm[place[cut]]) * weights[q[cut]]).sum(axis=1)
        own = (own + scores[q, place]).round(9)                 # copies tie whatever the order of summation
        order = np.lexsort((-own, q))
        q, place, own = q[order], place[order], own[order]
        keep = own >= np.maximum(_last(q, own, n, k), 1e-12)[q]
        return q[keep], place[keep], own[keep]

    def _walk(self, n: int, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Scores of all places by the lists of the words that are not dense."""
        scores = np.zeros((n, self.blocks * BLOCK))
        first, size = self.first[at], self.size[at]
        short = size < RUN
        postings, term = _spread(first[short], size[short])
        np.add.at(scores.reshape(-1), owner[short][term] * scores.shape[1] + self.doc[postings], self.impact[postings])
        runs, term = _spread(first[~short] // RUN, size[~short] // RUN)
        ends = np.searchsorted(owner[~short][term], np.arange(n + 1))
        doc, impact = self.doc[:self.runs].reshape(-1, RUN), self.impact[:self.runs].reshape(-1, RUN)
        most = int(np.diff(ends).max(initial=0))
        docs, to, add = np.empty((most, RUN), np.int32), np.empty((most, RUN), np.int64), np.empty((most, RUN))     # made once, not for each query
        for q, (x, y) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
            np.take(doc, runs[x:y], axis=0, out=docs[:y - x], mode="clip")
            np.take(impact, runs[x:y], axis=0, out=add[:y - x], mode="clip")
            to[:y - x] = docs[:y - x]
            np.add.at(scores[q], to[:y - x].reshape(-1), add[:y - x].reshape(-1))
        return scores


def _postings(texts: Iterable[bytes]) -> Iterator[list[np.ndarray]]:
    """Postings of the texts, about `PART` at a time: the distinct terms, the number of its term among them, its count and its text's
    number in the part for each posting, and the size of each text. Counts and numbers are as narrow as the part allows."""
    def part() -> list[np.ndarray]:
        names, at = np.unique(np.concatenate(terms), return_inverse=True)
        tf = np.concatenate(counts)
        doc = np.repeat(np.arange(len(terms)), [len(x) for x in terms])
        return [names, *(x.astype(np.min_scalar_type(int(x.max(initial=0)))) for x in (at, tf, doc)), np.array(size, float)]

    terms, counts, size, held = [], [], [], 0
    for text in texts:
        own = _terms(text)
        terms.append(_numbers(own))
        counts.append(np.fromiter(own.values(), np.int64, len(own)))
        size.append(own.total())
        held += len(own)
        if held >= PART or len(size) >= PART:
            yield part()
            terms, counts, size, held = [], [], [], 0
    if size:
        yield part()


def _impact(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    out = tf * (K1 + 1)
    out /= tf + norm
    return out


def _kth(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest score of every row (0 where fewer than k are above 0)."""
    if scores.shape[1] < k:
        return np.zeros(len(scores))
    at = scores.shape[1] - k
    return np.partition(scores, at, axis=1)[:, at]


def _last(q: np.ndarray, scores: np.ndarray, n: int, k: int) -> np.ndarray:
    """The k-th of each query's scores, which descend (0 where fewer than k)."""
    ends = np.searchsorted(q, np.arange(n + 1))
    out = np.zeros(n)
    enough = np.diff(ends) >= k
    out[enough] = scores[ends[:-1][enough] + k - 1]
    return out


def _spread(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges of some sizes, and the range each belongs to."""
    owner = np.repeat(np.arange(len(size)), size)
    return np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size), owner


def _best(ids: list, found: Iterable[int], scores: Iterable[float], k: int) -> list[tuple]:
    rows = sorted(((-s, ids[i] is None, 0 if ids[i] is None else ids[i]) for i, s in zip(found, scores)))
    return [(None if none else i, -s) for s, none, i in rows[:k]]


def _planes(x: np.ndarray) -> bytes:
    """The numbers' first bytes, then their second ones, and so on, so that small ones are compressed when they are sent."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Queries (key, terms in order, dfs) packed together, about `PACKED` words at a time: their number and those of their distinct terms and
    of all their terms; then the keys, how many terms each has, the distinct terms in order, their dfs, and each query's terms by number."""
    def packed() -> pa.RecordBatch:
        keys, counts, terms, dfs = (np.concatenate(x) for x in zip(*held))
        vocab, first, number = np.unique(terms, return_index=True, return_inverse=True)
        gaps = np.diff(number, prepend=0)
        start = (np.cumsum(counts) - counts)[counts > 0]
        gaps[start] = number[start]
        head = np.array([len(keys), len(vocab), len(terms)])
        parts = [_planes(x) for x in (np.diff(keys, prepend=0), counts, np.diff(vocab, prepend=0), dfs[first], gaps.astype(np.uint32))]
        return pa.record_batch([pa.array([b"".join([head.tobytes(), *parts])], pa.binary())], ["t"])

    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(batch["terms"].value_lengths().to_numpy())
        edges = (np.flatnonzero(np.diff(ends // PACKED)) + 1).tolist()
        for a, b in zip([0, *edges], [*edges, len(batch)]):
            part = batch.slice(a, b - a)
            terms = part["terms"].flatten().to_numpy()
            held.append((part["key"].to_numpy(), part["terms"].value_lengths().to_numpy().astype(np.int64), terms, part["dfs"].flatten().to_numpy()))
            size += len(terms)
            if size >= PACKED:
                yield packed()
                held, size = [], 0
    if size:
        yield packed()


def _unpack(packed: bytes) -> tuple[np.ndarray, ...]:
    """keys, counts, distinct terms, their dfs, numbers of the terms: see `_pack`."""
    n, distinct, total = np.frombuffer(packed, np.int64, 3).tolist()
    out, at = [], 24
    for size, kind in ((n, np.int64), (n, np.int64), (distinct, np.int64), (distinct, np.int64), (total, np.uint32)):
        width = np.dtype(kind).itemsize
        out.append(np.frombuffer(packed, np.uint8, size * width, at).reshape(width, size).T.copy().view(kind).reshape(-1))
        at += size * width
    keys, counts, terms, dfs, gaps = out
    number = np.cumsum(gaps, dtype=np.int64)
    start = np.cumsum(counts) - counts
    return np.cumsum(keys), counts, np.cumsum(terms), dfs, number - np.repeat(np.append(0, number)[start], counts)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(shard, kind, rows): the batches cut where the shard or the kind changes."""
    for batch in batches:
        kinds, shards = batch["kind"].to_numpy(zero_copy_only=False), batch["shard"].to_numpy(zero_copy_only=False)
        edges = (np.flatnonzero((np.diff(kinds) != 0) | (np.diff(shards) != 0)) + 1).tolist()
        for a, b in zip([0, *edges], [*edges, len(kinds)]):
            if a < b:
                yield shards[a], kinds[a], batch.slice(a, b - a)


def _texts(parts: Iterator[tuple[int, int, pa.RecordBatch]], ids: list) -> Iterator[bytes]:
    """The texts that are not empty; their ids are added to `ids`."""
    for _, _, part in parts:
        for i, t in zip(part["id"], part["t"]):
            if text := t.as_py():
                ids.append(i.as_py())
                yield text


def _answers(shard: Shard, packed: bytes, k: int, n: int) -> Iterator[tuple[int, int, float]]:
    """(key, place, score) of the k best documents of packed queries, and of all that tie with the last, by query."""
    keys, counts, terms, df, number = _unpack(packed)
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    place = shard.enter(terms, idf)
    ends = np.append(0, np.cumsum(counts))
    step = max(1, min(AT_ONCE, CELLS // (shard.blocks * BLOCK)))
    for i in range(0, len(keys), step):
        own = number[ends[i]:ends[min(i + step, len(keys))]]
        here = place[own] >= 0
        owner, own = np.repeat(np.arange(len(counts[i:i + step])), counts[i:i + step])[here], own[here]
        q, at, scores = shard.ranked(len(counts[i:i + step]), owner, place[own], idf[own], k)
        yield from zip(keys[q + i].tolist(), at.tolist(), scores.tolist())


def _search(k: int, mean: float, n: int):
    """Each shard's documents come first (kind 0), then its queries: one a row (1: q, terms, dfs) or packed (2: in t; q is the key)."""
    def answers(shard: Shard, packed: bytes, names: pa.Array | None, kind: pa.DataType) -> pa.RecordBatch:
        out = []
        for key, found in groupby(_answers(shard, packed, k, n), itemgetter(0)):
            _, at, scores = zip(*found)
            out += [(key, d, x) for d, x in _best(shard.ids, at, scores, k)]
        columns = list(zip(*out)) or [(), (), ()]
        q, doc, score = (pa.array(c, t) for c, t in zip(columns, [pa.int64(), kind, pa.float64()]))
        return pa.record_batch([q if names is None else names.take(q), doc, score], ["q", "doc_id", "score"])

    def packs(kind: int, part: pa.RecordBatch) -> Iterator[tuple[bytes, pa.Array | None]]:
        """Packed queries, and what their keys number if they came one a row."""
        if kind == 1:
            keys = pa.array(range(len(part)), pa.int64())
            part, names = pa.record_batch([keys, part["terms"], part["dfs"]], ["key", "terms", "dfs"]), part["q"]
            yield from ((x.as_py(), names) for b in _pack(iter([part])) for x in b["t"])
        else:
            yield from ((x.as_py(), None) for x in part["t"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groupby(_slices(batches), itemgetter(0)):
            shard = None
            for kind, parts in groupby(rows, itemgetter(1)):
                if kind == 0:
                    ids: list = []
                    shard = Shard(ids, _texts(parts, ids), mean)
                elif shard is not None and len(shard.vocab):
                    yield from (answers(shard, x, names, part.schema.field("id").type) for _, _, part in parts for x, names in packs(kind, part))

    return run


def search(docs: DataFrame, queries: DataFrame, k: int = K, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The k best documents of every query: query_id, doc_id, rank, score. Both inputs have doc_id and text."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", utf8("text").alias("t"))
    asked = queries.select(F.col("doc_id").alias("query_id"), utf8("text").alias("t")).withColumn("q", F.unhex(F.sha2("t", 256)))
    counts = rows.select("t").mapInArrow(_frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    counts = stage(counts)
    n, size = rows.agg(F.count(F.lit(1)), F.sum(F.length("t"))).first()
    total = counts.where("term is null").agg(F.sum("df")).first()[0] or 0
    mean = max(total / max(n, 1), 1e-9)
    kind = docs.schema["doc_id"].dataType.simpleString()
    own = asked.dropDuplicates(["q"]).select("q", "t").mapInPandas(_query_terms, "q binary, term long")
    known = stage(own.join(counts.where("term is not null"), "term").groupBy("q")
                  .agg(F.array_sort(F.collect_list(F.struct("term", "df"))).alias("x"))
                  .select("q", F.monotonically_increasing_id().alias("key"), F.col("x.term").alias("terms"), F.col("x.df").alias("dfs")))
    packs = math.ceil((known.agg(F.sum(F.size("terms"))).first()[0] or 0) / PACKED)
    packed = stage(known.select("key", "terms", "dfs").repartition(max(1, packs)).mapInArrow(_pack, "t binary"))
    shards = max(1, math.ceil((size or 0) / shard_bytes))
    side = rows.select(F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"),
                       F.col("doc_id").alias("id"), "t")
    sent = packed.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(2).alias("kind"),
                         F.lit(None).cast(kind).alias("id"), "t")
    found = (side.union(sent).repartitionById(shards, "shard").sortWithinPartitions("shard", "kind")
             .mapInArrow(_search(k, mean, n), f"q long, doc_id {kind}, score double")).withColumnRenamed("q", "key")
    order = Window.partitionBy("key").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return (asked.select("query_id", "q").distinct().join(known.select("q", "key"), "q").join(best, "key")
            .select("query_id", "doc_id", "rank", "score"))
