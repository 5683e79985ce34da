"""Hard-negative mining by BOND: a vertical scan of embedding dimensions with shrinking candidate bitmaps.

Rows are cut into blocks and every block is stored by dimension (one column of scaled whole numbers per dimension) with each
column's minimum and maximum. An anchor reads a block's columns in descending order of its own magnitudes, a few at a
time. A candidate's partial inner product and what the unread columns may still add (from their minima and maxima) bound its
score from both sides; after each step the bitmap keeps the candidates whose bounds can still reach

* positives: the k-th best lower bound among the rows with the anchor's label;
* negatives: one of the anchor's score windows, above the third best lower bound of the rows surely inside it.

Survivors are scored exactly (whole numbers, so no rounding). Pruning only uses bounds, so results are exact; there is no cap.
Anchors pass over all blocks twice: first for their positives, whose scores set the windows, then for the negatives. Blocks are
dealt by row number, so no label or group of equal vectors makes one block larger; a block returns at most its own
first few rows for each anchor, and these are merged by ranked windows over a few rows per anchor (or window) and block.
The number of blocks grows with the square root of the number of rows, which keeps the anchors sent to them (a fiftieth of all rows
each) in balance with the blocks' size, and further where a block would exceed `BLOCK_BYTES`. Neither rows nor anchors are broadcast.

Edge cases: rows with a null label, a null vector or a null or non-finite component take no part; a row without an id is never an
anchor but may be a positive or a negative, after equal scores with an id; vectors of unequal length are compared as if the
shorter had zeros at its end, empty vectors score 0; scaled components beyond `LIMIT` are held there, so that scores of up to 8,191
dimensions fit in a long; repeated rows are separate rows (an anchor leaves out only itself), and an id that two anchors share
gives the rows of both; negative scores of positives have empty windows, a score of 0 the window 0; an empty table gives an
empty result; columns beyond vec_id, label and the vector are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartq.llm.common import stage

SCALE = 256
LIMIT = 1 << 25
POSITIVES = 5
NEGATIVES = 3
LOW, HIGH = 50, 95        # a negative's score in hundredths of the positive's, both ends included
BLOCK_BYTES = 128 << 20   # columns of one block in a worker's memory
STEP = 8                  # dimensions read between two looks at the bounds


class Block:
    """Rows of one block by dimension, ordered by label; `cols[d]` has the d-th component of all rows."""

    def __init__(self, rows: np.ndarray, label: np.ndarray, ids: np.ndarray, no_id: np.ndarray, number: np.ndarray):
        # ties in score go to the smaller id, so rows of a label are kept in the order of ids, those without one last
        order = np.lexsort((number, ids, no_id, label))
        self.cols = np.ascontiguousarray(rows[order].T)
        self.label, self.ids, self.no_id, self.number = label[order], ids[order], no_id[order], number[order]
        self.order = np.lexsort((self.number, self.ids, self.no_id)).argsort()   # place among all rows
        most = int(np.abs(self.cols).max(initial=0))
        if most * most * max(1, len(self.cols)) < 1 << 53:     # sums of doubles are exact here, and faster
            self.cols = self.cols.astype(np.float64)
        self.zones = {None: self._zone(slice(None))}

    def _zone(self, part) -> tuple[np.ndarray, np.ndarray]:
        own = self.cols[:, part]
        zero = np.zeros(len(own), own.dtype)
        return (own.min(axis=1), own.max(axis=1)) if own.shape[1] else (zero, zero)

    def part(self, label: int) -> slice:
        return slice(*np.searchsorted(self.label, [label, label + 1]).tolist())

    def scan(self, anchor: np.ndarray, zone: tuple[np.ndarray, np.ndarray], alive: np.ndarray, prune) -> tuple[np.ndarray, np.ndarray]:
        """Read columns by the anchor's descending magnitude; `prune(partial, least, most)` says which candidates stay.

        `alive` are the candidates' places; returns those left after the last column with their exact scores."""
        order = np.argsort(-np.abs(anchor), kind="stable")
        order = order[:np.count_nonzero(anchor)]               # the rest adds nothing
        ends = np.stack([anchor * zone[0], anchor * zone[1]])
        least, most = ([*np.cumsum(e[order][::-1])[::-1].tolist(), 0] for e in (ends.min(axis=0), ends.max(axis=0)))
        partial = np.zeros(len(alive), self.cols.dtype)
        whole = len(alive) == self.cols.shape[1]
        for k in range(0, len(order), STEP):
            dims = order[k:k + STEP]
            own = self.cols[dims] if whole else self.cols[dims[:, None], alive]
            partial += anchor[dims] @ own
            k = min(k + STEP, len(order))
            stay = prune(partial, least[k], most[k], alive)
            if not stay.all():
                alive, partial, whole = alive[stay], partial[stay], False
            if not len(alive):
                break
        return alive, partial.astype(np.int64)

    def positives(self, anchor: np.ndarray, label: int, number: int, k: int) -> list[tuple]:
        """The k best other rows of the label by (score, smaller id) as (score, id or None, number)."""
        part = self.part(label)
        if label not in self.zones:
            self.zones[label] = self._zone(part)
        alive = np.arange(part.start, part.stop)
        alive = alive[self.number[alive] != number]

        def prune(partial, least, most, _):
            if len(partial) <= k:
                return np.ones(len(partial), bool)
            floor = np.partition(partial, len(partial) - k)[len(partial) - k] + least
            return partial + most >= floor

        alive, score = self.scan(anchor.astype(self.cols.dtype), self.zones[label], alive, prune)
        return self._first(alive, score, k)

    def negatives(self, anchor: np.ndarray, label: int, windows: list[tuple[int, int]], k: int) -> list[list[tuple]]:
        """Per window [low, high] the k best rows of other labels with a score inside it, as in `positives`."""
        part = self.part(label)
        alive = np.concatenate([np.arange(part.start), np.arange(part.stop, len(self.label))])
        spans = sorted({w for w in windows if w[0] <= w[1]})
        if not spans:
            return [[] for _ in windows]

        def prune(partial, least, most, _):
            stay = np.zeros(len(partial), bool)
            for low, high in spans:
                inside = partial[(partial + least >= low) & (partial + most <= high)]
                floor = low if len(inside) < k else max(low, np.partition(inside, len(inside) - k)[len(inside) - k] + least)
                stay |= (partial + most >= floor) & (partial + least <= high)
            return stay

        alive, score = self.scan(anchor.astype(self.cols.dtype), self.zones[None], alive, prune)
        best = {}
        for low, high in spans:
            inside = (score >= low) & (score <= high)
            best[low, high] = self._first(alive[inside], score[inside], k)
        return [best.get(w, []) for w in windows]

    def _first(self, alive: np.ndarray, score: np.ndarray, k: int) -> list[tuple]:
        if len(score) > k:
            keep = score >= np.partition(score, len(score) - k)[len(score) - k]
            alive, score = alive[keep], score[keep]
        first = np.lexsort((self.order[alive], -score))[:k]
        return [(int(s), None if self.no_id[i] else int(self.ids[i]), int(self.number[i])) for i, s in zip(alive[first].tolist(), score[first].tolist())]


def windows_of(scores: list[int], low: int = LOW, high: int = HIGH) -> list[tuple[int, int]]:
    """The whole scores n with low * p <= 100 * n <= high * p, for every p, as (first, last)."""
    return [(-(-low * p // 100), high * p // 100) for p in scores]


def _scan(width: int, positives: int, negatives: int, low: int, high: int, second: bool):
    """Each block's rows come first (kind 0), then the anchors (kind 1)."""
    def matrix(column: pa.ListArray) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block, held = None, None, []
        for batch in batches:
            kinds, blocks = batch["kind"].to_numpy(zero_copy_only=False), batch["block"].to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((np.diff(kinds) != 0) | (np.diff(blocks) != 0)) + 1
            out = []
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(kinds)]):
                run_of = batch.slice(a, b - a)
                if blocks[a] != number:
                    number, block, held = blocks[a], None, []
                ids = run_of["vec_id"]
                parts = (matrix(run_of["q"]), run_of["label"].to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False),
                         ids.is_null().to_numpy(zero_copy_only=False), run_of["number"].to_numpy(zero_copy_only=False))
                if kinds[a] == 0:
                    held.append(parts)
                    continue
                if block is None:
                    if not held:
                        continue
                    block, held = Block(*(np.concatenate(x) for x in zip(*held))), []
                marks = run_of["marks"].to_pylist() if second else [None] * (b - a)
                for q, label, own, scores in zip(parts[0], parts[1].tolist(), parts[4].tolist(), marks):
                    if second:
                        found = block.negatives(q, label, windows_of(scores, low, high), negatives)
                        out += [(own, j, s, i, n) for j, rows in enumerate(found) for s, i, n in rows]
                    else:
                        out += [(own, 0, s, i, n) for s, i, n in block.positives(q, label, own, positives)]
            names = ["anchor", "slot", "score", "vec_id", "number"]
            columns = list(zip(*out)) if out else [()] * 5
            yield pa.record_batch([pa.array(c, pa.int32() if n == "slot" else pa.int64()) for n, c in zip(names, columns)], names)

    return run


def prepare(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows that take part, staged: vec_id, label (long), q (scaled components, zeros up to the longest), number (of the row)."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fit = vectors.where(F.col("label").isNotNull() & v.isNotNull()).where(finite)
    width = fit.agg(F.max(F.size(v))).first()[0] or 0
    scaled = F.transform(v, lambda x: F.least(F.greatest(F.floor(F.lit(float(SCALE)) * x.cast("double")), F.lit(-LIMIT)), F.lit(LIMIT)).cast("int"))
    q = F.concat(scaled, F.array_repeat(F.lit(0).cast("int"), F.lit(width) - F.size(v)))
    return stage(fit.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), q.alias("q"),
                            F.monotonically_increasing_id().alias("number")))


def mine(rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
         blocks: int | None = None) -> DataFrame:
    """For the rows of `prepare` marked by `anchors`: anchor_id, positive_id, rank, negative_id, positive_score, negative_score,
    and the row numbers of anchor and positive (anchor, positive)."""
    spark = rows.sparkSession
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("q"))).first()
    if not n:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long, "
                                         "anchor long, positive long")
    blocks = blocks or max(1, math.ceil(math.sqrt(n) / 40), math.ceil(n * width * 8 / BLOCK_BYTES))
    asked = rows.where(anchors & F.col("vec_id").isNotNull())
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    side = rows.select(F.pmod(F.xxhash64("number"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), "*",
                       F.lit(None).cast("array<long>").alias("marks"))

    def scan(sent: DataFrame, second: bool) -> DataFrame:
        dealt = side.union(sent.select(F.col("block").cast("int"), F.lit(1).alias("kind"), "vec_id", "label", "q", "number", "marks"))
        return (dealt.repartitionById(blocks, "block").sortWithinPartitions("block", "kind")
                .mapInArrow(_scan(width, positives, negatives, low, high, second), "anchor long, slot int, score long, vec_id long, number long"))

    def ranked(found: DataFrame, k: int) -> DataFrame:
        order = Window.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "number")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    first = scan(asked.select(every, "*", F.lit(None).cast("array<long>").alias("marks")), False)
    pos = stage(ranked(first, positives).select("anchor", (F.col("rank") - 1).alias("slot"), F.col("score").alias("positive_score"),
                                                F.col("vec_id").alias("positive_id"), F.col("number").alias("positive")))
    marks = (pos.groupBy(F.col("anchor").alias("number")).agg(F.array_sort(F.collect_list(F.struct("slot", "positive_score"))).alias("m"))
             .select("number", F.col("m.positive_score").alias("marks")))
    marked = asked.join(marks, "number")
    second = ranked(scan(marked.select(every, "vec_id", "label", "q", "number", "marks"), True), negatives)
    of = asked.select(F.col("number").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return (second.select("anchor", "slot", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
                          F.col("score").alias("negative_score"))
            .join(pos, ["anchor", "slot"]).join(of, "anchor")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "anchor", "positive"))
