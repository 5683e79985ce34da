"""Suffix-array dedup: blockwise sorting of suffix buckets, with cover-sample ranks for long ties.

A string of `LENGTH` bytes that starts in two places is found by sorting suffixes and comparing neighbours. Only suffixes of
windows whose anchor recurs (see `recurrence`) can match, and only within the bucket of their anchor; in a bucket all contexts
are aligned at the anchor, so suffixes that agree start at the same offset. One (bucket, offset) at a time is sorted:

* cover sample: at every `cover`-th aligned offset the suffixes are ranked once by their next `core` bytes;
* a suffix that starts less than `cover` bytes before a sampled offset is sorted by that rank, which settles the long
  tie, and by its few bytes on either side of the core. Neighbours with equal keys recur.

Memory holds one block of contexts of some megabytes and one offset's keys. Bytes are UTF-8; matches never cross documents;
every byte covered by a recurring string goes, judged on the input.

Edge cases: null texts are empty; texts shorter than `LENGTH` keep all; copies lose everything of `LENGTH` bytes or more;
self-repeating texts count their own strings; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartq.llm import recurrence

LENGTH = 400
GRAM = 32


def _ranks(*parts: np.ndarray) -> np.ndarray:
    """Dense ranks of byte rows, all parts side by side, in lexicographic order."""
    joined = np.ascontiguousarray(np.concatenate(parts, axis=1))
    keys = joined.view(np.dtype((np.void, joined.shape[1]))).ravel()
    return np.unique(keys, return_inverse=True)[1].ravel()


def _bytes_of(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x.astype(">i8")).view(np.uint8).reshape(len(x), 8)


def resolver(length: int, gram: int):
    reach = length - gram                  # an anchor stands at most so far into its first window
    cover = max(1, length // 6)            # distance of the sampled offsets
    core = length - cover + 1              # bytes that every window from one sampled offset to the next has in common

    def resolve(rows: pd.DataFrame) -> pd.DataFrame:
        n, width = len(rows), reach + 2 * length + cover
        table = np.zeros((n, width), dtype=np.uint8)
        start = reach - rows["off"].to_numpy().astype(np.int64)
        size = np.array([len(c) for c in rows["ctx"]], dtype=np.int64)
        for i, ctx in enumerate(rows["ctx"]):
            table[i, start[i]:start[i] + size[i]] = np.frombuffer(ctx, dtype=np.uint8)
        group = np.unique(rows["a"].to_numpy(), return_inverse=True)[1].ravel()
        cnt = rows["cnt"].to_numpy().astype(np.int64)
        flags = [np.zeros(c, dtype=bool) for c in cnt.tolist()]
        ranked: tuple[int, np.ndarray] | None = None
        for x in range(int(start.min()), int((start + cnt).max())):
            here = np.flatnonzero((start <= x) & (x < start + cnt))
            if len(here) < 2:
                continue
            s = -(-x // cover) * cover      # the next sampled offset
            if ranked is None or ranked[0] != s:
                ranked = (s, _ranks(_bytes_of(group), table[:, s:s + core]))
            # several contexts under one rank are needed for a match
            r = ranked[1][here]
            here = here[np.bincount(r)[r] > 1]
            if len(here) < 2:
                continue
            key = _ranks(_bytes_of(ranked[1][here]), table[here, x:s], table[here, s + core:x + length])
            for i in here[np.bincount(key)[key] > 1].tolist():
                flags[i][x - start[i]] = True
        return recurrence.flags_to_ranges(rows, flags, length)

    return resolve


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, dense: int = recurrence.DENSE, texts: bool = True) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, `kept` (bytes; null where nothing was
    removed, and everywhere without `texts`)."""
    units = recurrence.Units(words=False, length=length, gram=gram)
    plain, marked = recurrence.covered(docs, units, resolver(length, gram), dense)

    def cut(batches):
        for batch in recurrence.slices(batches):
            out = []
            for doc_id, text, first, last in zip(batch["doc_id"], batch["t"], batch["first"], batch["last"]):
                gone = recurrence.mask(first, last, len(text))
                spans = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
                kept = np.frombuffer(text, dtype=np.uint8)[~gone].tobytes()
                out.append((doc_id, len(text), int(gone.sum()), len(spans) // 2, hashlib.sha256(kept).hexdigest(), kept if texts else None))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]).astype({"doc_id": object})

    kind = docs.schema["doc_id"].dataType.simpleString()
    done = marked.mapInPandas(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    rest = plain.select("doc_id", F.col("n").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
                        F.col("sha").alias("kept_sha256"), F.lit(None).cast("binary").alias("kept"))
    return done.union(rest)
