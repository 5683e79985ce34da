"""Toxicity by maximum-scoring segments over token log-odds.

* Token scores: log-odds of toxic against clean labelled documents with an informative Dirichlet prior whose
  weights are the words' frequencies in the whole corpus. Words whose log-odds are `MIN_Z` standard errors above
  zero score them, every other word costs `DRIFT`, so clean text drifts down.
* Passages: all maximal scoring segments of a document, in one linear scan (runs of costing words count as one
  step). A segment of score s in a text of n words has the expected number K n exp(-lambda s) of chance segments as good;
  lambda is the root of the score distribution of clean text, K its extreme-value fit to the best segments of
  clean documents. Segments expected fewer than `SIGNIFICANT` times are the toxic passages.
* Document score: a logistic calibration of the best segment's and all significant segments' evidence.

The fit uses a bounded sample of labelled rows outside fold 0 (`PER_CLASS` documents of each class of at most
`SAMPLE_BYTES` bytes; half for the log-odds, half for the calibrations); the prior counts all documents and
every text is scored whole.

Edge cases: a null or empty text has no segment and gets the calibrated score of no evidence; with no labelled row of one
class the score is the smoothed rate of class 1; ties between equal segments keep the earlier one; repeated rows
score alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartq.llm.common import utf8
from chartq.llm.decontam import words
from chartq.llm.labelled import logistic, sample_with_rate, sigmoid
from chartq.llm.simhash import fingerprint

PER_CLASS = 2500
SAMPLE_BYTES = 1 << 16
PRIOR = 1000.0            # words' worth of corpus prior in each class
MIN_Z = 4.0
COPY_BITS = 6             # fingerprints of near copies within the sample differ in at most so many bits
MIN_COUNT = 5             # documents of the toxic sample below which a word has no score of its own
DRIFT = 0.5
SIGNIFICANT = 0.01
THRESHOLD = 0.5

SCORED = T.StructType([
    T.StructField("score", T.DoubleType()),
    T.StructField("passages", T.ArrayType(T.StructType([
        T.StructField("first", T.LongType()), T.StructField("last", T.LongType()),
        T.StructField("score", T.DoubleType()), T.StructField("expected", T.DoubleType())]))),
])


def maximal_segments(steps: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of (first, past the last, score) steps, in linear time."""
    left, right, span, back = [], [], [], []     # cumulative score before / after, positions, next candidate to look at
    total = 0.0
    for first, last, score in steps:
        if score <= 0:
            total += score
            continue
        lo, hi, a = total, total + score, first
        total = hi
        j = len(left) - 1
        while True:
            while j >= 0 and left[j] >= lo:
                j = back[j]
            if j < 0 or right[j] >= hi:
                break
            lo, a = left[j], span[j][0]            # the candidate reaches over everything from j on
            k = j
            j = back[j]
            del left[k:], right[k:], span[k:], back[k:]
        left.append(lo)
        right.append(hi)
        span.append((a, last))
        back.append(j)
    return [(a, b, r - x) for (a, b), x, r in zip(span, left, right)]


def steps(seq: list[bytes], weights: dict[bytes, float]) -> list[tuple[int, int, float]]:
    """Scoring words one by one, the costing words between them as single steps."""
    out, at = [], 0
    for i, w in enumerate(seq):
        s = weights.get(w)
        if s is not None:
            if i > at:
                out.append((at, i, -DRIFT * (i - at)))
            out.append((i, i + 1, s))
            at = i + 1
    return out


def _decay(scores: list[float], n: int) -> float:
    """lambda: the positive root of the mean of exp(lambda * score) over `n` clean words, most of which cost DRIFT."""
    counts = Counter(scores)
    counts[-DRIFT] += n - len(scores)
    s = np.array(list(counts))
    p = np.array([counts[x] for x in counts], dtype=float) / n
    if not (s > 0).any() or float((s * p).sum()) >= 0:
        return math.log(2) / DRIFT / 2
    lo, hi = 0.0, 1.0
    while float((p * np.exp(np.clip(hi * s, -700, 700))).sum()) < 1 and hi < 64:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if float((p * np.exp(np.clip(mid * s, -700, 700))).sum()) < 1 else (lo, mid)
    return lo if lo > 0 else hi


def evidence(m: dict, seq: list[bytes]) -> tuple[list[float], list[tuple[int, int, float, float]]]:
    """Features of a document and its significant passages (first, past the last, score, expected number)."""
    found = maximal_segments(steps(seq, m["scores"]))
    logs = [math.log(m["k"] * len(seq)) - m["decay"] * s for _, _, s in found]
    best = max(0.0, -min(logs)) if logs else 0.0
    passages = [(a, b, s, math.exp(min(e, 700.0))) for (a, b, s), e in zip(found, logs) if e < math.log(SIGNIFICANT)]
    return [math.log1p(best), math.log1p(sum(p[2] for p in passages))], passages


def corpus_counts(docs: DataFrame, vocabulary: list[bytes]) -> tuple[np.ndarray, int]:
    """Occurrences of the words of a bounded vocabulary in all documents, and the number of all words."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast({w: i for i, w in enumerate(vocabulary)})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = held.value
        counts = np.zeros(len(number) + 1, dtype=np.int64)
        for batch in batches:
            for t in batch["t"]:
                seq = words(t)
                ids = [number[w] for w in seq if w in number]
                counts[:-1] += np.bincount(ids, minlength=len(number)) if len(ids) > len(number) else 0
                if len(ids) <= len(number):
                    np.add.at(counts, ids, 1)
                counts[-1] += len(seq)
        at = np.flatnonzero(counts)
        yield pd.DataFrame({"w": at, "n": counts[at]})

    rows = docs.select(utf8("text").alias("t")).mapInPandas(count, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(vocabulary) + 1, dtype=np.int64)
    for r in rows:                        # one row per word of the bounded vocabulary
        out[r["w"]] = r["n"]
    return out[:-1], int(out[-1])


def unlike(texts: list[bytes], bits: int = COPY_BITS) -> list[bytes]:
    """The texts of a bounded sample without near copies of an earlier one, which would count one author's words many times."""
    prints = np.array([fingerprint(t) for t in texts], dtype=np.int64)
    kept: list[int] = []
    for i in range(len(texts)):
        if not (np.bitwise_count(prints[kept] ^ prints[i]) <= bits).any():
            kept.append(i)
    return [texts[i] for i in kept]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> dict:
    """Plain data of a fitted model."""
    rows, rate = sample_with_rate(docs, labels, label, per_class, SAMPLE_BYTES)
    by = {c: [words(t) for t in unlike([t for y, t in rows if y == c])] for c in (0, 1)}
    out = {"rate": rate, "scores": None}
    if min(len(by[0]), len(by[1])) < 2:
        return out
    count = {c: Counter(w for seq in by[c][::2] for w in set(seq)) for c in by}   # a document counts a word once
    vocabulary = sorted(w for w, n in count[1].items() if n >= MIN_COUNT)
    corpus, total = corpus_counts(docs, vocabulary)
    n1, n0 = sum(count[1].values()), sum(count[0].values())
    y1 = np.array([count[1][w] for w in vocabulary], dtype=float)
    y0 = np.array([count[0][w] for w in vocabulary], dtype=float)
    prior = PRIOR * np.maximum(corpus, 1) / max(total, 1)
    odds = np.log((y1 + prior) / (n1 + PRIOR - y1 - prior)) - np.log((y0 + prior) / (n0 + PRIOR - y0 - prior))
    z = odds / np.sqrt(1 / (y1 + prior) + 1 / (y0 + prior + 0.5))
    strong = z >= MIN_Z
    out["scores"] = {vocabulary[i]: float(odds[i]) for i in np.flatnonzero(strong)}
    clean = by[0][1::2]
    met = [[out["scores"][w] for w in seq if w in out["scores"]] for seq in clean]
    out["decay"] = _decay([round(s, 3) for x in met for s in x], max(1, sum(map(len, clean))))
    tops = [(len(seq), max((s for _, _, s in maximal_segments(steps(seq, out["scores"]))), default=0.0)) for seq in clean if seq]
    out["k"] = 1 / max(float(np.mean([n * math.exp(-out["decay"] * s) for n, s in tops])), 1e-9) if tops else 1.0
    held = [(y, seq) for y in by for seq in by[y][1::2]]
    x = np.array([evidence(out, seq)[0] for _, seq in held])
    y = np.array([y for y, _ in held], dtype=float)
    share = y.mean()
    out["weights"] = logistic(x, y).tolist()
    out["weights"][0] += math.log(rate / (1 - rate)) - math.log(share / (1 - share))  # the sample's classes are of equal size
    return out


def score_column(spark, fitted: dict, text: str | Column = "text") -> Column:
    """Struct of score (probability of class 1) and significant passages (word positions)."""
    held = spark.sparkContext.broadcast(fitted)  # at most the words of the bounded sample

    @F.pandas_udf(SCORED)
    def run(texts: pd.Series) -> pd.DataFrame:
        m = held.value
        out = []
        for t in texts:
            if m["scores"] is None:
                out.append((m["rate"], []))
                continue
            x, passages = evidence(m, words(t))
            w = m["weights"]
            out.append((sigmoid(w[0] + w[1] * x[0] + w[2] * x[1]), [{"first": a, "last": b, "score": s, "expected": e} for a, b, s, e in passages]))
        return pd.DataFrame(out, columns=["score", "passages"])

    return run(utf8(text))
