"""Quality classifier by compression: zstandard dictionaries built from good and bad labelled text.

A text that a dictionary of good text compresses better than one of bad text is likely good. The features
are the normalised difference of both compressed sizes and the compressed share itself; a logistic
regression on other labelled documents than those behind the dictionaries turns them into a probability
(for classes of equal weight). The fit uses a bounded sample of labelled rows (`PER_CLASS` documents of
each class of at most `SAMPLE_BYTES` bytes); every document is compressed whole.

Edge cases: a null or empty text has features 0 and still gets a score between 0 and 1; with no labelled row
of one class the score is the smoothed rate of class 1 for every row; samples too small for dictionary
training serve as raw dictionary content; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartq.llm.common import utf8
from chartq.llm.labelled import logistic, sample, sigmoid

PER_CLASS = 3000           # labelled documents of each class: half for the dictionary, half for calibration
SAMPLE_BYTES = 1 << 16     # longest text that enters the sample
DICT_BYTES = 1 << 19
LEVEL = 3
THRESHOLD = 0.3


def _dictionary(texts: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICT_BYTES, texts).as_bytes()
    except zstandard.ZstdError:  # too few or too small samples
        return b"\n".join(texts)[:DICT_BYTES]


def compressors(dicts: tuple[bytes, bytes]) -> list[zstandard.ZstdCompressor]:
    return [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d)) for d in dicts]


def features(opened: list[zstandard.ZstdCompressor], text: bytes) -> tuple[float, float, float]:
    """The compressed-size difference normalised by the text's and by the larger compressed size, and the
    logarithm of the mean compressed share (repeated lines compress well under either dictionary)."""
    if not text:
        return 0.0, 0.0, 0.0
    bad, good = (len(c.compress(text)) for c in opened)
    return (bad - good) / len(text), (bad - good) / max(bad, good), math.log((bad + good) / 2 / len(text))


def model(rows: list[tuple[int, bytes]]) -> dict:
    """Plain data of a fitted model: `dicts` (bad, good) and calibration `weights`, or only the `rate` of class 1."""
    by = {c: [t for y, t in rows if y == c] for c in (0, 1)}
    out = {"rate": (len(by[1]) + 1) / (len(rows) + 2), "dicts": None}
    build = {c: [t for t in by[c][::2] if t] for c in by}
    if min(len(by[0]), len(by[1])) < 2 or not (build[0] and build[1]):
        return out
    out["dicts"] = (_dictionary(build[0]), _dictionary(build[1]))
    held = [(y, t) for y in by for t in by[y][1::2]]
    opened = compressors(out["dicts"])
    x = np.array([features(opened, t) for _, t in held])
    out["weights"] = logistic(x, np.array([y for y, _ in held], dtype=float)).tolist()
    return out


def score(m: dict, opened: list[zstandard.ZstdCompressor], text: bytes) -> float:
    """Probability of class 1."""
    if not opened:
        return m["rate"]
    w = m["weights"]
    return sigmoid(w[0] + sum(a * b for a, b in zip(w[1:], features(opened, text))))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> dict:
    return model(sample(docs, labels, label, per_class, SAMPLE_BYTES))


def score_column(spark, fitted: dict, text: str | Column = "text") -> Column:
    held = spark.sparkContext.broadcast(fitted)  # two dictionaries of at most DICT_BYTES

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = held.value
        opened = compressors(m["dicts"]) if m["dicts"] else []
        for texts in batches:
            yield pd.Series([score(m, opened, t) for t in texts], dtype="float64")

    return run(utf8(text))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, in its columns, whose score reaches the threshold."""
    fitted = fit(docs, labels)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return (packed.withColumn("score", score_column(docs.sparkSession, fitted, F.col("row.text")))
            .where(F.col("score") >= threshold).select("row.*"))
