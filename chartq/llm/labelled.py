"""Bounded samples of labelled documents and the logistic calibration both classifiers share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartq.llm.common import fold, utf8


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_bytes: int) -> list[tuple[int, bytes]]:
    """The rows of `sample_with_rate`."""
    return sample_with_rate(docs, labels, label, per_class, max_bytes)[0]


def sample_with_rate(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_bytes: int) -> tuple[list[tuple[int, bytes]], float]:
    """At most `per_class` labelled training documents of each class as (label, text bytes).

    Only rows outside fold 0 with a non-null id and label count. Labels of repeated ids are
    averaged (0.5 and more is class 1). Rows are drawn by the order of a hash of the id, so reruns
    agree; texts over `max_bytes` are left out of the sample (only of the sample: every text is
    scored whole). With them comes the smoothed rate of class 1 among all labelled training rows. The id set is bounded by 2 * `per_class`, which makes its broadcast safe.
    """
    y = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold() != 0))
         .groupBy("doc_id").agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("y")))
    sized = docs.select("doc_id", F.octet_length(F.coalesce(F.col("text"), F.lit(""))).alias("bytes"))
    known = sized.where(F.col("bytes") <= max_bytes).join(y, "doc_id").groupBy("doc_id", "y").agg(F.lit(1).alias("one"))
    order = [F.xxhash64(F.col("doc_id").cast("string"), F.lit(label)), F.col("doc_id")]
    ids = [known.where(F.col("y") == c).orderBy(*order).limit(per_class).select("doc_id", "y") for c in (0, 1)]
    chosen = F.broadcast(ids[0].union(ids[1]))
    texts = (docs.select("doc_id", utf8("text").alias("t")).where(F.length("t") <= max_bytes).join(chosen, "doc_id")
             .groupBy("doc_id", "y").agg(F.min("t").alias("t")))
    rows = sorted((r["doc_id"], r["y"], bytes(r["t"])) for r in texts.collect())
    n, ones = y.agg(F.count("y"), F.coalesce(F.sum("y"), F.lit(0))).first()
    return [(y_, t) for _, y_, t in rows], (ones + 1) / (n + 2)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights (intercept first) of a ridge-regularised logistic regression, by Newton steps."""
    a = np.column_stack([np.ones(len(y)), x])
    w = np.zeros(a.shape[1])
    pen = np.full(a.shape[1], ridge)
    pen[0] = 1e-9
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + pen * w
        hess = (a * (p * (1 - p))[:, None]).T @ a + np.diag(pen + 1e-9)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def sigmoid(z: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


