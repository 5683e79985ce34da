"""A shard's search against loops, with every kind of list and ties, and how queries are sent."""

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from chartq.llm import topk
from chartq.llm.decontam import words


def test_topk_sends_packed_words_and_keeps_every_tie(monkeypatch):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, rng.integers(1, 60)) if x < 400).encode() for _ in range(700)]
    texts += texts[:90] + [b"", b"- ."]
    queries = texts[:40] + [b"nothing here"]
    rows = [Counter(words(t)) for t in texts]
    mean, n = sum(c.total() for c in rows) / len(rows), len(rows)
    df = Counter(w for c in rows for w in c)
    terms = [np.sort(topk._numbers(set(words(t)) & set(df))) for t in queries]
    number = dict(zip(topk._numbers(df).tolist(), df.values()))
    dfs = [np.array([number[x] for x in t.tolist()], np.int64) for t in terms]
    table = pa.record_batch([pa.array(range(7, 7 + len(terms)), pa.int64()), pa.array(terms, pa.list_(pa.int64())), pa.array(dfs, pa.list_(pa.int64()))],
                            ["key", "terms", "dfs"])
    for name, value in {"BLOCK": 16, "DENSE_WORDS": 8, "RUN": 4, "PACKED": 200, "CELLS": 5000, "RISE": 2, "PART": 64}.items():
        monkeypatch.setattr(topk, name, value)
    packs = [x.as_py() for b in topk._pack(iter([table])) for x in b["t"]]
    assert len(packs) > 1 and sum(map(len, packs)) < 16 * sum(map(len, terms))
    got = defaultdict(list)
    ids: list = []
    shard = topk.Shard(ids, topk._texts(iter([(0, 0, pa.record_batch([pa.array(range(n)), pa.array(texts)], ["id", "t"]))]), ids), mean)
    for key, at, score in (x for p in packs for x in topk._answers(shard, p, 5, n)):
        got[key - 7].append((shard.ids[at], score))
    for q, text in enumerate(queries):
        own = set(words(text))
        every = [sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * c.total() / mean)) for w in own if w in c) for c in rows]
        limit = max(sorted(round(x, 8) for x in every)[-5], 1e-9)
        assert sorted(i for i, _ in got[q]) == [i for i, x in enumerate(every) if round(x, 8) >= limit]
        assert all(abs(every[i] - x) < 1e-8 for i, x in got[q])
