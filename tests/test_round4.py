"""What a task of the search holds: no text but the one at hand, narrow postings, terms counted some at a time."""

import random
import tracemalloc

import pyarrow as pa

from chartq.llm import topk

ROWS = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("id", pa.int64()), ("t", pa.binary()), ("q", pa.binary()),
                  ("terms", pa.list_(pa.int64())), ("dfs", pa.list_(pa.int64()))])


def _texts(n, words=150, seed=3):
    rng = random.Random(seed)
    return [" ".join(f"w{int(rng.paretovariate(0.4)) % 100000}" for _ in range(words)).encode() for _ in range(n)]


def _documents(shard, ids, texts):
    n = len(texts)
    return pa.record_batch([pa.array(c, t) for c, t in zip(([shard] * n, [0] * n, ids, texts, [None] * n, [None] * n, [None] * n), ROWS.types)], schema=ROWS)


def _queries(shard, texts):
    n, terms = len(texts), [sorted(topk._numbers(set(topk.words(t))).tolist()) for t in texts]
    asked = [b"%d" % i for i in range(n)]
    columns = ([shard] * n, [1] * n, [None] * n, [b""] * n, asked, terms, [[2] * len(x) for x in terms])
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, ROWS.types)], schema=ROWS)


def _peak(rows):
    tracemalloc.start()
    out = list(rows())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, peak


def test_texts_of_a_shard_are_not_gathered():
    texts = [t + b" ." * 5000 for t in _texts(3000)]       # 10 kB of each text are no words
    parts = [_documents(0, list(range(a, a + 200)), texts[a:a + 200]) for a in range(0, 3000, 200)] + [_queries(0, texts[:20])]
    out, peak = _peak(lambda: topk._search(5, 150.0, 3000)(iter(parts)))
    first = {}
    for b in out:
        for q, d in zip(b["q"].to_pylist(), b["doc_id"].to_pylist()):
            first.setdefault(int(q), d)
    assert first == {i: i for i in range(20)}
    assert peak < sum(map(len, texts)) / 2


def test_index_of_a_shard_is_narrow(monkeypatch):
    monkeypatch.setattr(topk, "PART", 1 << 12)
    texts = _texts(4000)
    postings = sum(len(set(topk.words(t))) for t in texts)
    tracemalloc.start()
    shard = topk.Shard(list(range(len(texts))), texts, 150.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    held = sum(x.nbytes for x in (shard.vocab, shard.column, shard.first, shard.table, shard.doc, shard.impact))
    assert peak < held + 20 * postings
    assert shard.table.itemsize < 8        # counts, not doubles


def test_shards_of_one_task_follow_each_other():
    a, b = _texts(30, 20, 1), _texts(40, 20, 2)
    empty = _documents(3, [7, 8], [b"", b" . "])
    parts = [pa.Table.from_batches(x).combine_chunks().to_batches()[0] for x in (
        [_documents(0, list(range(30)), a), _queries(0, a[:2]), _documents(1, list(range(40)), b)],
        [_documents(1, [40, 41], a[:2]), _queries(1, a[:2]), _queries(2, a[:2]), empty, _queries(3, a[:2])])]
    got = [[x for out in topk._search(1, 20.0, 72)(iter(p)) for x in zip(out["q"].to_pylist(), out["doc_id"].to_pylist())]
           for p in (parts, [p.slice(i, 1) for p in parts for i in range(len(p))])]
    assert got[0] == got[1] == [(b"0", 0), (b"1", 1), (b"0", 40), (b"1", 41)]


def test_counts_of_long_texts_are_whole():
    shard = topk.Shard([1, 2, 3], iter([b"a " * 70000 + b"b", b"a b c", b"c"]), 100.0)
    assert shard.table.max() == 70000
    (at, scores), = shard.search([(topk._numbers([b"a"]), topk.np.ones(1))], 3)
    found = dict(zip([shard.ids[i] for i in at], scores))
    want = {d: round(n * 2.2 / (n + 1.2 * (0.25 + 0.75 * size / 100)), 9) for d, n, size in ((1, 70000, 70001), (2, 1, 3))}
    assert found == want


def test_terms_are_counted_some_at_a_time(monkeypatch):
    texts = _texts(2000)
    batch = pa.record_batch([pa.array([*texts, b""], pa.binary())], ["t"])
    whole, most = _peak(lambda: topk._frequencies(iter([batch])))
    monkeypatch.setattr(topk, "COUNTED", 2000)
    pieces, peak = _peak(lambda: (b.num_rows for b in topk._frequencies(iter([batch]))))
    assert len(whole) == 1 and len(pieces) > 5 and max(pieces) < 2200 and peak < most / 2
    counts = {}
    for b in topk._frequencies(iter([batch])):
        for t, n in zip(b["term"].to_pylist(), b["df"].to_pylist()):
            counts[t] = counts.get(t, 0) + n
    assert counts == dict(zip(whole[0]["term"].to_pylist(), whole[0]["df"].to_pylist())) and counts[None] == sum(len(topk.words(t)) for t in texts)
