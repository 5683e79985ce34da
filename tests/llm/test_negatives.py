import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from chartq.llm import negatives, queries

SCHEMA = "vec_id long, embedding array<float>, label int, score int, number string, q string"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, y, 1, "clash", "clash") for i, v, y in rows], SCHEMA).repartition(parts)


def brute(rows, positives=5, count=3):
    """The contract by plain loops over Python's whole numbers."""
    fit = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows
           if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda s, i: (-s, i is None, 0 if i is None else i)
    out = []
    for at, (a, qa, ya) in enumerate(fit):
        if a is None or a % 50:
            continue
        scores = [(sum(x * y for x, y in zip(qa, q)), i, y, j) for j, (i, q, y) in enumerate(fit)]
        same = sorted((key(s, i) for s, i, y, j in scores if y == ya and j != at))[:positives]
        for s_, none, p in same:
            p, ps = None if none else p, -s_
            fits = sorted(key(s, i) for s, i, y, _ in scores if y != ya and 50 * ps <= 100 * s <= 95 * ps)[:count]
            out += [(a, p, r + 1, None if none else n, ps, -s) for r, (s, none, n) in enumerate(fits)]
    return out


def mined(df, **options):
    found = negatives.mine(negatives.prepare(df), F.col("vec_id") % 50 == 0, **options)
    return [tuple(r) for r in found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def vectors(rng, n, dims):
    centres = [[rng.gauss(0, 0.3) for _ in range(dims)] for _ in range(4)]
    return [(i, [float(np.float32(x + rng.gauss(0, 0.15))) for x in rng.choice(centres)], rng.randrange(4)) for i in range(n)]


@pytest.mark.parametrize("blocks", [None, 1, 7])
def test_agrees_with_plain_loops(spark, blocks):
    rng = random.Random(4)
    rows = vectors(rng, 460, 12)
    assert ordered(mined(table(spark, rows), blocks=blocks)) == ordered(brute(rows))


def test_ties_copies_nulls_and_odd_vectors(spark):
    rng = random.Random(9)
    rows = vectors(rng, 120, 5)
    rows = [(i, [round(x, 1) for x in v], y) for i, v, y in rows]                       # many ties
    rows = [(i, [float(np.float32(x)) for x in v], y) for i, v, y in rows]
    rows += [(200 + i, rows[50][1], i % 4) for i in range(40)]                          # a group of equal vectors
    rows += [rows[50], rows[51], (None, rows[3][1], 1), (None, None, None), (300, None, 1), (350, [None, 1.0], 2), (400, [float("nan")] * 5, 1),
             (450, [float("inf")] * 5, 1), (500, rows[7][1], None), (550, [], 1), (600, [0.5], 2), (650, [-x for x in rows[0][1]], 1), (-50, rows[9][1], 3),
             (700, [0.0] * 5, 2)]
    assert ordered(mined(table(spark, rows), blocks=4)) == ordered(brute(rows))


def test_large_components_are_held_and_exact(spark):
    rows = [(i, [float(np.float32(x)) for x in (9000.5 * (i % 5), -120.25 * (i % 7), 3.0)], i % 2) for i in range(101)]
    assert ordered(mined(table(spark, rows))) == ordered(brute(rows))
    rows = [(0, [1e30, 1.0], 1), (1, [1e30, 2.0], 1), (2, [6e4, 0.0], 2)]
    found = mined(table(spark, rows))
    assert [r[:4] for r in found] == []          # 6e4 is under half of the held 131072
    assert mined(table(spark, [(0, [1e30], 1), (1, [1e30], 1), (2, [1e5], 2)]))[0][3] == 2


def test_columns_are_read_in_descending_magnitude_and_candidates_shrink(monkeypatch):
    rng = np.random.default_rng(2)
    rows = rng.integers(-200, 200, (3000, 32))
    rows[:, 20:] //= 40
    block = negatives.Block(rows, rng.integers(0, 3, 3000), np.arange(3000), np.zeros(3000, bool), np.arange(3000))
    seen = []
    scan = negatives.Block.scan

    def spy(self, anchor, zone, alive, prune):
        def watched(partial, least, most, alive_):
            seen.append(len(partial))
            return prune(partial, least, most, alive_)
        return scan(self, anchor, zone, alive, watched)

    monkeypatch.setattr(negatives.Block, "scan", spy)
    anchor = block.cols[:, 5].astype(np.int64)
    label = int(block.label[5])
    found = block.positives(anchor, label, int(block.number[5]), 5)
    assert seen == sorted(seen, reverse=True) and seen[-1] < seen[0] / 10
    scores = (anchor @ block.cols.astype(np.int64))
    own = [(-int(s), i) for i, s in enumerate(scores) if block.label[i] == label and i != 5]
    assert [f[0] for f in found] == [-s for s, _ in sorted(own)[:5]]


def test_no_rows_and_no_anchors(spark):
    assert mined(table(spark, [])) == []
    assert mined(table(spark, [(1, [1.0], 1), (2, [1.0], 1)])) == []
    assert mined(table(spark, [(50, [1.0], 1)])) == []


def test_query_agrees_with_sql(spark):
    sf = "/root/testdata/sf0.1"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{sf}/embeddings.parquet')")
    found = queries.QUERIES["op12_hard_negatives"](spark, sf)
    want = con.execute(queries.ORACLE["op12_hard_negatives"])
    at = [c[0] for c in want.description]
    assert sorted(tuple(r[c] for c in at) for r in found.collect()) == sorted(want.fetchall())
