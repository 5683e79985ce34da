"""Operators on passages (decontamination, phrase and suffix dedup) against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from chartq.llm import decontam, phrases, suffix
from chartq.llm import queries as Q
from tests.llm.conftest import LOW

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def windows_of(items, n=10):
    out = {}
    for i, t in items:
        w = WORD.findall((t or "").translate(LOW))
        size = min(n, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            out.setdefault(tuple(w[k:k + size]), set()).add(i)
    return out


def brute_hits(text, windows):
    w = WORD.findall((text or "").translate(LOW))
    hit, items = set(), set()
    for size in {len(k) for k in windows}:
        for k in range(len(w) - size + 1):
            if tuple(w[k:k + size]) in windows:
                items |= windows[tuple(w[k:k + size])]
                hit |= set(range(k, k + size))
    return len(w), len(hit), sorted(str(i) for i in items if i is not None)


@pytest.mark.parametrize("part_windows", [decontam.PART_WINDOWS, 9])
def test_decontamination_matches_brute_force(docs, benchmark, world, part_windows):
    windows = windows_of(world[1])
    got = Counter((r["row"]["doc_id"], r["hits"]["n_words"], r["hits"]["n_hit"], tuple(r["hits"]["items"]))
                  for r in decontam.scan(docs, benchmark, part_windows=part_windows).collect())
    want = Counter((i, n, h, tuple(x)) for i, t, _ in world[0] for n, h, x in [brute_hits(t, windows)])
    assert got == want
    assert sum(c for k, c in want.items() if k[2]) >= 3


def test_cleaning_removes_every_window_and_keeps_clean_rows(docs, benchmark, world):
    windows = windows_of(world[1])
    out = decontam.clean(docs, benchmark)
    assert out.columns == docs.columns
    rows = out.collect()
    assert all(brute_hits(r["text"], windows)[1] == 0 for r in rows)
    clean = Counter((i, t) for i, t, _ in world[0] if brute_hits(t, windows)[1] == 0)
    assert not clean - Counter((r["doc_id"], r["text"]) for r in rows)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in rows)
    dropped = decontam.clean(docs, benchmark, remove="documents").collect()
    assert Counter((r["doc_id"], r["text"]) for r in dropped) == clean


def test_decontamination_of_nothing(docs, no_docs, benchmark):
    assert decontam.scan(no_docs, benchmark).count() == 0
    assert decontam.clean(docs, benchmark.limit(0)).count() == docs.count()


def brute_cover(tokens, n):
    seen = Counter(w[i:i + n] for w in tokens for i in range(len(w) - n + 1))
    out = []
    for w in tokens:
        gone = np.zeros(len(w), dtype=bool)
        for i in range(len(w) - n + 1):
            if seen[w[i:i + n]] > 1:
                gone[i:i + n] = True
        out.append(gone)
    return out


@pytest.mark.parametrize("dense", [20_000, 1])
def test_phrases_match_brute_force(docs, world, dense):
    tokens = [tuple((t or "").encode().split()) for _, t, _ in world[0]]
    want = Counter((i, len(w), int(g.sum()), hashlib.sha256(b" ".join(x for x, y in zip(w, g) if not y)).hexdigest())
                   for (i, _, _), w, g in zip(world[0], tokens, brute_cover(tokens, 35)))
    got = Counter(tuple(r)[:4] for r in phrases.dedup(docs, dense=dense).collect())
    assert got == want
    assert any(k[2] for k in want)


@pytest.mark.parametrize("dense,length,gram", [(20_000, 400, 32), (1, 400, 32), (20_000, 60, 12)])
def test_suffixes_match_brute_force(docs, world, dense, length, gram):
    tokens = [(t or "").encode() for _, t, _ in world[0]]
    want = Counter((i, len(w), int(g.sum()), int((np.diff(np.concatenate(([0], g.astype(int)))) == 1).sum()),
                    hashlib.sha256(np.frombuffer(w, np.uint8)[~g].tobytes()).hexdigest())
                   for (i, _, _), w, g in zip(world[0], tokens, brute_cover(tokens, length)))
    got = Counter(tuple(r)[:5] for r in suffix.dedup(docs, length, gram, dense).collect())
    assert got == want
    assert any(k[2] for k in want)


def test_dedup_of_nothing(no_docs):
    assert phrases.dedup(no_docs).count() == 0
    assert suffix.dedup(no_docs).count() == 0


@pytest.mark.parametrize("key", ["op3_suffix_dedup", "op4_decontaminate", "op5_phrase_dedup"])
def test_queries_cover_every_document(spark, key):
    sf = "/root/testdata/sf0.001"
    ids = sorted(r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect())
    assert sorted(r[0] for r in Q.QUERIES[key](spark, sf).collect()) == ids
