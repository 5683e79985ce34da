import re
from collections import Counter

import xxhash

from chartq.llm import simhash
from tests.llm.conftest import LOW


def brute_print(text):
    w = re.findall("[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    if not w:
        return 0
    shingles = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, bits):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ps = list(root)
    for i, a in enumerate(ps):
        for b in ps[:i]:
            if (a ^ b).bit_count() <= bits:
                root[find(a)] = find(b)
    return {p: find(p) for p in ps}


def test_components_match_brute_force(docs, world):
    prints = [brute_print(t) for _, t, _ in world[0]]
    comp = brute_components(set(prints), 2)
    names = {}
    for (i, _, _), p in zip(world[0], prints):
        if i is not None:
            names[comp[p]] = min(i, names.get(comp[p], i))
    want = Counter((i, f"{p:016x}", names.get(comp[p])) for (i, _, _), p in zip(world[0], prints))
    got = simhash.components(docs).select("doc_id", simhash.hex16("fp"), "component_id").collect()
    assert Counter(map(tuple, got)) == want


def test_dense_keys_lose_no_link(spark):
    """Fingerprints around a few centres: the pair form and the linear form give the same components as brute force."""
    import random

    rng = random.Random(3)
    prints = set()
    for _ in range(4):
        centre = rng.getrandbits(64)
        for _ in range(80):
            p = centre
            for _ in range(rng.randint(0, 4)):
                p ^= 1 << rng.randrange(64)
            prints.add(p)
    signed = {p: p - (1 << 64) if p >> 63 else p for p in prints}
    fps = spark.createDataFrame([(s,) for s in signed.values()], "fp long")
    from chartq.llm.common import connected_components

    for bits in (1, 2):
        want = brute_components(prints, bits)
        for dense in (2, 10_000):
            edges = simhash.links(fps, bits, dense)
            assert all(((r[0] ^ r[1]) & ((1 << 64) - 1)).bit_count() <= bits for r in edges.collect())
            roots = dict(map(tuple, connected_components(edges).collect()))
            groups = Counter()
            for p, s in signed.items():
                groups[(want[p], roots.get(s, s))] += 1
            assert len(groups) == len(set(want.values())) == len({g[1] for g in groups})


def test_one_row_of_each_component_stays(docs, world, no_docs):
    out = simhash.keep_one(docs)
    assert out.columns == docs.columns
    comp = brute_components({brute_print(t) for _, t, _ in world[0]}, 2)
    kept = out.collect()
    assert Counter(comp[brute_print(r["text"])] for r in kept) == Counter(set(comp.values()))
    for r in kept:
        ids = [i for i, t, _ in world[0] if comp[brute_print(t)] == comp[brute_print(r["text"])] and i is not None]
        assert r["doc_id"] == (min(ids) if ids else None)
    assert simhash.keep_one(no_docs).count() == 0
    assert simhash.components(no_docs).count() == 0
