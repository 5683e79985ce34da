"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight bytes. Two fingerprints at `max_bits` or fewer differing bits
disagree in at most `max_bits` byte positions, so they share at least `8 - max_bits` positional
bytes. The inverted index is keyed by positional bytes; posting lists of single bytes would be
n / 256 long, so they are intersected up front: the eight positions are cut into `max_bits + 2`
groups, at least two of which are intact in any linked pair, and the index has one key for each
pair of groups. Pairs met under a key are tallied (shared positional bytes), kept when the tally
reaches the guaranteed minimum, and verified by their bit distance.

Copies collapse first (one index entry per distinct fingerprint). A key with more than `DENSE`
distinct fingerprints emits no pairs: all fingerprints of such keys go to an exact linear form,
where each is filed under itself and its 64 one-bit variants; two of them are at distance one or
two exactly if they meet under such a variant, and each is linked to the smallest one there.

Edge cases: a null or empty text has no words and fingerprint zero, and is linked like any other;
a null doc_id takes part in links but never names a component (a component of null ids only has a
null id); repeated rows are separate rows of one component; an empty table gives an empty result;
columns beyond doc_id and text are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartq.llm.common import connected_components, stage, utf8

SHINGLE = 3
MAX_BITS = 2
DENSE = 32          # distinct fingerprints of one index key beyond which the linear form takes over
_CHUNK = 1 << 16    # shingles whose bits are unpacked at a time


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the lower-cased word shingles (repeats included), as a signed long."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, 42)], dtype=np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = (ends[:-1]).tolist()
        starts = [0, *starts][: len(words) - shingle + 1]
        stops = (ends[shingle - 1:] - 1).tolist()
        h = xxhash.xxh64_intdigest
        hashes = np.array([h(joined[a:b], 42) for a, b in zip(starts, stops)], dtype=np.uint64)
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), _CHUNK):
        part = hashes[i:i + _CHUNK]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    value = 0
    for bit in np.flatnonzero(counts * 2 > len(hashes)).tolist():
        value |= 1 << bit
    return value - (1 << 64) if value >> 63 else value


def fingerprint_column(text: str | Column = "text", shingle: int = SHINGLE) -> Column:
    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return run(utf8(text))


def hex16(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _byte(c: str, p: int) -> Column:
    return F.shiftrightunsigned(F.col(c), 8 * p).bitwiseAND(F.lit(255))


def _keys(max_bits: int) -> list[tuple[int, ...]]:
    """Byte positions of every index key: each pair of the `max_bits + 2` position groups."""
    groups = np.array_split(np.arange(8), max_bits + 2)
    return [tuple(int(p) for p in np.concatenate(pair)) for pair in combinations(groups, 2)]


def shared_bytes(a: str, b: str) -> Column:
    """Tally of positions at which the two fingerprints hold the same byte."""
    return sum((_byte(a, p) == _byte(b, p)).cast("int") for p in range(8))


def links(fps: DataFrame, max_bits: int = MAX_BITS, dense: int = DENSE) -> DataFrame:
    """Edges (a, b) between distinct fingerprints `fps(fp)` that connect exactly what links of
    at most `max_bits` (1 or 2) bits connect; every edge is such a link."""
    if max_bits not in (1, 2):
        raise ValueError("max_bits must be 1 or 2")
    keys = _keys(max_bits)
    index = stage(fps.select("fp", F.posexplode(F.array(*[
        sum(F.shiftleft(_byte("fp", p), 8 * i) for i, p in enumerate(ps)) for ps in keys])).alias("j", "key")))
    sizes = index.groupBy("j", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = stage(index.join(sizes, ["j", "key"]))
    light = (met.where(F.col("n") <= dense).groupBy("j", "key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
             .select("fps", F.posexplode("fps").alias("i", "a"))
             .select("a", F.explode(F.slice("fps", F.lit(1), F.col("i"))).alias("b")))
    pairs = (light.where(shared_bytes("a", "b") >= 8 - max_bits)
             .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits))
    bits = [1 << i if i < 63 else -(1 << 63) for i in range(64)]
    heavy = met.where(F.col("n") > dense).select("fp").distinct()
    if max_bits == 2:
        near = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(b)) for b in bits])
    else:  # one differing bit: equal after clearing that bit, filed with the bit's number
        near = F.array(*[F.col("fp").bitwiseAND(F.lit(~b)) for b in bits])
    filed = heavy.select("fp", F.posexplode(near).alias("bit", "at"))
    place = ["at"] if max_bits == 2 else ["at", "bit"]
    # Stars over the places where at least two meet. A place of the linear form holds at most 65 fingerprints.
    star = (filed.groupBy(*place).agg(F.sort_array(F.collect_list("fp")).alias("fps")).where(F.size("fps") > 1)
            .select(F.explode(F.slice("fps", F.lit(2), F.size("fps"))).alias("a"), F.col("fps")[0].alias("b"))
            .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits))
    return pairs.select("a", "b").union(star)


def components(docs: DataFrame, max_bits: int = MAX_BITS, shingle: int = SHINGLE, extra: list[Column] | None = None) -> DataFrame:
    """One row per input row: doc_id, fp (long), component_id (smallest reachable doc_id), and `extra` columns."""
    prints = stage(docs.select("doc_id", fingerprint_column("text", shingle).alias("fp"), *(extra or [])))
    distinct = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = connected_components(links(distinct.select("fp"), max_bits))
    rooted = (distinct.join(roots, distinct.fp == roots.node, "left")
              .select("fp", "first_id", F.coalesce("root", "fp").alias("root")))
    names = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_print = stage(rooted.join(names, "root").select("fp", "component_id", "root"))
    return prints.join(by_print, "fp")


def keep_one(docs: DataFrame, max_bits: int = MAX_BITS, shingle: int = SHINGLE) -> DataFrame:
    """One row of each component stays: the smallest doc_id (nulls last), then the smallest row hash.

    The deciding columns are those of each row; of fully equal rows one is kept.
    """
    cols = docs.columns
    row_hash = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in cols])))
    found = components(docs, max_bits, shingle, [row_hash.alias("row_hash")])
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), F.col("row_hash").alias("row_hash"))
    # not grouped by fingerprint: that would tie the aggregate to the join's partitions and keep AQE from splitting hot ones
    best = stage(found.groupBy("root", "doc_id", "row_hash").agg(F.count(F.lit(1)).alias("n"))
                 .groupBy("root").agg(F.min_by(F.struct("doc_id", "row_hash", "n"), order).alias("w")).select("w.*"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), F.col("doc_id").alias("k1"), row_hash.alias("k2"))

    def of(winners: DataFrame) -> DataFrame:
        w = winners.select(F.col("doc_id").alias("w1"), F.col("row_hash").alias("w2"))
        return packed.join(w, packed.k1.eqNullSafe(w.w1) & (packed.k2 == w.w2), "left_semi").select("row.*")

    return of(best.where("n = 1")).union(of(best.where("n > 1")).dropDuplicates())
