"""Cross-tokenizer alignment: how the tokens of two tokenizers cover the same bytes, counted over a corpus.

Tokenizer A is a byte-level BPE file of the `tokenizers` library and reads a space and the text; tokenizer B is a sentencepiece
model, which adds that space itself. Byte offsets at which tokens of both end cut the bytes into groups; two tokens whose byte
ranges end together are linked. An id pair's count is the number of its links in the corpus.

Exact-text deduplication: documents are shuffled by their full text (pre-aggregated, so copies meet before the shuffle) and each
distinct text is tokenised and aligned once. The same pass adds up its id pairs, weighted by the text's multiplicity, in runs
of bounded size, and what is left per run is shuffled by pair. The counts come back to the texts by a lookup in the sorted pairs, in
parts of at most `PART` pairs, each broadcast and held against the texts in one pass; a pair that nearly every text has is thus
no join key. At last the measures of a text are joined to the doc_ids of its copies by the text's digest (SHA-256 and length);
a text that a third of all rows share is one row on the measured side, and the join's skewed side is split by AQE.

Edge cases: a null or empty text has no tokens (all measures 0, no groups), and so has one whose tokens do not spell the space and
the text again (an U+2581 in the text, characters that a normalisation changes, invalid UTF-8); such rows need no join. Repeated rows
are separate documents with equal measures, each counted; pairs that tie for a B id's highest count are all best; very
long texts are aligned whole; a null doc_id is kept; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartq.llm.bpe import CUT, byte_characters
from chartq.llm.common import stage, utf8

PART = 2_000_000       # id pairs of one broadcast: 17 bytes each
LINKS = 2_000_000      # links whose pairs a task adds up before it hands them on
ROW = 50_000           # pairs of one row
SLICE = 4 << 20        # bytes of text tokenised at a time
CACHED = 250_000       # pieces of text whose ids (A) a task remembers
CACHED_CHARS = 64      # the longest piece that is remembered
JOINED = 5_000         # pieces encoded as one text

MEASURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
_ALIGNED = ("digest binary, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
            "a array<int>, b array<int>, times array<long>")


class Aligner:
    """Both tokenizers with the bytes and decimal forms of their ids."""

    def __init__(self, a_json: str, b_model: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")   # a Spark task has one core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=b_model)
        back = {c: b for b, c in enumerate(byte_characters())}
        entries = self.a.get_vocab(with_added_tokens=True)
        a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            a_bytes[i] = bytes(back[c] for c in entry) if all(c in back for c in entry) else entry.encode()
        b = self.b
        b_bytes = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
                   for i in range(b.get_piece_size())]
        tables = (a_bytes, b_bytes)
        self.sizes = [np.fromiter(map(len, table), np.int64, len(table)) for table in tables]
        self.starts = [np.cumsum(size) - size for size in self.sizes]
        self.flat = [np.frombuffer(b"".join(table), np.uint8) for table in tables]
        self.cut = re.compile(CUT).split
        self.known: dict[str, bytes] = {}
        # an id's decimal form and what follows it: inside a group of a side, and at its end
        self.forms = [f"{i}{e}" for table, ends in ((a_bytes, ",|"), (b_bytes, ",;")) for e in ends for i in range(len(table))]

    def a_ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of A. Byte-level splitting always cuts at a space before a visible character, so what lies between such spaces is
        encoded once and remembered; that changes no id."""
        if len(self.known) > CACHED:
            self.known.clear()
        cut = [self.cut(t) for t in texts]
        fresh = sorted({p for _, *rest in cut for p in rest}.difference(self.known))
        own = dict(self._encoded(fresh))
        self.known.update((p, ids) for p, ids in own.items() if len(p) <= CACHED_CHARS)
        get = {p: ids for p, ids in own.items() if len(p) > CACHED_CHARS}.get
        find = self.known.get
        heads = [self._one(head) if head else b"" for head, *_ in cut]
        return [np.frombuffer(head + b"".join([find(p) or get(p) for p in rest]), np.int32) for head, (_, *rest) in zip(heads, cut)]

    def _one(self, text: str) -> bytes:
        return np.array(self.a.encode(text, add_special_tokens=False).ids, np.int32).tobytes()

    def _encoded(self, pieces: list[str]) -> Iterator[tuple[str, bytes]]:
        """Each piece with the ids of a space and the piece. Many are encoded as one text, whose ids are cut by their bytes."""
        for i in range(0, len(pieces), JOINED):
            part = pieces[i:i + JOINED]
            ids = np.frombuffer(self._one("".join([" " + p for p in part])), np.int32)
            ends = np.cumsum(self.sizes[0][ids])
            at = np.searchsorted(ends, np.cumsum([1 + len(p.encode()) for p in part])) + 1
            yield from ((p, ids[a:b].tobytes()) for p, a, b in zip(part, [0, *at[:-1].tolist()], at.tolist()))

    def ids(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(a.astype(np.int64), np.array(b, np.int64)) for a, b in zip(self.a_ids([" " + t for t in texts]), self.b.encode(texts, num_threads=1))]

    def spell(self, side: int, ids: np.ndarray) -> bytes:
        """The bytes of a run of ids, gathered from the bytes of all ids."""
        size, start = self.sizes[side][ids], self.starts[side][ids]
        ends = np.cumsum(size)
        return self.flat[side][np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)].tobytes()

    def align(self, text: bytes, ids: tuple[np.ndarray, np.ndarray]) -> tuple[int, str, np.ndarray, np.ndarray] | None:
        """Number of groups, the groups as text and the linked tokens' ids; None where the tokens do not spell the text."""
        whole = b" " + text
        if any(self.spell(side, own) != whole for side, own in enumerate(ids)):
            return None
        ends = [np.cumsum(size[own]) for size, own in zip(self.sizes, ids)]
        shared, *at = np.intersect1d(*ends, assume_unique=True, return_indices=True)   # every token has bytes, so ends differ
        codes, group, offset = [], [], 0
        for size, own, end, last in zip(self.sizes, ids, ends, at):
            code = own + offset
            code[last] += len(size)
            codes.append(code)
            group.append(2 * np.searchsorted(shared, end) + (offset > 0))
            offset += 2 * len(size)
        order = np.argsort(np.concatenate(group), kind="stable")
        told = "".join(map(self.forms.__getitem__, np.concatenate(codes)[order].tolist()))
        return len(shared), told[:-1], ids[0][at[0]], ids[1][at[1]]


class _Tally:
    """Weighted counts of id pairs, added up whenever `LINKS` of them have gathered."""

    def __init__(self):
        self.keys, self.times, self.size = [], [], 0

    def add(self, keys: np.ndarray, times: np.ndarray) -> None:
        self.keys.append(keys)
        self.times.append(times)
        self.size += len(keys)

    def add_up(self) -> int:
        """The number of distinct pairs left."""
        if self.keys:
            keys, at = np.unique(np.concatenate(self.keys), return_inverse=True)
            times = np.zeros(len(keys), np.int64)
            np.add.at(times, at, np.concatenate(self.times))
            self.keys, self.times, self.size = [keys], [times], len(keys)
        return self.size

    def take(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs, a bounded number at a time."""
        if self.add_up():
            keys, times = self.keys[0], self.times[0]
            for i in range(0, len(keys), ROW):
                yield keys[i:i + ROW], times[i:i + ROW]
        self.keys, self.times, self.size = [], [], 0


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64)).cast(kind))


def _align(held):
    """Rows (text, copies) to one row per text, and rows without a digest that hold a run's added-up pairs."""
    def rows_of(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) if out else [[] for _ in range(10)]
        kinds = [pa.binary(), *[pa.int64()] * 5, pa.string()]
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
        arrays += [_lists(list(columns[7]), pa.int32()), _lists(list(columns[8]), pa.int32()), _lists(list(columns[9]), pa.int64())]
        return pa.record_batch(arrays, ["digest", "copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a", "b", "times"])

    def pairs(tally: _Tally) -> list[tuple]:
        return [(*[None] * 7, keys >> 32, keys & 0xFFFFFFFF, times) for keys, times in tally.take()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, tally, none = Aligner(*held.value), _Tally(), np.zeros(0, np.int64)
        for batch in batches:
            texts, copies = batch["t"], batch["copies"].to_pylist()
            start = 0
            while start < len(texts):
                stop, size = start, 0
                while stop < len(texts) and size < SLICE:
                    size += len(texts[stop].as_buffer())
                    stop += 1
                raw = texts.slice(start, stop - start).to_pylist()
                said = [t.decode("utf-8", "replace") for t in raw]
                out = []
                for t, n, ids in zip(raw, copies[start:stop], aligner.ids(said)):
                    digest = hashlib.sha256(t).digest() + len(t).to_bytes(8, "big")
                    found = aligner.align(t, ids)
                    if found is None:
                        out.append((digest, n, 0, 0, 0, 0, "", none, none, none))
                        continue
                    groups, told, a, b = found
                    keys, times = np.unique(a << 32 | b, return_counts=True)
                    tally.add(keys, times * n)
                    own = (digest, n, len(ids[0]), len(ids[1]), groups, len(a), hashlib.sha256(told.encode()).hexdigest(),
                           keys >> 32, keys & 0xFFFFFFFF, times)
                    out.append(own)
                if tally.size > LINKS and tally.add_up() > LINKS // 2:
                    out += pairs(tally)
                yield rows_of(out)
                start = stop
        yield rows_of(pairs(tally))

    return run


def _lookup(held):
    """What the pairs of one part add to a text's sums: links that are best, counts of all links."""
    @F.arrow_udf("struct<n_best:long,count_sum:long>")
    def look(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        keys, counts, best = held.value
        for a, b, times in columns:
            own = a.flatten().to_numpy().astype(np.int64) << 32 | b.flatten().to_numpy().astype(np.int64)
            n = times.flatten().to_numpy()
            at = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
            here = (keys[at] == own) if len(keys) else np.zeros(len(own), bool)
            row = np.repeat(np.arange(len(a)), np.asarray(a.value_lengths().fill_null(0)))
            sums = []
            for value in (best, counts):
                total = np.zeros(len(a), np.int64)
                np.add.at(total, row[here], n[here] * value[at[here]])
                sums.append(pa.array(total))
            yield pa.StructArray.from_arrays(sums, ["n_best", "count_sum"])

    return look


def pair_counts(aligned: DataFrame) -> DataFrame:
    """a, b, n (links in the corpus) and best (n is the highest of this b) of every linked id pair."""
    runs = aligned.where("digest is null").select(F.explode(F.arrays_zip("a", "b", "times")).alias("p"))
    counts = stage(runs.groupBy("p.a", "p.b").agg(F.sum("p.times").alias("n")))
    top = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(top, "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, a_file: str, b_file: str, part: int = PART) -> tuple[DataFrame, DataFrame]:
    """Per document doc_id, the `MEASURES` and groups_sha256; and the corpus' id pairs with their counts."""
    spark = docs.sparkSession
    with open(a_file, encoding="utf-8") as a, open(b_file, "rb") as b:
        held = spark.sparkContext.broadcast((a.read(), b.read()))
    texts = utf8("text")
    distinct = docs.select(texts.alias("t")).where(F.length("t") > 0).groupBy("t").agg(F.count(F.lit(1)).alias("copies"))
    aligned = stage(distinct.mapInArrow(_align(held), _ALIGNED))
    counts = stage(pair_counts(aligned))
    measured = aligned.where("digest is not null").withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})
    parts = max(1, -(-counts.count() // part))
    for i in range(parts):
        found = _lookup(_part(spark, counts, i, parts))("a", "b", "times")
        measured = measured.withColumn("found", found).withColumns(
            {c: F.col(c) + F.col(f"found.{c}") for c in ("n_best", "count_sum")}).drop("found")
        measured = stage(measured if i + 1 < parts else measured.select("digest", *MEASURES, "groups_sha256"))
    # no text, no tokens: such rows need no join, and would all share one key
    size = F.length(texts)
    key = F.concat(F.unhex(F.sha2(texts, 256)), F.unhex(F.lpad(F.hex(size.cast("long")), 16, "0"))).alias("digest")
    joined = docs.where(size > 0).select("doc_id", key).join(measured, "digest").select("doc_id", *MEASURES, "groups_sha256")
    bare = docs.where(size == 0).select("doc_id", *[F.lit(0).cast("long").alias(c) for c in MEASURES], F.lit("").alias("groups_sha256"))
    return joined.union(bare), counts


def _part(spark: SparkSession, counts: DataFrame, i: int, parts: int):
    """The pairs that a hash deals to part i as broadcast arrays, sorted by key."""
    rows = counts.where(F.pmod(F.xxhash64("a", "b"), F.lit(parts)) == i).toArrow()
    keys = rows["a"].to_numpy().astype(np.int64) << 32 | rows["b"].to_numpy().astype(np.int64)
    order = np.argsort(keys)
    return spark.sparkContext.broadcast((keys[order], rows["n"].to_numpy()[order], rows["best"].to_numpy().astype(bool)[order]))
