"""Substring dedup by repeated-phrase automata.

Recurring windows of `WINDOW` words are confirmed in shards of the corpus that hold all open occurrences of an anchor
(see `recurrence`); the maximal recurring passages of a shard are compiled into one Aho-Corasick automaton over word
numbers (pyahocorasick), and everything routed to the shard is streamed through it to locate each occurrence.
Windows are judged on the input; every word covered by a recurring window goes.

Edge cases: null and empty texts and texts shorter than a window keep all their words; copies lose all
windows; self-repeating texts count their own windows; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartq.llm import recurrence

WINDOW = 35
GRAM = 8
UNITS = recurrence.Units(words=True, length=WINDOW, gram=GRAM)


def resolver(length: int):
    def resolve(rows: pd.DataFrame) -> pd.DataFrame:
        number: dict[bytes, int] = {}
        seqs = [tuple(number.setdefault(w, len(number)) for w in ctx.split(b" ")) for ctx in rows["ctx"]]
        count: Counter = Counter()
        for seq, kind in zip(seqs, rows["kind"]):
            for i in range(len(seq) - length + 1):
                count[seq[i:i + length]] += int(kind)        # a witness stands for two or more
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for seq, kind in zip(seqs, rows["kind"]):
            if kind != 1:
                continue
            again = np.array([count[seq[i:i + length]] > 1 for i in range(len(seq) - length + 1)], dtype=np.int8)
            for a, b in np.flatnonzero(np.diff(np.concatenate(([0], again, [0])))).reshape(-1, 2).tolist():
                automaton.add_word(seq[a:b - 1 + length], b - 1 + length - a)
        flags = [np.zeros(len(seq) - length + 1, dtype=bool) for seq in seqs]
        if len(automaton):
            automaton.make_automaton()
            for seq, kind, f in zip(seqs, rows["kind"], flags):
                if kind == 1:
                    for end, size in automaton.iter(seq):
                        f[end - size + 1:end - length + 2] = True
        return recurrence.flags_to_ranges(rows, flags, length)

    return resolve


def dedup(docs: DataFrame, length: int = WINDOW, gram: int = GRAM, dense: int = recurrence.DENSE, texts: bool = True) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, `kept` (text; null where nothing was removed, and
    everywhere without `texts`)."""
    units = recurrence.Units(words=True, length=length, gram=gram)
    plain, marked = recurrence.covered(docs, units, resolver(length), dense)

    def cut(batches):
        for batch in recurrence.slices(batches):
            out = []
            for doc_id, text, first, last in zip(batch["doc_id"], batch["t"], batch["first"], batch["last"]):
                words = text.split()
                gone = recurrence.mask(first, last, len(words))
                kept = b" ".join(w for w, g in zip(words, gone.tolist()) if not g)
                out.append((doc_id, len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if texts else None))
            yield pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]).astype({"doc_id": object})

    kind = docs.schema["doc_id"].dataType.simpleString()
    done = marked.mapInPandas(cut, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept string")
    rest = plain.select("doc_id", F.col("n").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"),
                        F.lit(None).cast("string").alias("kept"))
    return done.union(rest)
