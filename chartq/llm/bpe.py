"""Byte-level BPE encoding and decoding with a sentencepiece BPE model serialised directly from a rank vocabulary.

The rank file (a base64 token and its rank per line) becomes a sentencepiece model without any training: byte b of a token
is written as one visible character, the token as the piece of these characters, its score is its negative rank, and
normalisation is the identity. Sentencepiece merges the adjacent pair with the highest score first, the leftmost on
ties, so a piece of text is merged in rank order, as byte-level BPE does. A whole text is cut into pre-tokens by the split
pattern; each pre-token is byte-mapped and encoded by itself. Decoding maps ids to pieces and their characters back to bytes.

The model (about as large as the vocabulary file) is the only thing broadcast; texts are encoded where they are, in one
pass without a shuffle. Ids of pieces of text met before are kept in a table of bounded size, which changes no result.

Edge cases: a null text is empty and has no ids; invalid UTF-8 is read with U+FFFD in its place; strings of special
tokens are ordinary text; a rank that no token has is a piece that never occurs; a vocabulary without all 256 bytes, or with
a token twice, is an error; ids unknown to the vocabulary (and nulls) decode to no bytes; a null list of ids decodes to
empty bytes; repeated rows are separate rows, ties between equal pairs go to the left, very long texts and pre-tokens are
encoded whole; an empty table gives an empty result; other columns travel inside the struct `row`, so no name clashes.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartq.llm.common import utf8

CACHED = 400_000      # pieces of text whose ids a task remembers
CACHED_CHARS = 64     # the longest piece that is remembered
AT_ONCE = 1 << 20     # ids whose bytes are put together at a time
# Before a space with a visible character behind it the split pattern always starts a new pre-token.
CUT = r" (?=\S)"


def byte_characters() -> list[str]:
    """The visible character of every byte: printable Latin-1 bytes are themselves, the others follow from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
    if len(ranks) < len(pairs) or len(set(ranks.values())) < len(pairs):
        raise ValueError(f"{path}: a token or a rank occurs twice")
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError(f"{path}: the vocabulary lacks single bytes")
    return ranks


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model whose ids are the ranks; the unknown piece, which never occurs, comes after them."""
    from sentencepiece import sentencepiece_model_pb2

    chars = byte_characters()
    model = sentencepiece_model_pb2.ModelProto()
    kinds = model.SentencePiece
    by_rank = {rank: token for token, rank in ranks.items()}
    size = max(by_rank) + 1
    for rank in range(size):
        token = by_rank.get(rank)
        if token is None:     # U+E000 is no byte's character
            model.pieces.add(piece=f"\ue000{rank}", score=0.0, type=kinds.UNUSED)
        else:
            model.pieces.add(piece="".join(chars[b] for b in token), score=-float(rank), type=kinds.NORMAL)
    model.pieces.add(piece="unk", score=0.0, type=kinds.UNKNOWN)
    trainer = model.trainer_spec
    trainer.model_type, trainer.vocab_size = trainer.BPE, size + 1
    trainer.unk_id, trainer.bos_id, trainer.eos_id, trainer.pad_id = size, -1, -1, -1
    trainer.unk_piece = "unk"
    norm = model.normalizer_spec
    norm.name = "identity"
    norm.add_dummy_prefix = norm.remove_extra_whitespaces = norm.escape_whitespaces = False
    return model.SerializeToString()


class _Known(dict):
    """What `make` makes of a piece of text, made when first asked for; long pieces are not kept."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, piece: str) -> bytes:
        made = self.make(piece)
        if len(piece) <= CACHED_CHARS:
            self[piece] = made
        return made


class Encoder:
    """Text to ids (as 32-bit integers) by a serialised model and a split pattern.

    Text is first cut at the spaces where `cut` matches. The ids of what lies between them, and of each pre-token, are
    remembered, as both repeat a lot. Without `cut` whole texts are split."""

    def __init__(self, model: bytes, pattern: str, cut: str | None = CUT):
        import regex
        from sentencepiece import SentencePieceProcessor

        self.split = regex.compile(pattern).findall
        self.cut = re.compile(cut).split if cut else lambda text: [text]
        self.pieces = SentencePieceProcessor(model_proto=model)
        self.map = dict(enumerate(byte_characters()))
        self.merged = _Known(self.merge)
        self.known = _Known(lambda piece: self.code(" " + piece))

    def merge(self, pre_token: str) -> bytes:
        return array("i", self.pieces.encode(pre_token.encode().decode("latin-1").translate(self.map))).tobytes()

    def code(self, text: str) -> bytes:
        return b"".join(map(self.merged.__getitem__, self.split(text)))

    def encode(self, text: bytes) -> np.ndarray:
        for known in (self.known, self.merged):
            if len(known) > CACHED:
                known.clear()
        first, *rest = self.cut(text.decode("utf-8", "replace"))
        return np.frombuffer(self.code(first) + b"".join(map(self.known.__getitem__, rest)), np.int32)


def token_bytes(model: bytes) -> list[bytes]:
    """The bytes of every id: the inverse of the byte mapping; pieces that never occur have none."""
    from sentencepiece import SentencePieceProcessor

    pieces = SentencePieceProcessor(model_proto=model)
    back = {c: b for b, c in enumerate(byte_characters())}
    texts = [pieces.id_to_piece(i) for i in range(pieces.get_piece_size())]
    return [bytes(back[c] for c in t) if all(c in back for c in t) else b"" for t in texts]


class Decoder:
    """Ids to bytes: the bytes of all ids lie one after the other, and those of a run of ids are gathered at once."""

    def __init__(self, model: bytes):
        table = token_bytes(model)
        self.size = np.fromiter(map(len, table), np.int64, len(table))
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(table), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        out = []
        for i in range(0, len(ids), AT_ONCE):
            part = ids[i:i + AT_ONCE]
            part = part[(part >= 0) & (part < len(self.size))]
            size = self.size[part]
            ends = np.cumsum(size)
            at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[part] - ends + size, size)
            out.append(self.flat[at].tobytes())
        return b"".join(out)


def _rows(ids: pa.Array) -> Iterator[np.ndarray]:
    """Every list of ids (none where it is null), with -1 for nulls."""
    values = ids.values.fill_null(-1).to_numpy(zero_copy_only=False)
    ends = ids.offsets.to_numpy()
    for a, b, there in zip(ends[:-1].tolist(), ends[1:].tolist(), ids.is_valid().to_pylist()):
        yield values[a:b] if there else values[:0]


class Tokenizer:
    """A byte-level BPE tokenizer of a rank file as Column functions."""

    def __init__(self, spark: SparkSession, vocabulary: str, pattern: str):
        self.model = spark.sparkContext.broadcast(serialise(read_ranks(vocabulary)))
        self.pattern = pattern

    def ids(self, text: Column) -> Column:
        """The ids (array<int>) of a text given as UTF-8 bytes."""
        held, pattern = self.model, self.pattern

        @F.arrow_udf("array<int>")
        def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            encoder = Encoder(held.value, pattern)
            for batch in batches:
                ids = [encoder.encode(t.as_py() or b"") for t in batch]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)])))

        return encode(text)

    def decoded(self, ids: Column) -> Column:
        """The bytes that a list of ids stands for."""
        held = self.model

        @F.arrow_udf("binary")
        def decode(lists: pa.Array) -> pa.Array:
            decoder = Decoder(held.value)
            return pa.array([decoder.decode(row) for row in _rows(lists)], pa.binary())

        return decode(ids)

    def encode(self, docs: DataFrame) -> DataFrame:
        """Every input row as struct `row`, with the `ids` of its whole text."""
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        return docs.select(row.alias("row"), self.ids(utf8("text")).alias("ids"))

    def decode(self, encoded: DataFrame) -> DataFrame:
        """The rows of `encode` with the bytes of their ids as `decoded`."""
        return encoded.select("*", self.decoded(F.col("ids")).alias("decoded"))


@F.arrow_udf(T.BinaryType())
def packed(ids: pa.Array) -> pa.Array:
    """Ids as little-endian unsigned 32-bit integers, the form of token files. Nulls in a list are left out, a null list is empty."""
    return pa.array([row[row >= 0].astype("<u4").tobytes() for row in _rows(ids)], pa.binary())
