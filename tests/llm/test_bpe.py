import base64
import hashlib

import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from chartq.llm import bpe, queries  # noqa: E402

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
ODD = ["<|endoftext|> is text", "don't  stop\n\n  now\t", "漢字 かな 😀👍🏽", "a" * 5000, "  　x", "1234567 12³ ½", "\x00\x01\x7f\u0085", "éé ﬀ", "'S 's'LL'll"]


@pytest.fixture(scope="module")
def judge():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_and_bytes_agree_with_the_other_library(spark, world, make_docs, judge):
    rows = [*world[0], *[(100 + i, t, "odd") for i, t in enumerate(ODD)]]
    coder = bpe.Tokenizer(spark, PATH, PATTERN)
    docs = make_docs(rows).withColumn("ids", F.lit("clash")).withColumn("decoded", F.lit(1))
    found = coder.decode(coder.encode(docs)).select("row.doc_id", "row.text", "row.ids", F.col("ids").alias("own"), "decoded").collect()
    assert len(found) == len(rows)
    for r in found:
        assert r["own"] == judge.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
        assert r["ids"] == "clash"


def test_every_token_is_encoded_as_itself():
    ranks = bpe.read_ranks(PATH)
    encoder = bpe.Encoder(bpe.serialise(ranks), PATTERN)
    tokens = sorted(ranks, key=ranks.get)
    mapped = ["".join(encoder.map[b] for b in t) for t in tokens]
    assert encoder.pieces.encode(mapped) == [[i] for i in range(len(tokens))]
    assert bpe.token_bytes(bpe.serialise(ranks))[:len(tokens)] == tokens


def test_cached_pieces_do_not_change_ids(monkeypatch, judge):
    monkeypatch.setattr(bpe, "CACHED", 3)
    monkeypatch.setattr(bpe, "CACHED_CHARS", 2)
    encoder = bpe.Encoder(bpe.serialise(bpe.read_ranks(PATH)), PATTERN)
    plain = bpe.Encoder(bpe.serialise(bpe.read_ranks(PATH)), PATTERN, cut=None)
    for t in [*ODD, " ".join(ODD), "  ".join(ODD) + " ", "a \x1c b \u3000c  d\n e"] * 2:
        assert plain.encode(t.encode()).tolist() == judge.encode_ordinary(t)
        assert encoder.encode(t.encode()).tolist() == judge.encode_ordinary(t)


def test_a_vocabulary_with_gaps_and_a_bad_one(tmp_path):
    single = [(bytes([b]), 2 * b) for b in range(256)] + [(b"ab", 601)]
    path = tmp_path / "ranks"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % r for t, r in single))
    encoder = bpe.Encoder(bpe.serialise(bpe.read_ranks(str(path))), PATTERN)
    assert encoder.encode("abé".encode()).tolist() == [601, 2 * 0xC3, 2 * 0xA9]
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % r for t, r in single[1:]))
    with pytest.raises(ValueError):
        bpe.read_ranks(str(path))


def test_odd_ids_and_empty_tables(spark, no_docs):
    coder = bpe.Tokenizer(spark, PATH, PATTERN)
    lists = spark.createDataFrame([([64, None, 10 ** 9, -5, 65],), (None,), ([],)], "ids array<int>")
    out = coder.decode(lists).select("decoded", bpe.packed("ids").alias("p")).collect()
    assert [bytes(r["decoded"]) for r in out] == [b"ab", b"", b""]
    assert [len(bytes(r["p"])) for r in out] == [12, 0, 0]
    assert coder.decode(coder.encode(no_docs)).count() == 0


def test_query(spark, judge):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = queries.QUERIES["op11_byte_bpe"](spark, sf).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = judge.encode_ordinary(texts[r["doc_id"]] or "")
        own = hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), own)
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()
