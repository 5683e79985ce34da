import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")

from chartq.llm import alignment, queries  # noqa: E402

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["<|endoftext|> <s></s> <unk>", "▁under", "  two  spaces ", "漢字 かな 😀👍🏽 é", "\x00\x01 \u0085​", "tab\tline\n\nend ", "a" * 3000, "ﬀ ① Å", "the the the", "The the THE", "…"]


@pytest.fixture(scope="module")
def pair():
    a = tokenizers.Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def brute(texts, pair):
    """The contract by loops over tokens: (doc_id, text) to the measures."""
    a, b = pair
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(x): x for x in own} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in own)}
    aligned = []
    for i, text in texts:
        groups, links, n = [], [], (0, 0)
        if text:
            ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            ba = [bytes(chars[c] for c in a.id_to_token(x)) for x in ia]
            bb = [bytes([int(b.id_to_piece(x)[3:5], 16)]) if b.is_byte(x) else b.id_to_piece(x).replace("▁", " ").encode() for x in ib]
            if b"".join(ba) == b"".join(bb) == (" " + text).encode():
                n = len(ia), len(ib)
                at, offset = {}, 0
                for x, t in zip(ib, bb):
                    offset += len(t)
                    at[offset] = x
                left, right, pos_a, pos_b, j = [], [], 0, 0, 0
                for x, t in zip(ia, ba):
                    pos_a += len(t)
                    left.append(x)
                    while j < len(ib) and pos_b < pos_a:
                        pos_b += len(bb[j])
                        right.append(ib[j])
                        j += 1
                    if pos_a in at:
                        links.append((x, at[pos_a]))
                        groups.append((left, right))
                        left, right = [], []
        aligned.append((i, n, groups, links))
    counts = Counter(x for _, _, _, links in aligned for x in links)
    top = {}
    for (_, y), n in counts.items():
        top[y] = max(top.get(y, 0), n)
    out = []
    for i, n, groups, links in aligned:
        told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((i, *n, len(groups), len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links),
                    hashlib.sha256(told.encode()).hexdigest() if n[0] else ""))
    return out, counts


def key(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


@pytest.mark.parametrize("part", [alignment.PART, 400])
def test_agrees_with_loops(spark, world, make_docs, pair, part, monkeypatch):
    monkeypatch.setattr(alignment, "LINKS", 500)
    monkeypatch.setattr(alignment, "ROW", 77)
    rows = [*world[0], *[(100 + i, t, "odd") for i, t in enumerate(ODD)]]
    docs = make_docs(rows).withColumn("digest", F.lit("clash")).withColumn("copies", F.lit(9)).repartition(3)
    found, counts = alignment.align(docs, A, B, part)
    want, pairs = brute([(i, t) for i, t, _ in rows], pair)
    assert key(tuple(r) for r in found.collect()) == key(want)
    assert {(r["a"], r["b"]): r["n"] for r in counts.collect()} == dict(pairs)


def test_texts_that_tokens_do_not_spell_have_none(spark, make_docs):
    rows = {r["doc_id"]: r for r in alignment.align(make_docs([(1, "▁under", "s"), (2, "plain", "s"), (3, "", "s")]), A, B)[0].collect()}
    assert rows[1]["n_a"] == rows[1]["n_groups"] == 0 and rows[1]["groups_sha256"] == ""
    assert rows[2]["n_a"] > 0 and rows[3]["n_b"] == 0


def test_remembered_pieces_do_not_change_ids(pair, monkeypatch):
    monkeypatch.setattr(alignment, "CACHED", 3)
    monkeypatch.setattr(alignment, "CACHED_CHARS", 4)
    with open(A, encoding="utf-8") as a, open(B, "rb") as b:
        aligner = alignment.Aligner(a.read(), b.read())
    texts = [*ODD, " ".join(ODD), "  ".join(ODD) + " ", "a \x1c b \u3000c  d\n e", "", " ", "\n x"]
    for _ in range(2):
        assert [x.tolist() for x in aligner.a_ids([" " + t for t in texts])] == [pair[0].encode(" " + t, add_special_tokens=False).ids for t in texts]


def test_no_rows(no_docs):
    found, counts = alignment.align(no_docs, A, B)
    assert found.count() == counts.count() == 0


def test_a_text_shared_by_many_documents_is_aligned_once(spark, make_docs, pair):
    rows = [(i, "one shared text, again and again", "s") for i in range(300)] + [(1000, "one other", "s")]
    found, _ = alignment.align(make_docs(rows).repartition(5), A, B)
    assert key(tuple(r) for r in found.collect()) == key(brute([(i, t) for i, t, _ in rows], pair)[0])


def test_query(spark, pair):
    sf = "/root/testdata/sf0.001"
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found = queries.QUERIES["op13_token_alignment"](spark, sf)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert key(tuple(r) for r in found.collect()) == key(brute(texts, pair)[0])
